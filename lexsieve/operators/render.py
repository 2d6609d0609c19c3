"""Text output of search results, in the usual layouts.  Rows come in order to the driver, a partition at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..plans.spec import SearchSpec
from . import search as S

PATH, NUMBER, MATCH, RESET = "\x1b[35m", "\x1b[32m", "\x1b[1;31m", "\x1b[0m"


@dataclass(frozen=True)
class Layout:
    filename: bool = True
    line_number: bool = True
    column: bool = False
    byte_offset: bool = False
    heading: bool = False
    color: bool = False
    null: bool = False  # a NUL instead of a line feed after paths
    separator: str | None = "--"
    vimgrep: bool = False  # forces line numbers


def _prefix(r, layout: Layout, mark: str) -> str:
    paint = (lambda s, c: f"{c}{s}{RESET}") if layout.color else (lambda s, c: s)
    parts = []
    if layout.filename and not layout.heading:
        parts.append(paint(str(r["name"]), PATH))
    if layout.line_number or layout.vimgrep:
        parts.append(paint(str(r["line_no"]), NUMBER))
    for on, name in ((layout.column, "column"), (layout.byte_offset, "byte_offset")):
        if on and r[name] is not None:
            parts.append(str(r[name]))
    return "".join(p + mark for p in parts)


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name", F.col("path" if "path" in rows.columns else "doc_id").cast("string"))


def render_lines(docs: DataFrame, spec: SearchSpec, layout: Layout = Layout()) -> Iterator[str]:
    """Output lines of a search: path:line:column:offset:text, '-' for lines of context, a separator between blocks."""
    if spec.only_matching:
        rows = S.only_matching(docs, spec).withColumn("line", F.col("match")).withColumn("byte_offset", F.lit(None).cast("bigint"))
        rows = rows.withColumns({"is_match": F.lit(True), "block_id": F.lit(0)})
    elif spec.lines_before or spec.lines_after:
        rows = S.context(docs, spec).withColumns({"column": F.lit(None).cast("int"), "byte_offset": F.lit(None).cast("bigint")})
    elif spec.passthru:
        rows = S.passthru(docs, spec).withColumns({"column": F.lit(None).cast("int"), "byte_offset": F.lit(None).cast("bigint"), "block_id": F.lit(0)})
    else:
        rows = S.line_records(docs, spec).withColumns({"is_match": F.lit(True), "block_id": F.lit(0)})
    if layout.color and not spec.invert and spec.replace is None:
        rows = rows.withColumn("line", F.when(F.col("is_match"), T.highlighted(F.col("line"), spec, MATCH, RESET)).otherwise(F.col("line")))
    last = None
    for r in _named(S.ordered(rows, spec)).toLocalIterator():
        here = r["doc_id"], r["block_id"]
        if layout.heading and layout.filename and (last is None or last[0] != here[0]):
            yield f"{PATH}{r['name']}{RESET}" if layout.color else str(r["name"])
        if last is not None and last != here and layout.separator is not None and (spec.lines_before or spec.lines_after):
            yield layout.separator
        last = here
        yield _prefix(r, layout, ":" if r["is_match"] else "-") + r["line"]


def render_counts(docs: DataFrame, spec: SearchSpec, matches: bool = False, filename: bool = True) -> Iterator[str]:
    for r in _named(S.ordered(S.counts(docs, spec), spec)).toLocalIterator():
        n = r["matches"] if matches and not spec.invert else r["hits"]
        yield f"{r['name']}:{n}" if filename else str(n)


def render_paths(rows: DataFrame, null: bool = False, spec: SearchSpec | None = None) -> str:
    end = "\0" if null else "\n"
    rows = S.ordered(rows, spec) if spec else rows
    return "".join(r["name"] + end for r in _named(rows).toLocalIterator())


def render_stats(docs: DataFrame, spec: SearchSpec) -> str:
    r = S.stats(docs, spec).first()
    return "\n".join(f"{r[c]} {c.replace('_', ' ')}" for c in ("matches_found", "lines_matched", "files_matched", "files_searched", "bytes_searched"))


def exit_code(docs: DataFrame, spec: SearchSpec) -> int:
    """0 if there is a match, 1 if not; errors are exceptions (2)."""
    return 0 if S.exists(docs, spec) else 1
