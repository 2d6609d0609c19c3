"""Column functions on a line and its matches.  Offsets and columns are in bytes."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from ..plans.dialect import Pattern
from ..plans.spec import SearchSpec

SPAN = ArrayType(StructType().add("match", StringType()).add("start", IntegerType()).add("end", IntegerType()))
#: White space in the Unicode sense, of the line's end or beginning.
_RIGHT, _LEFT = r"(?U)\s+\z", r"(?U)\A\s+"


def lines_of(text: Column) -> Column:
    """The pieces between line feeds; one more than there are line feeds, so a last line feed leaves an empty line."""
    return F.split(text, "\n", -1)


@F.arrow_udf(ArrayType(LongType()))
def line_offsets(text: pa.Array) -> pa.Array:
    """Byte offset of each line's start.  Null gives null."""
    out, ends, valid = [], [0], []
    for v in text:
        valid.append(v.is_valid)
        data = np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8)
        starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1]) if v.is_valid else np.zeros(0, np.int64)
        out.append(starts)
        ends.append(ends[-1] + len(starts))
    mask = None if all(valid) else pa.array([not v for v in valid])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)), mask=mask)


def matches(line: Column, spec: SearchSpec) -> Column:
    """Whether the line has a match, before inversion; a plain string needs no regular expression."""
    if spec.literal is not None:
        return line == spec.literal if spec.line else F.contains(line, F.lit(spec.literal))
    return _having(line, spec, line.rlike(spec.compiled.java), F.lit(False))


def _having(line: Column, spec: SearchSpec, value: Column, other: Column) -> Column:
    """value for lines that hold a literal which every match needs, other for the rest: a plain test saves the regular expression."""
    return F.when(F.contains(line, F.lit(spec.needed[0])), value).otherwise(other) if spec.needed else value


def hit(line: Column, spec: SearchSpec) -> Column:
    """Whether the line is selected."""
    return ~matches(line, spec) if spec.invert else matches(line, spec)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row; an expression that a lambda names is evaluated at each of its calls."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(64)
def _finder(python: str):
    return regex.compile(python).finditer


def spans_udf(pattern: Pattern):
    """Arrow function line -> spans, for patterns that may match nothing.

    An empty match right after another match is none.
    """
    python = pattern.python

    @F.arrow_udf(SPAN)
    def spans(line: pa.Array) -> pa.Array:
        find = _finder(python)
        rows = []
        for text in line.to_pylist():
            found, last = [], -1
            if text is None:
                rows.append(None)
                continue
            byte = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) if not text.isascii() else None
            for m in find(text):
                a, b = m.span()
                if a == b == last:
                    continue
                last = b
                found.append({"match": m[0], "start": a if byte is None else int(byte[a]), "end": b if byte is None else int(byte[b])})
            rows.append(found)
        kind = pa.list_(pa.struct([("match", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(rows, kind)

    return spans


@F.arrow_udf(SPAN)
def _laid_out(found: pa.Array, gaps: pa.Array) -> pa.Array:
    """Spans of the matches of a line, whose gaps (one more than matches) lie between and around them."""
    n = np.asarray(pc.fill_null(pc.list_value_length(found), 0)).astype(np.int64)
    texts, between = found.flatten(), gaps.flatten()
    size, gap = (np.asarray(pc.binary_length(x)).astype(np.int64) for x in (texts, between))
    row = np.repeat(np.arange(len(n)), n)
    ends = np.concatenate([[0], np.cumsum(n)])
    before = np.concatenate([[0], np.cumsum(gap)])[np.arange(len(size)) + 1 + row]  # all gaps up to a match, of all rows
    first = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(gaps), 0)))])[:-1]
    lead = np.concatenate([[0], np.cumsum(gap)])[first]
    done = np.concatenate([[0], np.cumsum(size)])
    start = before - lead[row] + done[:-1] - done[ends[:-1]][row]
    rows = pa.StructArray.from_arrays([texts, pa.array(start.astype(np.int32)), pa.array((start + size).astype(np.int32))], ["match", "start", "end"])
    null = np.asarray(found.is_null())
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows, mask=pa.array(null) if null.any() else None)


def spans(line: Column, spec: SearchSpec) -> Column:
    """All matches as (match, start, end).

    Where no match is empty the matches and the gaps between them are found in generated code, and only laid out in Python.
    """
    p = spec.compiled
    if p.may_be_empty:
        return spans_udf(p)(line)
    return _laid_out(F.regexp_extract_all(line, F.lit(p.java), F.lit(0)), F.split(line, p.java, -1))


@F.arrow_udf(ArrayType(StringType()))
def _gaps(line: pa.Array, found: pa.Array) -> pa.Array:
    """The texts before, between and after the spans of a line."""
    out = []
    for text, spans in zip(line, found):
        if not text.is_valid:
            out.append(None)
            continue
        raw, at, parts = text.as_buffer().to_pybytes(), 0, []
        for m in spans.as_py():
            parts.append(raw[at : m["start"]].decode())
            at = m["end"]
        out.append([*parts, raw[at:].decode()])
    return pa.array(out, pa.list_(pa.string()))


def match_count(line: Column, spec: SearchSpec) -> Column:
    """Matches in the line that don't overlap."""
    if spec.compiled.may_be_empty:
        return F.size(spans(line, spec))
    return _having(line, spec, F.regexp_count(line, F.lit(spec.compiled.java)), F.lit(0))


def first_column(line: Column, spec: SearchSpec) -> Column:
    """1-based byte column of the first match; with trim counted from the first character that is shown."""
    if spec.literal is not None:
        at = F.instr(line, spec.literal)
    else:
        at = F.regexp_instr(line, F.lit(spec.compiled.java))
    # regexp_instr gives 0 for an empty match too: then it is found by the text before it
    if spec.compiled.may_be_empty:
        return F.get(spans(line, spec), F.lit(0))["start"] + 1 - _cut(line, spec)
    return F.octet_length(F.substring(line, F.lit(1), at - 1)) + 1 - _cut(line, spec)


def _cut(line: Column, spec: SearchSpec) -> Column:
    return F.octet_length(line) - F.octet_length(trim_left(line)) if spec.trim else F.lit(0)


def trim_right(line: Column) -> Column:
    return F.regexp_replace(line, F.lit(_RIGHT), F.lit(""))


def trim_left(line: Column) -> Column:
    return F.regexp_replace(line, F.lit(_LEFT), F.lit(""))


def replaced(line: Column, spec: SearchSpec) -> Column:
    """The line with every match replaced by the template."""
    p = spec.compiled
    if not p.may_be_empty:
        return F.regexp_replace(line, F.lit(p.java), F.lit(p.template(spec.replace)))
    # gaps and replaced matches, so that an empty match right after another is left alone
    found, template = spans(line, spec), F.lit(p.template(spec.replace))
    new = F.transform(found, lambda m: F.regexp_replace(m["match"], F.lit(r"\A(?:" + p.java + r")\z"), template))
    return F.array_join(F.zip_with(_gaps(line, found), F.array_append(new, F.lit("")), lambda gap, m: F.concat(gap, m)), "")


def shown(line: Column, spec: SearchSpec) -> Column:
    """The text of an output line: replaced, trimmed, and cut or left out if longer than max_columns bytes."""
    trimmed = trim_left(line) if spec.trim else trim_right(line)
    text = replaced(line, spec) if spec.replace is not None else line
    text = trim_left(text) if spec.trim else trim_right(text)
    if spec.max_columns:
        n = spec.max_columns
        if spec.max_columns_preview:
            short = F.concat(F.make_valid_utf8(F.substring(trimmed.cast("binary"), 1, n).cast("string")), F.lit(" [... omitted end of long line]"))
        else:
            short = F.lit("[Omitted long matching line]")
        text = F.when(F.octet_length(trimmed) > n, short).otherwise(text)
    return text


def highlighted(line: Column, spec: SearchSpec, opening: str = "\x1b[1;31m", closing: str = "\x1b[0m") -> Column:
    """The line with each match between two marks."""
    if spec.compiled.may_be_empty:
        return line
    mark = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(line, F.lit(spec.compiled.java), F.lit(f"{mark(opening)}$0{mark(closing)}"))
