"""The library's surface: build_index, search, search_records, index_status, clear_index, type_list."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import index as I
from .operators import search as S
from .plans.spec import SearchSpec
from .sources import corpus as C
from .sources import filters
from .storage import work_dir

#: search_records returns at most so many matches by default.
RECORDS = 200


def index_dir_for(spark: SparkSession, root: str) -> str:
    """Where the index of a corpus goes: $LEXSIEVE_INDEX_DIR, else the shared work folder."""
    name = re.sub(r"[^A-Za-z0-9._-]+", "-", root.rstrip("/").rsplit("/", 1)[-1])
    base = os.environ.get("LEXSIEVE_INDEX_DIR") or f"{work_dir(spark)}/index"
    return f"{base}/{hashlib.sha256(root.encode()).hexdigest()[:16]}-{name}"


def git_head(root: str) -> str | None:
    """The commit that a working tree stands on, as a version of the corpus; None outside of one."""
    try:
        with open(os.path.join(root, ".git/HEAD"), encoding="ascii") as f:
            head = f.read().strip()
        if not head.startswith("ref: "):
            return head or None
        ref = head[5:]
        try:
            with open(os.path.join(root, ".git", ref), encoding="ascii") as f:
                return f.read().strip() or None
        except OSError:
            with open(os.path.join(root, ".git/packed-refs"), encoding="ascii") as f:
                return next((line.split()[0] for line in f if line.rstrip().endswith(" " + ref)), None)
    except OSError:
        return None


def build_index(corpus: DataFrame, path: str, force: bool = False, corpus_version: str | None = None, max_bytes: int = C.INDEX_BYTES, store: bool = True) -> dict:
    return I.build(corpus, path, force, max_bytes, corpus_version, store)


def ensure_index(corpus: DataFrame, path: str, corpus_version: str | None = None) -> dict:
    """Build or refresh the index if there is none, or none that can be read, or an old one."""
    try:
        facts = I.facts(corpus.sparkSession, path)
        if not I.is_stale(facts["corpus_version"], corpus_version):
            return facts
        return I.refresh(corpus, path, corpus_version=corpus_version)
    except I.NoIndex:
        return I.build(corpus, path, True, corpus_version=corpus_version)


def _scope(corpus: DataFrame, spec: SearchSpec, index: str | None, current: bool) -> DataFrame:
    docs = I.candidates(corpus, index, spec, current) if index else corpus  # of the whole corpus, as `current` means it
    return filters.documents(docs, spec, size="size" if "size" in docs.columns else None) if "path" in docs.columns else docs


def tree(spark: SparkSession, root: str, spec: SearchSpec, index: str | None = None, text_mode: bool = False, **options) -> DataFrame:
    """The documents of a file tree that may match; files are filtered by path and ruled out by the index before any is read.

    The listing is on the driver, as the walk gives it; options as of sources.corpus.file_tree.
    """
    files = filters.documents(C.listing(spark, root, **options), spec, size="size")
    if index:
        files = I.candidates(files, index, spec)
    return C.file_tree(spark, root, text_mode, only=[r[0] for r in files.select("path").toLocalIterator()], **options)


def search(corpus: DataFrame, spec: SearchSpec, index: str | None = None, mode: str = "lines", current: bool = False) -> DataFrame:
    """Search a corpus; `index` is the folder of its index, if it has one.

    Modes: lines, records (with columns and offsets), submatches, only_matching, passthru, counts, files_with,
    files_without, files, stats, context, json.
    """
    everything = mode in ("passthru", "counts", "files_without", "files", "stats")
    docs = _scope(corpus, spec, None if everything else index, current)
    operators = {"lines": S.match_lines, "records": S.line_records, "submatches": S.submatches, "only_matching": S.only_matching, "passthru": S.passthru, "counts": S.counts, "files_with": S.files_with, "files_without": S.files_without, "stats": S.stats, "context": S.context, "json": S.json_lines}
    if mode == "files":
        return docs.select(*[c for c in ("doc_id", "path") if c in docs.columns])
    if mode not in operators:
        raise ValueError(f"no mode {mode!r}")
    return operators[mode](docs, spec)


def search_records(corpus: DataFrame, pattern: str, index: str | None = None, max_results: int = RECORDS, context_lines: int = 0, **options) -> tuple[DataFrame, DataFrame]:
    """(matches with context, one row of statistics).

    With a limit the search runs here, at most max_results matches come to the driver, and elapsed_ms is its time; without
    one the matches stay a plan, which runs when it is used, and elapsed_ms is that of the statistics.
    """
    began = time.monotonic()
    spec = SearchSpec(pattern, max_results=max_results, context=context_lines, **options)
    scope = _scope(corpus, spec, None, False)
    docs = I.candidates(scope, index, spec) if index else scope
    found = S.context_records(docs, spec)
    if max_results:
        found = corpus.sparkSession.createDataFrame(found.collect(), found.schema)
    total = corpus.select(F.count("*").alias("total_files"))
    stats = S.stats(docs, spec).crossJoin(docs.select(F.count("*").alias("candidates"))).crossJoin(total).first()  # a row each
    row = (stats["total_files"], stats["candidates"], stats["files_searched"], stats["lines_matched"], round((time.monotonic() - began) * 1000, 3))
    return found, corpus.sparkSession.createDataFrame([row], "total_files bigint, candidates bigint, files_searched bigint, matches_found bigint, elapsed_ms double")


def search_response(corpus: DataFrame, pattern: str, index: str | None = None, **options) -> str:
    """search_records as one JSON text: {matches, stats}, or {error}.  At most max_results matches come to the driver."""
    try:
        found, stats = search_records(corpus, pattern, index, **options)
        name = "path" if "path" in found.columns else "doc_id"
        rows = [{"file": str(r[name]), "line": r["line_no"], "text": r["line"], **{k: r[k] for k in ("context_before", "context_after") if r[k]}} for r in found.collect()]
        return json.dumps({"matches": rows, "stats": stats.first().asDict()}, indent=2, ensure_ascii=False)
    except (ValueError, TypeError) as e:
        return json.dumps({"error": str(e)})


def index_status(spark: SparkSession, path: str) -> DataFrame:
    return I.status(spark, path)


def clear_index(spark: SparkSession, path: str) -> bool:
    return I.clear(spark, path)


type_list = filters.type_list
