"""The n-gram index: build, append, refresh, compact, status, and pruned search.

An index is a folder of segments, `s-...`, each with Parquet tables

    postings(ngram, block, n, docs, doc_ids)   inverted lists of blocks (runs of documents), in ranges of ngram and sorted:
                                      a row for each n-gram and block, with the places of the n documents, packed to about
                                      a byte each; and a row without ngram for each block, with the doc_ids at the places
    files(doc_id, path, mtime_secs, content_hash)
    texts(doc_id, path, ..., text)    the documents themselves, sorted by doc_id in small row groups (unless store=False)
    gone-.../(doc_id)                 documents of the segment that a later refresh replaced or removed

and the file CURRENT, which names the segments in force, with the n-gram range of each posting file and the n-grams that
very many documents have, so that a search reads only the files it needs and sees without a job when it is no use.

CURRENT is put in place by one atomic rename: a reader sees the old state or the new one, and a failed build changes
nothing.  What a state no longer names is deleted only when it is older than KEEP_SECONDS, so that running readers end in
peace.  Writers take the file LOCK; one that finds it held fails, unless the holder is older than LOCK_SECONDS.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ..functions.grams import bitmap, block_lists, places, posting_blocks, sparse_grams, without
from ..plans import gram_query
from ..plans.spec import SearchSpec
from ..sources.corpus import INDEX_BYTES
from ..storage import Folder
from . import search as S

FORMAT = 2
#: How segments keep their postings; those of another layout aren't read.
LAYOUT = "packed"
CURRENT, LOCK = "CURRENT.json", "LOCK"
KEEP_SECONDS, LOCK_SECONDS = 3600, 6 * 3600
#: Corpora up to this size are spread over all cores before n-grams are extracted, unless their stored texts are read.
SPREAD_BYTES = 1 << 30
#: Text whose postings, or which itself, are sorted by one task: there are as many tasks as the texts need, so that none spills.
PART_BYTES, LEAST_PART_BYTES = 32 << 20, 2 << 20
#: Rows, and bytes of each, that show where to cut the postings into ranges.
CUT_ROWS, CUT_BYTES = 2000, 2048
#: What a row of postings takes besides its list, in bytes.
ROW_WEIGHT = 60
#: Up to so many ids are sent to all tasks; of more, both sides of a join are shuffled.
BROADCAST_ROWS = 1 << 20
#: More segments than this are merged by the next refresh or append.
MOST_SEGMENTS = 8
#: N-grams in at least this share of a segment's documents are named in CURRENT; a document has so many n-grams at most.
COMMON_SHARE = 0.1
#: A pattern that more than this share of the documents may match is searched without the index.
WEAK_SHARE = 0.5
#: Up to so many candidates are looked up by their ids in the stored texts; more are joined.
LISTED = 2000
STORED = ("doc_id", "path", "size", "mtime", "atime", "created", "text")
#: Small row groups and pages of stored texts: a few ids reach few of them.
TEXT_LAYOUT = {"parquet.block.size": 4 << 20, "parquet.page.row.count.limit": 16, "parquet.page.size.row.check.min": 8}


class NoIndex(LookupError):
    """There is no index there, or one of another format."""


class Locked(RuntimeError):
    """Another writer is at work on the index."""


def _prepared(corpus: DataFrame, max_bytes: int) -> DataFrame:
    """(doc_id, path, mtime_secs, content) of the documents that are indexed: with text, not binary, not too large."""
    path = F.col("path") if "path" in corpus.columns else F.col("doc_id").cast("string")
    mtime = F.col("mtime").cast("bigint") if "mtime" in corpus.columns else F.lit(0).cast("bigint")
    return _indexable(corpus, max_bytes).select("doc_id", path.alias("path"), mtime.alias("mtime_secs"), F.col("text").cast("binary").alias("content"))


def _indexable(corpus: DataFrame, max_bytes: int) -> DataFrame:
    return corpus.where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes) & ~F.contains("text", F.lit("\0")))


def _spread(corpus: DataFrame) -> DataFrame:
    """A small corpus over all cores, however few row groups it came in; a large one as it is read."""
    size = int(corpus._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return corpus.repartition(corpus.sparkSession.sparkContext.defaultParallelism * 2) if size <= SPREAD_BYTES else corpus


def _volume(corpus: DataFrame, max_bytes: int) -> tuple[int, int]:
    """Number and bytes of the documents that are indexed."""
    return tuple(_prepared(corpus, max_bytes).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("content").cast("bigint")), F.lit(0))).first())


def _parts(spark: SparkSession, n_bytes: int) -> int:
    return max(1, -(-n_bytes // PART_BYTES), min(spark.sparkContext.defaultParallelism, n_bytes // LEAST_PART_BYTES))


def _cuts(contents: DataFrame, n: int, parts: int) -> np.ndarray:
    """Keys of n-grams that cut the postings of `contents` (content), of n rows, into ranges of about the same size."""
    if parts == 1:
        return np.zeros(0, np.uint64)
    head = F.substring("content", 1, CUT_BYTES).alias("content")
    some = contents.where(F.rand(1) < 1.2 * CUT_ROWS / max(n, 1)).select(head).limit(2 * CUT_ROWS).collect()
    keys, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if some:
        for key, count, _ in block_lists(pa.array([bytes(r[0]) for r in some], pa.binary())):
            keys.append(key)
            weights.append(count + ROW_WEIGHT)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    ends = np.cumsum(weight[order])
    at = np.searchsorted(ends, (np.arange(1, parts) * ends[-1]) // parts) if len(ends) else []
    return np.unique(key[order][at])


def extract_blocks(corpus: DataFrame, max_bytes: int = INDEX_BYTES, cuts: np.ndarray | None = None) -> DataFrame:
    """(part, ngram, block, n, docs, doc_ids): blocks of documents and the lists of their n-grams; see posting_blocks."""
    rows = _prepared(corpus, max_bytes).select("doc_id", "content")
    cuts = np.zeros(0, np.uint64) if cuts is None else cuts
    return rows.mapInArrow(posting_blocks(cuts, uuid.uuid4().hex), f"part int, ngram binary, block bigint, n int, docs binary, doc_ids array<{rows.schema['doc_id'].dataType.simpleString()}>")


def extract(corpus: DataFrame, max_bytes: int = INDEX_BYTES) -> DataFrame:
    """(ngram, doc_id) of all distinct sparse n-grams of each document."""
    return _prepared(_spread(corpus), max_bytes).select(F.explode(sparse_grams("content")).alias("ngram"), "doc_id")


def extracted_counts(corpus: DataFrame, max_bytes: int = INDEX_BYTES) -> DataFrame:
    """(ngram, n): numbers of documents that hold an n-gram, a row for each n-gram and run of documents."""
    return extract_blocks(_spread(corpus), max_bytes).where(F.col("ngram").isNotNull()).select("ngram", "n")


def _files(corpus: DataFrame, max_bytes: int) -> DataFrame:
    return _prepared(corpus, max_bytes).select("doc_id", "path", "mtime_secs", F.xxhash64("content").alias("content_hash"))


@contextmanager
def _writing(folder: Folder):
    """Hold the lock of an index."""
    held = folder.age(LOCK)
    if held is not None and held > LOCK_SECONDS:
        folder.delete(LOCK)
    if not folder.create(LOCK):
        raise Locked(f"{folder.path} is being written; delete {LOCK} if that isn't so")
    try:
        yield
    finally:
        folder.delete(LOCK)


def _new_segment(corpus: DataFrame, folder: Folder, max_bytes: int, store: bool, volume: tuple[int, int] | None = None, name: str | None = None) -> dict:
    """Write a segment of the documents of a corpus; its entry for CURRENT.  volume: their number and bytes, if known."""
    spark, name = corpus.sparkSession, name or f"s-{uuid.uuid4().hex}"
    at = f"{folder.path}/{name}"
    n, size = volume or _volume(corpus, max_bytes)
    parts = _parts(spark, size)
    if store:
        _write_texts(_texts_of(corpus, max_bytes), at, parts)
        corpus = spark.read.parquet(f"{at}/texts")  # read again and again instead of the corpus; evenly cut and in order
    else:
        corpus = _spread(corpus)
    cuts = _cuts(_prepared(corpus, max_bytes).select("content"), n, parts)
    _files(corpus, max_bytes).write.mode("overwrite").parquet(f"{at}/files")
    blocks = extract_blocks(corpus, max_bytes, cuts)
    # n-grams are taken once, and their lists shuffled once, to the range that the task has found for each
    return _write_segment(spark, folder, blocks.repartitionById(len(cuts) + 1, "part").drop("part"), name)


def _write_texts(texts: DataFrame, at: str, parts: int) -> None:
    texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").options(**TEXT_LAYOUT).parquet(f"{at}/texts")


def _write_segment(spark: SparkSession, folder: Folder, rows: DataFrame, name: str) -> dict:
    """Write the postings, in partitions that are ranges of n-grams, of a segment that has its files; its entry for CURRENT."""
    at = f"{folder.path}/{name}"
    # sorted by n-gram: a lookup reads the row groups whose range holds it
    rows.sortWithinPartitions("ngram").write.mode("overwrite").option("parquet.enable.dictionary#docs", "false").parquet(f"{at}/postings")
    n_files = spark.read.parquet(f"{at}/files").count()
    stored = spark.read.parquet(f"{at}/postings")
    lists = stored.where(F.col("ngram").isNotNull())
    grams = lists.groupBy(F.col("_metadata.file_name").alias("file"), "ngram").agg(F.sum("n").alias("n"))
    # the common ones are few, since a document has so many n-grams at most
    common = F.collect_list(F.when(F.col("n") >= COMMON_SHARE * n_files, F.struct(F.hex("ngram").alias("g"), (F.col("n") / n_files).alias("share"))))
    ranges = grams.groupBy("file").agg(F.hex(F.min("ngram")).alias("low"), F.hex(F.max("ngram")).alias("high"), F.count("*").alias("ngrams"), F.sum("n").alias("postings"), common.alias("common")).collect()  # a row for each file
    return {
        "name": name, "layout": LAYOUT, "num_files": n_files, "num_ngrams": sum(r["ngrams"] for r in ranges), "num_postings": sum(r["postings"] for r in ranges), "files": sorted([r["low"], r["high"], r["file"]] for r in ranges),
        "common": {c["g"]: round(c["share"], 4) for r in ranges for c in r["common"]}, "id": stored.schema["doc_ids"].dataType.elementType.simpleString(), "texts": spark.read.parquet(f"{at}/texts").schema.json() if folder.exists(f"{name}/texts") else None, "gone": [],
    }


def _texts_of(corpus: DataFrame, max_bytes: int) -> DataFrame:
    return _indexable(corpus, max_bytes).select(*[c for c in STORED if c in corpus.columns])


def _publish(spark: SparkSession, folder: Folder, segments: list[dict], corpus_version: str | None) -> dict:
    """Put a state in force, and delete what no state has named for a while."""
    n = sum(s["num_files"] - s.get("num_gone", 0) for s in segments)
    now = {"format": FORMAT, "version": uuid.uuid4().hex, "num_files": n, "num_ngrams": _num_ngrams(segments), "corpus_version": corpus_version, "timestamp": int(time.time()), "segments": segments}
    folder.publish(CURRENT, json.dumps(now))
    named = {s["name"] for s in segments}
    for name in folder.names():
        if name.startswith("s-") and name not in named and (folder.age(name) or 0) > KEEP_SECONDS:
            folder.delete(name)
    return now


def _num_ngrams(segments: list[dict]) -> int | None:
    """Distinct n-grams, if that is known without a scan: of one segment as it was written."""
    return segments[0]["num_ngrams"] if len(segments) == 1 and not segments[0]["gone"] else None


def build(corpus: DataFrame, path: str, force: bool = False, max_bytes: int = INDEX_BYTES, corpus_version: str | None = None, store: bool = True) -> dict:
    """Build the index, or refresh it if there is one and `force` isn't set; returns its facts.

    store: whether to keep the texts too, sorted by doc_id, so that a pruned search reads candidates alone.
    """
    spark = corpus.sparkSession
    folder = Folder(spark, path)
    if not force and exists(spark, path):
        try:
            return refresh(corpus, path, max_bytes, corpus_version, store)
        except NoIndex:
            pass
    with _writing(folder):
        return _publish(spark, folder, [_new_segment(corpus, folder, max_bytes, store)], corpus_version)


def exists(spark: SparkSession, path: str) -> bool:
    return Folder(spark, path).exists(CURRENT)


def facts(spark: SparkSession, path: str) -> dict:
    """What CURRENT says."""
    folder = Folder(spark, path)
    try:
        out = json.loads(folder.read(CURRENT))
        ok = out["format"] == FORMAT and all(s["layout"] == LAYOUT for s in out["segments"]) and all(folder.exists(f"{s['name']}/{t}/_SUCCESS") for s in out["segments"] for t in ("postings", "files"))
    except Exception as e:  # unreadable in any way
        raise NoIndex(f"no readable index in {path}") from e
    if not ok:
        raise NoIndex(f"the index in {path} is of another format or not whole")
    return out


def _live(spark: SparkSession, path: str, segment: dict, rows: DataFrame) -> DataFrame:
    """Rows with a doc_id without those of documents that are gone from the segment."""
    for name in segment["gone"]:
        rows = rows.join(spark.read.parquet(f"{path}/{segment['name']}/{name}"), "doc_id", "left_anti")
    return rows


def _blocks(spark: SparkSession, path: str, segment: dict, ngrams: list[bytes] | None = None) -> DataFrame:
    """(ngram, block, n, docs) of a segment as stored, also the row of each block without ngram and docs; of some n-grams
    alone, out of the files whose range holds them."""
    at = f"{path}/{segment['name']}/postings"
    reader = spark.read.schema("ngram binary, block bigint, n int, docs binary")
    if ngrams is None:
        return reader.parquet(at)
    wanted = [g.hex().upper() for g in ngrams]
    files = [f"{at}/{name}" for low, high, name in segment["files"] if any(low <= g <= high for g in wanted)]
    rows = reader.parquet(*files) if files else spark.createDataFrame([], reader.parquet(at).schema)
    return rows.where(F.col("ngram").isin([F.lit(g) for g in ngrams]))


def _block_ids(spark: SparkSession, path: str, segment: dict) -> DataFrame:
    """(block, doc_ids) of a segment: what the places in its lists stand for."""
    rows = spark.read.schema(f"ngram binary, block bigint, doc_ids array<{segment['id']}>").parquet(f"{path}/{segment['name']}/postings")
    return rows.where(F.col("ngram").isNull()).select("block", "doc_ids")


def _named(spark: SparkSession, path: str, segment: dict, rows: DataFrame) -> DataFrame:
    """Rows with a block and `at`, places in it: with a row for each place, which has its doc_id instead."""
    rows = rows.join(_block_ids(spark, path, segment), "block")
    others = [c for c in rows.columns if c not in ("block", "at", "doc_ids")]
    return rows.select(*others, F.explode(F.transform("at", lambda i: F.get("doc_ids", i))).alias("doc_id"))


def _live_blocks(spark: SparkSession, path: str, segment: dict) -> DataFrame:
    """(ngram, block, n, docs) of a segment without the documents that are gone from it, or n-grams that only those had."""
    rows = _blocks(spark, path, segment).where(F.col("ngram").isNotNull())
    if not segment["gone"]:
        return rows
    gone = reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{segment['name']}/{name}") for name in segment["gone"]])
    places_of = _block_ids(spark, path, segment).select("block", F.posexplode("doc_ids").alias("at", "doc_id"))
    dead = places_of.join(gone, "doc_id", "left_semi").groupBy("block").agg(F.collect_list("at").alias("at")).select("block", bitmap("at").alias("dead"))
    # a bit for each document
    rows = rows.join(F.broadcast(dead) if segment["num_files"] <= 32 * BROADCAST_ROWS else dead, "block", "left")
    return rows.select("ngram", "block", without("docs", "dead").alias("left")).select("ngram", "block", "left.n", "left.docs").where(F.col("n") > 0)


def posting_table(spark: SparkSession, path: str) -> DataFrame:
    """(ngram, block, n, docs) of the documents in force: n of a block of documents hold the n-gram, those at the places docs."""
    path = path.rstrip("/")
    return reduce(DataFrame.unionByName, [_live_blocks(spark, path, s) for s in facts(spark, path)["segments"]])


def _postings_of(spark: SparkSession, path: str, segment: dict, lists: DataFrame) -> DataFrame:
    return _live(spark, path, segment, _named(spark, path, segment, lists.select("ngram", "block", places("docs").alias("at"))))


def postings(spark: SparkSession, path: str) -> DataFrame:
    """(ngram, doc_id); a filter on ngram reaches the sorted files."""
    path = path.rstrip("/")
    return reduce(DataFrame.unionByName, [_postings_of(spark, path, s, _blocks(spark, path, s)).select("ngram", "doc_id") for s in facts(spark, path)["segments"]])


def files(spark: SparkSession, path: str) -> DataFrame:
    path = path.rstrip("/")
    return _files_of(spark, path, facts(spark, path)["segments"])


def _files_of(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_live(spark, path, s, spark.read.parquet(f"{path}/{s['name']}/files")) for s in segments])


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): new, modified (another mtime second), unchanged or removed.  A rename is a removal and a new path."""
    a = old.select("path", F.col("mtime_secs").alias("was"), F.lit(True).alias("had"))
    b = new.select("path", F.col("mtime_secs").alias("is"), F.lit(True).alias("has"))
    status = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("is")), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def refresh(corpus: DataFrame, path: str, max_bytes: int = INDEX_BYTES, corpus_version: str | None = None, store: bool = True) -> dict:
    """Bring the index up to date: new and modified documents become a segment, replaced and removed ones are marked gone.

    The postings of unchanged documents aren't touched, until there are more than MOST_SEGMENTS segments.  If nothing
    changed only the corpus version is brought up to date.
    """
    spark = corpus.sparkSession
    folder, path = Folder(spark, path), path.rstrip("/")
    with _writing(folder):
        before, name = facts(spark, path), f"s-{uuid.uuid4().hex}"
        # the keys of the corpus, so that its texts aren't read for each comparison
        _prepared(corpus, max_bytes).select("doc_id", "path", "mtime_secs", F.octet_length("content").cast("bigint").alias("bytes")).write.parquet(f"{path}/{name}/keys")
        new = spark.read.parquet(f"{path}/{name}/keys")
        old = _files_of(spark, path, before["segments"])
        found = {r["status"]: r["n"] for r in changes(old, new).groupBy("status").agg(F.count("*").alias("n")).collect()}
        if set(found) <= {"unchanged"}:
            now = {**before, "corpus_version": corpus_version}
            folder.publish(CURRENT, json.dumps(now))
            folder.delete(name)
            return now
        # a document is unchanged if path, mtime and id are
        fresh = new.join(old, ["doc_id", "path", "mtime_secs"], "left_anti")
        volume = tuple(fresh.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first())
        segments = [_without(spark, path, s, new) for s in before["segments"]]
        segment = _new_segment(_only(corpus, fresh, volume[0]), folder, max_bytes, store, volume, name)
        folder.delete(f"{name}/keys")
        return _publish(spark, folder, _merged(spark, folder, [*segments, segment]), corpus_version)


def _only(corpus: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The documents of a corpus whose doc_id, path and mtime are among n keys."""
    path = F.col("path") if "path" in corpus.columns else F.col("doc_id").cast("string")
    mtime = F.col("mtime").cast("bigint") if "mtime" in corpus.columns else F.lit(0).cast("bigint")
    keys = keys.select(F.col("doc_id").alias("__doc"), F.col("path").alias("__path"), F.col("mtime_secs").alias("__mtime"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & path.eqNullSafe(F.col("__path")) & mtime.eqNullSafe(F.col("__mtime"))
    return corpus.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, same, "left_semi")


def _without(spark: SparkSession, path: str, segment: dict, new: DataFrame) -> dict:
    """The segment's entry, with the documents that `new` (doc_id, path, mtime_secs) doesn't hold as they were marked gone."""
    was = _files_of(spark, path, [segment])
    gone = f"gone-{uuid.uuid4().hex}"
    was.join(new, ["doc_id", "path", "mtime_secs"], "left_anti").select("doc_id").write.parquet(f"{path}/{segment['name']}/{gone}")
    n = spark.read.parquet(f"{path}/{segment['name']}/{gone}").count()
    if not n:
        Folder(spark, path).delete(f"{segment['name']}/{gone}")
    return {**segment, "gone": [*segment["gone"], gone], "num_gone": segment.get("num_gone", 0) + n} if n else segment


def _merged(spark: SparkSession, folder: Folder, segments: list[dict]) -> list[dict]:
    """The segments; merged to one if they are many or most of their documents are gone.  Empty ones are left out."""
    live = [s for s in segments if s["num_files"] > s.get("num_gone", 0)] or segments[-1:]
    if len(live) <= MOST_SEGMENTS and 2 * sum(s.get("num_gone", 0) for s in live) <= sum(s["num_files"] for s in live):
        return live
    name, path = f"s-{uuid.uuid4().hex}", folder.path
    at = f"{path}/{name}"
    if len({s["texts"] for s in live}) == 1 and live[0]["texts"]:
        texts = reduce(DataFrame.unionByName, [_live(spark, path, s, spark.read.parquet(f"{path}/{s['name']}/texts")) for s in live])
        _write_texts(texts, at, _parts(spark, texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]))
    _files_of(spark, path, live).write.mode("overwrite").parquet(f"{at}/files")
    # blocks stay as they are, with the ids of documents that are gone, which no list leads to any more
    lists = [_live_blocks(spark, path, s).withColumn("doc_ids", F.lit(None).cast(f"array<{s['id']}>")) for s in live]
    ids = [_block_ids(spark, path, s).select(F.lit(None).cast("binary").alias("ngram"), "block", F.size("doc_ids").alias("n"), F.lit(None).cast("binary").alias("docs"), "doc_ids") for s in live]
    size = sum(folder.size(f"{s['name']}/postings") for s in live)
    return [_write_segment(spark, folder, reduce(DataFrame.unionByName, lists + ids).repartitionByRange(_parts(spark, size), "ngram"), name)]


def append(corpus: DataFrame, path: str, max_bytes: int = INDEX_BYTES, batch: str | None = None, store: bool = True) -> dict:
    """Add documents as a segment; those of them whose doc_id is indexed replace it.

    batch: a name for them; what is appended under the name of a batch that is there changes nothing.
    """
    spark = corpus.sparkSession
    folder, path = Folder(spark, path), path.rstrip("/")
    with _writing(folder):
        try:
            before = facts(spark, path)
        except NoIndex:
            if folder.exists(CURRENT):  # of another layout, or damaged: what it holds must not be lost unsaid
                raise
            before = {"segments": [], "corpus_version": None, "batches": []}
        if batch is not None and any(batch in s.get("batches", []) for s in before["segments"]):
            return before
        segment = _new_segment(corpus, folder, max_bytes, store)
        ids = spark.read.parquet(f"{path}/{segment['name']}/files").select("doc_id")
        others = []
        for s in before["segments"]:
            kept = _files_of(spark, path, [s]).join(ids, "doc_id", "left_anti").select("doc_id", "path", "mtime_secs")
            others.append(_without(spark, path, s, kept))
        merged = _merged(spark, folder, [*others, segment])
        names = [b for s in before["segments"] for b in s.get("batches", [])] + ([batch] if batch is not None else [])
        merged[-1] = {**merged[-1], "batches": names}
        merged[:-1] = [{**s, "batches": []} for s in merged[:-1]]
        return _publish(spark, folder, merged, before["corpus_version"])


def is_stale(indexed: str | None, current: str | None) -> bool:
    """Whether corpus versions tell that the index is old; an index that names one serves a corpus that doesn't."""
    return current is not None and indexed != current


def status(spark: SparkSession, path: str) -> DataFrame:
    """One row: format, files, n-grams, postings, corpus version, build time, bytes on disk; all null without an index."""
    kinds = "exists boolean, format int, num_files bigint, num_ngrams bigint, num_postings bigint, corpus_version string, built_at bigint, disk_bytes bigint"
    try:
        f = facts(spark, path)
    except NoIndex:
        return spark.createDataFrame([(False, *[None] * 7)], kinds)
    ngrams, n = f["num_ngrams"], f["segments"][0]["num_postings"]
    if ngrams is None:
        ngrams, n = posting_table(spark, path).agg(F.count_distinct("ngram"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")).first()
    return spark.createDataFrame([(True, f["format"], f["num_files"], ngrams, n, f["corpus_version"], f["timestamp"], Folder(spark, path).size())], kinds)


def clear(spark: SparkSession, path: str) -> bool:
    """Delete the index; whether there was one."""
    folder = Folder(spark, path)
    return folder.exists(CURRENT) and folder.delete()


def lookup(spark: SparkSession, path: str, ngrams: list[bytes]) -> DataFrame:
    """(ngram, doc_ids): sorted posting lists."""
    path = path.rstrip("/")
    rows = reduce(DataFrame.unionByName, [_postings_of(spark, path, s, _blocks(spark, path, s, ngrams)) for s in facts(spark, path)["segments"]])
    return rows.groupBy("ngram").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def documents_with_all(spark: SparkSession, path: str, ngrams: list[bytes]) -> DataFrame:
    """(doc_ids): the intersection of the n-grams' sorted posting lists; an n-gram that the index lacks has an empty one."""
    lists = lookup(spark, path, ngrams).agg(F.collect_list("doc_ids").alias("lists"))
    whole = F.when(F.size("lists") == len(set(ngrams)), F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0))), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b)))
    return lists.select(F.coalesce(whole, F.array().cast(lists.schema["lists"].dataType.elementType)).alias("doc_ids"))


def delta_encoded(lists: DataFrame) -> DataFrame:
    """(ngram, first, gaps) of (ngram, doc_ids): sorted lists as differences; delta_decoded is its inverse."""
    ids = F.col("doc_ids")
    gaps = F.zip_with(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), lambda a, b: a - b)
    return lists.select("ngram", F.get(ids, F.lit(0)).alias("first"), gaps.alias("gaps"))


@F.arrow_udf(ArrayType(LongType()))
def _running(first: pa.Array, gaps: pa.Array) -> pa.Array:
    """The numbers that begin with `first` and grow by the gaps; none without a first."""
    some = np.asarray(first.is_valid())
    gap = np.asarray(pc.fill_null(gaps.flatten(), 0)).astype(np.int64)
    n = np.where(some, np.asarray(pc.fill_null(pc.list_value_length(gaps), 0)) + 1, 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    steps = np.zeros(ends[-1], np.int64)
    head = ends[:-1][some]
    inner = np.ones(len(steps), bool)
    inner[head] = False
    steps[inner] = gap
    steps[head] = np.asarray(first.drop_null())
    total = np.cumsum(steps)
    base = np.repeat(np.concatenate([[0], total])[head], n[some])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(total - base))


def delta_decoded(lists: DataFrame) -> DataFrame:
    return lists.select("ngram", _running(F.col("first").cast("bigint"), "gaps").alias("doc_ids"))


def _share(condition: object, common: dict[str, float]) -> float:
    """Upper estimate of the share of a segment's documents that meet the condition."""
    if isinstance(condition, gram_query.Term):
        return min((common.get(g.hex().upper(), COMMON_SHARE) for g in gram_query.covering(condition.literal)), default=1.0)
    parts = [_share(p, common) for p in condition.parts]
    return min(parts) if isinstance(condition, gram_query.Both) else min(1.0, sum(parts))


def matching(spark: SparkSession, path: str, condition: object, state: dict | None = None) -> DataFrame:
    """(doc_id) of the documents in force that meet the condition on n-grams."""
    path = path.rstrip("/")
    state = state or facts(spark, path)
    wanted = gram_query.wanted(condition)

    def of(s: dict) -> DataFrame:
        lists = _blocks(spark, path, s, wanted).select("ngram", "block", places("docs").alias("at"))
        return _live(spark, path, s, _named(spark, path, s, gram_query.candidates_of_blocks(lists, condition)))

    return reduce(DataFrame.union, [of(s) for s in state["segments"]])


def candidates(corpus: DataFrame, path: str, spec: SearchSpec, current: bool = False) -> DataFrame:
    """The documents of `corpus` that may match.

    Documents that the index doesn't hold, or holds in another version, always may; `current` asserts there are none, and
    that `corpus` is the whole of what was indexed: then, if texts are stored, few candidates are read from there by their
    ids, which skips the other row groups.  Without a condition or a readable index, or if most documents may match, all do.
    """
    spark, condition = corpus.sparkSession, spec.pruning()
    try:
        state = facts(spark, path) if condition is not None else None
    except NoIndex:
        state = None
    if state is None:
        return corpus
    total = sum(s["num_files"] for s in state["segments"])
    if sum(s["num_files"] * _share(condition, s["common"]) for s in state["segments"]) > WEAK_SHARE * total:
        return corpus
    found = matching(spark, path, condition, state)
    if current:
        if all(s["texts"] for s in state["segments"]) and all(c in STORED for c in corpus.columns):
            ids = [r[0] for r in found.limit(LISTED + 1).collect()]
            if len(ids) <= LISTED:
                return _stored(spark, path.rstrip("/"), state, ids, corpus.columns)
        return corpus.join(found, "doc_id", "left_semi")
    ruled_out = files(spark, path).join(found, "doc_id", "left_anti").select("doc_id", "mtime_secs")
    if "mtime" in corpus.columns:
        ruled_out = ruled_out.withColumnRenamed("mtime_secs", "__mtime").withColumnRenamed("doc_id", "__doc")
        return corpus.join(ruled_out, (F.col("doc_id") == F.col("__doc")) & (F.col("mtime").cast("bigint") == F.col("__mtime")), "left_anti")
    return corpus.join(ruled_out.select("doc_id"), "doc_id", "left_anti")


def _stored(spark: SparkSession, path: str, state: dict, ids: list, columns: list[str]) -> DataFrame:
    """The stored documents of these ids; the ids reach the row groups of the sorted files."""
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", max(LISTED, int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold"))))
    rows = []
    for s in state["segments"]:
        texts = spark.read.schema(StructType.fromJson(json.loads(s["texts"]))).parquet(f"{path}/{s['name']}/texts").select(*columns)
        rows.append(_live(spark, path, s, texts.where(F.col("doc_id").isin(ids) if ids else F.lit(False))))
    return reduce(DataFrame.unionByName, rows)


def query_strength(spark: SparkSession, path: str, spec: SearchSpec) -> DataFrame:
    """One row: strength, candidates, total."""
    total, condition = files(spark, path).count(), spec.pruning()
    n = matching(spark, path, condition).count() if condition is not None else total
    return spark.createDataFrame([(gram_query.strength(n, total, condition is not None), n, total)], "strength string, candidates bigint, total bigint")


def pruned(operator, corpus: DataFrame, path: str, spec: SearchSpec, current: bool = False) -> DataFrame:
    """A search operator over the candidates; equal to the operator over the whole corpus."""
    return operator(candidates(corpus, path, spec, current), spec)


def search_lines(corpus: DataFrame, path: str, spec: SearchSpec, current: bool = False) -> DataFrame:
    return pruned(S.match_lines, corpus, path, spec, current)
