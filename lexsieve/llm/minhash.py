"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups.

Two documents are near-duplicates if the Jaccard similarity of their sets of 3-token windows (as 48-bit hashes) reaches
the threshold; groups are the connected components.  Documents of equal sets, by a 128-bit fingerprint, are one class, of
which the least document is looked up for all.  Banding finds a pair of similarity s with probability
1 - (1 - s^rows)^bands; every pair so found is compared on the whole sets, unless others link it already; in large buckets of documents that
the leaders don't link, pairs without a rare window in common are left out, which can't be near (prefix_pairs).

Defined results: null or token-less texts are in no group, nor is a null doc_id in near_duplicates, which gives ids; rows that repeat a doc_id are one
document, near to whatever any of its texts is near to, but are dropped each by its own text; texts of any length
are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .buckets import linked
from .common import BROADCAST_BYTES, keyed, private, table, written
from .components import components
from .tokens import TOKENS_SQL, U, mix, shingles, slices, tokenise

SHINGLE, SLOTS, ROWS, THRESHOLD = 3, 160, 4, 0.5
#: Windows of the sets that are compared at once.
PAIR_WINDOWS = 1 << 18
#: Bytes of a stored window hash, and rows of a slice, which share a 64-bit key with it.
WIDTH, MOST_ROWS = 6, 1 << 16


def superminhash(seeds: np.ndarray, bounds: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (rows x m, uint64: rank << 32 | fraction) of the sets seeds[bounds[d]:bounds[d+1]].

    Element i draws a random permutation of the slots one step at a time (Fisher-Yates) and offers slot perm(k) the
    value k + fraction; a slot keeps the least.  All elements take step k together, and a row stops as soon as all
    its slots hold less than k: no later step can lower them.
    """
    nd = len(bounds) - 1
    sig = np.full(nd * m, np.iinfo(np.uint64).max, U)
    row = np.repeat(np.arange(nd), np.diff(bounds))
    seed, perm, drawn = seeds, None, None
    for k in range(m):
        if k:
            open_rows = (sig.reshape(nd, m) >= U(k << 32)).any(1)
            on = open_rows[row]
            if not on.any():
                break
            if perm is None:  # the first step's swap comes with it
                row, seed, drawn = row[on], seed[on], drawn[on]
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(row), 1))
                perm[np.arange(len(row)), drawn] = 0
                perm[:, 0] = drawn
            elif not on.all():
                row, seed, perm = row[on], seed[on], perm[on]
        r = mix(seed + U((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = k + ((r >> U(32)) * U(m - k) >> U(32)).astype(np.int64)
        slot = drawn = at
        if perm is not None:
            every = np.arange(len(row))
            slot = perm[every, at].astype(np.int64)
            perm[every, at] = perm[:, k]
            perm[:, k] = slot
        np.minimum.at(sig, row * m + slot, (r & U(0xFFFFFFFF)) | U(k << 32))
    return sig.reshape(nd, m)


def _packed(gram: np.ndarray) -> np.ndarray:
    """Window hashes as WIDTH little-endian bytes each."""
    return np.ascontiguousarray(gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH])


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return wide.view("<u8").ravel()


def signatures(batches: Iterator[pa.RecordBatch], m: int = SLOTS, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, fp, fq, bands, grams): fingerprint of the set, band keys, the sorted set itself."""
    for batch in batches:
        for i, texts in slices(batch.column(1), rows=MOST_ROWS):
            h, bounds = shingles(tokenise(texts), SHINGLE)
            row = np.repeat(np.arange(len(texts), dtype=U), np.diff(bounds))
            u = np.unique(row << U(48) | h >> U(16))
            row, gram = (u >> U(48)).astype(np.int64), u & U((1 << 48) - 1)
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            seeds = mix(gram + U(0x632BE59BD9B4E019))
            sig = superminhash(seeds, bounds, m)
            some = np.diff(bounds) > 0
            prints = []
            for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(seeds ^ U(salt)))])
                prints.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U)))
            nb = m // rows
            keys = np.zeros((len(texts), nb), U)
            for r in range(rows):
                keys = mix(keys * U(0x9E3779B97F4A7C15) + sig[:, r : nb * rows : rows] + np.arange(nb, dtype=U))
            keys = np.ascontiguousarray(keys[some]).view(np.int64)
            off = pa.py_buffer((bounds * WIDTH).astype(np.int32))
            blobs = pa.Array.from_buffers(pa.binary(), len(texts), [None, off, pa.py_buffer(_packed(gram))]).filter(pa.array(some))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, nb, dtype=np.int32)), pa.array(keys.ravel()))
            ids = batch.column(0).slice(i, len(texts)).filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(f[some].view(np.int64)) for f in prints), bands, blobs], ["doc_id", "fp", "fq", "bands", "grams"])


def _similar(threshold: float):
    """Pairs with their packed sets -> whether they are near; PAIR_WINDOWS windows at once."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.asarray(pc.binary_length(b.column(k))).astype(np.int64) // WIDTH for k in (2, 3)]
            ok = np.minimum(*n) >= threshold * np.maximum(*n)  # else too unlike in size
            look = np.flatnonzero(ok)
            ends = np.cumsum((n[0] + n[1])[look])
            i = 0
            while i < len(look):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIR_WINDOWS, "right")))
                j = min(j, i + MOST_ROWS)
                part = look[i:j]
                keys = [_unpacked(b"".join(b.column(k).take(pa.array(part)).to_pylist())) | np.repeat(np.arange(len(part), dtype=U), n[k - 2][part]) << U(48) for k in (2, 3)]
                both = np.sort(np.concatenate(keys))
                same = (both[1:][both[1:] == both[:-1]] >> U(48)).astype(np.int64)
                common = np.bincount(same, minlength=len(part))
                ok[part] = common >= threshold * (n[0][part] + n[1][part] - common)
                i = j
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], ["a", "b", "ok"])

    return check


def _verified(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ok) for each pair, by the whole sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = written(ids, "ids")
    if ids.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    grams = written(sigs.select("doc_id", "grams").join(ids, "doc_id", "left_semi"), "grams")
    x = grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("x"))
    y = grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("y"))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar(threshold), "a bigint, b bigint, ok boolean"), "verified")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root, grams) -> (id, root, n, gram) of each window hash; n is the set's size."""
    for b in batches:
        n = np.asarray(pc.binary_length(b.column(2))).astype(np.int64) // WIDTH
        ends, i = np.cumsum(n), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIR_WINDOWS, "right")))
            at = pa.array(np.repeat(np.arange(i, j), n[i:j]))
            gram = _unpacked(b"".join(b.column(2).slice(i, j - i).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.repeat(n[i:j], n[i:j])), pa.array(gram.view(np.int64))], ["id", "root", "n", "gram"])
            i = j


def prefix_pairs(items: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """items(id, root), by sets -> (a, b): at least all pairs of unlike root whose Jaccard similarity reaches the threshold.

    Each set's windows are put in the order of their frequency among the items, rarest first.  Of two near sets the
    smaller has one of its first n - ceil(2 t / (1 + t) n) + 1 windows among the first n - ceil(t n) + 1 of the other, so
    only sets that share such a rare window are paired; what very many items share comes last in each.
    """
    grams = sigs.select(F.col("doc_id").alias("id"), "grams").join(items.select("id", "root").distinct(), "id").select("id", "root", "grams")
    windows = written(grams.mapInArrow(_windows, "id bigint, root bigint, n bigint, gram bigint"), "windows")
    often = windows.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    # windows of one item alone come first and pair nothing
    shared = windows.join(often, "gram")
    own = windows.groupBy("id").agg(F.count("*").alias("every")).join(shared.groupBy("id").agg(F.count("*").alias("shared")), "id").select("id", (F.col("every") - F.col("shared")).alias("alone"))
    ranked = shared.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("df", "gram"))).join(own, "id").withColumn("rank", F.col("rank") + F.col("alone"))
    first = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    prefix = written(ranked.where(F.col("rank") <= first(threshold)).select("gram", "id", "root", "n", (F.col("rank") <= first(2 * threshold / (1 + threshold))).alias("inner")), "prefixes")
    x, y = prefix.where("inner").toDF("gram", "i", "r", "m", "f"), prefix.toDF("gram", "j", "s", "n", "g")
    near = x.join(y, "gram").where((F.col("r") != F.col("s")) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("i") != F.col("j")))) & (F.col("m") >= threshold * F.col("n") - 1e-9))
    return near.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def _linked(rows: DataFrame, threshold: float) -> DataFrame:
    """rows(doc_id BIGINT, text), doc_id unique and not null -> (doc_id, group_id) of groups of two or more."""
    sigs = written(rows.mapInArrow(signatures, "doc_id bigint, fp bigint, fq bigint, bands array<bigint>, grams binary"), "signatures")
    # documents of equal sets are one from here on; counts of a class are added up before they are shuffled
    classes = written(sigs.groupBy("fp", "fq").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = sigs.select("doc_id", "bands").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    members = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.lit(True).alias("own"))
    roots = linked(members, lambda pairs: _verified(pairs, sigs, threshold), lambda items: prefix_pairs(items, sigs, threshold))
    of = classes.join(roots.toDF("rep", "root"), "rep", "left").where("n > 1 or root is not null")
    of = written(of.select("fp", "fq", F.coalesce("root", "rep").alias("group_id")), "groups")
    return sigs.select("doc_id", "fp", "fq").join(of, ["fp", "fq"]).select("doc_id", "group_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, group_id, links, keep) of all documents in groups of two or more, a row for each.

    group_id is the group's smallest doc_id, which alone has keep = true; links is the number of other documents in it.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    rows = keyed(rows, "row")
    got = _linked(rows.select(F.col("row").alias("doc_id"), "text"), threshold)
    if rows.where("row <> doc_id").limit(1).count():
        name = rows.select("row", "doc_id")
        links = got.toDF("row", "root").join(name.withColumnRenamed("doc_id", "a"), "row").join(name.toDF("root", "b"), "root")
        got = components(links.select("a", "b")).toDF("doc_id", "group_id")
    got = written(got, "grouped")
    sizes = got.groupBy("group_id").agg((F.count("*") - 1).alias("links"))
    return got.join(sizes, "group_id").select("doc_id", "group_id", "links", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` but those whose text is near to that of their group's kept row; all columns stay.

    Kept is the row of the smallest doc_id, nulls last, then text.  Rows without tokens all stay.
    """
    p = private(docs)
    docs = keyed(docs, p)
    linked = _linked(docs.select(F.col(p).alias("doc_id"), "text"), threshold)
    gone = written(linked.where("doc_id <> group_id").select(F.col("doc_id").alias(p)), "dropped")
    if gone.count() * 16 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, p, "left_anti").drop(p)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB SQL of the groups that all pairs of documents give, without hashing.
ORACLE = f"""
WITH RECURSIVE t AS {TOKENS_SQL.format(id="doc_id", text="text", table="documents")},
w AS (SELECT id, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, pos, count(*) OVER (PARTITION BY id) AS n FROM t WINDOW o AS (PARTITION BY id ORDER BY pos)),
s AS (SELECT DISTINCT id, CASE WHEN n >= 3 THEN word || ' ' || b || ' ' || c WHEN n = 2 THEN word || ' ' || b ELSE word END AS gram FROM w WHERE c IS NOT NULL OR (n < 3 AND pos = 0)),
size AS (SELECT id, count(*) AS n FROM s GROUP BY id),
pairs AS (SELECT x.id AS x, y.id AS y, count(*) AS c FROM s AS x JOIN s AS y ON x.gram = y.gram AND x.id <> y.id GROUP BY x.id, y.id),
near AS (SELECT x, y FROM pairs JOIN size AS a ON a.id = x JOIN size AS b ON b.id = y WHERE c >= {THRESHOLD} * (a.n + b.n - c)),
reach AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach AS r JOIN near AS n ON r.y = n.x)
SELECT x AS doc_id, min(y) AS group_id, count(*) - 1 AS links, x = min(y) AS keep FROM reach GROUP BY x
"""
