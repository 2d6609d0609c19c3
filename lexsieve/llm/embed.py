"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

A vector is normalised, padded to a power of two, and rotated by three rounds of random signs and Hadamard transform.
Its hash is the axis, with sign, nearest to the result.  A table's key joins HASHES such hashes; vectors of equal keys
in one of the tables are candidates.  With multiprobe, one of the two sides also looks in the PROBES keys that lie
next: those with one hash's nearest axis replaced by a later one, in the order of the least loss.  There are more tables
for longer vectors, whose hashes are finer, so that recall at the threshold stays above 0.9.

Equal vectors are one class, of which the least vec_id is looked up for all.  Candidates of a bucket are compared with
its leaders (buckets.py), each pair by its cosine, what these leave apart in large buckets by products of blocks, and what is
near is grouped: a result row for each vector, not for
each of the pairs of a group.

Defined results: null vectors, null vec_id, vectors with null or non-finite parts and zero vectors have no row; vectors
of another length than most are near to vectors of their own length only; rows that repeat a vec_id are one vector (the
first in order of its parts); equal vectors are near like others; a vector near to none is a group of itself, with links
0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .buckets import linked
from .common import table, written
from .tokens import U, mix

THRESHOLD = 0.9
HASHES, PROBES, SEED = 3, 4, 10
#: Vectors of a block of a large bucket.
BLOCK = 2048


def tables_for(dim: int) -> int:
    """Hash tables for vectors of a length: 8 up to 64 parts, 4 more for each doubling."""
    return 8 + 4 * max(0, (dim - 1).bit_length() - 6)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; their length must be a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    signs = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (3, x.shape[1])) * 2 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def keys(x: np.ndarray, table_no: int, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Keys (rows x 1 + probes, int64) of unit vectors in one table: the own key first, then the probes."""
    n, dim = x.shape
    d = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    depth = min(probes + 1, d)
    axes, losses = [], []
    for k in range(hashes):
        r = rotate(padded, SEED + 1000 * table_no + k)
        order = np.argsort(-np.abs(r), 1, kind="stable")[:, :depth]
        top = np.take_along_axis(r, order, 1)
        axes.append(2 * order + (top < 0))
        losses.append(np.abs(top[:, :1]) - np.abs(top))
    axes, losses = np.stack(axes, 1), np.stack(losses, 1)  # rows x hashes x depth
    salt = U(table_no * 1_000_003 + dim)

    def join(a: np.ndarray) -> np.ndarray:
        out = np.full(n, salt, U)
        for k in range(hashes):
            out = mix(out * U(0x9E3779B97F4A7C15) + a[:, k].astype(U))
        return out.view(np.int64)

    own = axes[:, :, 0]
    out = [join(own)]
    flat = losses[:, :, 1:].reshape(n, -1)
    best = np.argsort(flat, 1, kind="stable")[:, :probes]
    for p in range(best.shape[1]):
        k, j = np.divmod(best[:, p], depth - 1)
        a = own.copy()
        a[np.arange(n), k] = axes[np.arange(n), k, j + 1]
        out.append(join(a))
    return np.stack(out, 1)


def _units(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) of the usable vectors, for each length."""
    column = column.cast(pa.list_(pa.float64()))
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    flat, out = column.flatten(), []
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    ends = np.cumsum(size)
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        x = values[(ends[rows] - n)[:, None] + np.arange(n)]
        norm = np.linalg.norm(x, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        out.append((rows[ok], x[ok] / norm[ok, None]))
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        b = b.filter(b.column(0).is_valid())
        for rows, x in _units(b.column(1)):
            for i in range(0, len(rows), 1024):
                part, tables = x[i : i + 1024], tables_for(x.shape[1])
                all_keys = np.concatenate([keys(part, t) for t in range(tables)], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, all_keys.size + 1, all_keys.shape[1], dtype=np.int32)), pa.array(all_keys.ravel()))
                unit = np.ascontiguousarray(part, "<f4")
                ends = np.arange(len(part) + 1, dtype=np.int32) * 4 * x.shape[1]
                units = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(unit)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[i : i + 1024])), units, lists], ["vec_id", "unit", "keys"])


def _checked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(pc.binary_length(b.column(2)))
            same = size == np.asarray(pc.binary_length(b.column(3)))
            ok = np.zeros(b.num_rows, bool)
            for n in np.unique(size[same]):
                rows = np.flatnonzero(same & (size == n))
                x, y = (np.frombuffer(b"".join(b.column(k).take(pa.array(rows)).to_pylist()), "<f4").reshape(len(rows), -1).astype(float) for k in (2, 3))
                ok[rows] = np.einsum("ij,ij->i", x, y) >= threshold
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], ["a", "b", "ok"])

    return run


def _block_pairs(threshold: float):
    """Vectors of a cell -> their near pairs of unlike root."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        one, other = key[1].as_py(), key[2].as_py()
        ids, roots, block = (t.column(c).to_numpy() for c in ("id", "root", "block"))
        size = np.asarray(pc.binary_length(t.column("unit").combine_chunks()))
        found = [np.zeros((0, 2), np.int64)]
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            x = np.frombuffer(b"".join(t.column("unit").take(pa.array(at)).to_pylist()), "<f4").reshape(len(at), -1).astype(float)
            left, right = np.flatnonzero(block[at] == one), np.flatnonzero(block[at] == other)
            a, b = np.nonzero(x[left] @ x[right].T >= threshold)
            i, j = at[left[a]], at[right[b]]
            apart = roots[i] != roots[j]
            found.append(np.stack([np.minimum(ids[i], ids[j])[apart], np.maximum(ids[i], ids[j])[apart]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def block_pairs(items: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """items(key, id, root), units(vec_id, unit) -> (a, b): all near pairs of unlike root within a key.

    A large bucket is cut into blocks of about BLOCK vectors; each two blocks are multiplied in a task of their own, and
    near pairs alone leave it.
    """
    sizes = items.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = items.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.join(units.withColumnRenamed("vec_id", "id"), "id").select("key", "id", "root", "block", "unit", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    cells = rows.select("key", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "id", "root", "block", "unit")
    return cells.groupBy("key", "one", "other").applyInArrow(_block_pairs(threshold), "a bigint, b bigint")


def near_groups(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """embeddings(vec_id, embedding) -> (vec_id, class_id, links), a row for each vector.

    class_id is the smallest vec_id of the group that cosines of at least `threshold` link, directly or over others;
    links is the number of other vectors in it.
    """
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    hashed = written(rows.mapInArrow(_hashed, "vec_id bigint, unit binary, keys array<bigint>"), "hashed")
    if hashed.groupBy("vec_id").count().where("count > 1").limit(1).count():
        first = hashed.groupBy("vec_id").agg(F.min(F.struct("unit", "keys")).alias("r"))
        hashed = written(first.select("vec_id", "r.unit", "r.keys"), "hashed")
    print_of = F.md5("unit").alias("print")
    classes = written(hashed.select("vec_id", print_of).groupBy("print").agg(F.min("vec_id").alias("rep")), "classes")
    lead = hashed.join(classes.select(F.col("rep").alias("vec_id")), "vec_id", "left_semi")
    members = lead.select(F.col("vec_id").alias("id"), F.posexplode("keys").alias("place", "key"))
    # a vector's own key comes before its probes
    members = members.select("key", "id", (F.pmod("place", F.lit(PROBES + 1)) == 0).alias("own"))

    def verified(pairs: DataFrame) -> DataFrame:
        a = hashed.select(F.col("vec_id").alias("a"), F.col("unit").alias("u"))
        b = hashed.select(F.col("vec_id").alias("b"), F.col("unit").alias("v"))
        return written(pairs.join(a, "a").join(b, "b").select("a", "b", "u", "v").mapInArrow(_checked(threshold), "a bigint, b bigint, ok boolean"), "verified")

    units = hashed.select("vec_id", "unit")
    roots = linked(members, verified, lambda items: block_pairs(items, units, threshold))
    of = classes.join(roots.toDF("rep", "root"), "rep", "left").select("print", F.coalesce("root", "rep").alias("class_id"))
    found = hashed.select("vec_id", print_of).join(of, "print").select("vec_id", "class_id")
    found = written(found, "classed")
    sizes = found.groupBy("class_id").agg((F.count("*") - 1).alias("links"))
    return found.join(sizes, "class_id").select("vec_id", "class_id", "links")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


#: DuckDB SQL of op10_embedding_dedup: all pairs of vectors, without hashing.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings),
near AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v AS a JOIN v AS b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) >= {THRESHOLD} * a.size * b.size),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, n.y FROM reach AS r JOIN near AS n ON r.y = n.x)
SELECT x AS vec_id, min(y) AS class_id, count(*) - 1 AS links FROM reach GROUP BY x
"""
