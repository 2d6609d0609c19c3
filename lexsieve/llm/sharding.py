"""Reproducible global shuffle: a Feistel permutation of row numbers with cycle walking.

Rows are numbered 0 .. N-1 by doc_id; a keyed Feistel network on the smallest even-bit domain of at least N numbers
permutes them, and a number that lands outside 0 .. N-1 is sent through again until it lands inside.  The new position
gives shard = position mod shards and slot = position div shards, so that anyone can compute where a row goes, or which
row a slot holds (`locate`, `row_at`), from (N, seed, shards) alone.

Defined results: rows of null doc_id come first; rows that repeat a doc_id get consecutive numbers; one row, or none,
works like any other number; texts are not read; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import keyed, private, table, written

ROUNDS, SEED = 6, 20240607
ROWS_PER_SHARD = 512
#: Ids that are sorted in one task.
RANGE_ROWS = 1 << 20
P, Q = 2147483647, 2147483629  # primes


def round_keys(seed: int = SEED) -> list[tuple[int, int]]:
    """(factor, addend) of each round."""
    out, x = [], seed % P or 1
    for _ in range(2 * ROUNDS):
        x = x * 48271 % P
        out.append(x)
    return list(zip(out[::2], out[1::2]))


def half_bits(n: int) -> int:
    return max(1, ceil(max(n - 1, 1).bit_length() / 2))


def permute(x: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The position of each row number below n (or the reverse)."""
    h = half_bits(n)
    if h > 31:
        raise ValueError("at most 2^62 rows")
    mask, keys = np.int64((1 << h) - 1), round_keys(seed)

    def f(half: np.ndarray, key: tuple[int, int]) -> np.ndarray:
        t = (half * key[0] + key[1]) % P
        return t * t % Q & mask

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> h, v & mask
        if inverse:
            for key in reversed(keys):
                left, right = right ^ f(left, key), left
        else:
            for key in keys:
                left, right = right, left ^ f(right, key)
        return left << h | right

    out = once(np.asarray(x, np.int64))
    while (outside := np.flatnonzero(out >= n)).size:  # cycle walking
        out[outside] = once(out[outside])
    return out


def locate(row: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    """The row in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        extra = [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))]
        at += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "part", "at"])


def number_rows(ids: DataFrame, n: int) -> DataFrame:
    """ids(doc_id[, others]), n rows -> the same with row_no: 0 .. n-1 in the order of all columns, without one partition seeing all rows.

    Ranges of about RANGE_ROWS rows are sorted apart and written once, so that what follows sees one and the same cut into
    ranges.  Rows alike in all columns may swap numbers, which nobody can tell.
    """
    order = [F.col(f"`{c}`").asc_nulls_first() for c in ids.columns]
    ranges = ids.repartitionByRange(max(1, ceil(n / RANGE_ROWS)), *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"`{c}` {t}" for c, t in ids.dtypes)
    rows = written(ranges.mapInArrow(_numbered, f"{kinds}, part int, at bigint"), "ranges")
    before = rows.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # a row for each range
    return rows.join(F.broadcast(before.select("part", "before")), "part").select(*ids.columns, (F.col("before") + F.col("at")).alias("row_no"))


def assign(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """docs(doc_id) -> (doc_id, row_no, position, shard, slot), a row for each row."""
    return _placed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id")), rows_per_shard, seed)


def _placed(ids: DataFrame, rows_per_shard: int, seed: int) -> DataFrame:
    n = ids.count()
    shards = max(1, ceil(n / rows_per_shard))

    @F.arrow_udf("bigint")
    def position(row: pa.Array) -> pa.Array:
        return pa.array(permute(row.to_numpy(), n, seed))

    out = number_rows(ids, n).select(*ids.columns, "row_no", position("row_no").alias("position"))
    return out.select(*ids.columns, "row_no", "position", F.pmod("position", F.lit(shards)).alias("shard"), F.floor(F.col("position") / shards).cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, path: str, rows_per_shard: int = ROWS_PER_SHARD, seed: int = SEED) -> None:
    """Write `docs` in shuffled order: folders __shard=k, rows by slot; every row once, whatever its doc_id.

    Rows that share a doc_id, null included, are told apart by a number of their own and take their places in its order.
    """
    p = private(docs, "__shard")
    rows = keyed(docs, f"{p}key")
    ids = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"{p}key").alias("key"))
    where = _placed(ids, rows_per_shard, seed).select(F.col("key").alias(f"{p}key"), F.col("shard").alias("__shard"), F.col("slot").alias(f"{p}slot"))
    rows = rows.join(where, f"{p}key").repartition("__shard").sortWithinPartitions("__shard", f"{p}slot")
    rows.drop(f"{p}key", f"{p}slot").write.partitionBy("__shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of op2_sharding, the cycle walk as a recursive query."""
    ctes = []
    for i, (a, c) in enumerate(round_keys()):
        ctes.append(f"(SELECT row_no, n, h, r AS l, xor(l, ((((r * {a} + {c}) % {P}) * ((r * {a} + {c}) % {P})) % {Q}) & ((1::BIGINT << h) - 1)) AS r FROM {{src}}) AS f{i}")
    inner = "(SELECT row_no, n, h, (v >> h) AS l, v & ((1::BIGINT << h) - 1) AS r FROM {v}) AS s"
    for c in ctes:
        inner = c.format(src=inner)
    once = f"SELECT row_no, n, h, ((l << h) | r) AS v FROM {inner}"
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, (row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1)::BIGINT AS row_no, (count(*) OVER ())::BIGINT AS n FROM documents
), sized AS (
  SELECT doc_id, row_no, n, greatest(1, ceil(length(bin(greatest(n - 1, 1))) / 2.0))::BIGINT AS h FROM base
), walk AS (
  {once.format(v="(SELECT row_no, n, h, row_no AS v FROM sized) AS z")}
  UNION ALL
  {once.format(v="(SELECT row_no, n, h, v FROM walk WHERE v >= n) AS z")}
)
SELECT s.doc_id, s.row_no, w.v AS position,
       (w.v % greatest(1, ceil(s.n / {ROWS_PER_SHARD}.0))::BIGINT)::BIGINT AS shard,
       (w.v // greatest(1, ceil(s.n / {ROWS_PER_SHARD}.0))::BIGINT)::BIGINT AS slot
FROM sized s JOIN walk w ON s.row_no = w.row_no AND w.v < w.n
"""
