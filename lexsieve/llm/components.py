"""Connected components of a pair table: union-find inside partitions, then large-star / small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition; emits (node, root) with root the smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            p, q = find(u), find(v)
            if p != q:
                parent[max(p, q)] = min(p, q)
                parent.setdefault(min(p, q), min(p, q))
    pairs = [(x, find(x)) for x in list(parent)]
    pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _least(edges: DataFrame) -> DataFrame:
    """edges(u, v) with m, the least v of each u: aggregated before the shuffle, then joined, so that a node of very many edges is no single task."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """edges(a BIGINT, b BIGINT) -> (node, root): every node of an edge, and the smallest node it is linked with.

    Self-loops, repeats and both directions are allowed; nulls are dropped.  Rounds go on until the edges stay as they are.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u <> v")
    e = written(e.mapInArrow(_forest, "u bigint, v bigint"), "forest")
    state = None
    while True:
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state or new[0] == 0:
            break
        state = new
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = _least(large)  # every u > v here
        small = low.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = written(small.where("u <> v").distinct(), "stars")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
