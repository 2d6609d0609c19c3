"""Shared plumbing: table access, the shared work folder, written intermediate tables, size checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import Folder, work_dir

#: A side of a join (or a model shipped with a Python function) up to this size may be broadcast.
BROADCAST_BYTES = 64 << 20


#: Rows are read, and go to Python, in batches of this size, so that memory doesn't depend on how long texts are.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "512"}
#: Row groups of written tables.
ROW_GROUP_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Set BATCHES on the session, but what was configured."""
    configured = spark.sparkContext.getConf()
    for key, value in BATCHES.items():
        if not configured.contains(key):
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and return the reread table.

    This cuts the lineage: what follows survives the loss of executors without computing `df` again.
    """
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for tables in _watched:
        tables.append(path)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_watched: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession, *done: str) -> Iterator[list[str]]:
    """Gives the list of the tables that are written meanwhile; at the end all but the last one, and `done`, are deleted."""
    tables: list[str] = []
    _watched.append(tables)
    try:
        yield tables
    finally:
        _watched.remove(tables)
    for path in [*tables[:-1], *done]:
        Folder(spark, path).delete()


def private(df: DataFrame, *wanted: str) -> str:
    """A prefix with which no column of `df` begins, for helper columns that can't clash."""
    prefix = "__x"
    while any(c.lower().startswith(prefix) for c in [*df.columns, *wanted]):
        prefix += "x"
    return prefix


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with a bigint column `key` that tells its rows apart: doc_id if that does.

    If a doc_id is null or repeated it is a number that ascends by doc_id (nulls last), text and the other columns; the
    table is then written once, so that a row's number stays as it is.
    """
    doc_id = F.col("doc_id").cast("bigint")
    if not docs.groupBy(doc_id.alias(key)).count().where(f"{key} is null or count > 1").limit(1).count():
        return docs.withColumn(key, doc_id)
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    ordered = docs.orderBy(doc_id.asc_nulls_last(), "text", F.xxhash64(F.lit(0), *others))
    return written(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed")
