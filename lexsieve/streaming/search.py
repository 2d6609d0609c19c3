"""Search over a stream of documents: the line operators are narrow, so they run on a streaming DataFrame as they are.

Index maintenance over a stream goes batch by batch: each micro-batch becomes a segment of the index that searches read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import index, search as S
from ..plans.spec import SearchSpec


def match_stream(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Selected lines of a streaming corpus; global limits and sorts are for finished results, not for streams."""
    if spec.max_results or spec.sort:
        raise ValueError("max_results and sort need a finished result")
    return S.match_lines(docs, spec)


def append_index(docs: DataFrame, path: str, checkpoint: str):
    """Start a query that adds arriving documents to an index, a segment for each micro-batch; a replayed batch is added once.

    A document that arrives again under its doc_id replaces what was there.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            last = batch.groupBy("doc_id").agg(F.max_by(F.struct("*"), "text").alias("r")).select("r.*")  # one version of a document in a batch
            index.append(last, path, batch=f"{checkpoint}#{number}")

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()
