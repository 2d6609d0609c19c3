"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; stages but the
last return the columns of `docs`.  A stage may be given any table with doc_id, text, lang and source; nulls, empty
texts, repeated rows, empty tables and further columns of any name are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexsieve.llm.bpe import encode
from lexsieve.llm.common import passing, small_batches, table, written
from lexsieve.llm.decontam import drop_contaminated
from lexsieve.llm.langid import keep_identified
from lexsieve.llm.minhash import drop_near_duplicates
from lexsieve.llm.quality import keep_good


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    small_batches(spark)
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality that aren't toxic."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all others."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of every document."""
    small_batches(spark)
    return encode(docs)


STAGES = [
    ("language ID", language),
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", tokens),
]

#: Hashed vectors, fitted classifiers and signatures are beyond SQL; tests/llm/test_other_ops.py holds the stages against
#: brute force (language ID and quality: test_text_ops.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; a stage's own tables, and its input, are deleted when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with passing(spark, *before) as tables:
            docs = written(stage(spark, docs, sf_dir), f"stage{i}")
        before = tables[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
