"""Language-model scores: byte n-grams mixed by deleted interpolation.

Of the lower-cased UTF-8 text every byte is predicted from the four before it (five-grams; a text begins after zero
bytes).  Counts of all five-grams are taken over all documents, apart for training documents and held-out ones (one in
HELD_OUT by hash of doc_id); all lower orders follow from them.  The estimate is

    p(w | h) = sum_k lambda_k(b) c(h_k w) / c(h_k)   for contexts h_k of 4, 3, 2, 1, 0 bytes, and 1/256,

with a set of weights for each bucket b of the frequency of the longest context, floor(log2(1 + c(h_4))).  The weights
come from expectation-maximisation on the held-out counts, run as grouped sums over the table of held-out five-grams.

Scoring looks every five-gram of every text up in the table of log-probabilities.  A table of up to BROADCAST_BYTES goes to
the executors.  A larger one stays where it is: texts are cut into runs of PART_BYTES, each run asks for its distinct
five-grams once, these are joined with the table, and runs and answers are brought together; what is shuffled is the
texts and, for each run, its distinct five-grams, however often they occur.

Defined results: null and empty texts have n_bytes 0, log_prob 0 and bits_per_byte null; texts are read whole; repeated
rows get a row each (and count each); a null doc_id is a training document; an empty table gives an empty result;
without held-out documents the weights stay uniform; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BROADCAST_BYTES, table, written
from .tokens import buffer, slices, strings

ORDER, HELD_OUT, EM_STEPS, EM_CHANGE = 5, 10, 30, 1e-4
TERMS = ORDER + 1
#: Text that looks its five-grams up together.
PART_BYTES = 8 << 20


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(five-gram that ends at each byte, row bounds) of the lower-cased rows."""
    data, offsets = buffer(strings(pc.utf8_lower(strings(texts))))
    size = np.diff(offsets)
    lead = ORDER - 1
    padded = np.zeros(len(data) + lead * len(size), np.int64)
    row = np.repeat(np.arange(1, len(size) + 1), size)
    padded[np.arange(len(data)) + lead * row] = data
    key = np.zeros(len(padded), np.int64)
    for k in range(ORDER):
        key[lead:] |= padded[lead - k : len(padded) - k] << (8 * k)
    return key[np.arange(len(data)) + lead * row], offsets


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(sorted_keys)))


class _Counter:
    """Counts of keys, merged when as many new ones wait as are held."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.wait: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        head, n = _runs(keys)
        self.wait.append((keys[head], n))
        self.waiting += len(head)
        if self.waiting > len(self.keys) + (1 << 20):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.wait)])
        counts = np.concatenate([self.counts, *(c for _, c in self.wait)])
        self.wait, self.waiting = [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        head, _ = _runs(keys)
        self.keys, self.counts = keys[head], np.add.reduceat(counts, head) if len(head) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters = _Counter(), _Counter()
    for batch in batches:
        held = np.asarray(batch.column(1))
        for i, texts in slices(batch.column(0)):
            key, bounds = grams(texts)
            out = np.repeat(held[i : i + len(texts)], np.diff(bounds))
            for counter, part in zip(counters, (key[~out], key[out])):
                counter.add(part)
    train, test = counters
    for c in counters:
        c.merge()
    keys = np.union1d(train.keys, test.keys)
    both = []
    for c in counters:
        n = np.zeros(len(keys), np.int64)
        n[np.searchsorted(keys, c.keys)] = c.counts
        both.append(n)
    for i in range(0, len(keys), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)]) for x in (keys, *both)], ["key", "n", "held"])


def count_grams(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> written (key, n, held): training and held-out counts of every five-gram."""
    held = F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64(F.lit(4), F.col("doc_id").cast("bigint")), F.lit(HELD_OUT)) == 0)
    parts = docs.select("text", held.alias("held")).mapInArrow(_count, "key bigint, n bigint, held bigint")
    return written(parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("held").alias("held")), "grams")


def _low(key: Column, order: int) -> Column:
    return key.bitwiseAND(F.lit((1 << 8 * order) - 1))


def estimates(counts: DataFrame) -> DataFrame:
    """(key, held, b, p5 .. p1): bucket and maximum-likelihood estimates of each five-gram (0 for unseen contexts)."""
    key = F.col("key")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    levels = {ORDER: counts.select("key", "n")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy(_low(key, k).alias("key")).agg(F.sum("n").alias("n"))
    levels[ORDER - 1] = written(levels[ORDER - 1], "grams4")
    for k in range(ORDER - 2, 0, -1):  # from here on the tables are small
        levels[k] = levels[k + 1].groupBy(_low(key, k).alias("key")).agg(F.sum("n").alias("n"))
    context = lambda t: t.groupBy(F.shiftright("key", 8).alias("h")).agg(F.sum("n").alias("nh"))
    model = levels[1].crossJoin(levels[1].agg(F.sum("n").alias("nh"))).select("key", ratio("n", "nh").alias("p1"))
    for k in range(2, ORDER + 1):
        grams_k = levels[k] if k < ORDER else counts
        more = grams_k.withColumn("h", F.shiftright("key", 8)).withColumn("low", _low(key, k - 1)).join(context(levels[k]), "h")
        lower = model.withColumnRenamed("key", "low")
        extra = ["held", F.floor(F.log2(F.col("nh") + 1)).cast("int").alias("b")] if k == ORDER else []
        model = more.join(lower, "low").select("key", *extra, ratio("n", "nh").alias(f"p{k}"), *[f"p{j}" for j in range(k - 1, 0, -1)])
    return written(model, "estimates")


def _terms() -> list[Column]:
    return [F.lit(1 / 256), *(F.col(f"p{k}") for k in range(1, TERMS))]


def _share(lam: dict[int, list[float]], k: int) -> Column:
    """Weight of term k by bucket; buckets without held-out counts have uniform weights."""
    known = F.array(*[F.lit(float(lam[b][k] if b in lam else 1 / TERMS)) for b in range(max(lam, default=0) + 1)])
    return F.coalesce(F.get(known, F.col("b")), F.lit(1 / TERMS))


def _mixture(lam: dict[int, list[float]]) -> Column:
    """The interpolated probability."""
    return sum((_share(lam, k) * t for k, t in enumerate(_terms())), F.lit(0.0))


def learn_weights(model: DataFrame) -> dict[int, list[float]]:
    """bucket -> weights of 1/256, p1 .. p5, by expectation-maximisation on the held-out counts."""
    held = written(model.where("held > 0").drop("key"), "held")
    lam: dict[int, list[float]] = {}
    for _ in range(EM_STEPS):
        parts = held.select("b", "held", *[(_share(lam, k) * t).alias(f"r{k}") for k, t in enumerate(_terms())])
        parts = parts.withColumn("total", sum((F.col(f"r{k}") for k in range(TERMS)), F.lit(0.0)))
        rows = parts.groupBy("b").agg(*[F.sum(F.col("held") * F.col(f"r{k}") / F.col("total")).alias(f"r{k}") for k in range(TERMS)]).collect()
        new = {r["b"]: [r[f"r{k}"] / sum(r[f"r{j}"] for j in range(TERMS)) for k in range(TERMS)] for r in rows}
        moved = max((abs(x - y) for b in new for x, y in zip(new[b], lam.get(b, [1 / TERMS] * TERMS))), default=0.0)
        lam = new
        if moved < EM_CHANGE:
            break
    return lam


def _looked_up(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = model.value
        for batch in batches:
            for i, texts in slices(batch.column(1)):
                n, total = _summed(keys, logs, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array(n), pa.array(total)], ["doc_id", "n_bytes", "log_prob"])

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (part, doc_id, text): runs of rows of about PART_BYTES of text get a number."""
    part, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for i, texts in slices(batch.column(1)):
            rows = batch.slice(i, len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), part)), rows.column(0), rows.column(1)], ["part", "doc_id", "text"])
            size += texts.nbytes
            if size >= PART_BYTES:
                part, size = part + 1, 0


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, text) -> (part, key): the distinct five-grams of each part that follow one another."""
    now, counter = None, _Counter()

    def out() -> pa.RecordBatch:
        counter.merge()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(counter.keys), now, np.int64)), pa.array(counter.keys)], ["part", "key"])

    for batch in batches:
        part = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if now is not None and now != part[a]:
                yield out()
                counter = _Counter()
            now = int(part[a])
            for _, texts in slices(batch.column(1).slice(a, b - a)):
                counter.add(grams(texts)[0])
    if now is not None:
        yield out()


def _summed(keys: np.ndarray, logs: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, log-probability) of the rows, by sorted keys."""
    key, bounds = grams(texts)
    order = np.argsort(key)
    at = np.searchsorted(keys, key[order])
    if len(key) and (at.max() >= len(keys) or (keys[at] != key[order]).any()):
        raise AssertionError("a five-gram that wasn't counted")
    score = np.empty(len(key))
    score[order] = logs[at]
    sums = np.concatenate([[0.0], np.cumsum(score)])
    return np.diff(bounds), sums[bounds[1:]] - sums[bounds[:-1]]


def _answered(rows: pa.Table, answers: pa.Table) -> pa.Table:
    key, log = answers.column("key").to_numpy(), answers.column("log").to_numpy()
    order = np.argsort(key)
    key, log, out = key[order], log[order], []
    ids = rows.column("doc_id").combine_chunks()
    for i, texts in slices(rows.column("text")):
        n, total = _summed(key, log, texts)
        out.append(pa.table([ids.slice(i, len(texts)), pa.array(n), pa.array(total)], ["doc_id", "n_bytes", "log_prob"]))
    return pa.concat_tables(out)


def score(docs: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, log_prob, bits_per_byte), a row for each row; log_prob in nats."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = estimates(count_grams(rows))
    lam = learn_weights(model)
    logs = written(model.select("key", F.ln(_mixture(lam)).alias("log")), "model")
    if logs.count() * 16 <= most:
        got = logs.select("key", "log").toArrow()
        key, log = got.column(0).to_numpy(), got.column(1).to_numpy()
        order = np.argsort(key)
        out = rows.mapInArrow(_looked_up(docs.sparkSession.sparkContext.broadcast((key[order], log[order]))), "doc_id bigint, n_bytes bigint, log_prob double")
    else:
        parts = written(rows.mapInArrow(_parts, "part bigint, doc_id bigint, text string"), "parts")
        answers = parts.select("part", "text").mapInArrow(_asked, "part bigint, key bigint").join(logs, "key").select("part", "key", "log")
        out = parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_answered, "doc_id bigint, n_bytes bigint, log_prob double")
    return out.select("doc_id", "n_bytes", F.round("log_prob", 4).alias("log_prob"), F.when(F.col("n_bytes") > 0, F.round(-F.col("log_prob") / F.col("n_bytes") / F.ln(F.lit(2.0)), 6)).alias("bits_per_byte"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
