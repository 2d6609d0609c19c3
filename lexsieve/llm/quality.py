"""Quality and toxicity of documents by hierarchical empirical Bayes.

1. Evidence of a document: two logistic regressions (good, toxic) on the presence of its telling words and word
   beginnings (hashed) and a few shape features of its whole text, fitted on labelled documents.
2. Evidence of a site: over all documents, the mean of these probabilities by host and by path within the host, in one
   grouped aggregation.  A host's posterior mean shrinks towards the global mean, a path's towards its host's; the
   strength of each prior is estimated from the spread between the hosts, or paths (method of moments), so that
   sparse sites lean on their prior and large ones on their own documents.
3. A document's log-odds are its own plus SITE_WEIGHT times what its path's posterior departs from the global mean.

`source` is read as host[/path...]; the path level is host plus first path segment, or, for a source without a path,
host plus `lang`.

Defined results: null text counts as empty; a null source or lang is a site of its own; empty texts get the evidence of
a text without words; very long texts are read whole; repeated rows are scored each (and count each in their site);
labels of unknown documents, null labels and repeated labels (the least counts) do no harm; without labels of both
classes the classifier is constant at the prior, and an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import BROADCAST_BYTES, private, table, written
from .tokens import U, buffer, slices, tokenise

#: About this many labelled documents, chosen by hash of doc_id, fit the document classifier.
TRAIN_ROWS = 12_000
WORD_BITS, MIN_G2 = 19, 18.0
#: Words count by themselves and by their first so many bytes.
PREFIXES = (4, 5, 6, 7)
SITE_WEIGHT = 0.25
#: Kept: good with at least MIN_GOOD, toxic with less than MAX_TOXIC.
MIN_GOOD, MAX_TOXIC = 0.5, 0.5

SHAPE = 9
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 . , and quotes, 6 other ASCII sign, 7 non-ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 6
_CLASS[[9, 10, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-?"]] = 5


def features(texts: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row) for each distinct hashed word or word beginning of a row, by row; shape features by row.

    used: if given, only features of these (a mask) are returned.
    """
    t = tokenise(texts)
    nd = len(texts)
    data, off = buffer(texts)
    size = np.diff(off)
    rows = np.repeat(np.arange(nd), size)
    kinds = np.bincount(rows * 8 + _CLASS[data], minlength=nd * 8).reshape(nd, 8) if nd else np.zeros((0, 8))
    of = t.rows()
    parts = []
    for k in (0, *PREFIXES):
        h, at = t.prefixes(k) if k else (t.hash, slice(None))
        feature, row = (h >> U(64 - WORD_BITS)).astype(np.int64), of[at]
        if used is not None:
            telling = used[feature]
            feature, row = feature[telling], row[telling]
        parts.append(row << WORD_BITS | feature)
    both = np.unique(np.concatenate(parts))
    word = np.sort(of.astype(U) << U(32) | t.hash >> U(32))
    distinct = np.bincount((word >> U(32)).astype(np.int64)[np.concatenate([[True], word[1:] != word[:-1]])], minlength=nd)[:nd] if len(word) else np.zeros(nd)
    n = t.counts
    letters = kinds[:, 1] + kinds[:, 2]
    share = lambda a, b: a / np.maximum(b, 1)
    same = np.zeros(len(t.hash), bool)
    same[1:] = t.hash[1:] == t.hash[:-1]
    shape = np.stack([
        np.ones(nd), share(kinds[:, 1], letters), share(kinds[:, 3], size), share(kinds[:, 6], n), share(kinds[:, 5], n),
        share(distinct, n), share(np.bincount(of[same], minlength=nd)[:nd], n), np.log1p(n) / 10, share(kinds[:, 4], size),
    ], 1)
    shape[:, 3:5] = np.minimum(shape[:, 3:5], 2)
    return (both & ((1 << WORD_BITS) - 1)).astype(np.int32), (both >> WORD_BITS).astype(np.int32), shape


def _fit(word: np.ndarray, row: np.ndarray, shape: np.ndarray, y: np.ndarray, steps: int = 250) -> np.ndarray:
    """Weights (words, then shape) of a logistic regression with a ridge, by Adam on all rows."""
    w = np.zeros((1 << WORD_BITS) + SHAPE)
    if y.min() == y.max():
        w[1 << WORD_BITS] = 4.0 if y.max() else -4.0
        return w
    n = len(y)
    # words that go with the class beyond chance, by the likelihood ratio of their counts
    a, every = np.zeros(1 << WORD_BITS), np.zeros(1 << WORD_BITS)
    for i in range(0, len(word), 1 << 19):  # a part at a time, for the driver's memory
        part = word[i : i + (1 << 19)]
        every += np.bincount(part, minlength=1 << WORD_BITS)
        a += np.bincount(part, y[row[i : i + (1 << 19)]], 1 << WORD_BITS)
    b = every - a
    q, have = y.mean(), np.maximum(a + b, 1)
    g2 = 2 * (a * np.log(np.maximum(a / have / q, 1e-9)) + b * np.log(np.maximum(b / have / (1 - q), 1e-9)))
    telling = g2 >= MIN_G2
    chosen = telling[word]
    row, word = row[chosen], word[chosen]
    used, word = np.unique(word, return_inverse=True)
    theta = np.zeros(len(used) + SHAPE)
    theta[len(used)] = np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    ridge = np.concatenate([np.full(len(used), 2e-4), np.full(SHAPE, 1e-5)])
    for k in range(1, steps + 1):
        z = np.bincount(row, theta[word], n) + shape @ theta[len(used) :]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.concatenate([np.bincount(word, e[row], len(used)), shape.T @ e]) + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    w[used] = theta[: len(used)]
    w[1 << WORD_BITS :] = theta[len(used) :]
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights (2 x features, float32) for good and toxic, fitted on about `most` labelled documents."""
    cols = [F.min(F.col(c).cast("int")).alias(c) for c in ("quality", "toxic")]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*cols).where("quality is not null and toxic is not null")
    n = known.count()
    known = known.where(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) < min(1.0, most / max(n, 1)) * (1 << 30))
    known = F.broadcast(known)  # bounded by `most`

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts in slices(b.column(0)):
                word, row, shape = features(texts)
                cut = np.searchsorted(row, np.arange(len(texts) + 1))
                words = pa.array([word[cut[d] : cut[d + 1]].astype("<i4").tobytes() for d in range(len(texts))], pa.binary())
                shapes = pa.array([s.tobytes() for s in shape], pa.binary())
                yield pa.RecordBatch.from_arrays([words, shapes, b.column(1).slice(i, len(texts)), b.column(2).slice(i, len(texts))], ["w", "s", "quality", "toxic"])

    picked = docs.select("text", F.col("doc_id").cast("bigint").alias("doc_id")).join(known, "doc_id").select("text", "quality", "toxic")
    got = picked.mapInArrow(rows, "w binary, s binary, quality int, toxic int").toArrow()
    if got.num_rows == 0:
        w = np.zeros((2, (1 << WORD_BITS) + SHAPE), np.float32)
        w[:, 1 << WORD_BITS] = 4.0, -4.0
        return w
    words = [np.frombuffer(x.as_buffer(), "<i4") for x in got.column("w")]
    row = np.repeat(np.arange(len(words), dtype=np.int32), [len(x) for x in words])
    shape = np.stack([np.frombuffer(x.as_buffer(), float) for x in got.column("s")])
    word = np.concatenate(words)
    return np.stack([_fit(word, row, shape, (got.column(c).to_numpy() > 0).astype(float)) for c in ("quality", "toxic")]).astype(np.float32)


def evidence(weights: np.ndarray):
    """Arrow function text -> struct(good, toxic): log-odds of the document's own text."""

    used = (weights[:, : 1 << WORD_BITS] != 0).any(0)

    @F.arrow_udf("good double, toxic double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            parts = []
            for _, texts in slices(text):
                word, row, shape = features(texts, used)
                n = len(texts)
                z = [np.round(np.clip(np.bincount(row, w[word], n) + shape @ w[1 << WORD_BITS :].astype(float), -12, 12), 6) for w in weights]
                parts.append(pa.StructArray.from_arrays([pa.array(z[0]), pa.array(z[1])], ["good", "toxic"]))
            yield pa.chunked_array(parts, pa.struct([("good", pa.float64()), ("toxic", pa.float64())])).combine_chunks()

    return score


def _probability(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def site_columns(docs: DataFrame) -> tuple[Column, Column]:
    """(host, path) of a row; nulls are sites of their own."""
    source = F.coalesce(F.col("source"), F.lit("\0"))
    parts = F.split(source, "/")
    return parts[0], F.concat_ws("/", parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.col("lang"), F.lit("\0")))


def posteriors(scored: DataFrame, names: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """scored(host, path, <names> log-odds) -> (host, path, n, <name>_site, <name>_base): shrunk and global means.

    With n_s documents of mean x_s in site s, prior mean m and prior strength k its posterior mean is
    (n_s x_s + k m) / (n_s + k), where k = m (1 - m) / (variance between sites) - 1 (1 at least, 1e6 at most).
    """
    by_path = scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(_probability(F.col(c))).alias(c) for c in names])
    everywhere, host = W.partitionBy(), W.partitionBy("host")
    hosts = by_path.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(c).alias(f"{c}_h") for c in names])
    total = hosts.agg(F.sum("host_n").alias("all_n"), *[F.sum(f"{c}_h").alias(f"{c}_all") for c in names])

    def strength(m: Column, between: Column) -> Column:
        k = m * (1 - m) / F.greatest(between, F.lit(1e-9)) - 1
        return F.least(F.greatest(k, F.lit(1.0)), F.lit(1e6))

    hosts = hosts.crossJoin(F.broadcast(total))  # one row
    spread = hosts.agg(*[(F.sum(F.col("host_n") * F.pow(F.col(f"{c}_h") / F.col("host_n") - F.col(f"{c}_all") / F.col("all_n"), 2)) / F.sum("host_n")).alias(f"{c}_v") for c in names])
    hosts = hosts.crossJoin(F.broadcast(spread))  # one row
    for c in names:
        m = F.col(f"{c}_all") / F.col("all_n")
        k = strength(m, F.col(f"{c}_v"))
        hosts = hosts.withColumn(f"{c}_base", m).withColumn(f"{c}_host", (F.col(f"{c}_h") + k * m) / (F.col("host_n") + k))
    hosts = hosts.select("host", *[f"{c}_{x}" for c in names for x in ("base", "host")])
    paths = by_path.join(hosts, "host")
    spread = paths.agg(*[(F.sum(F.col("n") * F.pow(F.col(c) / F.col("n") - F.col(f"{c}_host"), 2)) / F.sum("n")).alias(f"{c}_v") for c in names])
    paths = paths.crossJoin(F.broadcast(spread))  # one row
    for c in names:
        m = F.col(f"{c}_host")
        k = strength(m, F.col(f"{c}_v"))
        paths = paths.withColumn(f"{c}_site", (F.col(c) + k * m) / (F.col("n") + k))
    return paths.select("host", "path", "n", *[f"{c}_{x}" for c in names for x in ("site", "base")])


def _with_site(rows: DataFrame, sites: DataFrame, p: str) -> DataFrame:
    """rows (with p_host, p_path, p_s) joined with their sites; adds p_good, p_toxic, p_keep."""
    if sites.count() * 200 <= BROADCAST_BYTES:
        sites = F.broadcast(sites)
    sites = sites.select(F.col("path").alias(f"{p}_path"), *[F.col(c).alias(f"{p}_{c}") for c in sites.columns if c not in ("host", "path")])
    out = rows.join(sites, f"{p}_path", "left")
    for c in ("good", "toxic"):
        clip = lambda x: F.least(F.greatest(F.col(f"{p}_{x}"), F.lit(1e-6)), F.lit(1 - 1e-6))
        shift = SITE_WEIGHT * (_logit(clip(f"{c}_site")) - _logit(clip(f"{c}_base")))
        out = out.withColumn(f"{p}_{c}", F.round(_probability(F.col(f"{p}_s.{c}") + F.coalesce(shift, F.lit(0.0))), 6))
    return out.withColumn(f"{p}_keep", (F.col(f"{p}_good") >= MIN_GOOD) & (F.col(f"{p}_toxic") < MAX_TOXIC))


def _scored(docs: DataFrame, weights: np.ndarray, p: str) -> DataFrame:
    host, path = site_columns(docs)
    return docs.withColumns({f"{p}_host": host, f"{p}_path": path, f"{p}_s": evidence(weights)("text")})


def assess(docs: DataFrame, labels: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """docs(doc_id, text, lang, source) -> (doc_id, good, toxic, host_path, site_good, site_toxic, keep), a row for each row.

    The narrow scores are written once and serve both the aggregation and the result.
    """
    weights = train(docs, labels) if weights is None else weights
    rows = written(_scored(docs.select("doc_id", "text", "lang", "source"), weights, "p").select("doc_id", "p_host", "p_path", "p_s"), "scores")
    sites = written(posteriors(rows.select(F.col("p_host").alias("host"), F.col("p_path").alias("path"), "p_s.good", "p_s.toxic")), "sites")
    out = _with_site(rows, sites, "p")
    return out.select("doc_id", F.col("p_good").alias("good"), F.col("p_toxic").alias("toxic"), F.col("p_path").alias("host_path"), F.round("p_good_site", 6).alias("site_good"), F.round("p_toxic_site", 6).alias("site_toxic"), F.col("p_keep").alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """The rows of `docs` that `assess` keeps, with all their columns.

    Texts are scored twice, once for the sites and once for the rows, which is cheaper than to shuffle them.
    """
    weights = train(docs, labels) if weights is None else weights
    p = private(docs)
    rows = _scored(docs.select("text", "lang", "source"), weights, "p")
    sites = written(posteriors(rows.select(F.col("p_host").alias("host"), F.col("p_path").alias("path"), "p_s.good", "p_s.toxic")), "sites")
    return _with_site(_scored(docs, weights, p), sites, p).where(f"{p}_keep").select(*[f"`{c}`" for c in docs.columns])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
