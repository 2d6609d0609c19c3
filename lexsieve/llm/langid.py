"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector of DIM parts.  A letter trigram's vector binds (multiplies) the vectors of its
letters, permuted (rotated) by their place: rot2(a) * rot(b) * c.  A document's vector bundles (sums) those of all its
trigrams; a language's prototype bundles the unit vectors of its training documents.  A document gets the language
whose prototype has the greatest cosine with it; equal cosines go to the first name.

It is accepted if that cosine is at least what texts of its length should have, and leads the second by MIN_MARGIN.  The
least cosine of a length (by the power of two of its number of trigrams) is LENIENCE times the QUANTILE quantile of the
training documents of that length; lengths that training lacks take the one of the next shorter length, else MIN_COSINE.

Every row with a text and a declared language trains, and every declared language has a prototype.  The bundles are sums of
whole numbers and the quantiles are taken from counts of all training cosines, so that neither depends on how the rows
lie in partitions.  Prototypes of more than BROADCAST_BYTES are asked block by block.

Text is lower-cased, a run of non-letters is one space, and trigrams do not cross documents.

Defined results: null, empty and letterless texts have no trigram, hence lang null, cosine 0 and accepted false; very
long texts are read whole; rows of null declared language train nothing; without any labelled row nothing is accepted;
with one language alone the margin is the cosine; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import BROADCAST_BYTES, passing, private, table, written
from .tokens import U, buffer, give_back, mix, slices, strings

DIM = 1024
#: Labelled documents of a language that train: all.
TRAIN_PER_LANG = math.inf
#: Parts of unit vectors are summed as whole multiples of 1 / FINE.
FINE = 1 << 30
#: Rows of vectors, cosines, and languages' sums that a worker holds at once.
ROWS, COSINES, SUMS = 2048, 1 << 20, 1024
MIN_COSINE, MIN_MARGIN = 0.05, 0.01
#: Least cosine of a length, and how many training documents of that length it takes to know it.
QUANTILE, LENIENCE, KNOWN = 0.01, 0.5, 20

_alpha: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _alpha


def _letter_vector(code: int, dim: int) -> np.ndarray:
    words = mix(np.arange(dim // 64, dtype=U) + U(code * 0x9E3779B97F4A7C15 % 2**64))
    return (np.unpackbits(words.view(np.uint8)).astype(np.int8) << 1) - 1


class Space:
    """Trigram vectors, made when first met."""

    #: Vectors held at once; when full they are made anew, which bounds memory for scripts of many letters.
    MOST = 24_000

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.ids = np.full(0x110000, -1, np.int32)
        self.vectors = np.zeros((0, dim), np.int8)
        self.reset()

    def reset(self) -> None:
        self.direct = np.full(1 << 18, -1, np.int32)  # of trigrams of the first 64 letters
        self.other: dict[int, int] = {}
        self.rows = np.zeros((256, self.dim), np.int8)
        self.n = 0

    def letters(self, codes: np.ndarray) -> np.ndarray:
        ids = self.ids[codes].astype(np.int64)
        if len(ids) and ids.min() < 0:
            for c in np.unique(codes[ids < 0]).tolist():
                self.ids[c] = len(self.vectors)
                self.vectors = np.vstack([self.vectors, _letter_vector(c, self.dim)])
            ids = self.ids[codes].astype(np.int64)
        return ids

    def _make(self, abc: np.ndarray) -> np.ndarray:
        """Rows for the letter ids abc (n x 3)."""
        if self.n + len(abc) > len(self.rows):
            more = np.zeros((max(2 * len(self.rows), self.n + len(abc)), self.dim), np.int8)
            more[: self.n] = self.rows[: self.n]
            self.rows = more
        v = self.vectors
        self.rows[self.n : self.n + len(abc)] = np.roll(v[abc[:, 0]], 2, 1) * np.roll(v[abc[:, 1]], 1, 1) * v[abc[:, 2]]
        self.n += len(abc)
        return np.arange(self.n - len(abc), self.n)

    def lookup(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Row of each trigram."""
        if len(self.vectors) <= 64:
            key = a << 12 | b << 6 | c
            got = self.direct[key]
            if len(got) and got.min() < 0:
                new = np.unique(key[got < 0])
                self.direct[new] = self._make(np.stack([new >> 12, new >> 6 & 63, new & 63], 1))
                got = self.direct[key]
            return got
        key, inverse = np.unique(a << 42 | b << 21 | c, return_inverse=True)
        small = (key >> 42 < 64) & (key >> 21 & 0x1FFFFF < 64) & (key & 0x1FFFFF < 64)
        packed = (key >> 42) << 12 | (key >> 21 & 63) << 6 | key & 63
        got = np.where(small, self.direct[np.where(small, packed, 0)], -1).astype(np.int64)
        for i in np.flatnonzero(~small):
            got[i] = self.other.get(int(key[i]), -1)
        new = np.flatnonzero(got < 0)
        if len(new):
            k = key[new]
            got[new] = self._make(np.stack([k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF], 1))
            self.direct[packed[new[small[new]]]] = got[new[small[new]]]
            self.other.update(zip(key[new[~small[new]]].tolist(), got[new[~small[new]]].tolist()))
        return got[inverse]

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, trigrams) of the rows."""
        if self.n > self.MOST:
            self.reset()
        nd = len(texts)
        data, offsets = buffer(strings(pc.utf8_lower(texts)))
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        letter = _letters()[codes]
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        where = np.concatenate([[0], np.cumsum(kept)])[chars]
        s = self.letters(np.where(letter, codes, 32)[kept])
        out = np.zeros((nd, self.dim), np.float32)
        n = np.zeros(nd, np.int64)
        if len(s) >= 3:
            t = self.lookup(s[:-2], s[1:-1], s[2:])
            for d in range(nd):
                ids = t[where[d] : max(where[d], where[d + 1] - 2)]
                n[d] = len(ids)
                if len(ids):
                    count = np.bincount(ids)
                    used = np.flatnonzero(count)
                    out[d] = count[used].astype(np.float32) @ self.rows[used].astype(np.float32)
        return out, n


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-30)


@dataclass
class Model:
    """Blocks (languages, their unit prototypes) in order of name, and the least cosine for texts of 2^k trigrams, k from 0."""

    blocks: list[tuple[list[str], np.ndarray]]
    least: np.ndarray


def _length(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), 62)


def _bundles(dim: int):
    """mapInArrow function (lang, text) -> (lang, v), the summed vectors of some of a language's rows."""

    def result(total: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array(total, pa.string()), "v": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = Space(dim), {}
        for batch in batches:
            for i, texts in slices(batch.column("text"), rows=ROWS):
                v, _ = space.documents(texts)
                parts = np.rint(_unit(v.astype(float)) * FINE).astype(np.int64)
                codes = batch.column("lang").slice(i, len(texts)).dictionary_encode()
                of = codes.indices.to_numpy()
                order = np.argsort(of, kind="stable")
                starts = np.flatnonzero(np.diff(of[order], prepend=-1))
                for k, x in zip(of[order][starts].tolist(), np.add.reduceat(parts[order], starts)):
                    name = codes.dictionary[k].as_py()
                    total[name] = total.get(name, 0) + x
                if len(total) > SUMS:
                    yield result(total)
                    total = {}
        if total:
            yield result(total)
        space = None
        give_back()

    return bundle


def _prototype(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v.as_buffer(), np.int64) for v in t.column("v"))
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "v": [_unit(total.astype(float)).astype(np.float32).tobytes()]})


def prototypes(docs: DataFrame, dim: int = DIM) -> list[tuple[list[str], np.ndarray]]:
    """The blocks of the model, fitted on all labelled rows."""
    rows = docs.select("lang", "text").where("lang is not null and text is not null")
    kind = "lang string, v binary"
    every = written(rows.mapInArrow(_bundles(dim), kind).groupBy("lang").applyInArrow(_prototype, kind), "profiles")
    names = sorted(r["lang"] for r in every.select("lang").collect())
    most, blocks = max(1, BROADCAST_BYTES // (4 * dim)), []
    for i in range(0, len(names), most):
        part = names[i : i + most]
        vectors = {r["lang"]: np.frombuffer(r["v"], np.float32) for r in every.where(F.col("lang").between(part[0], part[-1])).collect()}
        blocks.append((part, np.stack([vectors[k] for k in part])))
    return blocks


#: Scores of a row: its length, the cosine with its declared language, the best language and cosine, the second cosine.
SCORES = "k int, own double, detected string, cosine double, second double"


def _score(names: list[str], vectors: np.ndarray):
    """Arrow function (text, lang[, scores by the blocks before]) -> scores."""
    kind = pa.struct([("k", pa.int32()), ("own", pa.float64()), ("detected", pa.string()), ("cosine", pa.float64()), ("second", pa.float64())])
    rows = max(1, min(ROWS, COSINES // len(names)))

    @F.arrow_udf(SCORES)
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        space, known = Space(vectors.shape[1]), pa.array(names, pa.string())
        for text, lang, *before in batches:
            parts = []
            for i, texts in slices(text, rows=rows):
                v, n = space.documents(texts)
                at = np.arange(len(n))
                cos = np.round((_unit(v) @ vectors.T).astype(float), 6)
                of = pc.fill_null(pc.index_in(lang.slice(i, len(n)), value_set=known), -1).to_numpy()
                own = np.where(of < 0, np.nan, cos[at, of])
                best = cos.argmax(1)
                top = cos[at, best]
                cos[at, best] = -np.inf
                second, detected = cos.max(1), known.take(pa.array(best))
                if before:
                    was = {f: pc.struct_field(before[0].slice(i, len(n)), f) for f in ("own", "detected", "cosine", "second")}
                    a, b = (pc.fill_null(was[f], -np.inf).to_numpy() for f in ("cosine", "second"))
                    own = np.where(of < 0, pc.fill_null(was["own"], np.nan).to_numpy(), own)
                    detected = pc.if_else(pa.array(top > a), detected, was["detected"])
                    top, second = np.maximum(top, a), np.maximum(np.minimum(top, a), np.maximum(second, b))
                columns = [pa.array(_length(n).astype(np.int32), mask=n == 0), pa.array(own, mask=np.isnan(own)), detected, pa.array(top), pa.array(second, mask=np.isinf(second))]
                parts.append(pa.StructArray.from_arrays(columns, fields=list(kind)))
            yield pa.chunked_array(parts, kind).combine_chunks()
        space = None
        give_back()

    return score


def _scored(docs: DataFrame, blocks: list[tuple[list[str], np.ndarray]], p: str) -> DataFrame:
    """`docs` with their scores as column p; beyond one block the table is written between them."""
    if not blocks:
        return docs.withColumn(p, F.lit(None).cast("struct<" + SCORES.replace(" ", ":").replace(",:", ",") + ">"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    with passing(docs.sparkSession):
        for i, block in enumerate(blocks):
            docs = (written(docs, "languages") if i else docs).withColumn(p, _score(*block)("text", lang, *[p][:i]))
    return docs


def _least_cosines(scored: DataFrame, p: str) -> np.ndarray:
    """The least cosine by length, from the scores of all labelled rows."""
    counts = scored.where(f"{p}.k is not null and {p}.own is not null").groupBy(F.col(f"{p}.k"), F.round(F.col(f"{p}.own") * 1e6).cast("bigint").alias("c")).agg(F.count("*").alias("n"))
    one = Window.partitionBy("k")
    ranked = counts.withColumns({"upto": F.sum("n").over(one.orderBy("c")), "total": F.sum("n").over(one)})
    low = F.floor((F.col("total") - 1) * QUANTILE)
    near: dict[int, list] = {}
    for r in ranked.where((F.col("upto") > low) & (F.col("upto") - F.col("n") <= low + 1)).collect():
        near.setdefault(r["k"], []).append(r)
    out, last = np.full(63, MIN_COSINE), MIN_COSINE
    for k in range(63):
        here = sorted(near.get(k, []), key=lambda r: r["c"])
        if here and here[0]["total"] >= KNOWN:
            at = (here[0]["total"] - 1) * QUANTILE
            a, b = (next(r["c"] for r in here if i < r["upto"]) / 1e6 for i in (int(at), min(int(at) + 1, here[0]["total"] - 1)))
            last = max(MIN_COSINE, LENIENCE * (a + (b - a) * (at - int(at))))
        out[k] = last
    return out


def _fit(docs: DataFrame, p: str, dim: int, *drop: str) -> tuple[Model, DataFrame]:
    """The model of all labelled rows of `docs`, and `docs` without the columns `drop` with scores as column p, written."""
    blocks = prototypes(docs, dim)
    scored = written(_scored(docs, blocks, p).drop(*drop), "languages")
    return Model(blocks, _least_cosines(scored, p)), scored


def profiles(docs: DataFrame, dim: int = DIM) -> Model:
    """The model, fitted on all labelled rows."""
    return _fit(docs.select("text", "lang"), "scores", dim, "text", "lang")[0]


def _judged(model: Model, p: str) -> dict[str, Column]:
    """detected, cosine, margin and accepted of rows with scores as column p."""
    s = {f: F.col(f"{p}.{f}") for f in ("k", "detected", "cosine", "second")}
    known = s["k"].isNotNull() & s["detected"].isNotNull()
    of = lambda c: F.when(known, c)
    margin = s["cosine"] - F.coalesce(s["second"], F.lit(0.0))
    least = F.element_at(F.array(*map(F.lit, model.least.tolist())), s["k"] + 1)
    accepted = of((s["cosine"] >= least) & (margin >= MIN_MARGIN))
    return {"detected": of(s["detected"]), "cosine": F.coalesce(of(s["cosine"]), F.lit(0.0)), "margin": F.coalesce(of(margin), F.lit(0.0)), "accepted": F.coalesce(accepted, F.lit(False))}


def identify_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs(doc_id, text, lang) -> (doc_id, lang, detected, cosine, margin, accepted), a row for each row."""
    docs, p = docs.select("doc_id", "text", "lang"), "scores"
    model, scored = _fit(docs, p, DIM, "text") if model is None else (model, _scored(docs, model.blocks, p))
    return scored.select("doc_id", "lang", *(c.alias(k) for k, c in _judged(model, p).items()))


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The accepted rows of `docs`, with all its columns."""
    p = private(docs)
    model, scored = _fit(docs, p, DIM) if model is None else (model, _scored(docs, model.blocks, p))
    return scored.where(_judged(model, p)["accepted"]).drop(p)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
