"""Licence notices in texts, by a positional index of rare template words.

1. Document frequencies of all template words are counted over all documents.
2. The index holds, of each template, its floor((1 - SHARE) L) + 2 words of highest IDF (at least) with their places.
3. Each file's occurrences of indexed words are looked up; postings are intersected by relative position (place in the
   file - place in the template): two of them, or all of a shorter template's, must agree.
4. Candidates are verified: at least SHARE of the template's words stand at their places, and so do all words of each of
   its mandatory key phrases.

If SHARE of a template's words are in place then at most floor((1 - SHARE) L) of the indexed ones are not, so step 3
loses nothing.

Defined results: null and empty texts have no match; texts are read whole and every notice in them is reported; a place
that several templates match is reported for each; repeated rows match by themselves; null doc_id is carried along;
an empty table, of texts or of templates, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .license_texts import TEMPLATES
from .tokens import TOKENS_SQL, U, slices, tokenise

SHARE = 0.8

NOTICE = "doc_id bigint, license string, template int, token_pos int, share double"
#: Text of a table of templates that is collected at most.
TEMPLATE_BYTES = 16 << 20


def templates_of(rows: DataFrame) -> list[tuple[str, str, list[str]]]:
    """Templates out of a table (license, text, phrases ARRAY<STRING>), in the order of its rows' values.

    A null name is 'unknown', null phrases are none, rows of null text are left out.  The table is checked to be small.
    """
    rows = rows.select("license", "text", "phrases").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates; at most {TEMPLATE_BYTES} are looked for at once")
    return [(r["license"] or "unknown", r["text"], [p for p in r["phrases"] or [] if p]) for r in rows.orderBy("license", "text").collect()]


class Templates:
    """Tokenised templates."""

    def __init__(self, templates: list[tuple[str, str, list[str]]]):
        self.names = [t[0] for t in templates]
        t = tokenise(pa.array([t[1] for t in templates], pa.large_string()))
        self.hash, self.bounds, self.size = t.hash, t.bounds, t.counts
        if not self.size.all():
            raise ValueError("a template without words")
        self.words = np.unique(self.hash)
        self.must = np.zeros(len(self.hash), bool)  # in a key phrase
        for k, (_, _, phrases) in enumerate(templates):
            own = self.hash[self.bounds[k] : self.bounds[k + 1]]
            for phrase in phrases:
                h = tokenise(pa.array([phrase], pa.large_string())).hash
                at = [i for i in range(len(own) - len(h) + 1) if (own[i : i + len(h)] == h).all()]
                if not at:
                    raise ValueError(f"{phrase!r} isn't in its template")
                self.must[self.bounds[k] + at[0] : self.bounds[k] + at[0] + len(h)] = True

    def index(self, frequency: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, template, place) sorted by word, and how many postings of each template must agree."""
        rows, need = [], []
        for k in range(len(self.names)):
            own = self.hash[self.bounds[k] : self.bounds[k + 1]]
            spare = int((1 - SHARE) * len(own) + 1e-9)
            by_idf = sorted(range(len(own)), key=lambda i: (frequency.get(int(own[i].view(np.int64)), 0), i))
            chosen = by_idf[: spare + 2]
            need.append(len(chosen) - spare)
            rows += [(own[i], k, i) for i in chosen]
        rows.sort(key=lambda r: int(r[0]))
        return np.array([r[0] for r in rows], U), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array(need)


def word_frequencies(docs: DataFrame, templates: Templates) -> dict[int, int]:
    """Documents that hold each template word (hash as a signed number), over all documents."""
    words = templates.words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for b in batches:
            for _, texts in slices(b.column(0)):
                t = tokenise(texts)
                at = np.searchsorted(words, t.hash)
                at[at == len(words)] = 0
                hit = words[at] == t.hash
                seen = np.unique(t.rows()[hit] * len(words) + at[hit])
                total += np.bincount(seen % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}  # a row for each template word


def scan(docs: DataFrame, templates: list[tuple[str, str, list[str]]] | DataFrame = TEMPLATES) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, license, template, token_pos, share): a row for each notice found.

    template is its number in `templates`; token_pos the place, in words, at which it begins (negative if cut off).
    """
    templates = templates_of(templates) if isinstance(templates, DataFrame) else templates
    if not templates:
        return docs.sparkSession.createDataFrame([], NOTICE)
    known = Templates(templates)
    word, of, place, need = known.index(word_frequencies(docs, known))
    lowest = np.ceil(SHARE * known.size - 1e-9).astype(np.int64)
    first, last = np.searchsorted(word, word, "left"), np.searchsorted(word, word, "right")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts in slices(b.column(1)):
                t = tokenise(texts)
                at = np.searchsorted(word, t.hash)
                at[at == len(word)] = 0
                token = np.flatnonzero(word[at] == t.hash)
                at = at[token]
                many = last[at] - first[at]
                posting = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                token = np.repeat(token, many)
                row = np.searchsorted(t.bounds, token, "right") - 1
                start = token - place[posting]  # of the template, within the slice
                key, n = np.unique(np.stack([row, of[posting], start], 1), axis=0, return_counts=True) if len(token) else (np.zeros((0, 3), np.int64), np.zeros(0))
                key = key[n >= need[key[:, 1]]]
                out = []
                for d, k, p in key.tolist():
                    lo, hi = max(p, t.bounds[d]), min(p + known.size[k], t.bounds[d + 1])
                    same = np.zeros(known.size[k], bool)
                    base = known.bounds[k] - p
                    same[lo - p : hi - p] = t.hash[lo:hi] == known.hash[base + lo : base + hi]
                    if same.sum() >= lowest[k] and same[known.must[known.bounds[k] : known.bounds[k + 1]]].all():
                        out.append((d, known.names[k], k, int(p - t.bounds[d]), round(float(same.mean()), 6)))
                cols = list(zip(*out)) if out else [()] * 5
                ids = b.column(0).slice(i, len(texts)).take(pa.array(cols[0], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64())], ["doc_id", "license", "template", "token_pos", "share"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(find, NOTICE)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of op3_license_scan: all alignments of all templates, without an index."""
    rows = []
    for k, (name, text, phrases) in enumerate(TEMPLATES):
        words = [w.decode() for w in _words(text)]
        must = set()
        for phrase in phrases:
            p = [w.decode() for w in _words(phrase)]
            at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
            must |= set(range(at, at + len(p)))
        low = int(np.ceil(SHARE * len(words) - 1e-9))
        rows += [f"({k}, '{name}', {len(words)}, {low}, {len(must)}, {i}, '{w}', {i in must})" for i, w in enumerate(words)]
    return f"""
WITH t(template, license, size, low, musts, i, word, must) AS (VALUES {", ".join(rows)}),
d AS {TOKENS_SQL.format(id="doc_id", text="text", table="documents")}
SELECT d.id AS doc_id, t.license, t.template::INT AS template, (d.pos - t.i)::INT AS token_pos, round(count(*) / t.size::DOUBLE, 6) AS share
FROM d JOIN t ON d.word = t.word GROUP BY d.id, t.license, t.template, d.pos - t.i, t.size, t.low, t.musts
HAVING count(*) >= t.low AND count(*) FILTER (WHERE t.must) = t.musts
"""


def _words(text: str) -> list[bytes]:
    t = tokenise(pa.array([text], pa.large_string()))
    return [t.text[a:b].tobytes() for a, b in zip(t.start, t.end)]
