"""Benchmark decontamination with a distributed positional inverted index.

The index is stored as Parquet in segments (runs of documents of about SLICE_BYTES): for each segment its sorted term hashes,
list lengths and token positions.  Segments are independent, so building and searching need no shuffle.

Search, in each segment, for every benchmark item:
* exact: every window of N tokens is a phrase.  Its terms are taken from the one with the shortest list in the segment
  to the longest; a candidate start survives if every further term's list has the position start + offset.
  Windows that lie end to end on one diagonal (document position - item position) are joined to one match.
* proximity: an item is near if at least SHARE of its tokens lie within SLOP positions of one diagonal.  At most
  floor((1 - SHARE) L) of its L tokens can then be missing, so among its m rarest tokens at least m minus that must lie
  there: those lists are offset-adjusted, sorted and scanned, and the candidates checked with all tokens.

Both are exact: nothing is capped or sampled, the order by rarity only saves work.

The benchmark is the query set.  It is searched in blocks of about BLOCK_BYTES, each against all segments, so that neither
the driver nor a worker ever holds more of it than a block (or one longer item).

Defined results: null doc_id (but in drop_contaminated) or item_id, and texts without tokens, match nothing; items of
fewer than N tokens, be it one, must occur whole; rows that repeat a doc_id or item_id match by themselves; an empty
benchmark or table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BROADCAST_BYTES, keyed, private, table, written
from .tokens import TOKENS_SQL, slices, tokenise

N = 13
SHARE, SLOP = 0.8, 6
#: Benchmark text that is searched at once.
BLOCK_BYTES = 4 << 20
#: Places of near candidates that are looked up at once.
PLACES = 1 << 18

SEGMENT = "docs binary, bounds binary, terms binary, counts binary, positions binary"
MATCH = "item_id bigint, doc_id bigint, kind string, item_pos int, doc_pos int, n_tokens int"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for i, texts in slices(batch.column(1)):
            t = tokenise(texts)
            if not len(t.hash):
                continue
            order = np.argsort(t.hash)
            h = t.hash[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            key = np.cumsum(new) - 1 << 32 | order
            key.sort()
            first = np.flatnonzero(new)
            parts = ids[i : i + len(texts)].astype("<i8"), t.bounds.astype("<i8"), h[first], np.diff(np.append(first, len(h))).astype("<u4"), (key & 0xFFFFFFFF).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["docs", "bounds", "terms", "counts", "positions"])


def build_index(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> the stored index, a row for each segment."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(rows.mapInArrow(_segments, SEGMENT), "index")


@dataclass
class Segment:
    docs: np.ndarray
    bounds: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    positions: np.ndarray

    def __post_init__(self):
        self.first = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])
        self.keys = np.repeat(np.arange(len(self.terms)) << 32, self.counts) | self.positions

    def term(self, h: np.ndarray) -> np.ndarray:
        """Number of each term, -1 for those the segment lacks."""
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == h, at, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether the list of each term has the position."""
        key = term << 32 | np.maximum(position, 0)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == key) & (position >= 0) & (term >= 0)

    def lists(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into term, position) for all postings of the terms."""
        some = np.flatnonzero(term >= 0)
        size = self.counts[term[some]].astype(np.int64)
        ends = np.cumsum(size)
        at = np.repeat(self.first[term[some]] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(some, size), self.positions[at].astype(np.int64)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, "right") - 1


@dataclass
class Query:
    """Benchmark items, tokenised."""

    items: np.ndarray
    hash: np.ndarray  # of all their tokens
    bounds: np.ndarray
    n: int

    def __post_init__(self):
        self.size = np.diff(self.bounds)
        self.item = np.repeat(np.arange(len(self.items)), self.size)
        self.offset = np.arange(len(self.hash)) - self.bounds[self.item]
        many = np.maximum(self.size - self.n + 1, 1)
        start = np.repeat(self.bounds[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.window_item = np.repeat(np.arange(len(self.items)), many)
        length = np.minimum(self.n, self.size[self.window_item])
        self.window = start[:, None] + np.minimum(np.arange(self.n), length[:, None] - 1)  # a short one repeats its last token


def _query(items: list, texts: pa.Array, n: int) -> Query:
    t = tokenise(texts)
    ids = np.array([-1 if x is None else x for x in items], np.int64)
    ok = (t.counts > 0) & np.array([x is not None for x in items], bool)
    bounds = np.concatenate([[0], np.cumsum(t.counts[ok])])
    return Query(ids[ok], t.hash[np.repeat(ok, t.counts)], bounds, n)


def _exact(s: Segment, q: Query, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, document, item position, document position, length) of maximal matches; positions within the segment."""
    w = q.window
    c = count[w]
    live = c.min(1) > 0
    w, item = w[live], q.window_item[live]
    order = np.argsort(c[live], 1, kind="stable")
    w = np.take_along_axis(w, order, 1)
    at, p = s.lists(term[w[:, 0]])
    diagonal = p - q.offset[w[at, 0]]
    for k in range(1, q.n):
        token = w[at, k]
        ok = s.has(term[token], diagonal + q.offset[token])
        at, diagonal = at[ok], diagonal[ok]
    first = q.window[live][at, 0]
    start = diagonal + q.offset[first]
    length = np.minimum(q.n, q.size[item[at]])
    doc = s.document(start)
    ok = start + length <= s.bounds[doc + 1]  # within one document
    first, start, length, doc, item = first[ok], start[ok], length[ok], doc[ok], item[at[ok]]
    off = q.offset[first]
    order = np.lexsort([off, start - off, doc, item])
    item, doc, off, start, length = item[order], doc[order], off[order], start[order], length[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] - off[1:] != start[:-1] - off[:-1]) | (off[1:] > off[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(new))[: len(head)] - 1
    return item[head], doc[head], off[head], start[head], off[tail] + length[tail] - off[head]


def _near(s: Segment, q: Query, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, document, first position, tokens) of near matches, the best of each item and document."""
    missing = np.floor((1 - SHARE) * q.size + 1e-9).astype(np.int64)
    present = np.bincount(q.item, count > 0, len(q.items))
    use = np.minimum(2 * missing + 2, q.size)  # the rarest tokens looked up
    order = np.lexsort([count, q.item])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - q.bounds[q.item[order]]
    chosen = np.flatnonzero((rank < use[q.item]) & (present >= q.size - missing)[q.item])
    at, p = s.lists(term[chosen])
    token = chosen[at]
    item, diagonal = q.item[token], p - q.offset[token]
    key = (item << 40) + diagonal + (1 << 32)
    order = np.argsort(key, kind="stable")
    key, item = key[order], item[order]
    # a lower bound: so many postings (tokens may repeat) must lie within SLOP of a diagonal
    need = (use - missing)[item]
    reach = np.arange(len(key)) + need - 1
    ok = reach < len(key)
    ok[ok] = key[reach[ok]] - key[ok] <= SLOP
    leads = np.unique((np.unique(key[ok])[:, None] - np.arange(SLOP + 1)).ravel())  # item << 40 | lead, shifted
    rows = [np.zeros((0, 4), np.int64)]
    size = q.size[(leads >> 40)] if len(leads) else np.zeros(0, np.int64)
    ends = np.cumsum(size) * (SLOP + 1)
    i = 0
    while i < len(leads):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PLACES, "right")))
        rows.append(_found(s, q, term, leads[i:j]))
        i = j
    rows = np.concatenate(rows)
    rows = rows[rows[:, 3] >= (q.size - missing)[rows[:, 0]]]
    rows = rows[np.lexsort([rows[:, 2], -rows[:, 3], rows[:, 1], rows[:, 0]])]  # of an item and a document most tokens first, then the first place
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    return tuple(rows[first].T)


def _found(s: Segment, q: Query, term: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """(item, document, first position, tokens found) for each lead (item << 40 | diagonal + 2^32) and document."""
    item = leads >> 40
    size = q.size[item]
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(leads)), size)
    token = np.repeat(q.bounds[item] - (ends - size), size) + np.arange(ends[-1])
    at = ((leads & (1 << 40) - 1) - (1 << 32))[of] + q.offset[token]
    places = (at[:, None] + np.arange(SLOP + 1)).ravel()
    hit = np.flatnonzero(s.has(np.repeat(term[token], SLOP + 1), places))
    where, row = places[hit], hit // (SLOP + 1)
    doc = s.document(where)
    order = np.lexsort([where, row, doc, of[row]])  # a lead's hits by document, then token
    lead, doc, row, where = of[row[order]], doc[order], row[order], where[order]
    new = np.ones(len(order), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (doc[1:] != doc[:-1])
    another = np.ones(len(order), bool)
    another[1:] = new[1:] | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    if not len(head):
        return np.zeros((0, 4), np.int64)
    return np.stack([item[lead[head]], doc[head], np.minimum.reduceat(where, head), np.add.reduceat(another.astype(np.int64), head)], 1)


def _search(s: Segment, q: Query) -> pa.RecordBatch:
    term = s.term(q.hash)
    count = np.where(term >= 0, s.counts[term], 0).astype(np.int64)
    item, doc, off, start, length = _exact(s, q, term, count)
    near_item, near_doc, near_start, near_n = _near(s, q, term, count)
    other = ~np.isin(near_item << 32 | near_doc, item << 32 | doc)
    near_item, near_doc, near_start, near_n = near_item[other], near_doc[other], near_start[other], near_n[other]
    all_items, all_docs = np.concatenate([item, near_item]), np.concatenate([doc, near_doc])
    kind = ["exact"] * len(item) + ["proximity"] * len(near_item)
    pos = np.concatenate([start, near_start]) - s.bounds[all_docs]
    offs, n = np.concatenate([off, np.zeros(len(near_item), np.int64)]), np.concatenate([length, near_n])
    cols = [pa.array(q.items[all_items]), pa.array(s.docs[all_docs]), pa.array(kind, pa.string()), *(pa.array(x.astype(np.int32)) for x in (offs, pos, n))]
    return pa.RecordBatch.from_arrays(cols, ["item_id", "doc_id", "kind", "item_pos", "doc_pos", "n_tokens"])


def _segment(row: dict) -> Segment:
    view = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
    return Segment(view("docs", "<i8"), view("bounds", "<i8"), view("terms", "<u8"), view("counts", "<u4"), view("positions", "<u4"))


_FIELDS = ("docs", "bounds", "terms", "counts", "positions")


def find_matches(index: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """index, benchmark(item_id, text) -> (item_id, doc_id, kind, item_pos, doc_pos, n_tokens).

    kind 'exact': a maximal run of n_tokens >= n equal tokens (or a whole shorter item), counted from item_pos and doc_pos.
    kind 'proximity', only for pairs without an exact match: n_tokens of the item's tokens are near; item_pos is 0.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    if blocks == 1:
        return _search_block(index, items.toArrow(), n)
    part = F.pmod(F.xxhash64(F.lit(6), "item_id", "text"), F.lit(blocks)).alias("block")
    path = written(items.select(part, "item_id", "text").repartition("block"), "blocks")
    found = [written(_search_block(index, path.where(F.col("block") == k).select("item_id", "text").toArrow(), n), "found") for k in range(blocks)]
    return reduce(DataFrame.union, found)


def _search_block(index: DataFrame, items: pa.Table, n: int) -> DataFrame:
    query = _query(items.column("item_id").to_pylist(), items.column("text"), n) if items.num_rows else None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows if query is not None and len(query.items) else 0):
                yield _search(_segment({c: b.column(k)[i] for k, c in enumerate(_FIELDS)}), query)

    return index.mapInArrow(search, MATCH)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of `docs` that match no benchmark item, with all their columns; each is judged by its own text."""
    p = private(docs)
    docs = keyed(docs, p)
    index = build_index(docs.select(F.col(p).alias("doc_id"), "text"))
    hit = written(find_matches(index, benchmark, n).select(F.col("doc_id").alias(p)).distinct(), "contaminated")
    if hit.count() * 16 <= BROADCAST_BYTES:
        hit = F.broadcast(hit)
    return docs.join(hit, p, "left_anti").drop(p)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


#: DuckDB SQL of op6_decontamination: all token pairs of equal words, by diagonal.
ORACLE = f"""
WITH b AS {TOKENS_SQL.format(id="item_id", text="text", table="benchmark")},
d AS {TOKENS_SQL.format(id="doc_id", text="text", table="documents")},
size AS (SELECT id AS item, count(*) AS n FROM b GROUP BY id),
m AS (SELECT b.id AS item, d.id AS doc, b.pos AS j, d.pos AS p, d.pos - b.pos AS diag FROM b JOIN d ON b.word = d.word SEMI JOIN size ON b.id = size.item),
runs AS (SELECT item, doc, diag, min(j) AS j, min(p) AS p, count(*) AS n FROM
  (SELECT *, j - row_number() OVER (PARTITION BY item, doc, diag ORDER BY j) AS run FROM m) AS x GROUP BY item, doc, diag, run),
exact AS (SELECT runs.* FROM runs JOIN size ON runs.item = size.item WHERE runs.n >= least({N}, size.n)),
near AS (SELECT m.item, m.doc, any_value(size.n - floor({1 - SHARE} * size.n + 1e-9)) AS need FROM m JOIN size ON m.item = size.item
  ANTI JOIN exact ON m.item = exact.item AND m.doc = exact.doc GROUP BY m.item, m.doc HAVING count(DISTINCT m.j) >= need),
leads AS (SELECT DISTINCT m.item, m.doc, near.need, m.diag - s.s AS lead FROM m JOIN near ON m.item = near.item AND m.doc = near.doc, range({SLOP + 1}) AS s(s)),
hits AS (SELECT l.item, l.doc, l.lead, count(DISTINCT m.j) AS n, min(m.p) AS p FROM leads AS l JOIN m ON l.item = m.item AND l.doc = m.doc AND m.diag BETWEEN l.lead AND l.lead + {SLOP}
  GROUP BY l.item, l.doc, l.lead, l.need HAVING count(DISTINCT m.j) >= l.need),
best AS (SELECT *, row_number() OVER (PARTITION BY item, doc ORDER BY n DESC, p) AS k FROM hits)
SELECT item AS item_id, doc AS doc_id, 'exact' AS kind, j::INT AS item_pos, p::INT AS doc_pos, n::INT AS n_tokens FROM exact
UNION ALL SELECT item, doc, 'proximity', 0::INT, p::INT, n::INT FROM best WHERE k = 1
"""
