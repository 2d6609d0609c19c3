"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into pieces by the vocabulary's public pattern.  The distinct pieces that a partition has not met before
are encoded together: an index maps the rank of every adjacent pair to all positions where it occurs; active ranks are
applied in ascending order, each to all its positions at once, and the lists of the pairs to the left and right of
every merge are updated.  Decoding joins the bytes of the ids.

Defined results: null text gives null ids, n_tokens 0 and round_trip true; empty text gives an empty list; texts of any
length are encoded whole; repeated rows each get their row; special-token strings are ordinary text; null doc_id is
carried along; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import buffer, give_back, slices

#: Vocabulary file of base64 tokens and ranks; each executor reads it at this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?[^\s\p{L}\p{N}]++| ?\p{N}++|\s+(?!\S)|\s+"
#: The same cut, faster, for texts in which Python's \w, \d and \s agree with the properties above.
_PLAIN = re.compile(r" ?[^\W\d_]++|'(?:[sdmt]|ll|ve|re)| ?(?:[^\s\w]|_)++| ?\d++|\s+(?!\S)|\s+").findall
_ODD = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af\u2010-\u2027\u2030-\u205e]").search
_EXACT = regex.compile(PATTERN).findall
#: Distinct pieces remembered at once; beyond it a worker starts afresh, which changes no result.
PIECES = 200_000
#: Ranks whose position lists are kept apart at a time; higher ones wait unsorted.
BLOCK = 512
#: Text whose new pieces are encoded together.
GROUP_BYTES = 2 << 20


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.double = np.zeros(len(self.tokens), bool)  # tokens that two equal halves make
        self.double[self.ranks[self.keys >> 32 == (self.keys & 0xFFFFFFFF)]] = True
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = np.array([len(t) for t in self.tokens])
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(-1))

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the pieces."""
        size = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, first = len(data), np.concatenate([[0], np.cumsum(size)])
        token, alive = self.byte[data].astype(np.int32), np.ones(n, bool)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        last = first[1:][size > 0] - 1
        after[last] = -1
        before[first[:-1][size > 0]] = -1
        now = np.full(n, -1, np.int32)  # rank of the pair that begins here
        index: dict[int, list[np.ndarray]] = {}  # rank -> positions, for the ranks below `until`
        active: list[int] = []
        later = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]  # (ranks, positions) from `until` on
        until = 0

        def file(rank: np.ndarray, at: np.ndarray) -> None:
            """Put positions in the lists of their ranks (all below `until`)."""
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            ends = [0, *cut.tolist(), len(at)]
            for k, r in enumerate(rank[ends[:-1]].tolist()):
                part = at[ends[k] : ends[k + 1]]
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        def enter(at: np.ndarray) -> None:
            """Look up the pairs that begin at these positions and list those that can merge."""
            nxt = after[at]
            rank = self.rank(token[at], token[nxt])
            rank[nxt < 0] = -1
            now[at] = rank
            can = rank >= 0
            at, rank = at[can], rank[can]
            soon = rank < until
            if soon.any():
                file(rank[soon], at[soon])
                at, rank = at[~soon], rank[~soon]
            if len(at):
                later.append((rank, at))

        enter(np.arange(n, dtype=np.int32))
        while True:
            if not active:
                rank, at = (np.concatenate(x) for x in zip(*later))
                live = now[at] == rank
                rank, at = rank[live], at[live]
                if not len(at):
                    break
                until = int(rank.min()) + BLOCK
                soon = rank < until
                later[:] = [(rank[~soon], at[~soon])]
                file(rank[soon], at[soon])
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[now[at] == r]
            if not len(at):
                continue
            right = after[at]
            if (right == -1).any():
                raise AssertionError("a pair without its right half")
            if self.double[r]:  # a run of one token: pairs are taken from its left end
                used, chosen = set(), []
                for p, q in zip(at.tolist(), right.tolist()):
                    if p not in used:
                        chosen.append(p)
                        used.add(q)
                at = np.array(chosen, np.int32)
                right = after[at]
            token[at], alive[right], now[right] = r, False, -1
            beyond = after[right]
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            left = before[at]
            both = np.concatenate([at, left[left >= 0]])
            both.sort()
            enter(both[np.concatenate([[True], both[1:] != both[:-1]])])
        return token[alive], np.concatenate([[0], np.cumsum(alive)])[first]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + size[i] of all i, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes texts of one partition; remembers the pieces met."""

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.new: list[bytes] = []
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each piece, piece range of each text); unknown pieces get numbers and wait for learn()."""
        known, bounds, out = self.known, [0], []
        for text in texts:
            got = (_EXACT if _ODD(text) else _PLAIN)(text)
            bounds.append(bounds[-1] + len(got))
            try:
                out.append(np.fromiter(map(known.__getitem__, got), np.int32, len(got)))
            except KeyError:
                for p in got:
                    if p not in known:
                        known[p] = len(known)
                        self.new.append(p.encode())
                out.append(np.fromiter(map(known.__getitem__, got), np.int32, len(got)))
        return np.concatenate([np.zeros(0, np.int32), *out]), np.array(bounds)

    def learn(self) -> None:
        if self.new:
            ids, bounds = self.vocabulary.encode(self.new)
            self.bounds = np.concatenate([self.bounds, bounds[1:] + self.bounds[-1]])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.new = []

    def expand(self, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of texts from their pieces."""
        size = self.bounds[at + 1] - self.bounds[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[_ragged(self.bounds[at], size)], ends[bounds]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts."""
        at, bounds = self.pieces(texts)
        self.learn()
        return self.expand(at, bounds)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, waiting, size = None, [], 0
        for batch in batches:
            for i, texts in slices(batch.column(1)):
                encoder = encoder or Encoder(path)
                waiting.append((batch.slice(i, len(texts)), texts, *encoder.pieces(texts.to_pylist())))
                size += texts.nbytes
                if size >= GROUP_BYTES:
                    yield from flush(encoder, waiting)
                    waiting, size = [], 0
        if waiting:
            yield from flush(encoder, waiting)
        encoder = None
        give_back()

    def flush(encoder: Encoder, waiting: list) -> Iterator[pa.RecordBatch]:
        encoder.learn()
        while waiting:
            rows, texts, at, cut = waiting.pop(0)
            ids, bounds = encoder.expand(at, cut)
            null = np.asarray(rows.column(1).is_null())
            data, offsets = buffer(texts)
            back = encoder.vocabulary.decode(ids)
            ok = np.ones(len(texts), bool)
            if not np.array_equal(back, data):
                ends = np.concatenate([[0], np.cumsum(encoder.vocabulary.size[ids])])[bounds]
                ok = np.array([np.array_equal(back[ends[d] : ends[d + 1]], data[offsets[d] : offsets[d + 1]]) for d in range(len(texts))])
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(null) if null.any() else None)
            yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(np.diff(bounds).astype(np.int32)), pa.array(ok)], ["doc_id", "ids", "n_tokens", "round_trip"])
        if len(encoder.known) > PIECES:
            encoder.forget()

    return run


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids, n_tokens, round_trip), a row for each row.

    round_trip tells that decoding the ids gives the text, byte for byte.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode(path), "doc_id bigint, ids array<int>, n_tokens int, round_trip boolean")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """encoded(doc_id, ids) -> (doc_id, text).  Null ids give null; ids outside the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else v.decode(np.array(x, np.int64)).tobytes().decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
