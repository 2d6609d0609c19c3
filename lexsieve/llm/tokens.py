"""Vectorised word tokens of Arrow string batches.

A token is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text.
Tokens are carried as 64-bit hashes; all work is numpy on the UTF-8 buffer, a few passes a byte.
Null texts count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text that is worked on at once, and text whose bytes are hashed at once.
SLICE_BYTES, HASH_BYTES = 1 << 19, 1 << 17
TOKEN_PATTERN = r"[^\x00-\x2f:-@\[-`{-\x7f]+"

#: The same tokens in DuckDB SQL: (id, word, pos) of a table's texts.
TOKENS_SQL = "(SELECT {id} AS id, unnest(regexp_extract_all(lower({text}), '[^\\x{{00}}-\\x{{2f}}:-@\\[-`\\{{-\\x{{7f}}]+')) AS word, generate_subscripts(regexp_extract_all(lower({text}), '[^\\x{{00}}-\\x{{2f}}:-@\\[-`\\{{-\\x{{7f}}]+'), 1) - 1 AS pos FROM {table})"

_WORD = np.zeros(256, bool)
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8)] = True
_WORD[128:] = True
_BYTE = np.random.Generator(np.random.PCG64(20231)).integers(0, 2**64, 256, dtype=U)
_R = 0xD1342543DE82EF95
_R_INV = pow(_R, -1, 2**64)
def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task, and freed memory would stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; a bijection of 64-bit words."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int) -> np.ndarray:
    steps = np.full(HASH_BYTES + 1, U(base))
    steps[0] = U(1)
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_R), _powers(_R_INV)


def strings(arr: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return pc.fill_null(arr.cast(pa.large_string()), "")


def buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls."""
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + n + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(arr: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about `most` bytes and at most `rows` rows each, whole rows only; a longer row comes alone."""
    arr = strings(arr)
    ends = buffer(arr)[1]
    i, n = 0, len(arr)
    while i < n:
        j = int(np.searchsorted(ends, ends[i] + most, "right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, arr.slice(i, j - i)
        i = j
    give_back()


@dataclass
class Tokens:
    hash: np.ndarray  # uint64 a token
    bounds: np.ndarray  # token range of row d: bounds[d] .. bounds[d + 1]
    start: np.ndarray  # byte offsets in the lower-cased buffer
    end: np.ndarray
    text: np.ndarray  # that buffer
    offsets: np.ndarray  # byte range of a row in it

    def prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the first k bytes, index) of the tokens longer than k bytes."""
        at = np.flatnonzero(self.end - self.start > k)
        start = self.start[at]
        h = np.zeros(len(at), U)
        for j in range(k):
            h += _BYTE[self.text[start + j]] * _UP[j]
        return mix(h + U(k + (1 << 32))), at

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def _places(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, SLICE_BYTES of text at a time."""
    starts, ends, before, n = [], [], False, len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    for a in range(0, n, SLICE_BYTES):
        word = _WORD[text[a : a + SLICE_BYTES]]
        last = np.empty_like(word)
        last[0], last[1:] = before, word[:-1]
        cut = np.zeros(len(word), bool)  # row starts
        lo, hi = np.searchsorted(offsets, [a, a + len(word)])
        cut[offsets[lo:hi] - a] = True
        starts.append((np.flatnonzero(word & (cut | ~last)) + a).astype(kind))
        ends.append((np.flatnonzero(last & (cut | ~word)) + a).astype(kind))
        before = word[-1]
    if before:
        ends.append(np.array([n], kind))
    return np.concatenate([np.zeros(0, kind), *starts]), np.concatenate([np.zeros(0, kind), *ends])


def _hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each token, HASH_BYTES of text at a time: the sum of its bytes' numbers times powers by their place."""
    out, i = np.empty(len(start), U), 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + HASH_BYTES, "right")))
        if int(end[i]) - base > HASH_BYTES:  # one very long token
            total, scale = U(0), U(1)
            with np.errstate(over="ignore"):
                for a in range(base, int(end[i]), HASH_BYTES):
                    part = _BYTE[text[a : min(a + HASH_BYTES, int(end[i]))]]
                    total += (part * _UP[: len(part)]).sum(dtype=U) * scale
                    scale *= _UP[HASH_BYTES]
            out[i] = total
        else:
            part = text[base : int(end[j - 1])]
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(_BYTE[part] * _UP[: len(part)], out=sums[1:])
            a = start[i:j] - base
            out[i:j] = (sums[end[i:j] - base] - sums[a]) * _DOWN[a]
        i = j
    return mix(out + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def tokenise(arr: pa.Array) -> Tokens:
    text, offsets = buffer(strings(pc.utf8_lower(strings(arr))))
    start, end = _places(text, offsets)
    return Tokens(_hashes(text, start, end), np.searchsorted(start, offsets), start, end, text, offsets)


def hash_words(words: list[str]) -> np.ndarray:
    """Hash of each word (each must be one token)."""
    t = tokenise(pa.array(words, pa.large_string()))
    if not (t.counts == 1).all():
        raise ValueError("not one token each")
    return t.hash


def shingles(t: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-token windows, row bounds; a row of 1..k-1 tokens has one window of all its tokens."""
    n, h = len(t.hash), t.hash
    counts = t.counts
    if n == 0:
        return np.zeros(0, U), np.zeros(len(counts) + 1, np.int64)
    m = U(0x9E3779B97F4A7C15)
    acc = np.zeros(n, U)
    for i in range(k):
        acc *= m
        acc[: n - i] += h[i:]
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(t.bounds[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
    out = acc[at]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        a = U(0)
        with np.errstate(over="ignore"):
            for x in h[t.bounds[d] : t.bounds[d + 1]]:
                a = a * m + x
            out[bounds[d]] = a + U(counts[d]) * U(0xC2B2AE3D27D4EB4F)
    return mix(out), bounds
