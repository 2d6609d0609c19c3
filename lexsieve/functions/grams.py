"""Sparse n-grams of text, and the hash functions of the index.

The weight of a byte pair tells how rare it is.  A substring of 3 to 8 bytes is a sparse n-gram if both its outer pairs
weigh more than every pair inside; so it depends on its own bytes alone, all 3-byte substrings are such, and what a
string holds a longer string that contains it holds too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

SHORTEST, LONGEST = 3, 8
#: Content, and number, of the documents whose posting lists are stored together.
BLOCK_BYTES, BLOCK_DOCS = 16 << 20, 1 << 16
#: Bytes whose n-grams are looked for at once; rows of a batch of lists.
CHUNK, ROWS = 1 << 20, 1 << 16


def byte_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, upper case, digit, sign) of each byte."""
    score = np.full(256, 40)

    def put(chars: str, value: int) -> None:
        score[[ord(c) for c in chars]] = value

    upper, lower, digits = (slice(65, 91), slice(97, 123), slice(48, 58))
    score[upper], score[lower], score[digits] = 50, 20, 30
    for chars, value in (("QXZqxz", 90), ("JKVWY", 70), ("_", 25), (" \t\n\r", 5), ("(){}[]", 15), (";,.:", 10), ("=+-*/", 12), ("<>!&|^~", 35), ("@#$%`", 60), ("'\"", 8)):
        put(chars, value)
    is_upper, is_digit, is_sign = (np.zeros(256, bool) for _ in range(3))
    is_upper[upper], is_digit[digits] = True, True
    is_sign[[ord(c) for c in "!@#$%^&*"]] = True
    return score, is_upper, is_digit, is_sign


@lru_cache(1)
def pair_weights() -> np.ndarray:
    """Weights of all 256 x 256 byte pairs."""
    score, is_upper, is_digit, is_sign = byte_classes()
    cross = lambda a, b: a[:, None] & b | b[:, None] & a
    bonus = np.select([cross(is_upper, is_sign), cross(is_upper, is_digit), is_upper[:, None] & is_upper], [40, 20, 15], 0)
    a = np.arange(256)
    return score[:, None] + score + bonus + ((31 * a[:, None] + a) & 15)


def positions(data: np.ndarray, shortest: int = SHORTEST, longest: int = LONGEST) -> list[tuple[int, np.ndarray]]:
    """(n, starts of the sparse n-grams of n bytes) for each n."""
    if len(data) < 3:
        return []
    w = pair_weights()[data[:-1], data[1:]]
    out = []
    inner = np.zeros(len(w), w.dtype)  # greatest weight of the pairs inside
    for n in range(3, longest + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        if n > 3:
            inner = np.maximum(inner[:m], w[n - 3 : n - 3 + m])
        ok = np.minimum(w[:m], w[n - 2 : n - 2 + m]) > inner[:m]
        if n >= shortest:
            out.append((n, np.flatnonzero(ok)))
    return out


def grams_of(text: bytes) -> list[bytes]:
    """The distinct sparse n-grams of a string, sorted."""
    return sorted({text[i : i + n] for n, at in positions(np.frombuffer(text, np.uint8)) for i in at.tolist()})


def gram_keys(data: np.ndarray) -> np.ndarray:
    """The distinct sparse n-grams of bytes without NUL as big-endian numbers of 8 bytes, zeros after the end, sorted."""
    parts, wide = [], data.astype(np.uint64)
    for n, at in positions(data):
        key = np.zeros(len(at), np.uint64)
        for k in range(n):
            key |= wide[at + k] << np.uint64(8 * (7 - k))
        parts.append(key)
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def key_bytes(key: np.ndarray) -> pa.Array:
    """The n-grams of keys as a binary array."""
    raw = key.astype(">u8").view(np.uint8).reshape(-1, 8)
    ends = np.concatenate([[0], np.cumsum((raw != 0).sum(1))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(raw[raw != 0])])


def distinct_grams(data: np.ndarray) -> pa.Array:
    """The distinct sparse n-grams of the bytes as a binary array, in byte order."""
    if (data == 0).any():  # a key then doesn't tell where its n-gram ends
        return pa.array(grams_of(data.tobytes()), pa.binary())
    return key_bytes(gram_keys(data))


def posting_blocks(cuts: np.ndarray, seed: str):
    """For mapInArrow: (doc_id, content without NUL) -> (part, ngram, block, n, docs, doc_ids).

    Runs of documents of about BLOCK_BYTES become blocks.  A block has one row with its doc_ids and no n-gram, and a row for
    each distinct n-gram with the places in doc_ids of the n documents that hold it (see packed).  part: the range between
    `cuts` (n-grams as by gram_keys) that the n-gram is in.  seed: makes the numbers of blocks unlike those of other builds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks, size, docs, parts = TaskContext.get().partitionId(), 0, 0, 0, []
        for batch in batches:
            start = 0
            for i, length in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
                size, docs = size + length, docs + 1
                if size >= BLOCK_BYTES or docs == BLOCK_DOCS:
                    parts.append(batch.slice(start, i + 1 - start))
                    yield from _block(parts, cuts, f"{seed}/{task}/{blocks}")
                    start, blocks, size, docs, parts = i + 1, blocks + 1, 0, 0, []
            if start < batch.num_rows:
                parts.append(batch.slice(start))
        if parts:
            yield from _block(parts, cuts, f"{seed}/{task}/{blocks}")

    return run


def _block(batches: list[pa.RecordBatch], cuts: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    number = fnv1a_64(name.encode()) >> 1
    ids = pa.concat_arrays([b.column(0) for b in batches])
    kind = pa.list_(ids.type)

    def rows(part: np.ndarray, ngram: pa.Array, n: np.ndarray, docs: pa.Array, doc_ids: pa.Array) -> pa.RecordBatch:
        block = pa.array(np.full(len(part), number, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), ngram, block, pa.array(n.astype(np.int32)), docs, doc_ids], ["part", "ngram", "block", "n", "docs", "doc_ids"])

    yield rows(np.array([number % (len(cuts) + 1)]), pa.nulls(1, pa.binary()), np.array([len(ids)]), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids).cast(kind))
    for key, n, places in block_lists(pa.concat_arrays([b.column(1) for b in batches])):
        heads = np.cumsum(n) - n
        for at in range(0, len(key), ROWS):
            end = min(at + ROWS, len(key))
            inside = places[heads[at] : heads[end - 1] + n[end - 1]]
            yield rows(np.searchsorted(cuts, key[at:end], "right"), key_bytes(key[at:end]), n[at:end], packed(inside, n[at:end]), pa.nulls(end - at, kind))


def block_lists(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of up to BLOCK_DOCS values without NUL, for each length of n-grams: keys as by gram_keys, ascending, how many of the values
    hold each, and which ones, ascending."""
    data = _joined(texts, b"\0")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64) + 1)  # after the NUL of each
    found: dict[int, list[np.ndarray]] = {}
    for start in range(0, len(data), CHUNK):
        here = data[start : start + CHUNK + LONGEST - 1]
        first, last = np.searchsorted(ends, [start, start + len(here) - 1], "right")
        bounds = np.clip(np.concatenate([[start], ends[first:last], [start + len(here)]]) - start, 0, len(here))
        doc = np.repeat(np.arange(first, last + 1, dtype=np.uint64), np.diff(bounds))
        for n, at, window in _windows(here):
            at = at[: np.searchsorted(at, CHUNK)]  # what begins later is the next chunk's
            if n <= 6:
                some = _distinct(window[at] >> np.uint64(64 - 8 * n) << np.uint64(16) | doc[at])
                found.setdefault(n, []).append(some)
            else:
                mask = np.uint64(2**64 - 1 if n == 8 else 2**64 - 256)
                found.setdefault(n, []).append(np.stack([window[at] & mask, doc[at]]))
    for n, parts in sorted(found.items()):
        if n <= 6:
            pairs = _distinct(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            key, doc = pairs >> np.uint64(16) << np.uint64(64 - 8 * n), pairs & np.uint64(0xFFFF)
        else:
            key, doc = np.concatenate(parts, axis=1)
            names, code = np.unique(key, return_inverse=True)
            pairs = _distinct(code.astype(np.uint64) << np.uint64(16) | doc)
            key, doc = names[pairs >> np.uint64(16)], pairs & np.uint64(0xFFFF)
        if len(key):
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield key[head], np.diff(np.append(head, len(key))), doc.astype(np.int64)


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted (np.unique hashes them first, which takes several times as long)."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])] if len(numbers) else numbers


def _joined(values: pa.Array, between: bytes) -> np.ndarray:
    kind = pa.large_binary()
    lists = pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values.cast(kind))
    return np.frombuffer(pc.binary_join(lists, pa.scalar(between, kind))[0].as_buffer(), np.uint8)


def _windows(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, starts of the sparse n-grams of n bytes that hold no NUL, the 8 bytes from each place on as big-endian numbers)."""
    if len(data) < SHORTEST:
        return
    w = pair_weights().astype(np.uint8).ravel()[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
    window = np.concatenate([data, np.zeros(LONGEST - 1, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        window = window[:-k] << np.uint64(8 * k) | window[k:]
    nul = data == 0
    bad, inner = nul[:-1] | nul[1:], np.zeros(len(w), np.uint8)
    for n in range(SHORTEST, LONGEST + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        if n > SHORTEST:
            inner = np.maximum(inner[:m], w[n - 3 : n - 3 + m])
        bad = bad[:m] | nul[n - 1 : n - 1 + m]
        yield n, np.flatnonzero((np.minimum(w[:m], w[n - 2 : n - 2 + m]) > inner[:m]) & ~bad), window


def packed(places: np.ndarray, n: np.ndarray) -> pa.Array:
    """Binary values of lists, of so many ascending places each: differences as numbers of seven bits a byte, low ones first."""
    gap = np.diff(places, prepend=0)
    head = (np.cumsum(n) - n)[n > 0]
    gap[head] = places[head]
    size = 1 + (gap >= 1 << 7).astype(np.int64) + (gap >= 1 << 14)
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(3):
        more = size > k
        out[(ends - size)[more] + k] = (gap[more] >> 7 * k & 127) | np.where(size[more] > k + 1, 128, 0)
    stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(stops), pa.py_buffer(out)])


def unpacked(docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, how many each value has) of packed lists; a null has none."""
    docs = pc.fill_null(docs, b"")
    data = _joined(docs, b"")
    stops = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(docs)))]).astype(np.int64)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(docs), np.int64)
    ends = np.concatenate([[0], np.flatnonzero(data < 128) + 1])
    begin = ends[:-1]
    place = np.arange(len(data)) - np.repeat(begin, np.diff(ends))
    total = np.cumsum(np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begin))
    upto = np.searchsorted(ends, stops)  # numbers before each value
    n = np.diff(upto)
    return total - np.repeat(np.concatenate([[0], total])[upto[:-1]], n), n


@F.arrow_udf(ArrayType(IntegerType()))
def places(docs: pa.Array) -> pa.Array:
    """The places of packed lists."""
    at, n = unpacked(docs)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(at.astype(np.int32)))


@F.arrow_udf(BinaryType())
def bitmap(lists: pa.Array) -> pa.Array:
    """Lists of places as bits, the lowest first."""
    out = []
    for places in lists:
        bits = np.zeros(BLOCK_DOCS, bool)
        bits[np.asarray(places.values)] = True
        out.append(np.packbits(bits[: np.flatnonzero(bits).max(initial=-1) + 1], bitorder="little").tobytes())
    return pa.array(out, pa.binary())


@F.arrow_udf(StructType().add("docs", BinaryType()).add("n", IntegerType()))
def without(docs: pa.Array, gone: pa.Array) -> pa.Array:
    """Packed lists without the places of a bitmap; null has none of them."""
    at, n = unpacked(docs)
    gone = pc.fill_null(gone, b"")
    bits = np.append(_joined(gone, b""), np.uint8(0))
    size = np.asarray(pc.binary_length(gone)).astype(np.int64)
    row, byte = np.repeat(np.arange(len(n)), n), at >> 3
    known = byte < size[row]
    dead = known & (bits[np.where(known, (np.cumsum(size) - size)[row] + byte, 0)] >> (at & 7) & 1 > 0)
    left = np.bincount(row[~dead], minlength=len(n))
    return pa.StructArray.from_arrays([packed(at[~dead], left), pa.array(left.astype(np.int32))], ["docs", "n"])


@F.arrow_udf(ArrayType(BinaryType()))
def sparse_grams(content: pa.Array) -> pa.Array:
    """Distinct sparse n-grams of each BINARY value; null gives null."""
    lists, ends, valid = [], [0], []
    for value in content:
        ok = value.is_valid
        grams = distinct_grams(np.frombuffer(value.as_buffer(), np.uint8)) if ok else pa.array([], pa.binary())
        valid.append(ok)
        lists.append(grams)
        ends.append(ends[-1] + len(grams))
    values = pa.concat_arrays(lists) if lists else pa.array([], pa.binary())
    mask = pa.array([not v for v in valid]) if not all(valid) else None
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=mask)


def fnv1a_64(text: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in text:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


@F.arrow_udf(StringType())
def fnv1a(content: pa.Array) -> pa.Array:
    """FNV-1a of BINARY values as 16 hex digits, all rows of a batch a byte at a time."""
    size = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in content], np.int64)
    data = np.frombuffer(b"".join(v.as_buffer().to_pybytes() for v in content if v.is_valid), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    h = np.full(len(size), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")  # rows of more than k bytes
    for k, n in enumerate(live.tolist()):
        rows = order[:n]
        h[rows] = (h[rows] ^ data[start[rows] + k]) * np.uint64(0x100000001B3)
    return pa.array([f"{x:016x}" if v.is_valid else None for x, v in zip(h.tolist(), content)], pa.string())


def fnv1a_column(content: Column) -> Column:
    """The same without Python, in 32-bit halves, for short values (n-grams, paths)."""
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    digits = F.hex(content)
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("h"), F.lit(0x84222325).cast("bigint").alias("l"))

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
        t = acc["l"].bitwiseXOR(byte)
        low = t * 435
        high = acc["h"] * 435 + F.shiftright(low, 32) + F.shiftleft(t.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(mask).alias("h"), low.bitwiseAND(mask).alias("l"))

    n = F.octet_length(content)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    half = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.aggregate(at, start, step, lambda acc: F.concat(half(acc["h"]), half(acc["l"])))
