"""Compact form of a sorted posting list: differences as variable-length numbers of seven bits a byte."""

from __future__ import annotations

import numpy as np


def encode_list(ids: list[int] | np.ndarray) -> bytes:
    """Bytes of an ascending list of numbers from 0 to 2^63 - 1."""
    a = np.asarray(ids, np.int64)
    gaps = np.diff(a, prepend=0).astype(np.uint64)
    if len(a) and (a[0] < 0 or (np.diff(a) < 0).any()):
        raise ValueError("the list isn't ascending")
    size = np.ones(len(a), np.int64)
    for k in range(1, 10):
        size += gaps >= np.uint64(1 << 7 * k) if k < 9 else gaps >> np.uint64(63) > 0
    at = np.cumsum(size) - size
    out = np.zeros(size.sum(), np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        part = (gaps[more] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
        out[at[more] + k] = part | np.where(size[more] > k + 1, np.uint8(128), np.uint8(0))
    return out.tobytes()


def decode_list(data: bytes) -> np.ndarray:
    """The list again; a number cut off at the end, or of more than ten bytes, is an error."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    if not len(last) or last[-1] != len(b) - 1:
        raise ValueError("the list is cut off")
    start = np.concatenate([[0], last[:-1] + 1])
    if (last - start).max() > 9:
        raise ValueError("a number is too long")
    place = np.arange(len(b)) - np.repeat(start, last - start + 1)
    parts = (b & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.cumsum(np.add.reduceat(parts, start)).astype(np.int64)
