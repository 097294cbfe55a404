"""Words, shingles and their 64-bit hashes for a whole Arrow batch at once, in numpy.

A word is a run of ASCII digits, ASCII letters (lower-cased) or bytes above 0x7F, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A text of fewer words than a shingle has,
but not none, is one shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SHINGLE = 5
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_POWERS = np.cumprod(np.full(64, _P), dtype=_U)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Spans above this many bytes are hashed one by one.
_LONG = 256


class Words(NamedTuple):
    low: np.ndarray  # lower-cased bytes
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    first: np.ndarray  # of each text, in words; one more at the end
    doc: np.ndarray  # of each word
    hash: np.ndarray


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOW[buf]


def words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(buf)
    low = _LOW[buf]
    w = _IS_WORD[low]
    begins, ends = w.copy(), w.copy()
    if n:
        begins[1:] &= ~w[:-1]
        ends[:-1] &= ~w[1:]
        at = offsets[(offsets > 0) & (offsets < n)]  # no word goes on from one text to the next
        begins[at], ends[at - 1] = w[at], w[at - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(low, start, end, first, doc, span_hash(low, start, end))


def span_hash(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: chained mixing of eight bytes at a time and of the length, so no sum of byte values decides; spans of up to eight bytes have different hashes if their lengths are equal."""
    size = end - start
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(low) + 1, "<u8", padded.data, strides=(1,))
    out = size.astype(_U) * _P
    todo = np.flatnonzero(size <= _LONG)
    for k in range(0, _LONG, 8):
        if k:
            todo = todo[size[todo] > k]
        if not len(todo):
            break
        have = np.minimum(size[todo] - k, 8)
        chunk = eight[start[todo] + k] & (~_U(0) >> (_U(64) - _U(8) * np.maximum(have, 1).astype(_U)))
        out[todo] = mix(out[todo] ^ np.where(have > 0, chunk, _U(0)))
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


#: Bytes of a content id.
ID_BYTES = 16


def content_ids(parts: Iterable[tuple[np.ndarray, bytes]]) -> pa.Array:
    """128-bit ids of arrays of bytes or numbers, each with a kind; those of different kinds differ."""
    return pa.array([hashlib.blake2b(p, digest_size=ID_BYTES, person=kind).digest() for p, kind in parts], pa.binary())


def text_ids(low: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Ids of whole texts, as given: equal for equal bytes alone."""
    off = offsets.tolist()
    return content_ids((low[a:b], b"text") for a, b in zip(off, off[1:]))


def common_elements(sets: list[np.ndarray], times: list[np.ndarray] | None = None) -> np.ndarray:
    """How many elements of each set each other set has as well, ``times`` each: rows count with their own times."""
    n, lot = len(sets), 1 << 20
    element = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(element, kind="stable")
    element, row = element[order], row[order]
    weight = np.ones(len(row), np.float32) if times is None else np.concatenate(times)[order].astype(np.float32)
    begin = np.flatnonzero(np.append(True, element[1:] != element[:-1])) if len(element) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(element)))
    out = np.zeros((n, n), np.float32)
    # Elements of few sets of many pair by pair, all others by products.
    few = 64 if n > 256 else 1
    some = np.unique(size[size > 1])
    for k in some[some <= few].tolist():
        at = begin[size == k][:, None] + np.arange(k)
        for i in range(0, len(at), max(1, lot // k**2)):
            part = at[i : i + max(1, lot // k**2)]
            cell = row[part][:, :, None] * n + row[part][:, None, :]
            out += np.bincount(cell.ravel(), np.repeat(weight[part], k), n * n).reshape(n, n)
    often, size = begin[size > few], size[size > few]
    step = max(1, lot // n)
    for i in range(0, len(often), step):
        k = size[i : i + step]
        at = np.repeat(often[i : i + step] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        count = np.zeros((n, len(k)), np.float32)
        count[row[at], np.repeat(np.arange(len(k)), k)] = weight[at]
        out += count @ (count > 0).astype(np.float32).T
    return out


def id_numbers(ids: pa.Array) -> np.ndarray:
    """(ids, 2) numbers that are equal for equal ids; there must be no nulls."""
    _, offs, data = ids.buffers()
    at = np.frombuffer(offs, np.int32)[ids.offset] if len(ids) else 0
    return np.frombuffer(data, np.int64, 2 * len(ids), at).reshape(-1, 2) if len(ids) else np.zeros((0, 2), np.int64)


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each shingle, in order."""
    n, count = len(w.hash), np.diff(w.first)
    acc = np.zeros(n, _U)
    for j in range(k):
        if n > j:
            acc[: n - j] += w.hash[j:] * _POWERS[j]
    ok = np.zeros(n, bool)
    if n >= k:
        ok[: n - k + 1] = w.doc[: n - k + 1] == w.doc[k - 1 :]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at, c = w.first[short], count[short]
        s = np.zeros(len(short), _U)
        for j in range(k - 1):
            has = c > j
            s[has] += w.hash[at[has] + j] * _POWERS[j]
        acc[at] = s + c.astype(_U)
        ok[at] = True
    i = np.flatnonzero(ok)
    return mix(acc[i]), w.doc[i], i
