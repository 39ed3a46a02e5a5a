"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes of one class inside one text. Work is cut into slices
of about SLICE bytes, and hashing into chunks that end between words, so memory
follows the slice and not the Arrow batch; only a single longer text makes a slice
larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1_000_000
CHUNK = 500_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def table(*ranges: tuple[int, int], high: bool = True) -> np.ndarray:
    """256 flags: class 1 for the given inclusive byte ranges, and for bytes from 0x80 where high."""
    t = np.zeros(256, np.uint8)
    for a, b in ranges:
        t[a : b + 1] = 1
    if high:
        t[128:] = 1
    return t


#: Words between blanks: all but 0x20 and 0x09 to 0x0D.
NOT_BLANK = np.ones(256, np.uint8)
NOT_BLANK[[0x20, 9, 10, 11, 12, 13]] = 0
#: Lower-case letters, digits and all beyond ASCII.
ALNUM = table((0x30, 0x39), (0x61, 0x7A))
#: Class 1: letters and digits; class 2: other visible bytes.
RUNS = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
RUNS[(NOT_BLANK == 1) & (RUNS == 0)] = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0.. and P^-0.. modulo 2^64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, CHUNK + 1)
        for k, base in (("p", _P), ("q", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"], _powers["q"]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[s:e] for each span; values are random 64-bit codes of the symbols."""
    p, q = powers(len(values) + 1)
    h = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=h[1:])
    return mix((h[ends] - h[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Of one slice. data: the bytes; start, end, hash, doc: one each per word; first: index of each text's first word, with the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray | None
    doc: np.ndarray
    first: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without a copy; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets from 0) of runs of texts with about size bytes."""
    data, offsets = buffers(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """The words of the texts in data; with lower, A-Z are lower-cased first."""
    if lower:
        data = _LOWER[data]
    kind = classes[data]
    if len(kind):
        change = np.ones(len(kind) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
        change[offsets] = True
        edge = np.flatnonzero(change)
        live = kind[edge[:-1]] != 0
        start, end = edge[:-1][live], edge[1:][live]
    else:
        start = end = np.zeros(0, np.int64)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    got = None
    if hashed:
        got = np.empty(len(start), np.uint64)
        a = 0
        while a < len(start):  # chunks end between words
            b = max(a + 1, int(np.searchsorted(end, start[a] + CHUNK, "right")))
            low = start[a]
            got[a:b] = span_hashes(_BYTE[data[low : end[b - 1]]], start[a:b] - low, end[a:b] - low)
            a = b
    return Words(data, start, end, got, doc, first)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of n words within one text."""
    if len(w.hash) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(w.hash) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w.hash[k : k + m]
    same = w.doc[:m] == w.doc[n - 1 :]
    return mix(h[same] + np.uint64(n)), w.doc[:m][same]
