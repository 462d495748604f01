"""Words, word n-grams and byte n-grams of many texts at once, as numpy arrays over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together until they have this many bytes.
BLOCK = 1 << 20

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_COEF = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(int(_BASE), -1, 1 << 64))
_POW = np.ones(1, dtype=np.uint64)
_IPOW = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    global _POW, _IPOW
    if _POW.size < n:
        size = max(n, 2 * _POW.size)
        _POW = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _IPOW = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, _INV)]), dtype=np.uint64)
    return _POW[:n], _IPOW[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def table(keep) -> np.ndarray:
    """Which byte values belong to words; bytes of non-ASCII characters (128 and over) always do."""
    return np.array([b >= 128 or keep(b) for b in range(256)])


#: Words without ASCII white space: [^\x20\x09-\x0D]+
SPACED = table(lambda b: b not in (9, 10, 11, 12, 13, 32))
#: Words of digits, ASCII letters in lower case and non-ASCII characters: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = table(lambda b: 48 <= b <= 57 or 97 <= b <= 122)
#: A-Z to a-z, other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of a block of texts: ``start`` and ``end`` in bytes, ``doc`` (row), and 64-bit ``hash``.

    ``first[d]`` is the number of words before row ``d``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wordly: np.ndarray):
        self.data, self.offsets = data, offsets
        n = data.size
        inside = wordly[data]
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        after = np.concatenate([inside[1:], [False]]) if n else inside
        edge = offsets[(offsets > 0) & (offsets < n)]
        if n:
            before[edge] = False
            after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = range_hash(data, self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``k`` words of one text, and the index of its first word."""
        m = self.start.size - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1:])
        out = np.zeros(at.size, np.uint64)
        for j in range(k):
            out += self.hash[at + j] * _COEF[j]
        return mix(out), at

    def text(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j`` joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j]))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes modulo 2**64, starting with 0."""
    pw, _ = powers(data.size + 1)
    out = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[:-1], out=out[1:])
    return out


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of the bytes of each range."""
    sums = prefix_sums(data) if sums is None else sums
    _, ipw = powers(data.size + 1)
    return mix((sums[end] - sums[start]) * ipw[start] + (end - start).astype(np.uint64) * _COEF[255])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` consecutive values."""
    n = x.size
    if n < w:
        return x[:0]
    m = -(-n // w) * w
    pad = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    pad = pad.reshape(-1, w)
    left = np.minimum.accumulate(pad, axis=1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


#: Low bits of an anchor key that hold the position, so that the leftmost of equal values wins; and windows per step.
_AT, _MANY = 22, 1 << 21


def anchors(values: np.ndarray, w: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: each window of ``w`` values picks its smallest value (leftmost of ties).

    ``valid`` says which windows (by first value) count. Returns, per run of valid windows with one pick: its position, the first
    window and the last window. What a window picks depends on its own values only; runs are cut every ``_MANY`` windows.
    """
    out = []
    for base in range(0, valid.size, _MANY):
        part = values[base:min(base + _MANY, valid.size) + w - 1]
        key = (part >> U(_AT) << U(_AT)) | np.arange(part.size, dtype=np.uint64)
        pick = (sliding_min(key, w) & U((1 << _AT) - 1)).astype(np.int64) + base
        pick[~valid[base:base + pick.size]] = -1
        new = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]])) if pick.size else pick
        last = np.concatenate([new[1:], [pick.size]]) - 1 if pick.size else pick
        ok = pick[new] >= 0
        out.append((pick[new][ok], new[ok] + base, last[ok] + base))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones that Spark stores."""
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
