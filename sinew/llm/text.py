"""Vectorised work on the UTF-8 bytes of many texts at once.

Every byte of a multi-byte character is 0x80 or above, so classes of ASCII characters (separators, white
space, digits) can be decided byte by byte with the same result as code point by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
PIECE = 1 << 16  # bytes hashed at once; temporaries stay in the processor's cache, and tables of powers small


def _table(excluded: list[tuple[int, int]]) -> np.ndarray:
    inside = np.ones(256, bool)
    for a, b in excluded:
        inside[a : b + 1] = False
    return inside


#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
PLAIN_WORD = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED_WORD = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """A run of texts: one byte array and the n + 1 offsets of the texts in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """From an Arrow column of strings; null counts as empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(raw[at[0] : at[-1]], at - at[0])

    def part(self, a: int, b: int) -> Texts:
        o = self.offsets[a : b + 1]
        return Texts(self.data[o[0] : o[-1]], o - o[0])

    def blocks(self, limit: int) -> Iterator[tuple[int, int]]:
        """Ranges of whole texts of `limit` bytes together, or one longer text."""
        a = 0
        while a < len(self):
            b = int(np.searchsorted(self.offsets, self.offsets[a] + limit, "right")) - 1
            b = max(a + 1, b)
            yield a, b
            a = b

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words (maximal runs of bytes of the class, never across texts); each text's first word, n + 1."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        member = inside[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = member[:-1]
        starts = np.flatnonzero(member & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = member[1:]
        ends = np.flatnonzero(member & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the \\n-split lines of each text, and each text's first line."""
        breaks = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.offsets, breaks, "right") - 1
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        first = np.searchsorted(owner, np.arange(len(self) + 1)) + np.arange(len(self) + 1)
        # An empty text has one empty line, and shares its start with the next text's first line.
        ends = np.empty(len(starts), np.int64)
        is_last = np.zeros(len(starts), bool)
        is_last[first[1:] - 1] = True
        ends[is_last] = self.offsets[1:]
        ends[~is_last] = breaks
        return starts, ends, first


class Hasher:
    """64-bit polynomial hashes of byte ranges over a random table of byte values, from prefix sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = (int(rng.integers(0, 1 << 60)) << 3) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) <= n:
            size = 1 << max(n, 1024).bit_length()
            self._powers = self._run(self.base, size)
            self._inverses = self._run(self.inverse, size)

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums of values times powers before each position; data of a bounded piece."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self._powers[: len(data)], out=out[1:])
        return out

    def windows(self, data: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all ranges of `width` bytes, by start."""
        if len(data) < width:
            return np.zeros(0, np.uint64)
        p = self.prefix(data)
        return mixed((p[width:] - p[:-width]) * self._inverses[: len(p) - width])

    def _raw(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p = self.prefix(data)
        return (p[ends] - p[starts]) * self._inverses[starts]

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ranges in ascending order; a range may be of any length."""
        out = np.empty(len(starts), np.uint64)
        i, n = 0, len(starts)
        while i < n:
            j = int(np.searchsorted(ends, starts[i] + PIECE, "right"))
            if j > i:
                a, b = starts[i], ends[j - 1]
                out[i:j] = self._raw(data[a:b], starts[i:j] - a, ends[i:j] - a)
                i = j
                continue
            total, power, step = 0, 1, pow(self.base, PIECE, 1 << 64)
            for a in range(int(starts[i]), int(ends[i]), PIECE):
                piece = data[a : min(a + PIECE, int(ends[i]))]
                total += power * int(self.prefix(piece)[-1])
                power = power * step & _MASK
            out[i] = total & _MASK
            i += 1
        for a in range(0, n, PIECE):
            b = a + PIECE
            out[a:b] = mixed(out[a:b] + (ends[a:b] - starts[a:b]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalises a 64-bit hash so that all its bits can serve as bucket numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` consecutive items each, by start."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mixed(out)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's items."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def owners(first: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """The text of each item."""
    return np.repeat(np.arange(len(first) - 1, dtype=kind), np.diff(first))
