"""Vectorised byte and word views of a batch of texts, for use inside Arrow tasks.

A batch of texts is one byte buffer with row offsets; words are runs of bytes other than
space and ``\\t\\n\\v\\f\\r`` (the class ``[^\\x20\\x09-\\x0D]+``). All functions work on whole
batches with numpy, so the per-word cost is a few array passes rather than Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets (n + 1 of them) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes, so that array work stays small.

    A text longer than the limit makes a range of its own; nothing is cut.
    """
    _, offs = buffer_of(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a batch: byte ``starts`` and ``ends``, the ``row`` of each, and ``first``, the row's first word.

    With another table of separators the same holds for other runs, such as lines.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE):
        self.buf, self.offs = buf, offs
        n = len(buf)
        solid = ~separators[buf] if n else np.zeros(0, bool)
        held = offs[:-1] < offs[1:]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[1:] = solid[:-1]
            before[offs[:-1][held]] = False
            after[:-1] = solid[1:]
            after[offs[1:][held] - 1] = False
        self.solid = solid
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offs) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, base: np.uint64 = _BASE) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts
        power = np.ones(int(size.max()), np.uint64)
        power[1:] = base
        power = np.cumprod(power, dtype=np.uint64)
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(at, size)
        values = power[place] * (self.buf[self.solid].astype(np.uint64) + np.uint64(1))
        return mix(np.add.reduceat(values, at) + size.astype(np.uint64) * _BASE2)

    def grams(self, hashed: np.ndarray, n: int, base: np.uint64 = _BASE2) -> np.ndarray:
        """Hash of the n words that start at each word; only meaningful where ``whole(n)`` holds."""
        out = np.zeros(len(hashed), np.uint64)
        if len(hashed) < n:
            return out
        m = len(hashed) - n + 1
        total = np.zeros(m, np.uint64)
        for k in range(n):
            total *= base
            total += hashed[k : k + m]
        out[:m] = mix(total)
        return out

    def whole(self, n: int) -> np.ndarray:
        """Whether n words of one text start at each word."""
        return np.arange(len(self)) + n <= self.first[1:][self.row]

    def place(self) -> np.ndarray:
        """Position of each word in its text."""
        return np.arange(len(self)) - self.first[:-1][self.row]


def cover(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie within ``size`` places from one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[bytes, np.ndarray]:
    """The given words of each group joined by one space: bytes and the n + 1 offsets of the groups."""
    size = ends - starts + 1
    per = np.bincount(group, weights=size, minlength=n_groups).astype(np.int64)
    offs = np.zeros(n_groups + 1, np.int64)
    np.cumsum(np.maximum(per, 0), out=offs[1:])
    at = np.cumsum(size) - size
    take = np.arange(int(size.sum()), dtype=np.int64) + np.repeat(starts - at, size)
    np.minimum(take, max(len(buf) - 1, 0), out=take)
    out = buf[take] if len(take) else np.zeros(0, np.uint8)
    if len(size):
        out[at + size - 1] = 0x20
    return out.tobytes(), offs  # each group ends with a space, to be left out


def group_bytes(data: bytes, offs: np.ndarray) -> Iterator[bytes]:
    """The groups of ``joined`` without the trailing space."""
    view = memoryview(data)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        yield view[a : b - 1] if b > a else view[a:a]
