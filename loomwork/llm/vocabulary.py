"""A fixed list of words, found among the words of a batch of texts by hash and then byte by byte."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from loomwork.llm.textnp import Words, buffer_of

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
"""A-Z lower-cased, all other bytes as they are."""

MARKS = np.ones(256, bool)
MARKS[0x30:0x3A] = MARKS[0x41:0x5B] = MARKS[0x61:0x7B] = MARKS[0x80:] = False
"""Separators of words of ASCII letters, digits and all that is not ASCII."""


def folded_words(column: pa.Array) -> Words:
    """Maximal runs of letters, digits and non-ASCII bytes of each text, A-Z lower-cased; a null has none."""
    buf, offs = buffer_of(column)
    return Words(FOLD[buf], offs, MARKS)


class Vocabulary:
    """Distinct words in byte order; a word's number is its place among them."""

    def __init__(self, words: Iterable[bytes]):
        self.words = sorted(set(words))
        size = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.bytes = np.frombuffer(b"".join(self.words), np.uint8)
        every = Words(self.bytes, np.concatenate([[0], self.ends]), np.zeros(256, bool))
        hashed, base = every.hashes(), np.uint64(0x9E3779B97F4A7C15)
        while len(np.unique(hashed)) < len(hashed):  # another base until no two words share a hash
            base += np.uint64(2)
            hashed = every.hashes(base)
        self.base = base
        order = np.argsort(hashed)
        self.hashed, self.number = hashed[order], order
        self.near = np.zeros(1 << 18, bool)
        self.near[(hashed & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.words)

    def numbers(self, words: Words) -> np.ndarray:
        """The number of each word, or -1 where it is none of the vocabulary."""
        out = np.full(len(words), -1, np.int64)
        if not len(self) or not len(words):
            return out
        hashed = words.hashes(self.base)
        some = np.flatnonzero(self.near[(hashed & np.uint64((1 << 18) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashed, hashed[some]), len(self) - 1)
        same = self.hashed[at] == hashed[some]
        some, number = some[same], self.number[at[same]]
        size = words.ends[some] - words.starts[some]
        same = size == self.ends[number] - self.starts[number]
        some, number, size = some[same], number[same], size[same]
        if not len(some):
            return out
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        unlike = words.buf[place + np.repeat(words.starts[some], size)] != self.bytes[place + np.repeat(self.starts[number], size)]
        same = np.add.reduceat(unlike, begin, dtype=np.int64) == 0
        out[some[same]] = number[same]
        return out
