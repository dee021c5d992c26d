"""Which texts stand whole in which passages, or hold them, by their words: one scan of the passages, in which pairs are found and checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PASSAGES = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)


def codes(numbers: np.ndarray, shingle: int) -> np.ndarray:
    """A code of each run of ``shingle`` word numbers; equal runs have equal codes."""
    total = np.zeros(max(0, len(numbers) - shingle + 1), np.uint64)
    for k in range(shingle if len(total) else 0):
        total = (total ^ (total >> np.uint64(29))) * _BASE + (numbers[k : k + len(total)] + 1).astype(np.uint64)
    return total


class Texts:
    """Texts as word numbers, with the codes of their heads and of all their runs in order."""

    def __init__(self, words: list[list[str]], shingle: int):
        self.shingle = shingle
        coded = pa.array([w for text in words for w in text], pa.string()).dictionary_encode()
        ends = np.cumsum([len(text) for text in words])
        self.vocabulary = coded.dictionary
        self.numbers = np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends[:-1]) if words else []
        runs = [codes(n, shingle) for n in self.numbers]
        self.heads = self._sorted(np.array([r[0] for r in runs], np.uint64), np.arange(len(runs)), np.zeros(len(runs), np.int64))
        sizes = [len(r) for r in runs]
        place = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0, np.int64)
        self.runs = self._sorted(np.concatenate(runs) if runs else np.zeros(0, np.uint64), np.repeat(np.arange(len(runs)), sizes), place)

    @staticmethod
    def _sorted(code: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(code, kind="stable")
        return code[order], text[order], place[order]

    def pairs(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(text, row) pairs, each once, of which one holds the other."""
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = pc.fill_null(pc.index_in(words.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(n)
        first, found = end - n, set()
        code = codes(number, self.shingle)
        strange = np.concatenate([[0], np.cumsum(number < 0)])
        row = np.repeat(np.arange(len(n)), n)[: len(code)]
        at = np.flatnonzero((np.arange(len(code)) + self.shingle <= end[row]) & (strange[self.shingle :][: len(code)] == strange[: len(code)]))
        for text, _, s in self._met(self.heads, code, at):
            mine = self.numbers[text]
            if s + len(mine) <= end[row[s]] and np.array_equal(number[s : s + len(mine)], mine):
                found.add((text, int(row[s])))
        for text, place, s in self._met(self.runs, code, at[at == first[row[at]]]):
            size = int(n[row[s]])
            mine = self.numbers[text][place : place + size]
            if len(mine) == size and np.array_equal(number[s : s + size], mine):
                found.add((text, int(row[s])))
        out = np.array(sorted(found), np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]

    @staticmethod
    def _met(held: tuple[np.ndarray, np.ndarray, np.ndarray], code: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        known, text, place = held
        low, high = np.searchsorted(known, code[at]), np.searchsorted(known, code[at], "right")
        for k in np.flatnonzero(high > low).tolist():
            for j in range(low[k], high[k]):
                yield int(text[j]), int(place[j]), int(at[k])


def search(items: pa.Array, texts: Texts):
    """A function over batches of (passage_id, w) that yields (item_id, passage_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PASSAGES):
                part = batch.slice(a, PASSAGES)
                text, row = texts.pairs(part.column("w"))
                yield pa.RecordBatch.from_arrays([items.take(pa.array(text)), part.column("passage_id").take(pa.array(row))], names=["item_id", "passage_id"])

    return run
