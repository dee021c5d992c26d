"""The best passages of each question, found where the passages lie: no (question, passage) pair is shuffled but those kept.

Passages stand in tiles, and so do the questions of a scope. The weights of a tile's questions (questions x terms) times
the impacts of a tile's passages (terms x passages) are all their scores at once, by BLAS. A task keeps the k best of each question
so far, by the score to nine places and then by the smaller id, so ties don't depend on tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUESTIONS, TERMS, PASSAGES = 128, 2048, 1024
"""Questions, terms and passages of a product."""
MOST_HELD = 1_000_000
"""Kept passages beyond which a task hands on what it has and starts anew."""
SLACK = 1e-8
"""Scores are compared to nine places; none that could round to a question's last is left out before."""


class Scope:
    """Tiles of the questions of one scope: question numbers, and chunks (terms, weights) of their vocabulary."""

    def __init__(self, question: np.ndarray, term: np.ndarray, weight: np.ndarray, mean: float | None):
        self.mean, self.tiles = mean, []
        own, row = np.unique(question, return_inverse=True)
        for a in range(0, len(own), QUESTIONS):
            mine = (row >= a) & (row < a + QUESTIONS)
            terms, column = np.unique(term[mine], return_inverse=True)
            chunks = []
            for c in range(0, len(terms), TERMS):
                some = (column >= c) & (column < c + TERMS)
                chunks.append((terms[c : c + TERMS], row[mine][some] - a, column[some] - c, weight[mine][some]))
            self.tiles.append((own[a : a + QUESTIONS], chunks, bool((weight[mine] > 0).all())))

    def scores(self, term: np.ndarray, passage: np.ndarray, impact: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each tile: its question numbers, and scores of the n passages; minus infinity where no term is shared."""
        for own, chunks, positive in self.tiles:
            total, shared = np.zeros((len(own), n)), None if positive else np.zeros((len(own), n))
            for terms, row, column, weight in chunks:
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                some = np.flatnonzero(terms[at] == term)
                q, d = np.zeros((len(own), len(terms))), np.zeros((len(terms), n))
                q[row, column], d[at[some], passage[some]] = weight, impact[some]
                total += q @ d
                if shared is not None:
                    q[row, column], d[at[some], passage[some]] = 1, 1
                    shared += q @ d
            yield own, np.where((total if shared is None else shared) > 0, total, -np.inf)


class Best:
    """The k best passages so far, by question and group."""

    def __init__(self, n_questions: int, k: int):
        self.n_questions, self.k = n_questions, k
        self.clear()

    def clear(self) -> None:
        self.held, self.least, self.n = {}, {}, 0

    def add(self, group, questions: np.ndarray, scores: np.ndarray, ids: list) -> None:
        """Scores of passages in order of their ids, a row a question; minus infinity enters nowhere."""
        least = self.least.setdefault(group, np.full(self.n_questions, -np.finfo(np.float64).max))
        hit = scores >= (least[questions] - SLACK)[:, None]
        for r in np.flatnonzero(hit.any(1)).tolist():
            c = np.flatnonzero(hit[r])
            s = np.round(scores[r, c], 9)
            if len(c) > self.k:
                first = np.argsort(-s, kind="stable")[: self.k]
                c, s = c[first], s[first]
            key = (int(questions[r]), group)
            old = self.held.get(key, [])
            new = sorted(old + [(-x, ids[i], float(scores[r, i])) for x, i in zip(s.tolist(), c.tolist())])[: self.k]
            self.n += len(new) - len(old)
            self.held[key] = new
            if len(new) == self.k:
                least[questions[r]] = -new[-1][0]


def search(questions: pa.Array, vocabulary: pa.Array, scopes: dict[object, Scope], k: int, id_type: pa.DataType, group_type: pa.DataType):
    """A function over batches of (passage_id, scope, part, size, t) that yields (question_id, passage_id, part, score).

    With a mean, a scope's scores are BM25 of ``size`` tokens; without one, shared terms over the root of ``size`` distinct ones.
    """

    def made(best: Best) -> pa.RecordBatch:
        rows = [(q, g, i, s) for (q, g), held in best.held.items() for _, i, s in held]
        q, g, i, s = zip(*rows) if rows else ((), (), (), ())
        columns = [questions.take(pa.array(q, pa.int64())), pa.array(i, id_type), pa.array(g, group_type), pa.array(s, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["question_id", "passage_id", "part", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(questions), k)
        for batch in batches:
            for at in range(0, batch.num_rows, PASSAGES):
                part = batch.slice(at, PASSAGES)
                _tile(part.take(pc.sort_indices(part.column("passage_id"))), vocabulary, scopes, best)
                if best.n > MOST_HELD:
                    yield made(best)
                    best.clear()
        yield made(best)

    return run


def _groups(values: pa.Array) -> list[tuple[object, np.ndarray]]:
    """Each distinct value with its places, in order."""
    coded = values.dictionary_encode(null_encoding="encode")
    code = coded.indices.to_numpy(zero_copy_only=False)
    return [(v, np.flatnonzero(code == c)) for c, v in enumerate(coded.dictionary.to_pylist())]


def _tile(part: pa.RecordBatch, vocabulary: pa.Array, scopes: dict[object, Scope], best: Best) -> None:
    many = max(1, len(vocabulary))
    lists = part.column("t")
    row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    number = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    some = np.flatnonzero(number >= 0)
    code, tf = np.unique(row[some] * many + number[some], return_counts=True)
    row, term = code // many, code % many
    size, ids = part.column("size").to_numpy(zero_copy_only=False).astype(np.float64), part.column("passage_id").to_pylist()
    groups = _groups(part.column("part"))
    for value, rows in _groups(part.column("scope")):
        scope = scopes.get(value)
        if scope is None or not len(code):
            continue
        place = np.full(part.num_rows, -1)
        place[rows] = np.arange(len(rows))
        mine = np.flatnonzero(place[row] >= 0)
        impact = np.ones(len(mine)) if scope.mean is None else _bm25(tf[mine], size[row[mine]] / scope.mean)
        for own, scores in scope.scores(term[mine], place[row[mine]], impact, len(rows)):
            if scope.mean is None:
                scores = scores / np.sqrt(np.maximum(size[rows], 1))
            for group, members in groups:
                columns = place[members][place[members] >= 0]
                if len(columns):
                    best.add(group, own, scores[:, columns], [ids[rows[c]] for c in columns.tolist()])


K1, B = 1.5, 0.75


def _bm25(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
