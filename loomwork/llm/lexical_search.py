"""Ranked lexical search: all documents scored for every item by dense blocked matrix products.

Scores are sums of integer term weights times integer impacts. One scan tokenises the documents and
writes, of each, its length and the items' terms it holds (numbers and occurrences); counts of the
whole corpus (documents, words, document frequencies) come from that table, and the scoring reads it
too, so no text is read twice and nothing of a document is shuffled.

Items stand in tiles. A tile has a compact vocabulary, that of its items, cut into chunks of at most
``TERMS`` terms. For each tile of documents, the weights of a chunk (items x terms) are multiplied by
the documents' impacts (terms x documents) in float64 by BLAS. All numbers are integers, and a chunk
ends where an item's weights times the largest impact could reach 2^53, so every partial sum is exact;
chunks are added up as 64-bit integers.

A task keeps the best ``k`` documents of each item so far. From a tile it takes all that score more
than the last of them, or as much with a smaller id, so ties never depend on tiles. What tasks keep is
ranked within salted groups of tasks first, then over all.

Items are sent to all tasks: at most ``MAX_ITEMS`` or ``MAX_BYTES`` of text a shard; more items are
searched in several shards, one after another.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.scratch import stored
from loomwork.llm.textnp import slices
from loomwork.llm.vocabulary import Vocabulary, folded_words

K = 50
ITEMS, TERMS, DOCUMENTS = 128, 2048, 1024
"""Items, terms and documents of a tile."""
MAX_ITEMS, MAX_BYTES = 20_000, 16 << 20
EXACT = (1 << 53) - 1
LARGEST_IMPACT = 1_000_000
SALTS = 256
_TERM = re.compile(b"[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+")


def terms_of(text: str | None) -> set[bytes]:
    """Distinct terms of a text; only A-Z are lower-cased."""
    return {t.lower() for t in _TERM.findall((text or "").encode())}


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


_HELD = "doc_id long, n long, terms binary, tf binary"


def _held(vocabulary: Vocabulary):
    """Of every document with a term: its length, and which terms of the vocabulary it holds how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = folded_words(part.column("text"))
                number = vocabulary.numbers(words)
                at = np.flatnonzero(number >= 0)
                code, tf = np.unique(words.row[at] * max(1, len(vocabulary)) + number[at], return_counts=True)
                row, term = code // max(1, len(vocabulary)), (code % max(1, len(vocabulary))).astype("<i4")
                some = np.flatnonzero(words.counts > 0)
                first, last = np.searchsorted(row, some), np.searchsorted(row, some, "right")
                ids = part.column("doc_id").take(pa.array(some))
                columns = [ids, pa.array(words.counts[some].astype(np.int64)), _cut(term, first, last), _cut(tf.astype("<i8"), first, last)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"])

    return run


def _cut(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    return pa.array([values[a:z].tobytes() for a, z in zip(first.tolist(), last.tolist())], pa.binary())


def _frequencies(n_terms: int):
    """Partial (term, documents that hold it) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["term", "df"])

    return run


@dataclass
class Tile:
    """Items and the chunks of their vocabulary: terms, and the weights as (item, column, weight) of a chunk's matrix."""

    items: list[int]
    chunks: list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]


def tiles(terms: Sequence[Sequence[int]], weights: np.ndarray, n_items: int = ITEMS, n_terms: int = TERMS, exact: int = EXACT) -> list[Tile]:
    """Neighbouring items share a tile while it stays within ``n_items`` and ``n_terms``; an item with more terms has a tile of several chunks."""
    out: list[Tile] = []
    held: list[int] = []
    vocabulary: set[int] = set()
    for k, mine in enumerate(terms):
        mine = [t for t in mine if weights[t] > 0]
        if not mine:
            continue
        if held and (len(held) == n_items or len(vocabulary.union(mine)) > n_terms):
            out.append(_tile(held, terms, weights, n_terms, exact))
            held, vocabulary = [], set()
        held.append(k)
        vocabulary.update(mine)
    if held:
        out.append(_tile(held, terms, weights, n_terms, exact))
    return out


def _tile(items: list[int], terms: Sequence[Sequence[int]], weights: np.ndarray, n_terms: int, exact: int) -> Tile:
    row, term = (np.array(x, np.int64) for x in zip(*((r, t) for r, k in enumerate(items) for t in terms[k] if weights[t] > 0)))
    vocabulary, column = np.unique(term, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column, value = row[order], column[order], weights[term[order]]
    edges, total, first = [0], np.zeros(len(items), np.int64), np.searchsorted(column, np.arange(len(vocabulary) + 1))
    for c in range(len(vocabulary)):
        mine = slice(first[c], first[c + 1])
        total[row[mine]] += value[mine] * LARGEST_IMPACT
        if c > edges[-1] and (c - edges[-1] == n_terms or total.max() > exact):
            edges.append(c)
            total[:] = 0
            total[row[mine]] = value[mine] * LARGEST_IMPACT
    chunks = []
    for a, z in zip(edges, [*edges[1:], len(vocabulary)]):
        mine = slice(first[a], first[z])
        chunks.append((vocabulary[a:z], (row[mine], column[mine] - a, value[mine])))
    return Tile(items, chunks)


class Best:
    """The k best documents of each item so far: by score, then by the smaller id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score, self.doc = [np.zeros(0, np.int64)] * n_items, [np.zeros(0, np.int64)] * n_items
        self.least, self.last = np.zeros(n_items, np.int64), np.full(n_items, np.iinfo(np.int64).min)

    def add(self, items: Sequence[int], scores: np.ndarray, docs: np.ndarray) -> None:
        """Scores of some documents, a row an item; those that beat the item's last enter."""
        items = np.asarray(items)
        least, last = self.least[items, None], self.last[items, None]
        hit = (scores > least) | ((scores == least) & (docs[None, :] < last))
        row, column = np.nonzero(hit)
        cuts = np.searchsorted(row, np.arange(len(items) + 1))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            c, item = column[cuts[r] : cuts[r + 1]], int(items[r])
            score, doc = np.concatenate([self.score[item], scores[r, c]]), np.concatenate([self.doc[item], docs[c]])
            order = np.lexsort((doc, -score))[: self.k]
            self.score[item], self.doc[item] = score[order], doc[order]
            if len(order) == self.k:
                self.least[item], self.last[item] = self.score[item][-1], self.doc[item][-1]


def impacts(n: np.ndarray, tf: np.ndarray, row: np.ndarray, corpus_n: int, corpus_words: int) -> np.ndarray:
    """Impact of each posting (tf, row of its document) for documents of n words."""
    size, which = np.unique(n, return_inverse=True)
    m = np.array([50 + 50 * s * corpus_n // corpus_words for s in size.tolist()], np.int64)[which]  # whole integers: n x N may pass 64 bits
    return 1_000_000_000 * tf // (1000 * tf + 20 * m[row])


def _scored(found: list[Tile], item_ids: list[int], n_terms: int, corpus_n: int, corpus_words: int, k: int, n_documents: int = DOCUMENTS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(item_ids), k)
        weights = []
        for tile in found:
            made = []
            for terms, (row, column, value) in tile.chunks:
                q = np.zeros((len(tile.items), len(terms)))
                q[row, column] = value
                place = np.full(n_terms, -1, np.int32)
                place[terms] = np.arange(len(terms))
                made.append((q, place))
            weights.append(made) if len(found) <= 16 else weights.append(None)
        for batch in batches:
            for at in range(0, batch.num_rows, n_documents):
                part = batch.slice(at, n_documents)
                doc, n = part.column("doc_id").to_numpy(), part.column("n").to_numpy()
                held = part.column("terms").to_pylist()
                term, tf = np.frombuffer(b"".join(held), "<i4"), np.frombuffer(b"".join(part.column("tf").to_pylist()), "<i8")
                row = np.repeat(np.arange(len(doc)), [len(h) // 4 for h in held])
                impact = impacts(n, tf, row, corpus_n, corpus_words)
                for tile, made in zip(found, weights):
                    total = None
                    for c, (terms, (r, column, value)) in enumerate(tile.chunks):
                        if made is None:  # many tiles: their matrices are made when needed
                            q, place = np.zeros((len(tile.items), len(terms))), np.full(n_terms, -1, np.int32)
                            q[r, column] = value
                            place[terms] = np.arange(len(terms))
                        else:
                            q, place = made[c]
                        mine = place[term]
                        some = np.flatnonzero(mine >= 0)
                        d = np.zeros((len(terms), len(doc)))
                        d[mine[some], row[some]] = impact[some]
                        more = (q @ d).astype(np.int64)
                        total = more if total is None else total + more
                    best.add(tile.items, total, doc)
        for a in range(0, len(item_ids), 1000):
            some = [i for i in range(a, min(a + 1000, len(item_ids))) if len(best.doc[i])]
            if some:
                ids = np.repeat(np.array([item_ids[i] for i in some], np.int64), [len(best.doc[i]) for i in some])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([best.doc[i] for i in some])), pa.array(np.concatenate([best.score[i] for i in some]))], names=["item_id", "doc_id", "score"])

    return run


def _top(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of each item, in two steps, so that no task gets the candidates of all tasks for an item."""
    order = [F.col("score").desc(), F.col("doc_id")]
    salted = candidates.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (score above 0) of every item.

    Documents without an id count in the corpus figures but can't be named, so they are not returned.
    Repeated rows are documents each: they count each and rank one after another. Texts of one
    item id count together, a term once; items without an id, a text or a known term have no rows. Null
    and empty texts hold no term. Other columns are not read; empty tables give no rows.
    """
    spark = documents.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_shards = max(1, -(-2 * size.n // MAX_ITEMS) if size.n > MAX_ITEMS else 1, -(-2 * size.bytes // MAX_BYTES) if size.bytes > MAX_BYTES else 1)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = []
    for shard in range(n_shards):
        mine = asked if n_shards == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_shards)) == shard)
        held: dict[int, set[bytes]] = {}
        for r in mine.collect():
            held.setdefault(r.item_id, set()).update(terms_of(r.text))
        vocabulary = Vocabulary(t for v in held.values() for t in v)
        table = stored(texts.mapInArrow(_held(vocabulary), _HELD), "held-terms")
        corpus = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        df = np.zeros(len(vocabulary), np.int64)
        counted = table.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
        weights = np.array([weight(corpus.n, d) if d else 0 for d in df.tolist()], np.int64)
        number = {w: k for k, w in enumerate(vocabulary.words)}
        ids = sorted(held)
        found = tiles([sorted(number[t] for t in held[i]) for i in ids], weights)
        scored = _scored(found, ids, len(vocabulary), corpus.n, corpus.words, k)
        best = _top(table.where(F.col("doc_id").isNotNull()).mapInArrow(scored, "item_id long, doc_id long, score long"), k)
        out.append(best if n_shards == 1 else stored(best, "ranked"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


ORACLE_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS words FROM docs),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, doc_id, sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // words)))))::BIGINT AS score
  FROM i JOIN df USING (term) JOIN tf USING (term) JOIN docs USING (doc_id), corpus GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= {K}"""
