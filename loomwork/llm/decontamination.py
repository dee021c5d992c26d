"""Benchmark decontamination: a BM25 inverted index of the test items with block-max WAND, queried with every passage of every document.

Passages are overlapping word windows, twice as long as the longest item, so an item of a text lies
whole in one of them. Items of more than ``ONE_INDEX`` words stand in indexes of their own by length, each
with its own passages, so that a long item does not make those of the short ones long. A passage retrieves each item that scores at least ``SHARE`` of what the item
scores against itself. Items are numbered by self-score and stand in blocks; a term has one posting
list (items and impacts) and the largest impact of each of its blocks.

Retrieval has two steps. For all passages of a batch at once, the block maxima of their terms are
added up; terms with the least impacts, whose sum over a block stays below a part of its lowest
threshold, count as present for that. Passages of which no block reaches its threshold are done. The
others walk their posting lists: cursors stand in order of items, the pivot is the first at which the
terms' largest impacts together reach the item's threshold, its block maxima decide whether it is
scored or a whole block skipped.

A retrieved item counts when the passage holds its question and its answer, or enough of the
item as a whole, so that a change in a short answer can't hide a copy.

Words are compared without the punctuation and symbols at their edges (Unicode categories P and S); a
word of nothing else is left out. An item of one word is held by any text with that word.

The index is a bounded list (``MAX_ITEMS`` items, ``MAX_BYTES`` of text) sent to all tasks; a larger
benchmark is indexed in several such shards, which pass over the documents one after another. Document
frequencies, the mean length and the stride are those of the whole benchmark, so shards change no score.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import textnp
from loomwork.llm.scratch import stored
from loomwork.llm.textnp import buffer_of, slices

K1, B = 1.2, 0.75
SHARE = 0.6
BLOCK = 4
"""Items of a block."""
PASSED_BY = 0.3
SHINGLE, OVERLAP = 5, 0.8
LEAST_STRIDE = 64
ONE_INDEX = 1024
"""Words up to which items share one index and its passages; longer ones have layers of their own."""
MAX_ITEMS, MAX_BYTES = 20_000, 16 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_WORD = re.compile(b"[^\x20\x09-\x0d]+")
_SENTENCE = re.compile(b"(?<=[.!?])[\x20\x09-\x0d]+|\n+")


@lru_cache(1)
def _marks() -> np.ndarray:
    """Of each code point: whether it is punctuation or a symbol."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "PS" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Words(textnp.Words):
    """Words without the punctuation and symbols at their edges; a word of nothing else is left out."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        super().__init__(buf, offs)
        marks = _marks()
        inner = ~marks[:256][buf]
        lead = np.flatnonzero(buf >= 0xC0)
        if len(lead):
            size = np.where(buf[lead] >= 0xF0, 4, np.where(buf[lead] >= 0xE0, 3, 2))
            code = buf[lead].astype(np.int64) & (0x7F >> size)
            for k in range(1, 4):
                more = size > k
                code[more] = code[more] << 6 | (buf[lead[more] + k] & 0x3F)
            mark = marks[np.minimum(code, sys.maxunicode)]
            for k in range(4):
                some = size > k
                inner[lead[some] + k] = ~mark[some]
        at = np.flatnonzero(inner & self.solid)
        before = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(inner & self.solid, out=before[1:])
        a, z = before[self.starts], before[self.ends]
        kept = z > a
        self.starts, self.ends, self.row = at[a[kept]], at[z[kept] - 1] + 1, self.row[kept]
        self.counts = np.bincount(self.row, minlength=len(offs) - 1).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[self.starts] += 1
        edge[self.ends] -= 1
        self.solid = np.cumsum(edge[:-1], dtype=np.int8) > 0


@lru_cache(1 << 16)
def _bare(word: bytes) -> bytes:
    text, marks = word.decode("utf-8", "surrogateescape"), _marks()
    a, z = 0, len(text)
    while a < z and marks[ord(text[a])]:
        a += 1
    while a < z and marks[ord(text[z - 1])]:
        z -= 1
    return text[a:z].encode("utf-8", "surrogateescape")


def bare(words: Sequence[bytes]) -> list[bytes]:
    """The words as ``Words`` has them."""
    return [w for w in map(_bare, words) if w]


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's question and of its answer: the last sentence, or the second half where there is but one."""
    parts = [p for p in (_WORD.findall(x) for x in _SENTENCE.split(_FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes())) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def shingles(words: Sequence[bytes]) -> set[bytes]:
    n = min(SHINGLE, len(words))
    return {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


class Item:
    """What a passage has to hold of an item: its question and its answer, or enough of both together."""

    def __init__(self, text: str):
        question, answer = map(bare, question_and_answer(text))
        self.parts = [(min(SHINGLE, len(p)), shingles(p)) for p in (question, answer)]
        self.whole = (min(SHINGLE, len(question) + len(answer)), shingles(question + answer))

    def within(self, words: Sequence[bytes]) -> bool:
        have: dict[int, set[bytes]] = {}

        def enough(n: int, want: set[bytes]) -> bool:
            if n not in have:
                have[n] = {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
            return len(want & have[n]) >= OVERLAP * len(want)

        return all(enough(*p) for p in self.parts) or enough(*self.whole)


def holds(words: Sequence[bytes], part: Sequence[bytes] | Item) -> bool:
    """Whether a passage holds at least ``OVERLAP`` of the part's five-word shingles (of the whole part where it is shorter), or an item."""
    words = bare(words)
    if isinstance(part, Item):
        return part.within(words)
    part = bare(part)
    want = shingles(part)
    if not want:
        return True
    n = min(SHINGLE, len(part))
    have = {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}
    return len(want & have) >= OVERLAP * len(want)


@dataclass
class Statistics:
    """What scores depend on: items, words in them, and how many items hold a term; and the words of the longest item of an index."""

    n: int
    words: int
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """Posting lists of terms, the largest impact of each of their blocks, and the items."""

    def __init__(self, items: Sequence[tuple[int, str]], known: Statistics | None = None):
        items = [(i, t) for i, t in sorted(items, key=lambda x: (x[0], x[1])) if bare(_WORD.findall(t.encode()))]
        words = _folded(pa.array([t for _, t in items], pa.large_string()))
        self.terms, term = np.unique(words.hashes(), return_inverse=True)
        n, length = len(items), words.counts
        pair, tf = np.unique(term * np.int64(max(n, 1)) + words.row, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        known = known or Statistics(n, int(length.sum()), int(max(length, default=0)), self.terms, np.bincount(term, minlength=len(self.terms)))
        df = known.df[np.searchsorted(known.terms, self.terms)]
        idf = np.log(1 + (known.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(1, known.words / max(1, known.n)))
        impact = (idf[term] * tf * (K1 + 1) / (tf + norm[item])).astype(np.float32)
        own = np.bincount(item, weights=impact, minlength=n)
        order = np.argsort(own, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids = [items[k][0] for k in order]
        self.parts = [(Item(items[k][1]),) for k in order]
        self.threshold = SHARE * own[order]
        by = np.lexsort((place[item], term))
        self.item, self.score = place[item][by], impact[by]
        self.first = np.searchsorted(term[by], np.arange(len(self.terms) + 1))
        self._blocks(term[by])
        self.needed = (self.threshold * (1 - 1e-5)).tolist()
        self.lists: dict[int, tuple[list[int], list[float], dict[int, float], float]] = {}
        self.near = np.zeros(1 << 18, bool)
        self.near[(self.terms & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        self.stride = max(LEAST_STRIDE, known.longest)

    def _blocks(self, term: np.ndarray) -> None:
        """Block maxima of each term, the lowest threshold of each block, and the terms not looked up at first."""
        n_terms, n_blocks = len(self.terms), -(-len(self.ids) // BLOCK)
        self.n_blocks, self.lowest = n_blocks, self.threshold[::BLOCK]
        code = term * max(1, n_blocks) + self.item // BLOCK
        cuts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        self.block, owner = code[cuts] % max(1, n_blocks), code[cuts] // max(1, n_blocks)
        self.most = np.maximum.reduceat(self.score, cuts) if len(cuts) else np.zeros(0, np.float32)
        self.first_block = np.searchsorted(owner, np.arange(n_terms + 1))
        self.top = np.maximum.reduceat(self.score, self.first[:-1]) if n_terms else np.zeros(0, np.float32)
        rank, self.passed = np.argsort(self.top, kind="stable"), np.zeros(n_blocks)
        self.looked_up = np.ones(n_terms, bool)
        for t in rank.tolist():
            a, z = self.first_block[t], self.first_block[t + 1]
            more = self.passed[self.block[a:z]] + self.most[a:z]
            if (more > PASSED_BY * self.lowest[self.block[a:z]]).any():
                break
            self.passed[self.block[a:z]] = more
            self.looked_up[t] = False

    @property
    def impact(self) -> np.ndarray:
        """All impacts, a row a term and a column an item: for looking at small indexes."""
        out = np.zeros((len(self.terms), len(self.ids)), np.float32)
        out[np.repeat(np.arange(len(self.terms)), np.diff(self.first)), self.item] = self.score
        return out

    def term_of(self, hashed: np.ndarray) -> np.ndarray:
        """The term number of each word, or -1."""
        out = np.full(len(hashed), -1, np.int64)
        some = np.flatnonzero(self.near[(hashed & np.uint64((1 << 18) - 1)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.terms, hashed[some]), len(self.terms) - 1)
            out[some] = np.where(self.terms[at] == hashed[some], at, -1)
        return out

    def passages(self, counts: np.ndarray) -> np.ndarray:
        """Passages of texts with so many words; a text has at least one."""
        return np.maximum(1, -(-np.maximum(counts - self.stride, 0) // self.stride))

    def reaching(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Which of n passages, given with the terms looked up, have a block that may reach its threshold."""
        out, step = np.zeros(n, bool), max(1, 4_000_000 // max(1, self.n_blocks))
        for a in range(0, n, step):
            low, high = np.searchsorted(passage, (a, a + step))
            t, size = term[low:high], (self.first_block[term[low:high] + 1] - self.first_block[term[low:high]])
            at = np.repeat(self.first_block[t] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            m = min(step, n - a)
            bound = np.bincount(np.repeat(passage[low:high] - a, size) * self.n_blocks + self.block[at], weights=self.most[at], minlength=m * self.n_blocks)
            out[a : a + m] = (bound.reshape(m, self.n_blocks) + self.passed >= self.lowest * (1 - 1e-5)).any(1)
        return out

    def postings(self, term: int) -> tuple[list[int], list[float], dict[int, float], float]:
        """Items, impacts, block maxima and largest impact of a term, as kept by the task."""
        known = self.lists.get(term)
        if known is None:
            a, z = self.first[term], self.first[term + 1]
            c, d = self.first_block[term], self.first_block[term + 1]
            known = self.lists[term] = (self.item[a:z].tolist(), self.score[a:z].tolist(), dict(zip(self.block[c:d].tolist(), self.most[c:d].tolist())), float(self.top[term]))
        return known

    def wand(self, terms: Sequence[int]) -> list[int]:
        """All items that reach their thresholds with these terms."""
        lists = [self.postings(t) for t in terms]
        cursors = [(p[0][0], k, 0) for k, p in enumerate(lists)]  # item, list, place in it
        least, out, end = self.needed, [], len(self.ids)
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (item, c, _) in enumerate(cursors):
                total += lists[c][3]
                if total >= least[item]:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block, bound = item // BLOCK, 0.0
            for _, c, _ in cursors[: pivot + 1]:
                bound += lists[c][2].get(block, 0.0)
            to = item
            if bound < least[item]:  # thresholds rise with the item, so the rest of the block misses them too
                to = min((block + 1) * BLOCK, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
            elif cursors[0][0] == item:
                if sum(lists[c][1][at] for _, c, at in cursors[: pivot + 1]) >= least[item]:
                    out.append(item)
                to = item + 1
            moved = []
            for here, c, at in cursors[: pivot + 1]:
                if here < to:
                    items = lists[c][0]
                    at = bisect_left(items, to, at)
                    if at == len(items):
                        continue
                    here = items[at]
                moved.append((here, c, at))
            cursors[: pivot + 1] = moved
        return out

    def retrieve(self, words: Words, hashed: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """Passages of each text; and (row, first word, word after the last, item) of every item retrieved."""
        n = self.passages(words.counts)
        begin = np.cumsum(n) - n
        term = self.term_of(hashed)
        at = np.flatnonzero((term >= 0) & self.looked_up[term])
        slot = words.place()[at] // self.stride  # stretch of the text; a passage is a stretch and the next
        row = words.row[at]
        pairs = [(begin[row] + np.minimum(slot, n[row] - 1), term[at])]
        earlier = slot > 0
        pairs.append((begin[row[earlier]] + np.minimum(slot[earlier] - 1, n[row[earlier]] - 1), term[at][earlier]))
        code = np.unique(np.concatenate([p * len(self.terms) + t for p, t in pairs]))
        hits: list[tuple[int, int, int, int]] = []
        for p in np.flatnonzero(self.reaching(code // len(self.terms), code % len(self.terms), int(n.sum()))).tolist():
            text = int(np.searchsorted(begin, p, "right")) - 1
            first = int(words.first[text]) + (p - int(begin[text])) * self.stride
            last = min(first + 2 * self.stride, int(words.first[text + 1]))
            mine = np.unique(term[first:last])
            hits += [(text, first, last, k) for k in self.wand(mine[mine >= 0].tolist())]
        return n, hits

    def found_in(self, words: Words, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """As ``verified``, of words and their hashes."""
        n, hits = self.retrieve(words, hashed) if len(self.ids) else (np.ones(len(words.counts), np.int64), [])
        found: list[set[int]] = [set() for _ in range(len(words.counts))]
        retrieved = np.zeros(len(words.counts), np.int64)
        for text, first, last, item in hits:
            retrieved[text] += 1
            if self.ids[item] not in found[text]:
                passage = [words.buf[a:b].tobytes() for a, b in zip(words.starts[first:last].tolist(), words.ends[first:last].tolist())]
                if all(part.within(passage) for part in self.parts[item]):
                    found[text].add(self.ids[item])
        return n, retrieved, found

    def verified(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Of each text: passages, items retrieved (once a passage), and ids of the items whose question and answer it holds."""
        return Layers([self]).verified(column)


class Layers:
    """Indexes of items of like lengths, asked one after another for the same words: a long item makes only its own passages long."""

    def __init__(self, indexes: Sequence[Index]):
        self.indexes = list(indexes)

    def verified(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """As ``Index.verified``; passages counted are those of the shortest items, retrievals those of all."""
        buf, offs = buffer_of(column)
        words = Words(_FOLD[buf], offs)
        hashed = words.hashes()
        n, retrieved, found = self.indexes[0].found_in(words, hashed)
        for index in self.indexes[1:]:
            _, more, also = index.found_in(words, hashed)
            retrieved, found = retrieved + more, [a | b for a, b in zip(found, also)]
        return n, retrieved, [sorted(x) for x in found]


def length_class(n_words: int) -> int:
    """0 for items of up to ``ONE_INDEX`` words; lengths of a later class differ by less than four times."""
    out = 0
    while n_words > ONE_INDEX << 2 * out:
        out += 1
    return out


def indexed(items: Sequence[tuple[int, str]], known: Statistics | None = None) -> Index | Layers:
    """The index of the items, with layers for long ones; statistics are those of all items, the longest being the longest of class 0."""
    items = sorted(items, key=lambda x: (x[0], x[1]))
    words = _folded(pa.array([t for _, t in items], pa.large_string()))
    classes: dict[int, list[int]] = {0: []}
    for k, n in enumerate(words.counts.tolist()):
        classes.setdefault(length_class(n), []).append(k)
    if known is None:
        terms, term = np.unique(words.hashes(), return_inverse=True)
        held = np.unique(term * np.int64(max(1, len(items))) + words.row) // max(1, len(items))
        longest = int(max(words.counts[classes[0]], default=0))
        known = Statistics(int((words.counts > 0).sum()), int(words.counts.sum()), longest, terms, np.bincount(held, minlength=len(terms)))
    layers = [Index([items[k] for k in mine], known if c == 0 else replace(known, longest=ONE_INDEX << 2 * c)) for c, mine in sorted(classes.items())]
    return layers[0] if len(layers) == 1 else Layers(layers)


def _folded(column: pa.Array) -> Words:
    words = Words(*buffer_of(column))
    return Words(_FOLD[words.buf], words.offs)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, term, words, first) of every distinct term of every item; ``words`` of an item stands in its first row, 0 in the others."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = _folded(part.column("text"))
            row, term = words.row, words.hashes()
            order = np.lexsort((term, row))
            row, term = row[order], term[order]
            new = np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])) if len(row) else np.zeros(0, bool)
            row, term = row[new], term[new]
            first = np.append(True, row[1:] != row[:-1]) if len(row) else new
            shard = part.column("shard").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(term.view(np.int64)), pa.array(np.where(first, words.counts[row], 0)), pa.array(first)], names=["shard", "term", "words", "first"])


def shards(benchmark: DataFrame) -> list[Index | Layers] | _Shards:
    """The index, or several one after another where the benchmark exceeds the bound of one. Items without words or an id are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-2 * size.n // MAX_ITEMS) if size.n > MAX_ITEMS else 1, -(-2 * size.bytes // MAX_BYTES) if size.bytes > MAX_BYTES else 1)
    if n == 1:
        return [indexed([tuple(r) for r in items.collect()])]
    items = items.select(F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("shard"), "item_id", "text")
    terms = stored(items.mapInArrow(_terms, "shard long, term long, words long, first boolean"), "item-terms")
    df = stored(terms.groupBy("term").agg(F.count("*").alias("df")), "item-frequencies")
    whole = terms.agg(F.count_if("first"), F.sum("words"), F.coalesce(F.max(F.when(F.col("words") <= ONE_INDEX, F.col("words"))), F.lit(0))).first()

    def made() -> Iterator[Index | Layers]:
        for k in range(n):
            own = df.join(terms.where(F.col("shard") == k).select("term").distinct(), "term").toArrow()
            term = own.column("term").to_numpy().view(np.uint64)
            order = np.argsort(term)
            known = Statistics(*whole, term[order], own.column("df").to_numpy()[order])
            yield indexed([tuple(r) for r in items.where(F.col("shard") == k).select("item_id", "text").collect()], known)

    return _Shards(n, made)


class _Shards:
    def __init__(self, n: int, made):
        self.n, self.made = n, made

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[Index | Layers]:
        return self.made()


_FOUND = "doc_id long, text string, n_passages long, n_retrieved long, items array<long>"


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_passages, n_retrieved, items (ids, ascending) and contaminated of every document row.

    Null and empty texts have one empty passage and no items; an item id with several texts counts by
    each. Repeated rows are judged each for itself. Other columns are not read; an empty benchmark
    finds nothing; an empty table gives no rows.
    """

    def look(index: Index | Layers):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    n, retrieved, items = index.verified(part.column("text"))
                    retrieved = retrieved + part.column("n_retrieved").to_numpy()
                    items = [sorted({*a, *b}) for a, b in zip(items, part.column("items").to_pylist())]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(n.astype(np.int64)), pa.array(retrieved), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "text", "n_passages", "n_retrieved", "items"])

        return run

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_passages"), F.lit(0).cast("long").alias("n_retrieved"), F.array().cast("array<long>").alias("items"))
    several = shards(benchmark)
    for index in several:
        rows = rows.mapInArrow(look(index), _FOUND)
        if len(several) > 1:
            rows = stored(rows, "found")  # the next shard's index replaces this one
    return rows.select("doc_id", "n_passages", "n_retrieved", "items", (F.size("items") > 0).alias("contaminated"))


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, all columns, that hold no benchmark item; in one scan a shard, without a join.

    Null and empty texts hold none; repeated rows share their fate; ids play no part. A column may have
    any name; an empty benchmark keeps all rows, an empty table gives none.
    """
    at = documents.columns.index("text")

    def keep(index: Index | Layers):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    _, _, items = index.verified(part.column(at))
                    yield part.filter(pa.array([not x for x in items], pa.bool_()))

        return run

    several = shards(benchmark)
    for index in several:
        documents = documents.mapInArrow(keep(index), documents.schema)
        if len(several) > 1:
            documents = stored(documents, "clean")
    return documents
