import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import lexical_search
from loomwork.llm.lexical_search import Best, ranked, tiles
from loomwork.llm.vocabulary import Vocabulary, folded_words

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=50):
    """The ranking by its definition, document by document."""
    tf = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n, words = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(FOLD)))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in tf:
            m = 100 - 50 + 50 * sum(c.values()) * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0 and d is not None:
                found.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_plain_ranking(spark, documents, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "été", "x9", "don't", "naïve", "Straße", "İ", "q"] + [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(300)]
    texts += [texts[0]] * 90 + ["", None, " ,.;", "alpha" * 3, "w1 " * 70_000]
    docs = list(enumerate(texts)) + [(5, texts[5]), (5, "gamma other"), (None, "alpha beta gamma")]
    items = [(k, " ".join(rng.choice(words, rng.integers(1, 12)))) for k in range(40)] + [(3, "gamma q"), (3, "gamma q"), (60, None), (None, "alpha"), (61, "nowhere"), (62, ""), (63, texts[0])]
    items_df = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert rows_of(ranked(documents(docs).repartition(5), items_df)) == want
    clash = documents(docs).selectExpr("*", "1 AS item_id", "2 AS score", "3 AS rank", "4 AS terms", "5 AS n")
    assert rows_of(ranked(clash, items_df.selectExpr("*", "1 AS doc_id", "1 AS score"), 7)) == plain(docs, items, 7)
    monkeypatch.setattr(lexical_search, "MAX_ITEMS", 20)  # several shards
    monkeypatch.setattr(lexical_search.tiles, "__defaults__", (3, 5, lexical_search.EXACT))  # many small tiles
    monkeypatch.setattr(lexical_search._scored, "__defaults__", (16,))
    assert rows_of(ranked(documents(docs), items_df)) == want


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked(documents([]), items).count() == 0
    assert ranked(documents([None, ""]), items).count() == 0
    assert ranked(documents(["a b"]), items.limit(0)).count() == 0
    assert rows_of(ranked(documents(["a", "c"]), items)) == plain([(0, "a"), (1, "c")], [(1, "a b")])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), unique=True, max_size=20), max_size=12), st.integers(1, 4), st.integers(1, 7), st.integers(1, 4))
def test_tiles_hold_every_weight_within_the_bound(terms, n_items, n_terms, bound):
    weights = np.arange(31) % 7
    exact = bound * 6 * lexical_search.LARGEST_IMPACT
    found = tiles(terms, weights, n_items, n_terms, exact)
    have = []
    for tile in found:
        assert len(tile.items) <= n_items
        for vocabulary, (row, column, value) in tile.chunks:
            assert 0 < len(vocabulary) <= n_terms
            sums = np.bincount(row, weights=value, minlength=len(tile.items)) * lexical_search.LARGEST_IMPACT
            assert sums.max() <= exact
            have += [(tile.items[r], int(vocabulary[c]), int(v)) for r, c, v in zip(row, column, value)]
    assert sorted(have) == sorted((k, t, int(weights[t])) for k, mine in enumerate(terms) for t in mine if weights[t])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 12)), max_size=40), st.integers(1, 5), st.integers(1, 6))
def test_ties_do_not_depend_on_tiles(pairs, k, size):
    best = Best(1, k)
    for at in range(0, len(pairs), size):
        some = pairs[at : at + size]
        best.add([0], np.array([[s for s, _ in some]], np.int64), np.array([d for _, d in some], np.int64))
    want = sorted((-s, d) for s, d in pairs if s > 0)[:k]
    assert list(zip((-best.score[0]).tolist(), best.doc[0].tolist())) == want


def test_vocabulary_compares_bytes(monkeypatch):
    words = folded_words(pa.array(["Ab cd, ab é É", None, "abc", "zz ab"]))
    known = Vocabulary([b"ab", "é".encode(), b"zz"])
    assert known.numbers(words).tolist() == [0, -1, 0, 2, -1, -1, 1, 0]
    monkeypatch.setattr(type(words), "hashes", lambda self, base=None: np.full(len(self), known.hashed[0]))
    one = Vocabulary.__new__(Vocabulary)
    one.__dict__ = dict(known.__dict__)
    found = one.numbers(words)
    assert all(n < 0 or w == known.words[n] for n, w in zip(found.tolist(), [b"ab", b"cd", b"ab", "é".encode(), "É".encode(), b"abc", b"zz", b"ab"]))
