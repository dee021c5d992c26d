import hashlib
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomwork.llm import substring_dedup as S


def plain(pairs, window=13):
    words = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in pairs]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 5000)}"
    passages = [[word() for _ in range(n)] for n in (5, 12, 13, 14, 20, 60, 300)]
    pairs = []
    for i in range(120):
        text = []
        for _ in range(rng.integers(0, 5)):
            text += [word() for _ in range(rng.integers(0, 9))]
            p = passages[rng.integers(0, len(passages))]
            a = rng.integers(0, 4)
            text += p[a : len(p) - rng.integers(0, 4)]
        pairs.append((int(rng.integers(0, 90)) * 3 - 50, (" ", "\n", " \t")[i % 3].join(text)))
    return pairs + [(1000, None), (1001, ""), (None, " ".join(passages[-1])), (2000, " ".join(passages[-1])), (2001, "é " * 50), (2002, "é " * 50 + "z")]


def test_matches_brute_force(documents):
    pairs = corpus()
    assert got(S.removed_words(documents(pairs))) == plain(pairs)
    assert S.removed_words(documents([])).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=6))
def test_small_alphabets(documents, texts):
    pairs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert got(S.removed_words(documents(pairs), 5)) == plain(pairs, 5)


def test_texts_are_cut_and_others_stay(documents):
    body = " ".join(f"w{i}" for i in range(20))
    docs = documents([(1, f"one\n{body}  end"), (2, f"two\n{body}  é\n"), (3, "left  as\tit is "), (4, None)])
    rows = {r.doc_id: r.text for r in S.without_repeats(docs).collect()}
    assert rows == {1: f"one\n{body}  end", 2: "two\né\n", 3: "left  as\tit is ", 4: None}
    assert S.without_repeats(docs).columns == docs.columns
