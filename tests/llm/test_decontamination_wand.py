import math
import random
import re
import unicodedata

import pytest

from loomwork.llm import decontamination as D


def tokens(text):
    out = []
    for w in re.findall("[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        while w and unicodedata.category(w[0])[0] in "PS":
            w = w[1:]
        while w and unicodedata.category(w[-1])[0] in "PS":
            w = w[:-1]
        out += [w] if w else []
    return out


def brute(items, texts, share):
    """Retrieved items of every passage by plain BM25 over all items."""
    docs = [(i, tokens(t)) for i, t in items if i is not None and t is not None and tokens(t)]
    n, mean, stride = len(docs), sum(len(w) for _, w in docs) / len(docs), max(64, max(len(w) for _, w in docs))
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1

    def score(have, w):
        out = 0.0
        for t in set(w) & have:
            tf = w.count(t)
            out += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        return out

    own = [score(set(w), w) for _, w in docs]
    found = []
    for text in texts:
        words, hits = tokens(text), 0
        for a in range(0, max(1, len(words) - stride), stride):
            have = set(words[a : a + 2 * stride])
            hits += sum(score(have, w) >= share * s * (1 - 1e-5) for (_, w), s in zip(docs, own))
        found.append(hits)
    return found


@pytest.mark.parametrize("bound", [20_000, 30, 9])
def test_retrieval_equals_plain_bm25_in_any_number_of_shards(spark, documents, monkeypatch, bound):
    draw = random.Random(11)
    word = lambda: f"c{draw.randrange(20)}" if draw.random() < 0.5 else f"w{draw.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(draw.choice([1, 5, 30, 90]))) + "? " + word() + ".") for i in range(50)]
    items += [(50, " ".join(f"u{k}" for k in range(700))), (51, None), (None, "x"), (52, "")]
    texts = [" ".join(word() for _ in range(draw.randrange(300))) for _ in range(40)]
    texts = [t if k % 3 else t + " " + items[draw.randrange(50)][1].upper() + "!! " + t for k, t in enumerate(texts)]
    texts += [None, "", "a " * 1000 + items[50][1] + " b" * 800]
    monkeypatch.setattr(D, "MAX_ITEMS", bound)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in D.leaks(documents(texts), benchmark).collect()}
    assert [rows[i].n_retrieved for i in range(len(texts))] == brute(items, texts, D.SHARE)
    assert 50 in rows[len(texts) - 1]["items"] and sum(r.contaminated for r in rows.values()) > 10
