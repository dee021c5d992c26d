import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import toxicity as X


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(2, 8))) for _ in range(400)]
    texts, label = [], []
    for i in range(n):
        text = [words[k] for k in rng.integers(0, 400, rng.integers(0, 120))]
        bad = i % 4 == 0
        if bad:
            text.insert(rng.integers(0, len(text) + 1), ("Vile.", "wretched", "zxqu" + words[rng.integers(0, 400)])[i // 4 % 3])
        texts.append(" ".join(text))
        label.append(int(bad))
    return texts, np.array(label)


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in X.start_net().items()}
    inputs = rng.normal(size=(9, X.INPUTS))
    windows = rng.integers(-1, 9, (5, X.WINDOW))
    windows[0] = -1
    target = np.array([0, 1, 0, 1, 1.0])
    forward = lambda: X.forward(net, inputs, windows, keep=True)
    logits, kept = forward()
    grad = X.backward(net, inputs, kept, 1 / (1 + np.exp(-logits)) - target)
    loss = lambda: float(np.sum(np.logaddexp(0, forward()[0]) - target * forward()[0]))
    for name in net:
        flat, at = net[name].reshape(-1), int(rng.integers(0, net[name].size))
        was, eps = flat[at], 1e-2
        flat[at] = was + eps
        up = loss()
        flat[at] = was - eps
        down = loss()
        flat[at] = was
        assert (up - down) / (2 * eps) == pytest.approx(float(grad[name].reshape(-1)[at]), rel=0.05, abs=2e-3), name


def test_held_out_accuracy_and_batch_independence():
    texts, label = corpus(1200)
    model = X.train(texts[:800], label[:800])
    scores = X.text_scores(model, pa.array(texts[800:]))
    assert ((scores >= X.CUTOFF) == (label[800:] == 1)).mean() > 0.97
    alone = [X.text_scores(model, pa.array([t]))[0] for t in texts[800:830]]
    assert np.allclose(alone, scores[:30], atol=1e-4)


def test_windows_cover_every_word_and_overlap():
    tokens = X.Tokens(pa.array(["", None, "a " * 5, "b " * 24, "c " * 25, "d " * 61]))
    windows, row = tokens.windows()
    assert np.bincount(row).tolist() == [1, 1, 1, 1, 2, 5]
    assert [int((windows[row == r] >= 0).any(0).sum()) for r in range(3)] == [0, 0, 5]


def test_query_contract(spark, documents):
    texts, label = corpus(300)
    docs = documents([*texts, None, "", "?!", "long " * 50_000])
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(label)] + [(0, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    rows = X.score(docs, X.fit(docs, labels)).collect()
    assert len(rows) == 304
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    kept = X.without_toxic(docs, X.fit(docs, labels))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if not r.predicted) and kept.columns == docs.columns


def test_no_labels_or_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in X.score(documents(["a"]), X.fit(documents(["a"]), none)).collect()] == [0]
    assert X.score(documents([]), X.fit(documents([]), none)).count() == 0
