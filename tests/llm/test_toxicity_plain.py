import math
import re

import numpy as np
import pyarrow as pa

from loomwork.llm import toxicity as X
from loomwork.llm.textnp import mix
from tests.llm.test_toxicity import corpus


def plain_score(model, text):
    """One text, window by window and word by word, in plain Python numbers."""
    words = re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    net = {k: v.astype(float) for k, v in model.net.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    word_at = {int(k): i for i, k in enumerate(model.words.keys)}
    gram_at = {int(k): i for i, k in enumerate(model.grams.keys)}
    hash_of = {}
    if words:
        from loomwork.llm.textnp import Words, buffer_of

        view = Words(*buffer_of(pa.array([" ".join(w.decode("utf-8", "replace") for w in words)])))
        hash_of = dict(zip(words, view.hashes().tolist()))

    def vector(word):
        out = np.zeros(X.INPUTS)
        if hash_of[word] in word_at:
            out[: X.OF_WORD] = model.word_vectors[word_at[hash_of[word]]]
        marked, found, n_grams = b"\x01" + word + b"\x01", [], 0
        for n in X.GRAMS:
            for i in range(len(marked) - n + 1):
                code = n
                for b in marked[i : i + n]:
                    code = (code << 8 | b) & (1 << 64) - 1
                n_grams += 1
                key = int(mix(np.array([code], np.uint64))[0])
                if key in gram_at:
                    found.append(model.gram_vectors[gram_at[key]])
        if found:
            out[X.OF_WORD : X.OF_WORD + X.OF_MEAN] = np.sum(found, 0)[: X.OF_MEAN] / math.sqrt(n_grams)
            out[X.OF_WORD + X.OF_MEAN :] = np.max(found, 0)[X.OF_MEAN :]
        return out

    def way(vectors, side):
        h, state, out = X.HIDDEN, np.zeros(X.HIDDEN), []
        for x in vectors:
            a, u = x @ net["x" + side] + net["s" + side], state @ net["u" + side]
            z, r = sigmoid(a[:h] + u[:h]), sigmoid(a[h : 2 * h] + u[h : 2 * h])
            new = np.tanh(a[2 * h :] + r * u[2 * h :])
            state = (1 - z) * new + z * state
            out.append(state)
        return out

    logits, at = [], 0
    while True:
        vectors = [vector(w) for w in words[at : at + X.WINDOW]]
        states = [np.concatenate(p) for p in zip(way(vectors, "f"), way(vectors[::-1], "b")[::-1])]
        weight = np.exp([s @ net["att"] for s in states])
        pooled = sum(w * s for w, s in zip(weight / weight.sum(), states)) if states else np.zeros(2 * X.HIDDEN)
        logits.append(float(pooled @ net["out"] + net["end"][0]))
        at += X.STRIDE
        if at + X.WINDOW - X.STRIDE >= len(words):
            break
    ranked = sorted(logits, reverse=True)
    features = [ranked[min(k, len(ranked) - 1)] for k in X.RANKS] + [math.log1p(sum(sigmoid(x) for x in logits)), math.log(len(logits))]
    return float(sigmoid(np.dot(features, model.scale) + model.shift))


def test_scores_equal_plain_ones_on_whole_texts():
    texts, label = corpus(400)
    model = X.train(texts, label, rounds=2, steps=30)
    some = [*texts[:40], None, "", "?!", "Élan " * 3, " ".join(texts[40:60])]
    assert np.allclose(X.text_scores(model, pa.array(some)), [plain_score(model, t) for t in some], atol=1e-4)


def test_vectors_learn():
    texts, label = corpus(400)
    few, more = X.train(texts, label, rounds=1, steps=1), X.train(texts, label, rounds=2, steps=30)
    assert np.abs(few.word_vectors - more.word_vectors).max() > 0.01 and np.abs(few.gram_vectors - more.gram_vectors).max() > 0.01
