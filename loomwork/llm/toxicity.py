"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Each word enters as learned vectors: one of its form and two, a mean and a largest value by
dimension, over those of its character n-grams. Overlapping word windows run through a forward and
a backward GRU; attention pools the states of a window to one logit. A text scores by its highest
windows, so that words which only together tell stand beside words which tell alone. Vectors and
network are trained together in numpy in one task from a bounded sample of labelled rows, on
windows of their whole texts (a lost executor trains again, to the same model); vectors start near zero, but for one dimension that starts from how
much the training rows' labels go with the feature. Scoring is one scan in which every window of
every text is computed in array batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.textnp import Words, buffer_of, mix, slices

WINDOW, STRIDE = 24, 12
HIDDEN, OF_WORD, OF_MEAN, OF_MOST = 8, 6, 3, 3
INPUTS = OF_WORD + OF_MEAN + OF_MOST
GRAMS = (3, 5, 7)
RANKS = (0, 2, 4)
"""A text's logit comes from its windows of these ranks."""
LEAST_ROWS = (3, 6)
"""Words and n-grams of fewer training rows have no vector."""
MAX_TOXIC, MAX_CLEAN = 600, 1200
"""Training takes at most this many labelled rows of each kind, whatever their length."""
CUTOFF = 0.3
VECTOR_RATE = 0.05

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[0x80:] = False
_NOT_LETTER[0x61:0x7B] = False


class Tokens:
    """Letter runs of a batch, lower-cased, as distinct words: hash buckets of each word and of its n-grams, and each token's word."""

    def __init__(self, column: pa.Array):
        buf, offs = buffer_of(column)
        words = Words(_FOLD[buf], offs, _NOT_LETTER)
        hashed = words.hashes()
        distinct, at, self.word = np.unique(hashed, return_index=True, return_inverse=True)
        self.first, self.counts, self.row = words.first, words.counts, words.row
        self.distinct = distinct
        starts, size = words.starts[at], words.ends[at] - words.starts[at]
        span = size + 2  # with an edge mark on both sides
        begin = np.cumsum(span) - span
        data = np.full(int(span.sum()) + max(GRAMS), 1, np.uint64)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        data[np.repeat(begin + 1, size) + inside] = words.buf[np.repeat(starts, size) + inside]
        owner = np.repeat(np.arange(len(span)), span)
        room = np.repeat(begin + span, span) - np.arange(len(owner))
        grams, owners = [], []
        for n in GRAMS:
            fits = np.flatnonzero(room >= n)
            code = np.full(len(fits), n, np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | data[fits + k]
            grams.append(mix(code))
            owners.append(owner[fits].astype(np.int32))
        self.gram, self.owner = np.concatenate(grams), np.concatenate(owners)

    def known(self, model: Model) -> Known:
        """Which vectors each distinct word has: its own, and those of its n-grams in order of words."""
        at = model.grams.of(self.gram)
        some = np.flatnonzero(at >= 0)
        order = some[np.argsort(self.owner[some], kind="stable")]
        owner = self.owner[order]
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        return Known(model.words.of(self.distinct), at[order], owner, cuts, np.maximum(np.bincount(self.owner, minlength=len(self.distinct)), 1).astype(np.float32))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """All overlapping windows, as distinct-word numbers (-1 past the end of the text), and the row of each. A wordless text has one empty window."""
        n = np.maximum(1, -(-np.maximum(self.counts - (WINDOW - STRIDE), 1) // STRIDE))
        row = np.repeat(np.arange(len(n)), n)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        place = start[:, None] + np.arange(WINDOW)[None, :]
        real = place < self.counts[row][:, None]
        at = np.where(real, self.first[:-1][row][:, None] + place, 0)
        return np.where(real, self.word[at] if len(self.word) else -1, -1), row


class Keys:
    """Places of hashed features in a list; all others have -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.near = np.zeros(1 << 16, bool)
        self.near[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def of(self, hashed: np.ndarray) -> np.ndarray:
        out = np.full(len(hashed), -1, np.int64)
        some = np.flatnonzero(self.near[(hashed & np.uint64(0xFFFF)).astype(np.int64)])
        if len(some) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashed[some]), len(self.keys) - 1)
            out[some] = np.where(self.keys[at] == hashed[some], at, -1)
        return out


@dataclass
class Known:
    """Vectors of distinct words: ``word`` (or -1); ``gram`` by ``owner``, runs of which start at ``cuts``; n-grams of each word."""

    word: np.ndarray
    gram: np.ndarray
    owner: np.ndarray
    cuts: np.ndarray
    grams: np.ndarray

    def inputs(self, model: Model) -> np.ndarray:
        """INPUTS values for each distinct word."""
        out = np.zeros((len(self.word), INPUTS), np.float32)
        have = self.word >= 0
        out[have, :OF_WORD] = model.word_vectors[self.word[have]]
        if len(self.cuts):
            vectors, owner = model.gram_vectors[self.gram], self.owner[self.cuts]
            out[owner, OF_WORD : OF_WORD + OF_MEAN] = np.add.reduceat(vectors[:, :OF_MEAN], self.cuts) / np.sqrt(self.grams[owner])[:, None]
            out[owner, OF_WORD + OF_MEAN :] = np.maximum.reduceat(vectors[:, OF_MEAN:], self.cuts)
        return out

    def of(self, some: np.ndarray) -> Known:
        """The same for a few of the words."""
        first = np.searchsorted(self.owner, (some, some + 1))
        size = first[1] - first[0]
        owner = np.repeat(np.arange(len(some)), size)
        at = np.repeat(first[0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        cuts = (np.cumsum(size) - size)[size > 0]
        return Known(self.word[some], self.gram[at], owner, cuts, self.grams[some])

    def step(self, model: Model, inputs: np.ndarray, slope: np.ndarray, spread: list[np.ndarray]) -> None:
        """Move the vectors against the slope of their inputs, by rates that fall with what each has moved."""
        have = self.word >= 0
        moved = slope[have, :OF_WORD]
        spread[0][self.word[have]] += moved * moved
        model.word_vectors[self.word[have]] -= VECTOR_RATE * moved / np.sqrt(spread[0][self.word[have]])
        used, at = np.unique(self.gram, return_inverse=True)
        top = model.gram_vectors[self.gram][:, OF_MEAN:] == inputs[self.owner, OF_WORD + OF_MEAN :]
        each = np.concatenate([slope[self.owner, OF_WORD : OF_WORD + OF_MEAN] / np.sqrt(self.grams[self.owner])[:, None], slope[self.owner, OF_WORD + OF_MEAN :] * top], 1)
        moved = np.stack([np.bincount(at, weights=each[:, k], minlength=len(used)) for k in range(each.shape[1])], 1).astype(np.float32)
        spread[1][used] += moved * moved
        model.gram_vectors[used] -= VECTOR_RATE * moved / np.sqrt(spread[1][used])


def _no_keys() -> Keys:
    return Keys(np.zeros(0, np.uint64))


@dataclass
class Model:
    words: Keys = field(default_factory=_no_keys)
    grams: Keys = field(default_factory=_no_keys)
    word_vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, OF_WORD), np.float32))
    gram_vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, OF_MEAN + OF_MOST), np.float32))
    net: dict[str, np.ndarray] = field(default_factory=dict)
    scale: np.ndarray = field(default_factory=lambda: np.zeros(len(RANKS) + 2))
    shift: float = -6.0

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.scale + self.shift, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def start_net(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net = {}
    for way in "fb":
        net["x" + way] = rng.normal(0, 0.5, (INPUTS, 3 * HIDDEN))
        net["u" + way] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        net["s" + way] = np.zeros(3 * HIDDEN)
    net["att"], net["out"], net["end"] = rng.normal(0, 0.3, 2 * HIDDEN), rng.normal(0, 0.5, 2 * HIDDEN), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in net.items()}


def forward(net: dict[str, np.ndarray], inputs: np.ndarray, windows: np.ndarray, keep: bool = False):
    """Logit of each window; with ``keep`` also what the backward pass needs. A word past the end leaves the state as it is."""
    n, h = len(windows), HIDDEN
    real = (windows >= 0).T
    at = np.where(windows >= 0, windows, 0).T
    states, saved = np.zeros((WINDOW, n, 2 * h), np.float32), {}
    for way in "fb":
        fed = inputs @ net["x" + way] + net["s" + way]
        if not len(fed):
            fed = np.zeros((1, 3 * h), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            x, u = fed[at[t]], state @ net["u" + way]
            gates = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
            new = np.tanh(x[:, 2 * h :] + gates[:, h:] * u[:, 2 * h :])
            before = state
            state = np.where(real[t][:, None], new + gates[:, :h] * (before - new), before)
            states[t][:, slice(0, h) if way == "f" else slice(h, 2 * h)] = state
            if keep:
                saved[way, t] = (before, gates, new, u)
    score = np.where(real, states @ net["att"], -1e9)
    score -= score.max(0)
    weight = np.exp(score) * real
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = (states * weight[:, :, None]).sum(0)
    logits = pooled @ net["out"] + net["end"]
    return (logits, (real, at, states, weight, pooled, saved)) if keep else logits


def backward(net: dict[str, np.ndarray], inputs: np.ndarray, kept, slope: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the loss, given its slope at each logit."""
    real, at, states, weight, pooled, saved = kept
    h, grad = HIDDEN, {}
    grad["end"], grad["out"] = slope.sum(keepdims=True), pooled.T @ slope
    down = slope[:, None] * net["out"]
    each = (states * down).sum(2)
    score = weight * (each - (weight * each).sum(0))
    grad["att"] = (states * score[:, :, None]).sum((0, 1))
    ds = weight[:, :, None] * down + score[:, :, None] * net["att"]
    fed_slope = np.zeros((*at.shape, INPUTS), np.float32)
    for way in "fb":
        part = slice(0, h) if way == "f" else slice(h, 2 * h)
        u = net["u" + way]
        gx, gu, gs = np.zeros_like(net["x" + way]), np.zeros_like(u), np.zeros(3 * h, np.float32)
        carry = np.zeros((states.shape[1], h), np.float32)
        for t in range(WINDOW - 1, -1, -1) if way == "f" else range(WINDOW):
            before, gates, new, fed = saved[way, t]
            total = carry + ds[t][:, part]
            live = real[t][:, None]
            z, r = gates[:, :h], gates[:, h:]
            dn = total * (1 - z) * (1 - new * new) * live
            dz = total * (before - new) * z * (1 - z) * live
            dr = dn * fed[:, 2 * h :] * r * (1 - r)
            da = np.concatenate([dz, dr, dn], 1)
            db = np.concatenate([dz, dr, dn * r], 1)
            gx += inputs[at[t]].T @ da if len(inputs) else 0
            fed_slope[t] += da @ net["x" + way].T
            gs += da.sum(0)
            gu += before.T @ db
            carry = np.where(live, total * z, total) + db @ u.T
        grad["x" + way], grad["u" + way], grad["s" + way] = gx, gu, gs
    grad["inputs"] = np.zeros((len(inputs), INPUTS), np.float32)
    np.add.at(grad["inputs"], at[real], fed_slope[real])
    return grad


def association(feature: np.ndarray, n: int, row: np.ndarray, label: np.ndarray, used: np.ndarray) -> np.ndarray:
    """How much more often toxic rows hold each of n features than clean ones, as a logarithm brought to 0..1.

    ``feature`` and ``row`` are the distinct pairs. Features whose z value stays below the level that the
    best of very many chance features reaches count as none; with more toxic rows real features stand
    higher above it, so that level is set higher.
    """
    toxic, clean = max(1, int(label[used].sum())), max(1, int((1 - label[used]).sum()))
    t = np.bincount(feature, weights=label[row], minlength=n)
    c = np.bincount(feature, weights=1 - label[row], minlength=n)
    share = np.clip((t + c) / (toxic + clean), 1e-9, 1 - 1e-9)
    z = (t / toxic - c / clean) / np.sqrt(share * (1 - share) * (1 / toxic + 1 / clean))
    floor = np.clip(0.25 * np.sqrt(toxic), 3.5, 6)
    often = np.log(np.maximum(t, 1e-9) / toxic) - np.log((c + 0.5) / clean)
    return (np.clip(often / 4, 0, 1) * np.clip((z - floor) / floor, 0, 1)).astype(np.float32)


def unlike(texts: list[str]) -> np.ndarray:
    """Which texts share no least five-word shingle, under any of four orders, with an earlier one: copies and near copies would count as evidence each."""
    words = Words(*buffer_of(pa.array(texts, pa.large_string())))
    gram = words.grams(words.hashes(), 5)
    at = np.flatnonzero(words.whole(5))
    keep, seen = np.ones(len(texts), bool), set()
    cuts = np.flatnonzero(np.append(True, words.row[at][1:] != words.row[at][:-1])) if len(at) else []
    if len(at):
        least = [np.minimum.reduceat(mix(gram[at] * np.uint64(2 * k + 3)), cuts) for k in range(4)]
        for i, row in enumerate(words.row[at][cuts].tolist()):
            mine = {(k, int(x[i])) for k, x in enumerate(least)}
            keep[row] = not mine & seen
            seen |= mine
    return keep


def _ranked(scores: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n rows, its scores of RANKS (the least it has where it has fewer), how many windows are likely and log windows; and its windows from the highest down."""
    order = np.lexsort((-scores, row))
    first = np.searchsorted(row[order], np.arange(n + 1))
    size = np.diff(first)
    at = np.stack([first[:-1] + np.minimum(k, size - 1) for k in RANKS], 1)
    likely = np.log1p(np.bincount(row, weights=_sigmoid(np.clip(scores, -30, 30)), minlength=n))
    return np.concatenate([scores[order][at].astype(np.float64), likely[:, None], np.log(size)[:, None]], 1), order


def _vocabulary(feature: np.ndarray, n: int, row: np.ndarray, label: np.ndarray, used: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Features with a vector, and their association."""
    value = association(feature, n, row, label, used)
    kept = np.flatnonzero((np.bincount(feature, minlength=n) >= least) | (value > 0))
    return kept, value[kept]


def _start(tokens: Tokens, label: np.ndarray, used: np.ndarray, rng: np.random.Generator) -> Model:
    """A model whose vectors start near zero, but for the association of words and n-grams with the label."""
    model, n_words = Model(), len(tokens.distinct)
    pairs = np.unique(tokens.row * np.int64(n_words + 1) + tokens.word)
    row, word = pairs // (n_words + 1), pairs % (n_words + 1)
    row, word = row[used[row]], word[used[row]]
    kept, value = _vocabulary(word, n_words, row, label, used, LEAST_ROWS[0])
    model.words = Keys(tokens.distinct[kept])
    model.word_vectors = rng.normal(0, 0.05, (len(kept), OF_WORD)).astype(np.float32)
    model.word_vectors[:, 0] += value  # distinct words are sorted, as keys are
    keys, gram = np.unique(tokens.gram, return_inverse=True)
    order = np.argsort(tokens.owner, kind="stable")
    gram, have = gram[order], np.bincount(tokens.owner, minlength=n_words)
    begin, held = np.cumsum(have) - have, []
    for at in range(0, len(word), 50_000):
        w, r = word[at : at + 50_000], row[at : at + 50_000]
        n = have[w]
        place = np.repeat(begin[w], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        held.append(np.unique(gram[place].astype(np.int64) * len(label) + np.repeat(r, n)))
    pairs = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
    kept, value = _vocabulary(pairs // len(label), len(keys), pairs % len(label), label, used, LEAST_ROWS[1])
    model.grams = Keys(keys[kept])
    model.gram_vectors = rng.normal(0, 0.02, (len(kept), OF_MEAN + OF_MOST)).astype(np.float32)
    model.gram_vectors[:, OF_MEAN] += value
    model.net = start_net()
    return model


def _logits(model: Model, inputs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return np.concatenate([forward(model.net, inputs, windows[a : a + 4096]) for a in range(0, len(windows), 4096)])


def train(texts: list[str], label: np.ndarray, rounds: int = 4, steps: int = 100, seed: int = 7) -> Model:
    """A model from texts and labels 0/1. With no texts, or only one label, the score is constant.

    A round trains on the highest window of each text and the second of clean ones, by the model so far, and
    as many others of clean texts. Every fourth text of either label trains nothing: on those the
    weights of a text's windows are fitted, so that they don't rest on what the network has learnt by heart.
    """
    label = np.asarray(label, np.float64)
    keep = unlike(texts)
    texts, label = [t for t, k in zip(texts, keep) if k], label[keep]
    if not len(label) or label.min() == label.max():
        return Model(shift=6.0 if len(label) and label[0] else -6.0)
    rng = np.random.default_rng(seed)
    tokens = Tokens(pa.array(texts, pa.large_string()))
    aside = np.where(label > 0, np.cumsum(label), np.cumsum(1 - label)) % 4 == 0
    aside &= min(label[aside].sum(), (1 - label[aside]).sum()) > 0
    model = _start(tokens, label, ~aside, rng)
    known = tokens.known(model)
    windows, owner = tokens.windows()
    inputs = known.inputs(model)
    strength = np.append(inputs[:, 0] + inputs[:, OF_WORD + OF_MEAN], 0)
    scores, step = strength[windows].max(1), 0
    first = {k: np.zeros_like(v) for k, v in model.net.items()}
    second = {k: np.zeros_like(v) for k, v in model.net.items()}
    spread = [np.full(v.shape, 1e-3, np.float32) for v in (model.word_vectors, model.gram_vectors)]
    clean = np.flatnonzero((label[owner] == 0) & ~aside[owner])
    for _ in range(rounds):
        _, order = _ranked(scores, owner, len(label))
        start = np.searchsorted(owner[order], np.arange(len(label) + 1))
        best, second_best = order[start[:-1]], order[np.minimum(start[:-1] + 1, start[1:] - 1)]
        chosen = np.concatenate([best[~aside], second_best[(label == 0) & ~aside], rng.choice(clean, min(len(clean), int((label == 0).sum())), replace=False)])
        target = label[owner[chosen]]
        weight = np.where(target > 0, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum())) * len(target)
        for _ in range(max(1, round(steps * 128 / len(chosen)))):
            shuffled = rng.permutation(len(chosen))
            for at in range(0, len(shuffled), 128):
                some = shuffled[at : at + 128]
                used, local = np.unique(windows[chosen[some]], return_inverse=True)
                local = local.reshape(len(some), WINDOW) - int(used[0] < 0)
                mine = known.of(used[used >= 0])
                inputs = mine.inputs(model)
                logits, kept = forward(model.net, inputs, local, keep=True)
                slope = ((_sigmoid(logits) - target[some]) * weight[some] / len(some)).astype(np.float32)
                step += 1
                grad = backward(model.net, inputs, kept, slope)
                fed = grad.pop("inputs")
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    model.net[k] -= (0.02 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                mine.step(model, inputs, fed, spread)
        scores = _logits(model, known.inputs(model), windows)
    model.scale, model.shift = _calibrate(*(x[aside] if aside.any() else x for x in (_ranked(scores, owner, len(label))[0], label)))
    return model


def _calibrate(features: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Scales and shift of a logistic fit of labels on the texts' features, with a small penalty; Newton's method."""
    x, w = np.concatenate([features, np.ones((len(features), 1))], 1), np.zeros(features.shape[1] + 1)
    for _ in range(25):
        p = _sigmoid(np.clip(x @ w, -30, 30))
        slope = x.T @ (p - label) + 0.1 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), slope)
    return w[:-1], float(w[-1])


def text_scores(model: Model, column: pa.Array) -> np.ndarray:
    if not model.net:
        return model.probabilities(np.zeros((len(column), len(RANKS) + 2)))
    tokens = Tokens(column)
    windows, row = tokens.windows()
    if not len(row):
        return np.zeros(0)
    return model.probabilities(_ranked(_logits(model, tokens.known(model).inputs(model), windows), row, len(column))[0])


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: CRC-32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Train on a bounded sample of labelled, not held-out rows: ids first (a bounded list), then one scan that meets it by broadcast.

    An id labelled both ways is left out; of an id with several texts the least is taken, before any row
    reaches the task that trains; only the model comes to the driver. Null texts are empty ones.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    some = [known.where(F.col("toxic") == k).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, max_toxic), (0, max_clean))]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(some[0].union(some[1])), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["doc_id"])
        model = train([row["text"] for row in rows], np.array([row["toxic"] for row in rows]))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    made = found.coalesce(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(made.model) if made else train([], np.zeros(0))


def score(documents: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document row.

    Every window of the whole text is scored. Null, empty and wordless texts have one empty window.
    Rows that repeat an id are scored each for itself. Only doc_id and text are read, and doc_id is
    no input of the score; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                scores = text_scores(model, part.column("text")).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """The rows, all columns, whose text scores below the cutoff; in one scan, without a join.

    Null and empty texts are scored like any other; repeated rows share their fate; ids play no part.
    A column may have any name; an empty table gives no rows.
    """
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield part.filter(pa.array(text_scores(model, part.column(names.index("text"))) < cutoff))

    return documents.mapInArrow(run, documents.schema)
