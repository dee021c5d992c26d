import numpy as np
import pytest

from loomwork.llm import decontamination as D


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    common = [f"c{i}" for i in range(30)]
    word = lambda: common[rng.integers(0, 30)] if rng.random() < 0.5 else f"w{rng.integers(0, 3000)}"
    say = lambda n: [word() for _ in range(n)]
    items = []
    for i in range(60):
        q, a = say(rng.integers(8, 30)), say(rng.integers(3, 12))
        items.append((i, " ".join(q).capitalize() + ". " + " ".join(a) + "."))
    items += [(60, ""), (61, None), (62, "one"), (None, "two words")]
    texts = []
    for i in range(150):
        text = say(rng.integers(0, 700))
        if i % 5 == 0:
            at = rng.integers(0, len(text) + 1)
            item = items[rng.integers(0, 60)][1].split()
            if i % 10 == 0:
                item[rng.integers(0, len(item))] = "odd"
            text[at:at] = item[: len(item) - (i % 3) * 4]
        texts.append((" ", "\n")[i % 2].join(text))
    return items, [*texts, None, "", "ONE"]


def plain(items, texts):
    """Every item scored against every passage, without bounds or blocks."""
    index = D.Index([(i, t) for i, t in items if i is not None and t is not None])
    own = {t: k for k, t in enumerate(index.terms.tolist())}
    out = {}
    for i, t in enumerate(texts):
        words = D._WORD.findall((t or "").lower().encode())
        hashed = D.Words(*D.buffer_of(D.pa.array([" ".join(w.decode() for w in words)]))).hashes().tolist()
        got, n = set(), 0
        starts = range(0, max(1, len(words) - index.stride), index.stride)
        for a in starts:
            terms = sorted({own[h] for h in hashed[a : a + 2 * index.stride] if h in own})
            score = index.impact[terms].sum(0)
            for k in np.flatnonzero(score >= index.threshold * (1 - 1e-5)):
                n += 1
                if all(D.holds(words[a : a + 2 * index.stride], p) for p in index.parts[k]):
                    got.add(index.ids[k])
        out[i] = (len(starts), n, sorted(got))
    return out


@pytest.mark.parametrize("bound", [20_000, 40])
def test_matches_full_scoring(spark, documents, monkeypatch, bound):
    items, texts = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = plain(items, texts)
    assert sum(bool(x[2]) for x in want.values()) > 4
    monkeypatch.setattr(D, "MAX_ITEMS", bound)
    rows = D.leaks(documents(texts), benchmark).collect()
    if bound == 20_000:
        assert {r.doc_id: (r.n_passages, r.n_retrieved, r["items"]) for r in rows} == want
    else:
        assert len(D.shards(benchmark)) > 1
        assert {r.doc_id for r in rows if r.contaminated} >= {i for i, x in want.items() if x[2]}
    kept = D.without_leaks(documents(texts), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if not r.contaminated)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.leaks(documents(["a", None]), none).collect()] == [False, False]
    assert D.leaks(documents([]), none).count() == 0


def test_question_and_answer_must_both_be_there():
    q, a = D.question_and_answer("Who wrote the long book of tides? A sailor.")
    assert q == b"who wrote the long book of tides?".split() and a == b"a sailor.".split()
    assert D.holds(b"x who wrote the long book of tides? a sailor. y".split(), q)
    assert not D.holds(b"who wrote the long book of tides? another".split(), a)
    assert D.question_and_answer("a b c") == ([b"a", b"b"], [b"c"])
