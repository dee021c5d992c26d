"""Texts held by passages or holding them equal a plain search, in one scan without a join."""

import random

import pytest

from loomwork.operators import containment, retrieval


@pytest.mark.parametrize("tile", [3, 1024])
def test_held_texts_equal_a_plain_search(spark, monkeypatch, tile):
    monkeypatch.setattr(containment, "PASSAGES", tile)
    monkeypatch.setattr(retrieval, "EVIDENCE", 200)
    draw = random.Random(8)
    say = lambda n: [draw.choice("abc") for _ in range(n)]
    passages = [say(draw.randint(1, 40)) for _ in range(60)] + [["z", *say(9)], say(3), []]
    items = [passages[k][draw.randint(0, 3) :][: draw.randint(4, 12)] for k in range(40)] + [say(5) + passages[1] + say(4), ["x", *passages[61], "y", "y"]] + [say(5) for _ in range(5)] + [say(4), []]
    held = lambda w, v: f" {' '.join(v)} " in f" {' '.join(w)} "
    want = sorted((i, p) for i, v in enumerate(items) for p, w in enumerate(passages) if len(v) >= 5 and (held(w, v) or (len(w) >= 5 and held(v, w))))
    chunks = spark.createDataFrame([(p, "  ".join(w)) for p, w in enumerate(passages)], "passage_id long, text string")
    evidence = spark.createDataFrame([(i, " ".join(v)) for i, v in enumerate(items)] + [(None, "a b c a b c"), (99, None)], "item_id long, text string")
    found = retrieval.gold_by_containment(chunks, evidence)
    assert sorted(tuple(r) for r in found.collect()) == want and len({p for _, p in want}) > 20
    assert "Join" not in found._jdf.queryExecution().toString()
    assert retrieval.gold_by_containment(chunks, evidence.limit(0)).count() == 0
