"""Exact choices of whole containers against all choices."""

import itertools
import random

import pytest

from loomwork.operators import containers
from loomwork.operators.containers import exact_choice, joined


def plain(rows, target):
    papers = {}
    for paper, container, size in rows:
        if paper is not None and container is not None and size and 0 < size <= target:
            papers.setdefault(paper, set()).add((paper, container, size))
    best = None
    for choice in itertools.product(*[[None, *sorted(papers[p])] for p in sorted(papers)]):
        choice = tuple(c for c in choice if c)
        if sum(c[2] for c in choice) == target and (best is None or (-len(choice), choice) < (-len(best), best)):
            best = choice
    return list(best or ())


def test_equals_all_choices(spark, monkeypatch):
    monkeypatch.setattr(containers, "FAN", 2)
    rng = random.Random(8)
    for target in (1, 9, 14):
        rows = [(f"p{rng.randrange(7)}", rng.randrange(50), rng.randrange(-1, 12)) for _ in range(16)] + [(None, 1, 3), ("p1", None, 2), ("p2", 7, None), ("p3", 1, 4), ("p3", 1, 4)]
        df = spark.createDataFrame(rows, "paper string, container long, size int").repartition(3)
        assert sorted(map(tuple, exact_choice(df, target).collect())) == plain(rows, target)
    assert exact_choice(spark.createDataFrame([("a", 1, 5), ("a", 2, 4)], "paper string, container long, size int"), 9).count() == 0
    assert exact_choice(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        exact_choice(df, 0)


def test_joining_is_associative():
    rng, target = random.Random(2), 20
    for _ in range(40):
        parts = [{0: (), **{s: ((f"p{k}", rng.randrange(9), s),) for s in rng.sample(range(1, 12), 3)}} for k in range(4)]
        a, b, c, d = parts
        left = joined(joined(joined(a, b, target), c, target), d, target)
        assert left == joined(joined(a, b, target), joined(c, d, target), target) == joined(a, joined(joined(b, c, target), d, target), target)
