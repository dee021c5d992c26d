"""Exact quantiles against numpy, with few rows a range so that narrowing takes several steps."""

import numpy as np

from pyspark.sql import functions as F

from loomwork.operators import order_statistics
from loomwork.operators.evaluation import latency, word_scores

SHARES = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)


def test_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(order_statistics, "RANGES", 64)
    rng = np.random.default_rng(4)
    groups = {
        "even": rng.uniform(-5, 5, 400).tolist(), "ties": [1.0] * 300 + [2.0] * 5 + [-7.5] * 90, "one": [3.25], "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324] * 9 + (10.0 ** rng.uniform(-6, 6, 100)).tolist(),
        "same": [4.0] * 50, None: [0.5, 1.5, 2.5], "none": [None, float("nan")],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "kind string, x double").repartition(3)
    got = {r.kind: r for r in order_statistics.quantiles(df, "kind", F.col("x"), SHARES, few=20).collect()}
    assert set(got) == set(groups) and got["none"].n == 0 and got["none"].q2 is None
    for g, vs in groups.items():
        if g == "none":
            continue
        ordered, n = sorted(vs), len(vs)
        assert got[g].n == n
        for k, q in enumerate(SHARES):
            low, high = ordered[int(np.floor((n - 1) * q))], ordered[int(np.ceil((n - 1) * q))]
            assert got[g][f"q{k}"] == low + (high - low) * ((n - 1) * q - np.floor((n - 1) * q))
    assert order_statistics.quantiles(df.limit(0), "kind", F.col("x"), SHARES).count() == 0


def test_latency_and_throughput(spark):
    rows = spark.createDataFrame([("a", 1.0, False, 0), ("a", 2.0, False, 10), ("a", 9.0, True, 4), ("a", 10.0, False, 20), ("b", 5.0, True, 7)], "kind string, ms double, failed boolean, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r.kind: r for r in latency(rows, "kind", "ms", F.col("failed"), "at").collect()}
    assert (got["a"].calls, got["a"].errors, got["a"].p50, got["a"].p95, got["a"].most, got["a"].wall_seconds, got["a"].calls_per_second, got["a"].successes_per_second) == (4, 1, 2.0, 9.2, 10.0, 20.0, 0.2, 0.15)
    assert (got["b"].p50, got["b"].mean, got["b"].wall_seconds, got["b"].calls_per_second) == (None, None, 0.0, None)


def test_word_scores(spark):
    pairs = spark.createDataFrame([(1, ["a", "b", "a"], ["a", "a", "c"]), (2, [], []), (3, ["x"], []), (4, ["b", "a"], ["a", "b"]), (5, ["q"], ["q"])], "k int, p array<string>, r array<string>")
    assert sorted(map(tuple, word_scores(pairs, "k").collect())) == [(1, 0, 2 / 3), (2, 1, 1.0), (3, 0, 0.0), (4, 0, 1.0), (5, 1, 1.0)]
