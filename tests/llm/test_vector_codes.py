import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from loomwork.llm import vector_codes
from loomwork.llm.vector_codes import Trie, compress, distinct_parts

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def plain(rows, parts=8, entries=16, rounds=6):
    """The codes by their definition, with lists only."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, [nearest(cut(v, p), books[p]) for p in range(parts)], label) for i, v, label in kept]
    total = {}
    for _, n, label in found:
        total[label] = total.get(label, 0) + sum(d for d, _ in n)
    return [(i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), total[label], sha) for i, n, label in found]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=40), st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=6), st.integers(1, 5))
def test_trie_walk_equals_all_distances(parts, entries, block):
    rows, book = np.array(parts, np.int32), np.array(entries, np.int64)
    leaves, weights, place = distinct_parts(rows)
    best, distance = Trie(leaves.astype(np.int64)).nearest(book, block)
    every = ((rows[:, None, :].astype(np.int64) - book[None]) ** 2).sum(2)
    assert best[place].tolist() == every.argmin(1).tolist()
    assert distance[place].tolist() == every.min(1).tolist()
    assert weights.sum() == len(rows) and len({tuple(x) for x in parts}) == len(leaves)


def test_equals_plain_codes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 16).round(1)], int(i) % 3 if i % 7 else None) for i in rng.permutation(150)]
    rows += [(500 + k, rows[0][1], 1) for k in range(60)]  # one vector many times
    rows += [(-1, None, 1), (-2, [], 1), (-3, [0.5] * 15 + [None], 1), (-4, [0.5] * 15 + [float("nan")], 1), (-5, [0.5] * 15 + [float("-inf")], 1), (900, [0.1] * 8, 2), (901, [0.1] * 9, 2)]
    rows += [rows[3], (None, rows[5][1], 4), (None, [0.25] * 16, 4)]
    want = sorted(plain(rows), key=repr)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(compress(df)) == want
    assert rows_of(compress(df.selectExpr("*", "1 AS width", "'x' AS code", "2 AS leaves"))) == want
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 0)
    assert rows_of(compress(df)) == want


def test_small_empty_and_large_values(spark):
    assert compress(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert compress(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0
    one = [(7, [0.5] * 8, None)]
    assert rows_of(compress(spark.createDataFrame(one, SCHEMA))) == plain(one)
    huge = [(k, [3e38 * (-1) ** k] * 8, 0) for k in range(40)]
    assert {r.error for r in compress(spark.createDataFrame(huge, SCHEMA)).collect()} == {0}
