"""nDCG under known and unknown judgments, and dense passages by a stand-in encoder."""

import math

import numpy as np

from loomwork.operators import retrieval, runs


def test_ndcg_is_full_relative_to_the_pool_or_unknown(spark):
    rankings = spark.createDataFrame([(q, "m", p, r, 0.0) for q in (1, 2, 3) for r, p in enumerate("abc", 1)], "question_id int, method string, passage_id string, rank int, score double")
    judged = spark.createDataFrame([(1, "b", 1), (1, "z", 1), (2, "a", 0), (2, "b", 1), (2, "c", 0), (3, "a", 0), (3, "c", 1)], "question_id int, passage_id string, grade int")
    labels = spark.createDataFrame([(1, "mapped", True), (2, "mapped", False), (3, "mapped", False)], "question_id int, status string, complete boolean")
    got = {r.question_id: r for r in runs.labelled_evaluation(rankings, judged, labels, (3,)).collect()}
    second, two = 1 / math.log2(3), 1 + 1 / math.log2(3)
    assert got[1].ndcg == round(second / two, 6) and got[1].pool_ndcg is None
    assert got[2].ndcg is None and got[2].pool_ndcg == round(second, 6)
    assert got[3].ndcg is None and got[3].pool_ndcg is None and got[3].judged_ndcg == round(second, 6) and got[3].judged_recall == 1.0


def test_dense_search_takes_any_encoder_and_any_key(spark):
    rows = spark.createDataFrame([("a", "red green"), ("b", "green green blue"), ("c", "..."), ("d", None)], "passage_id string, text string")
    vectors = retrieval.encoded(rows, "passage_id", "text")
    assert {r.vec_id: list(r.embedding) for r in vectors.collect()} == {k: v.tolist() for k, v in zip("ab", retrieval.hashed_words(["red green", "green green blue"]))}
    asked = retrieval.encoded(spark.createDataFrame([(7, "green")], "question_id long, question string"), "question_id", "question", lambda texts: np.array([[1.0, 0.0]] * len(texts)))
    held = retrieval.encoded(rows, "passage_id", "text", lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert [(r.query_id, r.vec_id, r["rank"]) for r in retrieval.dense_top_k(held, asked, 2).orderBy("rank").collect()] == [(7, "b", 1), (7, "a", 2)]
