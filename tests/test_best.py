"""The best passages found where they lie equal those of all scores, however they are cut into tiles."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import best, retrieval


def corpus(spark, n=150):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 30))) for _ in range(n - 30)] + ["a b c a"] * 30  # copies tie
    rows = [(f"p{draw.randrange(10**6):06}-{i}", t, f"s{i % 4}", f"src{i % 3}" if i else "lone") for i, t in enumerate(texts)]
    questions = [(1, 0, "a b x"), (2, 0, "j"), (3, 0, "c c d e"), (4, 0, "nothing")]
    return (
        retrieval.with_tokens(spark.createDataFrame(rows, "passage_id string, text string, section string, source string")).repartition(3),
        spark.createDataFrame(questions, "question_id long, scope int, question string"),
    )


def rows(ranking, *more):
    return sorted((r.question_id, *(r[m] for m in more), r["rank"], r.passage_id, round(r.score, 8)) for r in ranking.collect())


@pytest.mark.parametrize("tile", [7, 1024])
def test_best_equal_all_scores(spark, monkeypatch, tile):
    monkeypatch.setattr(best, "PASSAGES", tile)
    monkeypatch.setattr(best, "QUESTIONS", 2)
    monkeypatch.setattr(best, "TERMS", 3)
    chunks, questions = corpus(spark)
    few = retrieval.best_bm25(chunks, questions, 5)
    assert few.count() <= 4 * 5 < retrieval.bm25_scores(chunks, questions).count()
    assert rows(retrieval.ranked(few, 5)) == rows(retrieval.ranked(retrieval.bm25_scores(chunks, questions), 5))
    assert rows(retrieval.ranked(retrieval.best_overlap(chunks, questions, 5), 5)) == rows(retrieval.ranked(retrieval.overlap_scores(chunks, questions), 5))


def test_best_of_scopes_and_sections(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SHARD", 3)
    chunks, questions = corpus(spark)
    scoped = questions.withColumn("scope", F.when(F.col("question_id") == 2, "lone").otherwise(F.concat(F.lit("src"), F.col("question_id") % 3)))
    found = retrieval.best_bm25(chunks, scoped.unionByName(scoped.where("question_id = 1").withColumn("scope", F.lit("lone"))), 5, F.col("source"))
    want = retrieval.bm25_scores(chunks, scoped.unionByName(scoped.where("question_id = 1").withColumn("scope", F.lit("lone"))), F.col("source"))
    assert want.where("score <= 0").count(), "a scope of one passage has negative weights"
    assert rows(retrieval.ranked(found, 5)) == rows(retrieval.ranked(want, 5))
    wanted = questions.select("question_id").crossJoin(chunks.select("section").distinct())
    args = (chunks, wanted, 3)
    assert rows(retrieval.in_sections(retrieval.best_bm25(chunks, questions, 3, by="section"), *args), "section") == rows(retrieval.in_sections(retrieval.bm25_scores(chunks, questions), *args), "section")


def test_what_a_task_holds_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(best, "MOST_HELD", 3)
    chunks, questions = corpus(spark)
    assert rows(retrieval.ranked(retrieval.best_bm25(chunks, questions, 5), 5)) == rows(retrieval.ranked(retrieval.bm25_scores(chunks, questions), 5))


def test_dense_search_holds_few_scores_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    asked, vectors = retrieval._unit(rng.normal(size=(2048, 8))), rng.normal(size=(5000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), pa.array(list(vectors)), pa.array(np.zeros(5000, np.int32))], names=["vec_id", "embedding", "label"])
    run = retrieval._dense_search(np.arange(2048), np.zeros(2048, np.int32), asked, 3, True, pa.int64())
    tracemalloc.start()
    (out,) = run(iter([batch.slice(0, 2500), batch.slice(2500)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20, "all scores of one batch would be 41 MB"
    score = np.round(asked @ retrieval._unit(vectors).T, 6)
    want = {q: np.lexsort((np.arange(5000), -score[q]))[:3].tolist() for q in range(0, 2048, 97)}
    got = out.to_pylist()
    assert {q: [r["vec_id"] for r in got if r["query_id"] == q] for q in want} == want and len(got) == 3 * 2048
