import math

import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import agent, corpus, evaluation, grounding, quality, retrieval


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(column(*map(F.col, names)).alias("x")).first().x


def test_numbers_and_stems(spark):
    assert one(spark, T.numbers, "91.20 1,234.50 2.0 100 0.50 007 v1.2 x9") == ["91.2", "1234.5", "2", "100", "0.5", "7"]
    assert [one(spark, T.stem, w) for w in ("datasets", "training", "boxes", "used", "is")] == ["dataset", "train", "boxe", "used", "is"]
    assert one(spark, T.tokens, "Straße, Émile_2!") == ["strasse", "émile_2"]
    assert one(spark, T.normalised, " a\r\nb\rc \n") == "a\nb\nc"


@pytest.mark.parametrize("n", [0, 1, 5, 6, 8, 9, 14])
def test_windows_equal_a_loop(spark, n):
    text = " ".join(f"w{i} " for i in range(n))
    rows = corpus.passages(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), 5, 2).orderBy("chunk_number").collect()
    words, want, start = text.split(), [], 0
    while n:
        want.append(words[start : start + 5])
        if start + 5 >= n:
            break
        start += 3
    assert [r.text.split() for r in rows] == want


def test_passage_id_is_stable_and_links_hold(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(500))), "en"), (2, None, None)], "doc_id long, text string, lang string")
    links = corpus.linked(corpus.passages(docs))
    assert corpus.link_faults(links).count() == 0 and links.select("passage_id").distinct().count() == links.count() == 3


def test_ranking_metrics_worked_example(spark):
    ranks = spark.createDataFrame([(1, "m", "A", 1), (1, "m", "B", 2), (1, "m", "C", 3)], "question_id int, method string, passage_id string, rank int")
    gold = spark.createDataFrame([(1, "A"), (1, "C"), (1, "D")], "question_id int, passage_id string")
    questions = spark.createDataFrame([(1,), (2,)], "question_id int")
    rows = {r.question_id: r for r in evaluation.binary_metrics(ranks, gold, questions, 3).collect()}
    assert (rows[1].precision, rows[1].recall, rows[1].mrr) == (round(2 / 3, 6), round(2 / 3, 6), 1.0)
    assert rows[1].ndcg == pytest.approx(1.5 / (1 + 1 / math.log2(3) + 0.5), abs=1e-6)
    assert rows[2].recall is None and rows[2].ndcg is None and rows[2].precision == 0


def test_fusion_agreement_and_answers(spark):
    rankings = spark.createDataFrame([(1, "a", "p", 2), (1, "b", "p", 1), (1, "a", "q", 1)], "question_id int, method string, passage_id string, rank int")
    assert retrieval.fuse(rankings, 2).first().score == pytest.approx(0.03252247488, abs=1e-9)
    pairs = [(0, 0)] * 45 + [(1, 1)] * 45 + [(0, 1)] * 5 + [(1, 0)] * 5
    rows = evaluation.agreement(spark.createDataFrame([(a, b, "x") for a, b in pairs], "a int, b int, pair string"), "pair").collect()
    assert {(r.pair, r.agreement, r.kappa) for r in rows} == {(None, 0.9, 0.8), ("x", 0.9, 0.8)}
    scores = evaluation.answer_scores(spark.createDataFrame([("1", "BERT model", "The BERT base model!"), ("2", "", "a")], "question_id string, prediction string, reference string")).orderBy("question_id").collect()
    assert [(s.exact, s.f1) for s in scores] == [(0, 0.8), (1, 1.0)]


def test_plan_evidence_and_rewrite(spark):
    questions = spark.createDataFrame([(1, "What accuracy does the model achieve on the dataset?"), (2, "Which baseline is there?"), (3, "Who wrote novels?")], "question_id int, question string")
    needs = agent.requirements(questions)
    assert {(r.question_id, r.ordinal, r.name) for r in needs.collect()} == {(1, 0, "result"), (1, 1, "experiment_context"), (2, 0, "comparison"), (3, 0, "direct_answer")}
    hits = spark.createDataFrame([(1, "p", 1, "The accuracy score is high.", "intro"), (2, "q", 1, "nothing", "Related Work"), (3, "r", 1, "A novelist", "x")], "question_id int, passage_id string, rank int, text string, section string")
    said = {r.question_id: (r.sufficient, r.gap) for r in agent.verdicts(needs, agent.evidence(hits, needs)).collect()}
    assert said == {1: (False, "MISSING_EXPERIMENT_CONTEXT"), 2: (True, "NONE"), 3: (False, "TERMINOLOGY_MISMATCH")}
    log = agent.run_loop(questions, lambda q: q.join(hits.drop("rank"), "question_id").select("question_id", "passage_id", F.lit(1).alias("rank"), "text", "section"))
    rows = {(r.question_id, r.round): r for r in log.collect()}
    assert rows[2, 1].stop_reason == "sufficient" and rows[1, 3].stop_reason == "max_rounds" and (2, 2) not in rows
    assert rows[1, 2].query.endswith("dataset experimental setup evaluation metrics")


def test_grounding(spark):
    answers = spark.createDataFrame([(1, "What of 7?", "It grew by 12.50 in 7 of 9 years.", ["a", "z"])], "question_id int, question string, answer string, citations array<string>")
    passages = spark.createDataFrame([(1, "a", "grew by 12.5 then"), (1, "b", "over 9 years")], "question_id int, passage_id string, text string")
    faults = grounding.number_faults(answers, passages)
    assert [(r.code, r.subject) for r in faults.collect()] == [("NUMBER_FROM_UNCITED_PASSAGE", "9")]
    cited = grounding.citation_faults(answers, passages, passages.where("passage_id = 'b'"))
    assert {(r.code, r.subject) for r in cited.collect()} == {("HALLUCINATED_CITATION", "z"), ("CITATION_NOT_IN_PROMPT", "a")}
    final = grounding.finalised(answers, faults.unionByName(cited)).first()
    assert final.downgraded and final.citations == [] and (final.errors, final.warnings) == (2, 1)
    hits = spark.createDataFrame([(1, "p1", 1, []), (1, "p2", 2, [0, 1]), (1, "p3", 3, []), (1, "p4", 4, [1])], "question_id int, passage_id string, rank int, components array<int>")
    assert [r.passage_id for r in grounding.selected(hits, 3).orderBy("place").collect()] == ["p2", "p4", "p1"]
    assert one(spark, grounding.quote_supported, "quick brown fox jumps", "The quick brown fox jumps over") is True
    assert one(spark, grounding.quote_supported, "slow brown fox sleeps", "The quick brown fox jumps over") is False


def test_quality_and_percentiles(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "test"), (2, "train")], "id int, split string")
    assert [r.id for r in quality.split_overlaps(rows, "id", "split").collect()] == [1]
    with pytest.raises(ValueError):
        quality.assert_empty(quality.duplicate_keys(rows, "id"), "twice")
    log = spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 4, 10)], "method string, ms double")
    assert evaluation.latency(log, "method", "ms", F.lit(False)).first().p95 == 8.8
