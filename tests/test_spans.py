"""Spans and word budgets against plain loops."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.operators import spans

PLAIN = re.compile(r"\S.*?(?:[.!?](?=\s|$)|$)", re.DOTALL)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aé.!? \n", max_size=25), min_size=60, max_size=60))
def test_sentences_stand_where_a_plain_search_finds_them(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", spans.sentence_spans(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [(s.start, s.end, s.text) for s in r.s] == [(*m.span(), m.group()) for m in PLAIN.finditer(texts[r.k])], texts[r.k]


ANSWER = "The parser is fast.  It reads 90 words a second! Memory is not measured. Training takes two days"


def test_flagged_stretches_merge(spark):
    at = lambda s: (ANSWER.index(s), ANSWER.index(s) + len(s))
    faults = [
        (1, "UNSUPPORTED_CLAIM", "The parser is fast."), (1, "X", "parser is fast"), (1, "X", " is fast.  It reads 90"), (1, "X", "two days"), (1, "X", None), (1, "X", "not in it at all"),
        (2, "CLAIM_WITHOUT_EVIDENCE", "memory measured not"), (2, "PROVENANCE_OVERSTATED", "training two weeks"), (2, "X", "memory measured not"), (2, "UNSUPPORTED_CLAIM", "words none of which"),
        (3, "X", "The parser is fast." + " " * 120), (4, "X", "It reads 90 words" + " " * 120),
    ]
    answers = spark.createDataFrame([(k, ANSWER) for k in (1, 2, 3, 4, 5)], "question_id int, answer string")
    got = {}
    for r in spans.flagged(answers, spark.createDataFrame(faults, "question_id int, code string, subject string")).collect():
        got.setdefault(r.question_id, []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(0, at("It reads 90")[1])], 2: [at("Memory is not measured."), at("Training takes two days")], 3: [(0, at("It reads 90 words a second!")[1])], 4: [at("It reads 90 words a second!")],
    }


def test_word_budgets(spark):
    ranked = spark.createDataFrame([(1, "m", "a", 1, 300), (1, "m", "b", 2, 300), (1, "m", "c", 3, 10), (2, "m", "d", 1, 50)], "question_id int, method string, passage_id string, rank int, n_words int")
    places = spark.createDataFrame([(1, "b", 200), (1, "c", 10), (2, "e", 1)], "question_id int, passage_id string, last_word int")
    shown = {(r.question_id, r.budget, r.passage_id): (r.before, r.shown) for r in spans.within_budget(ranked, [300, 500]).collect()}
    assert shown == {(1, 300, "a"): (0, 300), (1, 500, "a"): (0, 300), (1, 500, "b"): (300, 200), (2, 300, "d"): (0, 50), (2, 500, "d"): (0, 50)}
    got = {r.budget: (r.questions, r.hits, r.words, r.partial) for r in spans.budget_hits(ranked, places, [300, 499, 500, 1000]).collect()}
    assert got == {300: (2, 0, 175.0, 0), 499: (2, 0, 274.5, 1), 500: (2, 1, 275.0, 1), 1000: (2, 1, 330.0, 0)}
