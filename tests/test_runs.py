from pyspark.sql import functions as F

from loomwork.functions import claims
from loomwork.operators import answers, corpus, hits, numbering, runs

RANKING = "question_id long, method string, passage_id string, rank int, score double"


def rankings(spark):
    rows = [(1, "m", "a", 1, 3.0), (1, "m", "b", 2, 2.0), (1, "m", "c", 3, 1.0), (2, "m", "x", 1, 1.0), (3, "m", "y", 1, 1.0)]
    return spark.createDataFrame(rows, RANKING)


def test_unknown_judgments_suppress_full_figures(spark):
    judged = spark.createDataFrame([(1, "b", 1), (1, "c", 0), (3, "y", 0)], "question_id long, passage_id string, grade int")
    labels = spark.createDataFrame([(1, "mapped", False), (2, "unmapped", False), (3, "mapped", True), (4, "mapped", True)], "question_id long, status string, complete boolean")
    got = {(r.question_id, r.k): r for r in runs.labelled_evaluation(rankings(spark), judged, labels, (1, 3)).collect()}
    assert set(got) == {(q, k) for q in (1, 3, 4) for k in (1, 3)}
    assert got[1, 3].category == "unjudged_top_k" and got[1, 3].precision is None and got[1, 3].judged_mrr == 1.0
    assert got[3, 1].category == "no_relevant_judgments" and got[3, 1].recall is None and got[3, 1].precision == 0.0
    assert got[4, 1].category == "no_passages" and got[4, 1].coverage == 1.0
    assert [(r.question_id, r.reason) for r in runs.label_exclusions(spark.createDataFrame([(1,), (2,), (9,)], "question_id long"), labels).orderBy("question_id").collect()] == [(2, "unmapped_labels"), (9, "missing_labels")]


def test_means_leave_out_what_is_not_finite(spark):
    rows = spark.createDataFrame([("m", 1.0), ("m", float("nan")), ("m", float("inf")), ("m", None)], "method string, x double")
    r = runs.finite_means(rows, ["method"], ["x"]).first()
    assert (r.questions, r.x, r.x_n) == (4, 1.0, 1)


def test_retries(spark):
    retrieved = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 2, "b"), (1, 3, "b"), (2, 1, "x")], "question_id long, round int, passage_id string")
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "question_id long, passage_id string")
    r = runs.retry_figures(runs.cumulative_recall(retrieved, gold)).first()
    assert (r.questions, r.retries, r.recall_before, r.recall_after, r.recovery_rate) == (2, 2, 0.5, 1.0, 1.0)
    assert (r.unnecessary, r.ineffective, r.redundant) == (0.5, 0.5, 0.5)


def test_flips_name_what_happened_to_the_evidence(spark):
    arm = "question_id long, sufficient boolean, citations array<string>, context array<string>"
    before = spark.createDataFrame([(1, True, ["a"], ["a", "b"]), (2, True, ["a", "b"], ["a", "b"]), (3, False, [], ["a"]), (4, True, ["a"], ["a"]), (5, True, ["a"], ["a"])], arm)
    after = spark.createDataFrame([(1, False, [], ["c"]), (2, False, [], ["b"]), (3, True, ["z"], ["z"]), (4, True, [], ["a"]), (5, True, ["a"], ["a"])], arm)
    got = {r.question_id: (r.why, r.jaccard) for r in runs.arm_flips(before, after).collect()}
    assert got == {1: ("evidence_dropped", 0.0), 2: ("evidence_partly_dropped", 0.5), 3: ("new_evidence", 0.0), 4: ("other", 1.0)}


def test_hits_of_mixed_scorers_keep_their_order(spark):
    kind = "request_id long, position int, passage struct<passage_id:string,text:string>, reranker_score double, rrf_score double"
    rows = [(1, 1, ("a", "t"), None, 0.1), (1, 2, ("b", "t"), 5.0, 0.2), (1, 3, ("a", "t"), None, 0.3), (1, 4, (" ", "t"), None, 0.3), (1, 5, ("c", None), None, 0.3), (2, 1, ("a", "t"), None, 0.1), (2, 2, ("b", "t"), None, 0.4)]
    dump = spark.createDataFrame(rows, kind)
    got = [(r.request_id, r.passage_id, r.score) for r in hits.adapted(dump).orderBy("request_id", "place").collect()]
    assert got == [(1, "a", None), (1, "b", None), (2, "b", 0.4), (2, "a", 0.1)]
    loss = {r.request_id: (r.no_text, r.no_id, r.duplicate, r.mixed) for r in hits.losses(dump).collect()}
    assert loss == {1: (1, 1, 1, True), 2: (0, 0, 0, False)}
    assert hits.adapted(dump.limit(0)).count() == 0 and {r.kind for r in hits.profile(dump).collect()} == {"mixed", "fusion"}


def test_references_and_statuses(spark):
    note = "question_id string, answers array<struct<unanswerable:boolean,yes_no:boolean,free_form:string,spans:array<string>>>"
    gold = spark.createDataFrame([("a", [(True, None, None, []), (False, True, "no words", [])]), ("b", [(True, None, None, [])]), ("c", [(False, None, "", ["two", "spans"])]), ("d", [(False, None, "the", [])]), ("e", [])], note)
    said = spark.createDataFrame([("a", "Yes!", "answered"), ("b", "", "refused"), ("c", "two", "answered")], "question_id string, text string, status string")
    questions = spark.createDataFrame([(q,) for q in "abcdef"], "question_id string")
    rows = {r.question_id: (r.status, r.em, r.f1, r.unanswerable_correct) for r in answers.qa_scores(questions, said, gold).collect()}
    assert rows == {
        "a": ("answered", 1.0, 1.0, None), "b": ("refused", None, None, 1.0), "c": ("answered", 0.0, 0.666667, None),
        "d": ("invalid_reference", None, None, None), "e": ("invalid_reference", None, None, None), "f": ("missing_reference", None, None, None),
    }


def test_claim_texts(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(claims.split_sentences(F.lit("- Zhang et al. report it. So.\n1. Third point!\n\n"))) == ["Zhang et al. report it.", "So.", "Third point!"]
    assert sorted(value(claims.content_terms(F.lit("The Classes “boxes” runs glass of 12 is")))) == ["box", "class", "glass", "runs"]
    assert value(claims.question_clauses(F.lit("What is it, and how many pairs was it trained on and audio frames?"))) == ["What is it", "how many pairs was it trained on"]
    assert value(claims.truncated(F.lit("abcdefghij klm"), 10)) == "abcd [...]" and value(claims.truncated(F.lit("short"), 10)) == "short"
    assert value(claims.handle(F.lit("[P1]"))) == "p1" and value(claims.cited_handles(F.lit("x [E2] [e2] [E11]"))) == ["e2", "e11"]


def test_corpus_checks(spark):
    docs = spark.createDataFrame([(1, "a\n\nbcd ", 8), (2, None, 0), (3, "  \r", 1)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in corpus.paragraph_ranges(docs.where("doc_id = 1")).collect()] == [(1, 2, 3, 6)]
    r = corpus.normalisation_report(docs).first()
    assert (r.documents, r.blank_lines, r.carriage_returns) == (3, 1, 1)
    rows = spark.createDataFrame([(1,), (1,), (9,), (None,)], "doc_id long")
    assert tuple(corpus.reference_faults(rows, docs, "doc_id").first()) == (1, 1, 1, 2)


def test_numbers_follow_the_key(spark):
    rows = spark.range(1000).select(((F.col("id") * 37) % 1009).alias("key"))
    got = [(r.key, r.n) for r in numbering.numbered(rows, "key", "n", 7).orderBy("key").collect()]
    assert got == [(k, i) for i, k in enumerate(sorted((i * 37) % 1009 for i in range(1000)))]
    assert numbering.numbered(rows.limit(0), "key", "n").count() == 0


def test_means_of_decimals_round_exact_halves_up(spark):
    """The mean 0.3000005 of (0.1, 0.500001) is a half in decimals; its binary sum may lie below."""
    import itertools

    pairs = [(x / 10**6, y / 10**6) for x, y in itertools.product(range(100_000, 100_040), range(500_001, 500_041, 2)) if (x + y) % 2]
    rows = [(n, m, k, v) for k, pair in enumerate(pairs) for n, new in enumerate(pair) for m, v in (("a", 0.0), ("b", new))]
    figures = spark.createDataFrame(rows, "question_id int, method string, k int, f double")
    want = {k: ((round(x * 10**6) + round(y * 10**6) + 1) // 2) / 10**6 for k, (x, y) in enumerate(pairs)}
    assert {r.k: r.mean_delta for r in runs.paired_contributions(figures, "a", "b", ["f"]).collect()} == want
    assert {r.k: r.f for r in runs.finite_means(figures.where("method = 'b'"), ["k"], ["f"]).collect()} == want
    odd = spark.createDataFrame([(1, "a", 1, 0.0), (1, "b", 1, float("inf"))], "question_id int, method string, k int, f double")
    assert runs.paired_contributions(odd, "a", "b", ["f"]).first().mean_delta == float("inf")
