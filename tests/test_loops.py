"""The loop with sections: which section a retry searches, fallback, stop reasons; and how much a retry may add."""

from pyspark.sql import functions as F

from loomwork.scratch import kept
from loomwork.operators import agent, retrieval


def _passages(spark):
    rows = [
        ("a0", 1, 0, "paper", "Introduction", "accuracy of parsing"),
        ("a1", 1, 1, "paper", "Our Approach", "encoder layers of the parser"),
        ("a2", 1, 2, "paper", "Experiments", "findings on the corpus"),
        ("a3", 1, 3, "paper", "Experiments ::: Results", "zebra zebra"),
        ("b0", 2, 0, "other", "Introduction", "parsing of words"),
        ("c0", 3, 0, "third", "Results", "nothing in common"),
        ("c1", 3, 1, "third", None, "accuracy of parsing"),
    ]
    return spark.createDataFrame(rows, "passage_id string, doc_id long, chunk_number int, source string, section string, text string")


def _sections(spark, rows):
    return {r.question_id: r.section for r in agent.next_sections(spark.createDataFrame(rows, "question_id int, scope string, gap string, searched array<string>"), agent.sections_of(_passages(spark), F.col("source"))).collect()}


def test_sections_follow_hints_then_document_order_and_never_repeat(spark):
    got = _sections(spark, [
        (1, "paper", "MISSING_RESULT", []), (2, "paper", "MISSING_RESULT", ["Experiments ::: Results"]), (3, "paper", "MISSING_RESULT", ["Experiments ::: Results", "Experiments"]),
        (4, "paper", "MISSING_METHOD", []), (5, "paper", "TERMINOLOGY_MISMATCH", []), (6, "paper", "WEAK_EVIDENCE", []), (7, "nope", "MISSING_RESULT", []),
        (8, "other", "MISSING_RESULT", []), (9, "paper", "INSUFFICIENT_INFORMATION", []),
    ])
    assert got == {1: "Experiments ::: Results", 2: "Experiments", 4: "Our Approach"}


def test_retry_searches_the_section_and_falls_back_in_the_same_round(spark):
    passages, asked = _passages(spark), []

    def retrieve(queries):
        asked.append({r.question_id: r.section for r in queries.collect()})
        return agent.scoped_hits(retrieval.bm25_scores(passages, queries.withColumnRenamed("query", "question"), F.col("source")), passages, queries, 1)

    questions = spark.createDataFrame([(1, "paper", "what accuracy has parsing"), (2, "third", "what accuracy has parsing"), (3, "none", "what accuracy has parsing")], "question_id int, scope string, question string")

    def judge(hits, needs):
        said = agent.judged_by_rules(hits, needs).join(hits.select("question_id").distinct().withColumn("any", F.lit(1)), "question_id", "left")
        return said.select("question_id", "sufficient", F.when(F.col("any").isNull(), agent.NO_INFORMATION).otherwise(F.col("gap")).alias("gap"))

    log = agent.run_loop(questions, retrieve, keep=kept(spark), sections=agent.sections_of(passages, F.col("source")), judge=judge)
    got = {(r.question_id, r.round): (r.triggered_by, r.section, r.fallback, r.retrieved, r.sufficient, r.stop_reason) for r in log.collect()}
    # the results sections hold no asked word: the same round searches the whole paper
    assert got[1, 1] == ("NONE", None, False, 1, False, None)
    assert got[1, 2] == ("MISSING_RESULT", "Experiments ::: Results", True, 1, False, None)
    assert got[1, 3] == ("MISSING_RESULT", "Experiments", False, 2, True, "sufficient")  # the section's name is a hint of the result
    assert got[2, 2] == ("MISSING_RESULT", "Results", True, 1, False, None)
    assert got[2, 3] == ("MISSING_RESULT", None, False, 1, False, "max_rounds")
    assert got[3, 1] == ("NONE", None, False, 0, False, "insufficient_information")
    assert len(got) == 7 and asked[1] == {1: "Experiments ::: Results", 2: "Results"}


def test_scoped_hits_keep_the_best_inside(spark):
    passages = _passages(spark).where("source = 'paper'")
    scores = spark.createDataFrame([(1, "a0", 9.0), (1, "a1", 1.0), (1, "a2", 5.0), (2, "a0", 9.0), (2, "a2", 9.0), (3, "a1", 2.0)], "question_id int, passage_id string, score double")
    asked = spark.createDataFrame([(1, "Our Approach"), (2, None), (3, "Experiments")], "question_id int, section string")
    assert sorted((r.question_id, r.rank, r.passage_id) for r in agent.scoped_hits(scores, passages, asked, 2).collect()) == [(1, 1, "a1"), (2, 1, "a0"), (2, 2, "a2"), (3, 1, "a1")]


def test_long_questions_stay_whole_and_get_words(spark):
    long, short = " ".join(f"w{k}" for k in range(60)), "Which one"
    words = F.array(*(F.lit(f"new{k}") for k in range(50)), F.lit("WHICH"))
    rows = spark.createDataFrame([(long,), (short,)], "q string").select(agent.extended(F.col("q"), words).alias("x")).collect()
    assert rows[0].x == long + "".join(f" new{k}" for k in range(agent.LEAST_ADDED))
    assert rows[1].x.split() == ["Which", "one"] + [f"new{k}" for k in range(38)]
