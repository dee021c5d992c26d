"""Lookalike passages of questions by hand."""

from loomwork.operators.acceptance import acceptance, candidates


def test_lookalikes_are_matched_in_number_and_by_stems(spark):
    units = [("p", f"u{k}", k, s, t) for k, (s, t) in enumerate([
        ("Results", "we achieve high accuracy and F1 scores"), ("Intro", "parsers and parsing accuracy"), ("Intro", "nothing"), ("Intro", "accuracy only"), ("Intro", "parsing accuracy scores of 90 points"),
        ("Intro", "other"), ("Intro", "more"), ("Intro", "last"),
    ])] + [("q", "z", 0, "Results", "parsing accuracy")]
    units = spark.createDataFrame(units, "scope string, passage_id string, position int, section string, text string")
    questions = spark.createDataFrame([(1, "p", "What accuracy do parsers reach?"), (2, "p", "Which limitation?"), (3, None, "Which one?"), (4, "q", "What accuracy?")], "question_id int, scope string, question string")
    gold = spark.createDataFrame([(1, "u0"), (1, "u1"), (1, "z"), (4, "z")], "question_id int, passage_id string")
    got = {}
    for r in candidates(questions, units, gold).collect():
        got.setdefault((r.question_id, r.kind), set()).add(r.passage_id)
    assert got == {(1, "gold"): {"u0", "u1"}, (1, "hard"): {"u4", "u3", "u2", "u5", "u6"}, (1, "matched"): {"u4", "u3"}, (4, "gold"): {"z"}}
    said = {r.type: (r.questions, r.judged, r.gold, r.hard, r.matched) for r in acceptance(questions, units, gold).collect()}
    assert said == {"result": (2, 2, 2, 1, 1), "limitation": (1, 0, 0, 0, 0), "factual": (1, 0, 0, 0, 0), "overall": (4, 2, 2, 1, 1)}
