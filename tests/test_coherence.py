"""Codes of answers by hand: status, citations, claims, clauses, components and ends."""

from loomwork.scratch import kept
from loomwork.operators import coherence, grounding

ANSWER = "question_id int, question string, answer string, evidence_status string, citations array<string>, provenance array<struct<claim:string,passage_ids:array<string>,support:string>>, components array<struct<name:string,passage_ids:array<string>>>, gap string, sufficient boolean"
PASSAGE = "question_id int, passage_id string, place int, text string, shown boolean"
SCORES = "The parser reaches ninety points accuracy on treebank"


def _codes(spark, answers, passages=None):
    rows = []
    for k, a in enumerate(answers):
        full = {"question": "What accuracy?", "answer": SCORES, "evidence_status": "SUFFICIENT", "citations": [], "provenance": [], "components": [], "gap": "NONE", "sufficient": True} | a
        rows.append((k, *(full[c] for c in ("question", "answer", "evidence_status", "citations", "provenance", "components", "gap", "sufficient"))))
    passages = [(k, i, n, t, s) for k in range(len(answers)) for i, n, t, s in (passages or [("p1", 1, SCORES, True), ("p2", 2, "Latency grows with words", True), ("p3", 3, "hidden", False)])]
    keep = kept(spark)
    held = keep(spark.createDataFrame(passages, PASSAGE), "passages")
    ended = keep(coherence.terminal(spark.createDataFrame(rows, ANSWER), held), "answers")
    found = coherence.codes(ended, held)
    out = {k: set() for k in range(len(answers))}
    for r in found.collect():
        out[r.question_id].add((r.code, r.subject))
        assert r.severity == coherence.SEVERITY[r.code]
    return out, coherence.summed(ended, found)


def test_codes(spark):
    claim = lambda ids, support="direct", text=SCORES: (text, ids, support)
    got, verdict = _codes(spark, [
        {"citations": ["p1"], "provenance": [claim(["p1"])]},
        {"citations": ["nope", "p3"]},
        {"citations": ["p1"], "provenance": [claim(["p2"], "partial"), claim(["nope"]), claim([], "partial"), claim([], "unsupported")]},
        {"citations": []},
        {"evidence_status": "INSUFFICIENT", "citations": ["p1"], "provenance": [claim(["p2"])]},
        {"citations": ["p2"], "provenance": [claim(["p2"]), claim(["p2"], "unsupported", "Latency grows with words")]},
        {"question": "What accuracy does the parser reach and how does memory behave?", "citations": ["p1"]},
        {"question": "What accuracy does the parser reach and how does memory behave?", "citations": []},
        {"citations": ["p1"], "components": [("result", ["p1", "p2"]), ("method", []), ("data", ["p3"]), ("other", ["p2"])]},
        {"citations": ["p1"], "components": [("method", [])]},
        {"citations": ["p1"], "sufficient": False},
        {"citations": ["p1"], "gap": "INSUFFICIENT_INFORMATION"},
    ])
    assert got[0] == set()
    assert got[1] == {("HALLUCINATED_CITATION", "nope"), ("CITATION_NOT_IN_PROMPT", "p3"), ("SUFFICIENT_WITHOUT_CITATION", "")}
    assert got[2] == {("HALLUCINATED_CITATION", "nope"), ("CLAIM_WITHOUT_EVIDENCE", SCORES), ("CITATION_PROVENANCE_MISMATCH", "nope,p2"), ("CITATION_PROVENANCE_MISMATCH", "p1")}
    assert got[3] == {("SUFFICIENT_WITHOUT_CITATION", "")}
    assert got[4] == {("REFUSAL_WITH_CITATIONS", "p1")}
    assert got[5] == {("PROVENANCE_OVERSTATED", SCORES)}
    assert got[6] == {("UNCOVERED_QUESTION_CLAUSE", "how does memory behave")}
    assert got[7] == {("SUFFICIENT_WITHOUT_CITATION", "")}
    assert got[8] == {("UNCOVERED_REQUIRED_COMPONENT", n) for n in ("method", "data", "other")}
    assert got[9] == set() and got[10] == {("GENERATED_WITH_INSUFFICIENT_EVIDENCE", "")} and got[11] == {("AGENT_INSUFFICIENT", "")}
    said = {r.question_id: (r.errors, r.warnings, r.worst) for r in verdict.collect()}
    assert said[0] == (0, 0, "ok") and said[2] == (1, 3, "error") and said[4] == (0, 1, "warning") and len(said) == 12


def test_no_passages(spark):
    rows = spark.createDataFrame([(1, "q", "a", "SUFFICIENT", ["x"], [("c", ["x"], "direct")], [], "NONE", True)], ANSWER)
    none = spark.createDataFrame([], PASSAGE)
    ended = coherence.terminal(rows, none)
    one = ended.collect()[0]
    assert (one.answer, one.evidence_status, one.citations, one.provenance, one.ended) == (grounding.REFUSAL, "INSUFFICIENT", [], [], "EMPTY_CONTEXT")
    assert [(r.code, r.severity) for r in coherence.codes(ended, none).collect()] == [("EMPTY_CONTEXT", "warning")]
    kept_status = rows.selectExpr("*", "cast(null as string) AS ended")
    assert {r.code for r in coherence.codes(kept_status, none).collect()} == {"HALLUCINATED_CITATION", "MISSING_REFUSAL"}


def test_claims_name_their_best_passages(spark):
    answers = spark.createDataFrame([(1, "Zhang et al. report that parsers reach high accuracy. Ok. Dogs chase quick brown foxes daily.\n1. Memory usage grows linearly"), (2, "Parsers reach high accuracy")], "question_id int, answer string")
    passages = spark.createDataFrame([(1, "a", 3, "a parser reaches a high accuracy, they report"), (1, "b", 2, "parsers reaching accuracy, Zhang reports high reach"), (1, "c", 1, "parsers reach high accuracy report zhang"), (1, "d", 4, "brown foxes and dogs")], "question_id int, passage_id string, place int, text string")
    got = [(r.question_id, r.claim, r.passage_ids, r.support) for r in grounding.claim_support(answers, passages).orderBy("claim").collect()]
    assert got == [(1, 0, ["c", "b"], "direct"), (1, 2, ["d"], "partial"), (1, 3, [], "unsupported")]


def test_quotes_with_ellipses_and_small_edits(spark):
    from pyspark.sql import functions as F

    text = "We train the model for 12.5 hours on two GPUs, and it reaches state-of-the-art accuracy of 91% there."
    quotes = {
        "train the model for 12.5 hours": True, "we train ... reaches state-of-the-art accuracy": True, "we train … of 92%": False, "We train the": False, "the model for 12.5 hours on three GPUs": False,
        "we train the model for 12.5 hours on two GPUs and it reaches accuracy": True, "...": False, "accuracy of 91% ... ... we train": True,
    }
    rows = spark.createDataFrame([(q, text) for q in quotes] + [(None, text), ("we train the model", None)], "q string, t string")
    got = {(r.q, r.t is None): r.ok for r in rows.select("q", "t", grounding.quote_supported(F.col("q"), F.col("t")).alias("ok")).collect()}
    assert got == {(q, False): ok for q, ok in quotes.items()} | {(None, False): False, ("we train the model", True): False}


def test_passages_are_shown_without_their_id(spark):
    from pyspark.sql import functions as F

    from loomwork.functions import claims

    rows = spark.createDataFrame([("p", "Results", 0.5, "A title", "x" * 30), ("", None, None, "", "short")], "paper string, section string, score double, title string, text string")
    shown = [r[0] for r in rows.select(claims.rendered(*(F.col(c) for c in rows.columns), 20)).collect()]
    assert shown == ["paper: p | section: Results | score: 0.500\n    title: A title\n    text: " + "x" * 14 + " [...]", "text: short"]
