"""Fingerprints that ignore unused fields, and contexts that are rebuilt only for the requests that were run."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomwork.operators import contexts

PASSAGES = "array<struct<passage_id:string,paper:string,section:string,title:string,score:double,rank:int,text:string>>"
CONFIG = {"version": contexts.VERSION, "max_passages": 2, "max_chars": 12, "show_scores": True}


def _requests(spark, rows):
    return spark.createDataFrame(rows, f"question_id int, question string, passages {PASSAGES}")


def test_fingerprint_is_that_of_the_fields_in_use(spark):
    base = _requests(spark, [(1, "Why?", [("a", None, None, None, None, None, "text")])])
    golden = hashlib.sha256(b'{"passages":[{"passage_id":"a","text":"text"}],"question":"Why?","question_id":1}').hexdigest()
    later = base.withColumns({"gap": F.lit(None).cast("string"), "components": F.array().cast("array<string>"), "map": F.create_map().cast("map<string,string>")})
    assert [r.fingerprint for r in contexts.fingerprints(base).collect()] == [golden] == [r.fingerprint for r in contexts.fingerprints(later.select(*reversed(later.columns))).collect()]
    for changed in (base.withColumn("gap", F.lit("NONE")), base.withColumn("question", F.lit("why?")), _requests(spark, [(1, "Why?", [("a", None, None, None, None, 1, "text")])])):
        assert contexts.fingerprints(changed).first().fingerprint != golden


def test_contexts_are_rebuilt_or_refused(spark):
    one, two, three = ("a", "p", "Intro", "T", 1.0, 2, "short"), ("b", "p", "", None, 2.0, 1, "a longer text than fits"), ("c", None, None, None, 2.0, 0, "third")
    plain = ("d", None, None, None, None, None, "no score")
    requests = _requests(spark, [(1, "q", [one, two, three]), (2, "q", [one, plain]), (3, "q", [("", None, None, None, None, None, "x")]), (4, "q", []), (5, "q", [one]), (6, "q", [one])])
    own = {r.question_id: r.fingerprint for r in contexts.fingerprints(requests).collect()}
    runs = [(k, "answered", contexts.VERSION, own[k]) for k in (1, 2, 3, 4)] + [(5, "answered", "old", own[5]), (6, "answered", contexts.VERSION, own[5]), (7, "answered", contexts.VERSION, "x"), (8, "refused", contexts.VERSION, "x")]
    runs = spark.createDataFrame(runs, "question_id int, status string, prompt_version string, fingerprint string")
    found, faults = contexts.reconstructed(runs, requests, CONFIG, "looked at")
    got = {r.question_id: (r.passage_ids, r.contexts) for r in found.collect()}
    assert got == {
        1: (["c", "b"], ["[1] passage_id: c\n    score: 2.000\n    text: third", "[2] passage_id: b\n    paper: p | score: 2.000\n    text: a long [...]"]),
        2: (["a", "d"], ["[1] passage_id: a\n    paper: p | section: Intro | score: 1.000\n    title: T\n    text: short", "[2] passage_id: d\n    text: no score"]), 4: ([], []),
    }
    assert {r.question_id: r.fault for r in faults.collect()} == {3: "dropped", 5: "version", 6: "request_differs", 7: "no_request"}
    for config, note in (({k: v for k, v in CONFIG.items() if k != "max_chars"}, "ok"), (CONFIG | {"version": "old"}, "ok"), (CONFIG, " ")):
        with pytest.raises(ValueError):
            contexts.reconstructed(runs, requests, config, note)
