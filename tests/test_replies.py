"""Answers out of noisy replies, against a plain character loop and cases by hand."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.operators import replies


def plain_objects(text):
    depth, start, quoted, skip, out = 0, None, False, False, []
    for i, c in enumerate(text):
        if quoted:
            skip, quoted = (not skip and c == "\\"), not (c == '"' and not skip)
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif depth and c == '"':
            quoted = True
        elif depth and c == "}":
            depth -= 1
            if depth == 0:
                out.append((start, i + 1))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='{}"\\ab \n', max_size=40))
def test_scanner_equals_a_character_loop(text):
    assert list(replies.balanced_objects(text)) == plain_objects(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30), st.integers(0, 3))
def test_valid_escapes_are_left_and_lone_ones_doubled(text, n):
    good = json.dumps({"answer": text})
    assert replies.mended(good) == (good, 0)
    bad = '{"answer": "' + "\\(" * n + '"}'
    assert json.loads(replies.mended(bad)[0]) == {"answer": "\\(" * n} and replies.mended(bad)[1] == n


def test_replies(spark):
    full = {"answer": " Yes {so} \"it\" is. ", "citations": ["p1", " p1", {"id": "p2"}, 7], "evidence_status": "SUFFICIENT", "retrieval_rounds": 2, "provenance": [{"claim": "c"}]}
    said = json.dumps(full)
    cases = {
        "plain": said, "prose": f"Here {{as requested}}: {said} {{", "nested": said.replace('"citations"', '"more": {"x": {"y": "}"}}, "citations"'), "cut": said[: len(said) // 2], "empty": "", "null": None,
        "think": f"<think>so {said[1:9]} then</think>{said}", "closed": f"it follows</THINK>\n```json\n{said}\n```", "open": f"<think> I guess {said}", "quoted_tag": json.dumps(full | {"answer": "The </think> tag"}),
        "latex": r'{"answer": "a $\extnormal{x}$ and \\alpha", "citations": [], "evidence_status": "ok"}', "second": f'{{"note": 1}} {json.dumps({"response": "r", "references": "p9", "status": "not-enough evidence", "rounds": "3", "claims": "prose"})}',
        "list": '["a"]', "number": '{"answer": 5}', "bad_rounds": '{"answer": "a", "retrieval_rounds": 0}', "bad_claims": '{"answer": "a", "provenance": [{"text": 1}]}', "bad_citations": '{"answer": "a", "citations": 3}',
        "bad_status": '{"answer": "a", "status": true}', "junk_after": '{"note": "x"} {broken}', "unknown": '{"answer": "a", "evidence_status": "perhaps", "b": 1, "a": 2}', "null_answer": '{"answer": null, "response": "x"}',
    }
    df = spark.createDataFrame(list(cases.items()), "key string, reply string").selectExpr("*", "1 AS objects", "2 AS answer")
    got = {r.key: r for r in replies.answers(df).collect()}
    assert len(got) == len(cases)
    whole = ('Yes {so} "it" is.', ["p1", "p2"], "SUFFICIENT", 2, 1, [], [])
    fields = lambda r: (r.answer, r.citations, r.evidence_status, r.retrieval_rounds, r.claims, r.extra, r.coerced)
    for name in ("plain", "prose", "think", "closed", "open"):
        assert fields(got[name]) == whole, name
    assert got["prose"].candidate == 1 and got["plain"].candidate == 0 and got["nested"].extra == ["more"]
    assert got["closed"].thinking and got["closed"].fence and not got["closed"].unclosed
    assert got["open"].thinking and got["open"].unclosed and not got["plain"].thinking and not got["plain"].fence
    assert got["quoted_tag"].answer == "The </think> tag" and not got["quoted_tag"].thinking
    assert got["latex"].answer == r"a $\extnormal{x}$ and \alpha" and got["latex"].repairs == 1 and got["latex"].coerced == ["evidence_status"]
    assert fields(got["second"]) == ("r", ["p9"], "INSUFFICIENT", 3, 0, [], ["response->answer", "references->citations", "status->evidence_status", "rounds->retrieval_rounds", "claims->provenance", "evidence_status", "retrieval_rounds:str->int", "provenance:str->[]"])
    assert got["second"].candidate == 1 and got["unknown"].extra == ["a", "b"] and got["unknown"].evidence_status == "INSUFFICIENT"
    errors = {n: r.error for n, r in got.items() if not r.parsed}
    assert errors == {
        "cut": "no_object", "empty": "no_object", "null": "no_object", "list": "no_object", "number": "answer", "bad_rounds": "retrieval_rounds", "bad_claims": "provenance", "bad_citations": "citations",
        "bad_status": "evidence_status", "junk_after": "invalid_json", "null_answer": "answer",
    }
    assert replies.answers(df.limit(0)).count() == 0
