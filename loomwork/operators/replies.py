"""Answers out of noisy replies: the first JSON object in a text that is an answer, with what had to be mended.

Finding objects needs a scanner with states, so that part runs over Arrow batches; typing, aliases and
checks are column expressions on the objects found (as variants). One scan, no shuffle: all candidates
of a reply stay in its row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names a field may have, the first being its own; words for a status and a support; reasoning tags.
FIELDS = {
    "answer": ("answer", "response", "output", "text", "final_answer"),
    "citations": ("citations", "cited_passages", "references", "sources", "evidence_ids"),
    "evidence_status": ("evidence_status", "status", "evidence", "sufficiency"),
    "retrieval_rounds": ("retrieval_rounds", "rounds", "retrieval_round"),
    "provenance": ("provenance", "claims", "claim_evidence", "supporting_claims"),
}
SUFFICIENT = ("SUFFICIENT", "SUPPORTED", "ANSWERED", "OK")
SUPPORT = ("direct", "full", "explicit", "yes", "true", "partial", "implied", "weak", "unsupported", "none", "no", "false")
ID_KEYS = ("passage_id", "id", "citation", "source")
TAGS = "think|thinking|reasoning|analysis"

_OUTSIDE = re.compile(r'[{}"]')
_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|\\')
_OPEN, _CLOSE = re.compile(rf"<({TAGS})>", re.IGNORECASE), re.compile(rf"</({TAGS})>", re.IGNORECASE)
_BLOCK = re.compile(rf"<({TAGS})>.*?</\1>", re.IGNORECASE | re.DOTALL)


def balanced_objects(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each outermost run from a brace to the one that closes it; braces in strings of a run don't count."""
    depth, start, at = 0, 0, 0
    while found := _OUTSIDE.search(text, at):
        at = found.end()
        if found[0] == "{":
            start = start if depth else found.start()
            depth += 1
        elif depth and found[0] == "}":
            depth -= 1
            if not depth:
                yield start, at
        elif depth:
            string = _STRING_END.match(text, at)
            if not string:
                return
            at = string.end()


def without_reasoning(text: str) -> tuple[str, bool, bool]:
    """The text without its reasoning, whether there was any, and whether it never ended (then it stays).

    Only what stands before the first object counts, so that an answer may name a tag. A closing tag
    alone ends reasoning that began in the prompt.
    """
    limit = next((a for a, _ in balanced_objects(text)), len(text))
    opened, closed = _OPEN.search(text, 0, limit), list(_CLOSE.finditer(text, 0, limit))
    if opened and closed and closed[-1].start() > opened.start():
        return _BLOCK.sub("", text, count=1), True, False
    if closed:
        return text[closed[0].end() :], True, False
    return text, bool(opened), bool(opened)


def mended(candidate: str) -> tuple[str, int]:
    """The candidate with backslashes doubled that begin no JSON escape, and how many those are."""
    lone = sum(len(m[0]) == 1 for m in _ESCAPE.finditer(candidate))
    return _ESCAPE.sub(lambda m: m[0] if len(m[0]) > 1 else "\\\\", candidate), lone


def _parsed(candidate: str) -> tuple[dict | None, int]:
    """The object, or None; and the escapes mended for it."""
    for text, repairs in ((candidate, 0), mended(candidate)):
        try:
            return json.loads(text), repairs
        except (ValueError, RecursionError):
            continue
    return None, 0


_FOUND = "key string, thinking boolean, unclosed boolean, fence boolean, tried int, objects array<struct<place:int,repairs:int,object:string>>"
_OBJECTS = pa.list_(pa.struct([("place", pa.int32()), ("repairs", pa.int32()), ("object", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("reply").to_pylist():
            bare, thinking, unclosed = without_reasoning(text or "")
            objects, tried, repaired = [], 0, 0
            for a, z in balanced_objects(bare):
                payload, repairs = _parsed(bare[a:z])
                if payload is not None:
                    repaired += repairs
                    objects.append({"place": tried, "repairs": repaired, "object": json.dumps(payload, ensure_ascii=False)})
                tried += 1
            rows.append((thinking, unclosed, "```" in bare, tried, objects))
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), _OBJECTS)
        yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, t) for c, t in zip(columns, types))], names=["key", "thinking", "unclosed", "fence", "tried", "objects"])


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _text(v: Column) -> Column:
    """A variant's string; null where it is none."""
    return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))


def _field(keys: Column, v: Column, name: str) -> tuple[Column, Column]:
    """The name a field goes by in the object (null if absent) and its value."""
    said, value = F.lit(None).cast("string"), F.lit(None).cast("variant")
    for alias in reversed(FIELDS[name]):
        there = F.array_contains(keys, alias)
        said, value = F.when(there, alias).otherwise(said), F.when(there, F.try_variant_get(v, f"$.{alias}", "variant")).otherwise(value)
    return said, value


def _ids(v: Column) -> Column:
    """Ids of a variant list of strings and objects that hold one, in order, once each."""
    def one(item: Column) -> Column:
        inner = F.coalesce(*(_text(F.try_variant_get(item, f"$.{k}", "variant")) for k in ID_KEYS))
        return _stripped(F.when(_is(item, "STRING"), _text(item)).when(_is(item, "OBJECT"), inner))

    return F.array_distinct(F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), one), lambda x: x.isNotNull() & (x != "")))


def answers(replies: DataFrame) -> DataFrame:
    """key, parsed, candidate, answer, citations, evidence_status, retrieval_rounds, claims, extra, coerced, thinking, unclosed, fence, repairs and error of every (key, reply) row.

    The first object that is an answer counts: its answer is a string, its citations are ids, its rounds
    a whole number of 1 or more, its claims objects with a text. Aliases, single ids, a missing or unknown
    status (INSUFFICIENT then), rounds as digits and claims as prose are mended and named in ``coerced``.
    Rows without one have the error of the last candidate: no_object, invalid_json or the first wrong field.
    Null and empty replies have no object. Repeated rows stay.
    """
    rows = replies.select(F.col("key").cast("string").alias("key"), F.col("reply").cast("string").alias("reply")).mapInArrow(_scan, _FOUND)
    none, text = F.array().cast("array<string>"), "string"

    def opened(o: Column) -> Column:
        return F.struct(o["place"].alias("place"), o["repairs"].alias("repairs"), F.try_parse_json(o["object"]).alias("v"), F.coalesce(F.json_object_keys(o["object"]), none).alias("keys"))

    def named(o: Column) -> Column:
        field = {name: _field(o["keys"], o["v"], name) for name in FIELDS}
        both = [c for name, (said, value) in field.items() for c in (said.alias(f"{name}_said"), value.alias(name))]
        return F.struct(o["place"].alias("place"), o["repairs"].alias("repairs"), o["keys"].alias("keys"), *both)

    def answered(o: Column) -> Column:
        return F.struct(o.alias("o"), _stripped(_text(o["answer"])).alias("answer"))

    def judged(x: Column) -> Column:
        o, answer = x["o"], x["answer"]
        keys, said, value = o["keys"], {n: o[f"{n}_said"] for n in FIELDS}, {n: o[n] for n in FIELDS}
        cited = value["citations"]
        empty = said["citations"].isNull() | F.coalesce(F.is_variant_null(cited), F.lit(True))
        citations = F.when(empty, none).when(_is(cited, "STRING"), F.array(_stripped(_text(cited)))).when(_is(cited, "ARRAY"), _ids(cited))
        status_text = _text(value["evidence_status"])
        status_key = F.regexp_replace(F.upper(_stripped(status_text)), "[- ]", "_")
        status = F.when(said["evidence_status"].isNull(), "INSUFFICIENT").when(status_text.isNotNull(), F.when(status_key.isin(*SUFFICIENT), "SUFFICIENT").otherwise("INSUFFICIENT"))
        rounds_text = _stripped(_text(value["retrieval_rounds"]))
        whole = F.when(_is(value["retrieval_rounds"], "BIGINT"), F.try_variant_get(value["retrieval_rounds"], "$", "int"))
        rounds = F.when(said["retrieval_rounds"].isNull(), 1).when(rounds_text.rlike(r"\A\d{1,9}\z"), rounds_text.cast("int")).otherwise(whole)
        made = value["provenance"]
        entries = F.try_variant_get(made, "$", "array<variant>")
        sound = lambda e: _is(e, "OBJECT") & _text(F.try_variant_get(e, "$.claim", "variant")).isNotNull() & (F.try_variant_get(e, "$.support", "variant").isNull() | F.coalesce(F.regexp_replace(F.lower(_stripped(_text(F.try_variant_get(e, "$.support", "variant")))), "[- ]", "_").isin(*SUPPORT), F.lit(False)))
        claims = F.when(said["provenance"].isNull() | _is(made, "STRING"), 0).when(_is(made, "ARRAY") & F.forall(entries, sound), F.size(entries))
        wrong = F.when(answer.isNull(), "answer").when(citations.isNull(), "citations").when(status.isNull(), "evidence_status").when(F.coalesce(rounds < 1, F.lit(True)), "retrieval_rounds").when(claims.isNull(), "provenance")
        notes = [F.when(said[n] != n, F.concat(said[n], F.lit("->"), F.lit(n))) for n in FIELDS]
        notes += [
            F.when(said["evidence_status"].isNull(), "<missing>->evidence_status").when(status_text != status, "evidence_status"),
            F.when(rounds_text.isNotNull(), "retrieval_rounds:str->int"), F.when(_is(made, "STRING"), "provenance:str->[]"),
        ]
        known = [alias for names in FIELDS.values() for alias in names]
        extra = F.array_sort(F.filter(keys, lambda k: ~k.isin(*known)))
        return F.struct(
            o["place"].alias("candidate"), o["repairs"].alias("repairs"), answer.alias("answer"), citations.alias("citations"), status.cast(text).alias("evidence_status"), rounds.alias("retrieval_rounds"),
            claims.alias("claims"), extra.alias("extra"), F.array_compact(F.array(*notes)).alias("coerced"), wrong.alias("wrong"),
        )

    # a step each, so that an object is parsed, and its fields are looked up, once and not for every use of them
    made = F.col("objects")
    for step in (opened, named, answered, judged):
        made = F.transform(made, step)
    every = rows.withColumn("judged", made)
    every = every.withColumn("a", F.get(F.filter("judged", lambda x: x["wrong"].isNull()), 0)).withColumn("last", F.get("judged", F.size("judged") - 1))
    error = F.when(F.col("a").isNotNull(), None).when(F.col("tried") == 0, "no_object").when(F.col("last").isNull() | (F.col("last.candidate") < F.col("tried") - 1), "invalid_json").otherwise(F.col("last.wrong"))
    fields = [F.col(f"a.{c}").alias(c) for c in ("candidate", "answer", "citations", "evidence_status", "retrieval_rounds", "claims", "extra", "coerced")]
    return every.select("key", F.col("a").isNotNull().alias("parsed"), *fields, "thinking", "unclosed", "fence", F.coalesce("a.repairs", F.lit(0)).alias("repairs"), error.alias("error"))
