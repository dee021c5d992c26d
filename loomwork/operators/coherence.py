"""Whether an answer's status, citations, claims and the question's parts go together: a table of codes.

Answers: question_id, question, answer, evidence_status, citations (array), provenance (array of
claim, passage_ids, support), components (array of name, passage_ids), gap, sufficient. Passages:
question_id, passage_id, place, text, shown. Ids cited or attributed meet the passages once, by
(question_id, passage_id); all rules read that table or its sums a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import claims as C
from loomwork.operators.grounding import DIRECT, PARTIAL, REFUSAL

# Codes and their severities.
SEVERITY = {
    "HALLUCINATED_CITATION": "error", "CITATION_NOT_IN_PROMPT": "error", "CLAIM_WITHOUT_EVIDENCE": "warning", "CITATION_PROVENANCE_MISMATCH": "warning", "PROVENANCE_OVERSTATED": "warning",
    "SUFFICIENT_WITHOUT_CITATION": "error", "MISSING_REFUSAL": "error", "REFUSAL_WITH_CITATIONS": "warning", "UNCOVERED_QUESTION_CLAUSE": "warning", "UNCOVERED_REQUIRED_COMPONENT": "warning",
    "EMPTY_CONTEXT": "warning", "AGENT_INSUFFICIENT": "warning", "GENERATED_WITH_INSUFFICIENT_EVIDENCE": "warning",
}
CLAUSE_RECALL = 0.35


def terminal(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """The answers with ``ended``: EMPTY_CONTEXT without any passage, AGENT_INSUFFICIENT where the gap says that nothing can be found; those become refusals.

    An answer kept although the judge was not satisfied has GENERATED_WITH_INSUFFICIENT_EVIDENCE.
    """
    have = passages.select("question_id").distinct().withColumn("any", F.lit(True))
    code = F.when(F.col("any").isNull(), "EMPTY_CONTEXT").when(F.col("gap") == "INSUFFICIENT_INFORMATION", "AGENT_INSUFFICIENT").when(~F.col("sufficient"), "GENERATED_WITH_INSUFFICIENT_EVIDENCE")
    full = answers.join(have, "question_id", "left").withColumn("ended", code)
    stop = F.coalesce(F.col("ended").isin("EMPTY_CONTEXT", "AGENT_INSUFFICIENT"), F.lit(False))
    kept = {"answer": F.when(stop, REFUSAL).otherwise(F.col("answer")), "evidence_status": F.when(stop, "INSUFFICIENT").otherwise(F.col("evidence_status"))}
    kept |= {c: F.when(~stop, F.col(c)).otherwise(F.filter(c, lambda x: F.lit(False))) for c in ("citations", "provenance")}
    return full.withColumns(kept).drop("any")


def references(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(question_id, passage_id, cited, attributed, retrieved, shown, text) of every id that an answer cites or a claim of it names."""
    cited = answers.select("question_id", F.explode("citations").alias("passage_id"), F.lit(True).alias("cited"), F.lit(False).alias("attributed"))
    named = answers.select("question_id", F.explode("provenance").alias("p")).select("question_id", F.explode("p.passage_ids").alias("passage_id"), F.lit(False).alias("cited"), F.lit(True).alias("attributed"))
    both = cited.unionByName(named).groupBy("question_id", "passage_id").agg(F.max("cited").alias("cited"), F.max("attributed").alias("attributed"))
    held = passages.select("question_id", "passage_id", "shown", "text", F.lit(True).alias("retrieved"))
    return both.join(held, ["question_id", "passage_id"], "left").na.fill(False, ["retrieved", "shown"])


def _coded(rows: DataFrame, code: str | Column, subject: Column) -> DataFrame:
    return rows.select("question_id", (F.lit(code) if isinstance(code, str) else code).alias("code"), subject.cast("string").alias("subject")).where("code is not null")


def _recall(terms: Column, held: Column) -> Column:
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(F.array_intersect(terms, held)) / F.greatest(F.size(terms), F.lit(1)))


def codes(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(question_id, code, severity, subject), each once, of answers that went through ``terminal``."""
    refs = references(answers, passages)
    listed = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("passage_id"))))
    valid = F.col("cited") & F.col("retrieved") & F.col("shown")
    sums = refs.groupBy("question_id").agg(
        F.count_if(valid).alias("n_valid"), listed(F.col("attributed") & ~F.col("cited")).alias("uncited"), listed(F.col("cited") & ~F.col("attributed")).alias("unclaimed"),
        F.array_distinct(F.flatten(F.collect_list(F.when(valid, C.content_terms(F.col("text")))))).alias("cited_terms"), F.max(F.when(valid, F.length("text"))).alias("cited_length"),
    )
    retrieved = passages.groupBy("question_id").agg(F.count("*").alias("n_passages"))
    full = answers.join(sums, "question_id", "left").join(retrieved, "question_id", "left").na.fill(0, ["n_valid", "n_passages", "cited_length"])
    said = F.col("evidence_status") == "SUFFICIENT"
    joined = lambda c: F.array_join(c, ",")
    claims = answers.select("question_id", F.explode("provenance").alias("p"))
    clauses = full.where(said & (F.col("cited_length") > 0)).select("question_id", "cited_terms", C.question_clauses(F.col("question")).alias("c")).where(F.size("c") > 1).select("question_id", "cited_terms", F.explode("c").alias("clause"))
    found = [
        _coded(refs, F.when(~F.col("retrieved"), "HALLUCINATED_CITATION").when(~F.col("shown"), "CITATION_NOT_IN_PROMPT"), F.col("passage_id")),
        _coded(claims.where((F.size("p.passage_ids") == 0) & (F.col("p.support") != "unsupported")), "CLAIM_WITHOUT_EVIDENCE", F.substring("p.claim", 1, 120)),
        _coded(full.where(said & (F.size("provenance") > 0) & (F.size("uncited") > 0)), "CITATION_PROVENANCE_MISMATCH", joined("uncited")),
        _coded(full.where(said & (F.size("provenance") > 0) & (F.size("unclaimed") > 0)), "CITATION_PROVENANCE_MISMATCH", joined("unclaimed")),
        _overstated(answers, refs.where(valid)),
        _coded(full.where(said & (F.col("n_valid") == 0)), F.when(F.col("n_passages") == 0, "MISSING_REFUSAL").otherwise("SUFFICIENT_WITHOUT_CITATION"), F.lit("")),
        _coded(full.where(~said & (F.size("citations") > 0)), "REFUSAL_WITH_CITATIONS", joined("citations")),
        _coded(clauses.where(_recall(C.content_terms(F.col("clause")), F.col("cited_terms")) < CLAUSE_RECALL), "UNCOVERED_QUESTION_CLAUSE", F.substring("clause", 1, 120)),
        _components(full.where(said), passages, refs),
        _coded(full, F.col("ended"), F.lit("")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    severity = F.lit(None).cast("string")
    for code, s in SEVERITY.items():
        severity = F.when(F.col("code") == code, s).otherwise(severity)
    return out.distinct().select("question_id", "code", severity.alias("severity"), "subject")


def _overstated(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """Claims that say more support than the best of the cited passages gives them."""
    claims = answers.select("question_id", F.posexplode("provenance").alias("place", "p")).withColumn("t", C.content_terms(F.col("p.claim")))
    scored = claims.join(cited.select("question_id", C.content_terms(F.col("text")).alias("u")), "question_id")
    best = scored.groupBy("question_id", "place").agg(F.first("p").alias("p"), F.max(_recall(F.col("t"), F.col("u"))).alias("score"))
    said = F.when(F.col("p.support") == "direct", 2).when(F.col("p.support") == "partial", 1).otherwise(0)
    borne = F.when(F.col("score") >= DIRECT, 2).when(F.col("score") >= PARTIAL, 1).otherwise(0)
    return _coded(best.where(said > borne), "PROVENANCE_OVERSTATED", F.substring("p.claim", 1, 120))


def _components(answers: DataFrame, passages: DataFrame, refs: DataFrame) -> DataFrame:
    """Components of which no passage is known, shown, or cited; an answer without any mapped component is not asked."""
    asked = answers.where(F.exists("components", lambda c: F.size(c["passage_ids"]) > 0)).select("question_id", F.explode("components").alias("c")).select("question_id", "c.name", F.explode_outer("c.passage_ids").alias("passage_id"))
    seen = passages.where("shown").select("question_id", "passage_id", F.lit(1).alias("visible"))
    named = refs.where("cited and retrieved and shown").select("question_id", "passage_id", F.lit(1).alias("used"))
    met = asked.join(seen, ["question_id", "passage_id"], "left").join(named, ["question_id", "passage_id"], "left").groupBy("question_id", "name").agg(F.count("used").alias("used"))
    return _coded(met.where("used = 0"), "UNCOVERED_REQUIRED_COMPONENT", F.col("name"))


def summed(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, errors, warnings, worst, codes) of every answer; ``worst`` is ok, warning or error."""
    n = found.groupBy("question_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    full = answers.select("question_id").join(n, "question_id", "left").na.fill(0, ["errors", "warnings"]).na.fill("", ["codes"])
    return full.withColumn("worst", F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warning").otherwise("ok"))
