"""Grounding checks: what an answer cites, the numbers and claims it makes, and whether passages support them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import claims as C
from loomwork.functions import text as T

DIRECT, PARTIAL, LEAST_TOKENS, MOST_PASSAGES = 0.60, 0.35, 3, 2
REFUSAL = "Insufficient evidence in the retrieved passages."


def selected(hits: DataFrame, limit: int = 8) -> DataFrame:
    """Prompt passages of each question: the best passage of each component in turn that none before it took, then the others in order.

    ``hits``: question_id, passage_id, rank and components (array of component numbers, may be empty).
    """
    rows = hits.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "passage_id", "components"))).alias("h"))
    parts = F.array_sort(F.array_distinct(F.flatten(F.transform("h", lambda x: x["components"]))))
    ids = F.transform("h", lambda x: x["passage_id"])
    chosen = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, c: F.concat(acc, F.slice(F.transform(F.filter("h", lambda x: F.array_contains(x["components"], c) & ~F.array_contains(acc, x["passage_id"])), lambda x: x["passage_id"]), 1, 1)),
    )
    return rows.select("question_id", F.posexplode(F.slice(F.array_distinct(F.concat(chosen, ids)), 1, limit)).alias("place", "passage_id"))


def citation_faults(answers: DataFrame, hits: DataFrame, shown: DataFrame) -> DataFrame:
    """(question_id, code, severity, subject): citations of passages never retrieved, or retrieved but not shown."""
    cited = answers.select("question_id", F.explode("citations").alias("passage_id")).distinct()
    never = cited.join(hits, ["question_id", "passage_id"], "left_anti").select("question_id", F.lit("HALLUCINATED_CITATION").alias("code"), F.lit("error").alias("severity"), F.col("passage_id").alias("subject"))
    unseen = cited.join(hits, ["question_id", "passage_id"], "left_semi").join(shown, ["question_id", "passage_id"], "left_anti")
    return never.unionByName(unseen.select("question_id", F.lit("CITATION_NOT_IN_PROMPT").alias("code"), F.lit("error").alias("severity"), F.col("passage_id").alias("subject")))


def number_faults(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Numbers of an answer that neither its cited passages nor its question state; where another shown passage does, that is a repairable warning."""
    said = answers.select("question_id", F.explode(F.array_except(T.numbers(F.col("answer")), T.numbers(F.col("question")))).alias("number"), "citations")
    stated = passages.select("question_id", "passage_id", F.explode(F.array_distinct(T.numbers(F.col("text")))).alias("number"))
    both = said.join(stated, ["question_id", "number"], "left")
    judged = both.groupBy("question_id", "number").agg(F.coalesce(F.bool_or(F.array_contains("citations", F.col("passage_id"))), F.lit(False)).alias("cited"), F.count("passage_id").alias("n"))
    code = F.when(F.col("n") > 0, "NUMBER_FROM_UNCITED_PASSAGE").otherwise("UNSUPPORTED_NUMBER")
    return judged.where("not cited").select("question_id", code.alias("code"), F.when(F.col("n") > 0, "warning").otherwise("error").alias("severity"), F.col("number").alias("subject"))


def _support(score: Column) -> Column:
    return F.when(score >= DIRECT, "direct").when(score >= PARTIAL, "partial").otherwise("unsupported")


def claim_support(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(question_id, claim, sentence, passage_ids, score, support) of each claim: a sentence of at least three content terms.

    ``answers``: question_id, answer; ``passages``: question_id, passage_id, place, text. The score is the best share of
    the claim's terms in a passage. A direct claim names its two best direct passages, a partial one its best, an
    unsupported one none; ties go to the earlier place. A question without passages has no claims to map.
    """
    claims = answers.select("question_id", F.posexplode(C.split_sentences(F.col("answer"))).alias("claim", "sentence"))
    claims = claims.withColumn("t", C.content_terms(F.col("sentence"))).where(F.size("t") >= LEAST_TOKENS)
    held = passages.select("question_id", "passage_id", "place", C.content_terms(F.col("text")).alias("u"))
    scored = claims.join(held, "question_id").withColumn("score", F.size(F.array_intersect("t", "u")) / F.size("t"))
    order = Window.partitionBy("question_id", "claim").orderBy(F.col("score").desc(), "place")
    top = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= MOST_PASSAGES)
    best = top.groupBy("question_id", "claim").agg(F.max_by("sentence", -F.col("r")).alias("sentence"), F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("r", "passage_id", "score"))).alias("p"))
    named = F.when(F.col("score") >= DIRECT, F.filter("p", lambda x: x["score"] >= DIRECT)).when(F.col("score") >= PARTIAL, F.slice("p", 1, 1)).otherwise(F.slice("p", 1, 0))
    return best.select("question_id", "claim", "sentence", F.transform(named, lambda x: x["passage_id"]).alias("passage_ids"), T.rounded(F.col("score")).alias("score"), _support(F.col("score")).alias("support"))


QUOTE_WORD, QUOTE_WORDS, QUOTE_SHARE = r"[a-z0-9]+(?:[.,%'-][a-z0-9]+)*", 4, 0.8


def quote_supported(quote: Column, text: Column) -> Column:
    """Whether a quote of four words or more was copied from a text, small edits allowed.

    An ellipsis parts a quote; each part stands in the text as a run of words, or, from three words on, four fifths of
    its distinct word triples do.
    """
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit(QUOTE_WORD), F.lit(0))
    triples = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 2, F.lit(1))), lambda i: F.array_join(F.slice(x, i, F.lit(3)), " ")))
    spaced = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    parts = F.filter(F.transform(F.split(quote, r"\.\.\.|…"), words), lambda p: F.size(p) > 0)
    have = words(text)

    def stands(p: Column) -> Column:
        share = F.size(F.array_intersect(triples(p), triples(have))) / F.size(triples(p))
        return F.contains(spaced(have), spaced(p)) | ((F.size(p) >= 3) & (share >= QUOTE_SHARE))

    enough = F.aggregate(parts, F.lit(0), lambda n, p: n + F.size(p)) >= QUOTE_WORDS
    return F.coalesce(enough & F.forall(parts, stands), F.lit(False))


def finalised(answers: DataFrame, faults: DataFrame) -> DataFrame:
    """Answers as they may be given: one with an error becomes the standard refusal without citations."""
    counts = faults.groupBy("question_id").agg(F.sum((F.col("severity") == "error").cast("long")).alias("errors"), F.sum((F.col("severity") == "warning").cast("long")).alias("warnings"))
    full = answers.join(counts, "question_id", "left").na.fill({"errors": 0, "warnings": 0})
    bad = F.col("errors") > 0
    return full.select("question_id", F.when(bad, REFUSAL).otherwise(F.col("answer")).alias("answer"), F.when(bad, F.array().cast("array<string>")).otherwise(F.col("citations")).alias("citations"), bad.alias("downgraded"), "errors", "warnings")
