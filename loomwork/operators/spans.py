"""Spans of flagged sentences in answers: where they stand, merged where they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T

# Codes whose subjects may be put in other words, the length at which subjects are cut, and what ends a sentence.
PARAPHRASED = ("UNSUPPORTED_CLAIM", "CLAIM_WITHOUT_EVIDENCE", "PROVENANCE_OVERSTATED")
CUT, LEAST_WORDS, CLOSE = 120, 3, 0.6
SENTENCE = r"(?s)\s*\S.*?(?:[.!?](?=\s|\z)|(?=\n?\z))"
WORD = r"[\p{L}\p{N}_]+"


def sentence_spans(text: Column) -> Column:
    """Start, end (offsets from 0, end left out) and text of each sentence, which begins with its first character that is no space."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    ends = F.transform(found, lambda s, i: F.aggregate(F.slice(found, F.lit(1), i + 1), F.lit(0), lambda n, x: n + F.length(x)))
    bare = lambda s: F.regexp_replace(s, r"\A\s+", "")
    return F.transform(F.arrays_zip(found.alias("s"), ends.alias("e")), lambda z: F.struct((z["e"] - F.length(bare(z["s"]))).alias("start"), z["e"].alias("end"), bare(z["s"]).alias("text")))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def closest_sentence(text: Column, claim: Column, least: float = CLOSE) -> Column:
    """The sentence span that holds most of the claim's distinct words, if that is ``least`` of them; the last of equals."""
    want = _words(claim)
    share = lambda s: F.size(F.array_intersect(want, _words(s["text"]))) / F.greatest(F.size(want), F.lit(1))
    scored = F.transform(sentence_spans(text), lambda s: F.struct(share(s).alias("score"), s["start"].alias("start"), s["end"].alias("end")))
    best = F.array_max(F.filter(scored, lambda s: s["score"] >= least))
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), best["end"].alias("end")))


def found_span(text: Column, code: Column, subject: Column) -> Column:
    """Where a fault's subject stands: word for word (three words or more), else, for codes of claims, the closest sentence.

    A subject that was cut at its longest reaches to the end of its sentence.
    """
    bare = F.regexp_replace(F.coalesce(subject, F.lit("")), r"\A\s+|\s+\z", "")
    start = F.when(F.size(F.regexp_extract_all(bare, F.lit(r"\S+"), F.lit(0))) >= LEAST_WORDS, F.instr(text, bare) - 1).otherwise(-1)
    end = start + F.length(bare)
    stop = F.regexp_instr(F.substring(text, end + 1, F.length(text)), F.lit(r"[.!?](\s|\z)"))
    whole = F.when(F.length(subject) < CUT, end).when(stop > 0, end + stop).otherwise(F.length(text))
    return F.when(start >= 0, F.struct(start.alias("start"), whole.cast("int").alias("end"))).when(code.isin(*PARAPHRASED), closest_sentence(text, bare))


def flagged(answers: DataFrame, faults: DataFrame) -> DataFrame:
    """(question_id, start, end) of the flagged stretches of (question_id, answer): spans of (question_id, code, subject) that overlap or touch are one."""
    spans = faults.join(answers.select("question_id", "answer"), "question_id").select("question_id", found_span(F.col("answer"), F.col("code"), F.col("subject")).alias("s")).where("s is not null").select("question_id", "s.start", "s.end").distinct()
    order = Window.partitionBy("question_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1))).withColumn("k", F.sum("new").over(order))
    return parted.groupBy("question_id", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")


def within_budget(ranked: DataFrame, budgets: list[int]) -> DataFrame:
    """(question_id, method, budget, passage_id, rank, before, shown): what fits when passages are read in rank order up to so many words; the last may be cut.

    ``ranked``: question_id, method, passage_id, rank, n_words; rankings are as deep as retrieval was. ``before`` words
    stand ahead of a passage, ``shown`` of its own are read.
    """
    order = Window.partitionBy("question_id", "method").orderBy("rank")
    placed = ranked.withColumn("before", F.sum("n_words").over(order) - F.col("n_words"))
    each = placed.withColumn("budget", F.explode(F.array(*(F.lit(b) for b in budgets)))).where(F.col("before") < F.col("budget"))
    return each.select("question_id", "method", "budget", "passage_id", "rank", "before", F.least("n_words", F.col("budget") - F.col("before")).cast("long").alias("shown"))


def evidence_places(passages: DataFrame, evidence: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, passage_id, last_word): where the evidence ends in each gold passage, by words from 1; a passage that lies within its evidence ends it.

    ``passages``: passage_id, text; ``evidence``: question_id, text; ``gold``: question_id, passage_id.
    """
    both = gold.join(passages.select("passage_id", T.words(F.col("text")).alias("w")), "passage_id").join(evidence.select("question_id", T.words(F.col("text")).alias("v")), "question_id")
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    at = F.instr(spaced("w"), spaced("v"))
    ahead = F.substring(spaced("w"), F.lit(1), at)
    spaces = F.length(ahead) - F.length(F.replace(ahead, F.lit(" "), F.lit("")))
    last = F.when(at > 0, spaces - 1 + F.size("v")).otherwise(F.size("w"))
    return both.groupBy("question_id", "passage_id").agg(F.min(last).cast("int").alias("last_word"))


def budget_hits(ranked: DataFrame, places: DataFrame, budgets: list[int]) -> DataFrame:
    """(method, budget, questions, hits, words, partial): questions whose evidence lies whole within the words read.

    ``places``: question_id, passage_id, last_word, the evidence's last word in the passage, from 1. ``words`` is
    the mean number read, ``partial`` how many questions' last passage was cut.
    """
    shown = within_budget(ranked, budgets)
    sizes = ranked.select("question_id", "method", "passage_id", "n_words").distinct()
    marked = shown.join(places, ["question_id", "passage_id"], "left").join(sizes, ["question_id", "method", "passage_id"])
    each = marked.groupBy("question_id", "method", "budget").agg(
        F.max(F.coalesce((F.col("last_word") <= F.col("shown")).cast("int"), F.lit(0))).alias("hit"), F.max("before").alias("ahead"), F.max_by("shown", "before").alias("last"), F.max((F.col("shown") < F.col("n_words")).cast("int")).alias("cut")
    )
    return each.groupBy("method", "budget").agg(F.count("*").alias("questions"), F.sum("hit").alias("hits"), F.round(F.avg(F.col("ahead") + F.col("last")), 6).alias("words"), F.sum("cut").alias("partial"))
