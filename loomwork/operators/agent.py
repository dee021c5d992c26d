"""The bounded plan-retrieve-judge-rewrite loop over DataFrames of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.scratch import kept

# Cues in order of priority, evidence requirements, and the words a retry adds.
COMPARISON_CUES = (
    "compare", "compared", "comparison", "versus", "vs", "outperform", "outperforms", "better than", "worse than", "baseline", "baselines",
    "differ from", "difference between", "improve over", "improvement over", "state-of-the-art", "state of the art",
)
CUES = {
    "comparison": COMPARISON_CUES,
    "limitation": ("limitation", "limitations", "drawback", "weakness", "shortcoming", "downside", "fail", "fails", "future work"),
    "result": (
        "accuracy", "accurate", "f1", "f-score", "bleu", "rouge", "perplexity", "auc", "precision", "recall", "score", "performance",
        "result", "results", "how well", "how much", "achieve", "achieved", "metric",
    ),
    "method": (
        "method", "approach", "architecture", "technique", "algorithm", "propose", "proposed", "trained", "implement", "implemented",
        "how do", "how does", "how did", "how is", "how are", "how was", "how were",
    ),
}
DESCRIPTIVE = ("baseline", "baselines", "state-of-the-art", "state of the art")
SETUP_CUES = (
    "dataset", "datasets", "corpus", "hyperparameter", "hyperparameters", "setup", "setting", "settings", "learning rate", "batch size",
    "split", "annotator", "annotators", "evaluate on", "evaluated on", "trained on",
)
#: name -> (section hints, keywords, keywords needed, gap where none is found)
REQUIREMENTS = {
    "method": (("method", "approach", "model", "architecture", "system"), (
        "we propose", "we present", "we introduce", "we develop", "we use", "we apply", "we employ", "we adopt", "we train", "we build",
        "our model", "our approach", "our method", "our system", "architecture", "algorithm", "based on", "consists of", "pipeline",
        "encoder", "classifier", "network"), 2, "MISSING_METHOD"),
    "experiment_context": (("setup", "setting", "dataset", "data", "corpus", "implementation", "training", "experiment", "evaluation"), (
        "dataset", "corpus", "hyperparameter", "learning rate", "batch size", "split", "setup", "implementation details", "annotated",
        "collected", "training set", "test set", "we use", "we used", "trained on", "pre-trained", "fine-tun"), 2, "MISSING_EXPERIMENT_CONTEXT"),
    "result": (("result", "evaluation", "findings", "experiment", "performance"), (
        "accuracy", "f1", "f-score", "f-measure", "bleu", "rouge", "perplexity", "precision", "recall", "score", "achieve", "obtain",
        "outperform", "improve", "performance", "%", "points"), 2, "MISSING_RESULT"),
    "comparison": (("comparison", "baseline", "related work", "compared"), (
        "baseline", "compare", "comparison", "outperform", "versus", "state-of-the-art", "state of the art", "improve", "better than",
        "previous work", "prior work", "existing"), 2, "MISSING_COMPARISON"),
    "limitation": (("limitation", "discussion", "conclusion", "error analysis", "future"), (
        "limitation", "fail", "failure", "drawback", "weakness", "future work", "however", "unable", "cannot"), 2, "WEAK_EVIDENCE"),
}
GAP_WORDS = {
    "MISSING_METHOD": "method approach architecture we propose",
    "MISSING_EXPERIMENT_CONTEXT": "dataset experimental setup evaluation metrics",
    "MISSING_RESULT": "results experimental findings accuracy score",
    "MISSING_COMPARISON": "baseline comparison state-of-the-art outperform",
    "WEAK_EVIDENCE": "additional detail",
}
PAPER_TERMS, QUERY_WORDS, TERM_LENGTH = 4, 40, 5
LEAST_ADDED = 8
"""Words a retry may add however long the question is."""
#: Section hints of the gaps that a retry may answer from one section.
GAP_HINTS = {REQUIREMENTS[name][3]: REQUIREMENTS[name][0] for name in ("method", "experiment_context", "result", "comparison")}
NO_INFORMATION = "INSUFFICIENT_INFORMATION"
"""The gap of a question that its scope can't answer: no retry."""


def question_type(question: Column) -> Column:
    """The first kind whose cue stands in the question; factual otherwise."""
    out = F.lit("factual")
    for kind, cues in reversed(CUES.items()):
        out = F.when(T.has_cue(F.lower(question), cues), kind).otherwise(out)
    return out


def requirements(questions: DataFrame) -> DataFrame:
    """(question_id, ordinal, name, hints, keywords, needed, gap): what each answer must be built on, in order."""
    text = F.lower("question")
    kind = question_type(F.col("question"))
    named = [c for c in COMPARISON_CUES if c not in DESCRIPTIVE]
    base = (
        F.when(kind == "method", F.array(F.lit("method"))).when(kind == "result", F.array(F.lit("result"))).when(kind == "limitation", F.array(F.lit("limitation")))
        .when((kind == "comparison") & ~T.has_cue(text, named), F.array(F.lit("comparison"))).when(kind == "comparison", F.array(F.lit("result"), F.lit("comparison")))
        .otherwise(F.array(F.lit("direct_answer")))
    )
    full = F.when(T.has_cue(text, SETUP_CUES), F.array_distinct(F.concat(base, F.array(F.lit("experiment_context"))))).otherwise(base)
    rows = questions.select("question_id", "question", F.posexplode(full).alias("ordinal", "name"))
    words = F.array_distinct(F.transform(T.key_terms(F.col("question")), T.stem))
    hints, keywords, needed, gap = F.array().cast("array<string>"), words, F.least(F.lit(2), F.greatest(F.size(words), F.lit(1))), F.lit("TERMINOLOGY_MISMATCH")
    for name, (h, w, n, g) in REQUIREMENTS.items():
        at = F.col("name") == name
        array = lambda xs: F.array(*(F.lit(x) for x in xs))
        hints, keywords, needed, gap = F.when(at, array(h)).otherwise(hints), F.when(at, array(w)).otherwise(keywords), F.when(at, F.lit(n)).otherwise(needed), F.when(at, g).otherwise(gap)
    return rows.select("question_id", "ordinal", "name", hints.alias("hints"), keywords.alias("keywords"), needed.alias("needed"), gap.alias("gap"))


def evidence(hits: DataFrame, needs: DataFrame) -> DataFrame:
    """(question_id, ordinal, name, passage_id) where a retrieved passage meets a requirement: by section hint or by enough distinct keywords, each at the start of a word."""
    joined = hits.join(needs, "question_id")
    text, section = F.lower("text"), F.lower("section")
    met = F.exists("hints", lambda h: F.contains(section, h))
    matched = F.size(F.filter("keywords", lambda w: F.regexp_like(text, F.concat(F.lit(r"(?<!\w)\Q"), w, F.lit(r"\E")))))
    return joined.where(met | (matched >= F.col("needed"))).select("question_id", "ordinal", "name", "passage_id")


def verdicts(needs: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, sufficient, gap): sufficient if every requirement has a passage, else the gap of the first that has none."""
    have = found.select("question_id", "ordinal").distinct().withColumn("met", F.lit(True))
    both = needs.join(have, ["question_id", "ordinal"], "left")
    gap = F.min_by("gap", F.when(F.col("met").isNull(), F.col("ordinal")))
    return both.groupBy("question_id").agg(F.bool_and(F.col("met").isNotNull()).alias("sufficient"), F.coalesce(gap, F.lit("NONE")).alias("gap"))


def paper_terms(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, terms): terms that recur over retrieved passages and are not in the question, the most common first, then the first seen."""
    asked = questions.select("question_id", T.key_terms(F.col("question")).alias("own"))
    terms = hits.select("question_id", "rank", F.posexplode(T.key_terms(F.col("text"))).alias("at", "term")).join(asked, "question_id")
    terms = terms.where((F.length("term") >= TERM_LENGTH) & ~F.array_contains("own", F.col("term")) & ~F.col("term").rlike(r"^[\d\-]+$"))
    counted = terms.groupBy("question_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("rank", "at")).alias("seen"))
    many = hits.groupBy("question_id").agg(F.when(F.count("*") > 1, 2).otherwise(1).alias("floor"))
    kept = counted.join(many, "question_id").where("n >= floor")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "seen", "term")))
    return kept.groupBy("question_id").agg(F.slice(F.transform(ordered, lambda x: x["term"]), 1, 4 * PAPER_TERMS).alias("terms"))


def extended(question: Column, words: Column, most: int = QUERY_WORDS, least_added: int = LEAST_ADDED) -> Column:
    """The question, whole, with those words that it lacks: at most ``most`` words in all, but ``least_added`` words have room after any question."""
    own = F.split(F.trim(question), r"\s+")
    new = F.filter(F.array_distinct(words), lambda w: ~F.array_contains(F.split(F.lower(F.trim(question)), r"\s+"), F.lower(w)) & (w != ""))
    room = F.greatest(F.lit(most) - F.size(own), F.lit(least_added))
    return F.array_join(F.concat(own, F.slice(new, F.lit(1), room)), " ")


def rewrites(active: DataFrame) -> DataFrame:
    """The next query of (question_id, question, gap, terms, used): the gap's words, and more terms of the passages until the query is new."""
    words = F.lit("")
    for gap, said in GAP_WORDS.items():
        words = F.when(F.col("gap") == gap, said).otherwise(words)
    base, terms = F.split(words, " "), F.coalesce("terms", F.array().cast("array<string>"))
    by_terms = F.col("gap").isin("TERMINOLOGY_MISMATCH", "WEAK_EVIDENCE")
    options = [extended(F.col("question"), F.concat(base, F.slice(terms, 1, PAPER_TERMS + extra) if extra else F.when(by_terms, F.slice(terms, 1, PAPER_TERMS)).otherwise(F.array().cast("array<string>")))) for extra in range(0, 3 * PAPER_TERMS + 1, PAPER_TERMS)]
    fresh = F.coalesce(*(F.when(~F.array_contains("used", o), o) for o in options), options[-1])
    return active.withColumn("query", fresh)


def sections_of(passages: DataFrame, scope: Column) -> DataFrame:
    """(scope, section, position): the named sections of each scope, and where each first stands."""
    rows = passages.where(F.col("section").isNotNull()).select(scope.alias("scope"), "section", F.struct("doc_id", "chunk_number").alias("at"))
    return rows.groupBy("scope", "section").agg(F.min("at").alias("position"))


def next_sections(active: DataFrame, sections: DataFrame) -> DataFrame:
    """(question_id, section): the section to search for each (question_id, scope, gap, searched), if any.

    Its lower-case name holds a hint of the gap and it was not searched before; earlier hints come first,
    then earlier sections. Gaps without hints have none: those retries search the whole scope.
    """
    hints = F.array().cast("array<string>")
    for gap, said in GAP_HINTS.items():
        hints = F.when(F.col("gap") == gap, F.array(*(F.lit(h) for h in said))).otherwise(hints)
    open_ = active.select("question_id", "scope", "searched", hints.alias("hints")).where(F.size("hints") > 0)
    both = open_.join(sections, "scope").where(~F.array_contains("searched", F.col("section")))
    hint = F.array_position(F.transform("hints", lambda h: F.contains(F.lower("section"), h)), True)
    return both.withColumn("hint", hint).where("hint > 0").groupBy("question_id").agg(F.min_by("section", F.struct("hint", "position")).alias("section"))


def scoped_hits(scores: DataFrame, passages: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best passages of each question: of the section it asks for, or of the whole scope where it asks for none or that one has none.

    ``scores``: question_id, passage_id, score; ``asked``: question_id, section (may be null). The k best inside and
    outside the section are kept first, so that no more than those meet.
    """
    held = scores.join(passages.select("passage_id", "section", "text"), "passage_id").join(asked.select("question_id", F.col("section").alias("wanted")), "question_id")
    held = held.withColumn("inside", F.coalesce(F.col("section") == F.col("wanted"), F.lit(False)))
    order = [F.round("score", 9).desc(), F.col("passage_id")]
    few = held.withColumn("rank", F.row_number().over(Window.partitionBy("question_id", "inside").orderBy(*order))).where(F.col("rank") <= k)
    each = Window.partitionBy("question_id")
    few = few.withColumn("any", F.max("inside").over(each)).where(F.col("inside") | ~F.col("any"))
    return few.withColumn("rank", F.row_number().over(each.orderBy(*order))).where(F.col("rank") <= k).select("question_id", "passage_id", "rank", "text", "section")


def judged_by_rules(hits: DataFrame, needs: DataFrame) -> DataFrame:
    """(question_id, sufficient, gap) of questions with these hits and needs."""
    return verdicts(needs, evidence(hits, needs))


def run_loop(
    questions: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    max_rounds: int = 3,
    keep: Callable[[DataFrame, str], DataFrame] | None = None,
    sections: DataFrame | None = None,
    judge: Callable[[DataFrame, DataFrame], DataFrame] = judged_by_rules,
) -> DataFrame:
    """(question_id, round, query, triggered_by, section, fallback, retrieved, sufficient, gap, stop_reason) of every round of every question.

    ``retrieve`` maps (question_id, query) rows, with the scope where questions have one and the section where
    ``sections`` are given, to hits (question_id, passage_id, rank, text, section);
    ``keep`` writes a round's rows to a shared table (by default one of the job's own), so that lineage does not grow. All open questions
    go through a round together; passages of earlier rounds stay with their question, first seen first.

    With ``sections`` (scope, section, position) a retry searches the section that fits its gap best and that this
    question has not searched yet; ``retrieve`` falls back to the whole scope where the section holds nothing, in
    the same round, which the log shows. ``judge`` maps the hits so far and the needs to (question_id, sufficient,
    gap); the gap ``INSUFFICIENT_INFORMATION`` ends a question's loop.
    """
    scope = F.col("scope") if "scope" in questions.columns else F.lit(0)
    keep = keep or kept(questions.sparkSession)
    given = ["scope"] * ("scope" in questions.columns) + ["section"] * (sections is not None)
    needs = keep(requirements(questions), "needs")
    none, never = F.array().cast("array<string>"), F.lit(None).cast("string")
    state = questions.select("question_id", scope.alias("scope"), "question", F.col("question").alias("query"), F.array(F.col("question")).alias("used"), F.lit("NONE").alias("triggered_by"), never.alias("section"), none.alias("searched"))
    pool, log = None, None
    for turn in range(1, max_rounds + 1):
        found = keep(retrieve(state.select("question_id", "query", *given)).withColumn("round", F.lit(turn)), f"hits-{turn}")
        both = found if pool is None else pool.unionByName(found)
        first = both.groupBy("question_id", "passage_id").agg(F.min_by(F.struct("round", "rank", "text", "section"), F.struct("round", "rank")).alias("h"))
        pool = keep(first.select("question_id", "passage_id", "h.*"), f"pool-{turn}")
        mine = pool.join(state.select("question_id"), "question_id", "left_semi")
        said = judge(mine, needs.join(state.select("question_id"), "question_id", "left_semi"))
        done = F.when(F.col("sufficient"), "sufficient").when(F.col("gap") == NO_INFORMATION, "insufficient_information").when(F.lit(turn >= max_rounds), "max_rounds")
        counts = mine.groupBy("question_id").agg(F.count("*").alias("retrieved"))
        inside = found.select("question_id", "section").distinct().withColumn("inside", F.lit(True))
        entry = state.join(said, "question_id").join(counts, "question_id", "left").join(inside, ["question_id", "section"], "left")
        now = keep(entry.withColumn("stop_reason", done).withColumn("fallback", F.col("section").isNotNull() & F.col("inside").isNull()), f"round-{turn}")
        entry = now.select("question_id", F.lit(turn).alias("round"), "query", "triggered_by", "section", "fallback", F.coalesce("retrieved", F.lit(0)).alias("retrieved"), "sufficient", "gap", "stop_reason")
        log = entry if log is None else log.unionByName(entry)
        if turn == max_rounds:
            break
        active = now.where("stop_reason is null").select("question_id", "scope", "question", "used", "gap", F.when(F.col("section").isNull(), F.col("searched")).otherwise(F.array_append("searched", F.col("section"))).alias("searched"))
        ordered = mine.withColumn("rank", F.col("round") * 1000 + F.col("rank"))
        terms = paper_terms(ordered.join(active.select("question_id"), "question_id", "left_semi"), questions)
        chosen = active.select("question_id", never.alias("section")).limit(0) if sections is None else next_sections(active, sections)
        told = rewrites(active.join(terms, "question_id", "left")).join(chosen, "question_id", "left")
        state = keep(told.select("question_id", "scope", "question", "query", F.array_append("used", F.col("query")).alias("used"), F.col("gap").alias("triggered_by"), "section", "searched"), f"state-{turn}")
    return log


def recall_by_round(log: DataFrame, hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of gold passages found up to each round of each question: a passage counts from the round that first found it."""
    first = hits.join(gold, ["question_id", "passage_id"], "left_semi").groupBy("question_id", "passage_id").agg(F.min("round").alias("first"))
    need = gold.groupBy("question_id").agg(F.count("*").alias("need"))
    at = log.select("question_id", "round").join(need, "question_id").join(first, "question_id", "left")
    return at.groupBy("question_id", "round", "need").agg(F.count(F.when(F.col("first") <= F.col("round"), 1)).alias("found")).withColumn("recall", T.rounded(F.col("found") / F.col("need")))
