"""Runs over judged questions: labelled evaluation, evidence by round, retry figures, audits, ablation grids and arm flips.

Rankings have question_id, method, passage_id, rank and score; judgments question_id, passage_id and grade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T

ANSWERED, REFUSED, NO_CITATION = "answered", "refused", "no-cite"


def label_exclusions(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """Questions that are not evaluated, with the reason: no label row, or one that is not mapped."""
    known = labels.select("question_id", "status")
    reason = F.when(F.col("status").isNull(), "missing_labels").when(F.col("status") != "mapped", "unmapped_labels")
    return questions.select("question_id").join(known, "question_id", "left").select("question_id", reason.alias("reason")).where("reason is not null")


def labelled_evaluation(rankings: DataFrame, judgments: DataFrame, labels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Figures of each mapped question, method and k, with unknown judgments kept apart.

    Where the labels are incomplete and the top k holds a passage without a judgment, full figures are null
    rather than counting it as irrelevant; where they are incomplete but all of the top k is judged, recall
    and nDCG are relative to the pool. ``judged_*`` are those of the ranking of judged passages only. ``category``
    names why a question fails. Labels have question_id, status and complete.
    """
    mapped = labels.where("status = 'mapped'").select("question_id", "complete")
    cells = mapped.crossJoin(F.broadcast(rankings.select("method").distinct())).select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    along = Window.partitionBy("question_id", "method").orderBy("rank")
    seen = rankings.join(judgments, ["question_id", "passage_id"], "left")
    seen = seen.withColumn("place", F.count("grade").over(along)).select("question_id", "method", "rank", "grade", "place")
    inside, good = F.col("rank") <= F.col("k"), F.col("grade") > 0
    compressed = good & (F.col("place") <= F.col("k"))
    got = cells.join(seen, ["question_id", "method"], "left").groupBy("question_id", "method", "k", "complete").agg(
        F.count_if(inside).alias("returned"), F.count_if(inside & F.col("grade").isNotNull()).alias("known"), F.count_if(inside & good).alias("hits"),
        F.min(F.when(inside & good, F.col("rank"))).alias("first"), F.count_if(compressed).alias("judged_hits"), F.min(F.when(compressed, F.col("place"))).alias("judged_first"),
        F.coalesce(F.sum(F.when(inside & good, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"), F.coalesce(F.sum(F.when(compressed, 1 / F.log2(F.col("place") + 1.0))), F.lit(0.0)).alias("judged_dcg"),
    )
    relevant = judgments.where("grade > 0").groupBy("question_id").agg(F.count("*").alias("relevant"))
    got = got.join(relevant, "question_id", "left").na.fill({"relevant": 0})
    full, complete = F.col("complete") | (F.col("known") == F.col("returned")), F.col("complete")
    some = F.col("relevant") > 0
    category = (
        F.when(F.col("returned") == 0, "no_passages").when(~full, "unjudged_top_k").when(~some, "no_relevant_judgments")
        .when(F.col("hits") == 0, "no_known_positive_at_k").otherwise("known_positive_hit")
    )
    share = F.col("hits") / F.col("relevant")
    best = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("k", F.col("relevant").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return got.select(
        "question_id", "method", "k", "returned", category.alias("category"),
        T.rounded(F.when(F.col("returned") > 0, F.col("known") / F.col("returned")).otherwise(1.0)).alias("coverage"),
        T.rounded(F.when(full, F.col("hits") / F.col("k"))).alias("precision"), T.rounded(F.when(full & complete & some, share)).alias("recall"),
        T.rounded(F.when(full & complete & some, F.col("dcg") / best)).alias("ndcg"), T.rounded(F.when(full & ~complete & some, F.col("dcg") / best)).alias("pool_ndcg"),
        T.rounded(F.when(some, F.col("judged_hits") / F.col("relevant"))).alias("judged_recall"), T.rounded(F.when(some, F.col("judged_dcg") / best)).alias("judged_ndcg"),
        T.rounded(F.when(full & ~complete & some, share)).alias("pool_recall"), T.rounded(F.when(full, F.coalesce(1 / F.col("first"), F.lit(0.0)))).alias("mrr"),
        T.rounded(F.col("judged_hits") / F.col("k")).alias("judged_precision"), T.rounded(F.coalesce(1 / F.col("judged_first"), F.lit(0.0))).alias("judged_mrr"),
        (F.col("relevant") - F.col("hits")).alias("missing"),
    )


def finite_means(figures: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Means over the rows that have a finite figure (no null, no NaN, no infinity), with their number."""
    def fine(n: str) -> Column:
        return F.when(~F.isnan(n) & (F.abs(F.col(n)) < float("inf")), F.col(n))

    return figures.groupBy(*by).agg(F.count("*").alias("questions"), *(T.exact_mean(fine(n)).alias(n) for n in names), *(F.count(fine(n)).alias(n + "_n") for n in names))


def paired_contributions(figures: DataFrame, before: str, after: str, names: list[str]) -> DataFrame:
    """Mean difference of each figure and k between two methods, over the questions where both have it."""
    tall = figures.select("question_id", "method", "k", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("f")).select("question_id", "method", "k", "f.*")
    both = tall.where("value is not null").groupBy("question_id", "k", "metric").agg(F.max(F.when(F.col("method") == before, F.col("value"))).alias("old"), F.max(F.when(F.col("method") == after, F.col("value"))).alias("new"))
    return both.where("old is not null and new is not null").groupBy("k", "metric").agg(T.exact_mean(F.col("new") - F.col("old")).alias("mean_delta"), F.count("*").alias("paired_questions"))


def evidence_recall(questions: DataFrame, retrieved: DataFrame, gold: DataFrame, mapping: DataFrame, runs: DataFrame) -> DataFrame:
    """Recall of gold passages over all rounds of a question and over the first, with what stands in the way.

    ``retrieved`` has question_id, round (from 1) and passage_id; ``mapping`` the questions with a gold
    mapping, ``runs`` those with a record and whether it failed. Failures count in ``recall`` as nothing found.
    """
    found = retrieved.groupBy("question_id", "passage_id").agg(F.min("round").alias("round"))
    hit = found.join(gold.select("question_id", "passage_id", F.lit(1).alias("hit")), ["question_id", "passage_id"], "left")
    sums = hit.groupBy("question_id").agg(F.count("*").alias("retrieved"), F.count("hit").alias("matched"), F.count_if((F.col("hit") == 1) & (F.col("round") == 1)).alias("first"))
    rounds = retrieved.groupBy("question_id").agg(F.max("round").alias("rounds"))
    need = gold.groupBy("question_id").agg(F.count("*").alias("gold"))
    full = questions.select("question_id").join(mapping.select("question_id", F.lit(1).alias("mapped")), "question_id", "left").join(runs.select("question_id", "failed"), "question_id", "left")
    full = full.join(need, "question_id", "left").join(sums, "question_id", "left").join(rounds, "question_id", "left").na.fill({"gold": 0, "retrieved": 0, "matched": 0, "first": 0, "rounds": 0})
    status = (
        F.when(F.col("mapped").isNull(), "missing_mapping").when(F.col("gold") == 0, "empty_mapping")
        .when(F.col("failed").isNull(), "missing_prediction").when(F.col("failed"), "retrieval_error").otherwise("ok")
    )
    valid = F.col("mapped").isNotNull() & (F.col("gold") > 0)
    recall = F.when(valid, F.col("matched") / F.col("gold"))
    return full.select(
        "question_id", status.alias("status"), "gold", "retrieved", "matched", "rounds",
        T.rounded(recall).alias("recall"), T.rounded(F.when(status == "ok", recall)).alias("successful_recall"), T.rounded(F.when(valid, F.col("first") / F.col("gold"))).alias("first_round_recall"),
    )


def cumulative_recall(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """By question and round: distinct passages and gold passages found until then, gold passages of the question, and what the round added."""
    found = retrieved.groupBy("question_id", "passage_id").agg(F.min("round").alias("round"))
    hit = found.join(gold.select("question_id", "passage_id", F.lit(1).alias("hit")), ["question_id", "passage_id"], "left")
    added = hit.groupBy("question_id", "round").agg(F.count("*").alias("new"), F.count("hit").alias("new_gold"))
    rounds = retrieved.select("question_id", "round").distinct().join(added, ["question_id", "round"], "left").na.fill(0)
    along = Window.partitionBy("question_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    need = gold.groupBy("question_id").agg(F.count("*").alias("gold"))
    total = rounds.withColumns({"seen": F.sum("new").over(along), "matched": F.sum("new_gold").over(along)})
    return total.join(need, "question_id", "left").na.fill({"gold": 0})


def retry_figures(by_round: DataFrame) -> DataFrame:
    """One row of figures of a run: recall before and after retries, recovery, and retries that were needless, useless or brought nothing new."""
    later, some = F.col("round") > 1, F.col("gold") > 0
    before = F.col("matched") - F.col("new_gold")
    ends = by_round.groupBy("question_id").agg(F.max("round").alias("rounds"), F.max("gold").alias("gold"), F.min_by("matched", "round").alias("a"), F.max_by("matched", "round").alias("z"), F.max("seen").alias("seen"))
    rate = lambda a, b: T.rounded(F.when(b > 0, a / b))
    retries = by_round.agg(
        F.count_if(later).alias("retries"), rate(F.count_if(later & some & (before == F.col("gold"))), F.count_if(later & some)).alias("unnecessary"),
        rate(F.count_if(later & some & (F.col("new_gold") == 0)), F.count_if(later & some)).alias("ineffective"), rate(F.count_if(later & (F.col("new") == 0)), F.count_if(later)).alias("redundant"),
    )
    improvable = some & (F.col("a") < F.col("gold"))
    whole = ends.agg(
        F.count("*").alias("questions"), T.rounded(F.avg("rounds")).alias("mean_rounds"), T.rounded(F.avg("seen")).alias("mean_passages"), F.count_if(some).alias("with_gold"),
        T.rounded(F.avg(F.when(some, F.col("a") / F.col("gold")))).alias("recall_before"), T.rounded(F.avg(F.when(some, F.col("z") / F.col("gold")))).alias("recall_after"),
        rate(F.count_if(improvable & (F.col("z") == F.col("gold"))), F.count_if(improvable)).alias("recovery_rate"),
    )
    return whole.crossJoin(retries)


def budget_recall(rankings: DataFrame, budgets: DataFrame, gold: DataFrame) -> DataFrame:
    """Recall of each question's ranking cut at its own budget (question_id, budget): what another arm may be compared with at equal cost."""
    cut = rankings.join(budgets, "question_id").where(F.col("rank") <= F.col("budget"))
    hits = cut.join(gold.select("question_id", "passage_id"), ["question_id", "passage_id"], "left_semi").groupBy("question_id", "method").agg(F.count("*").alias("hits"))
    need = gold.groupBy("question_id").agg(F.count("*").alias("gold")).join(budgets, "question_id").crossJoin(F.broadcast(rankings.select("method").distinct()))
    return need.join(hits, ["question_id", "method"], "left").na.fill({"hits": 0}).groupBy("method").agg(F.count("*").alias("questions"), T.rounded(F.avg(F.col("hits") / F.col("gold"))).alias("recall"), T.rounded(F.avg("budget")).alias("mean_budget"))


def critic_audit(verdicts: DataFrame, gold: DataFrame, shown: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Verdicts (question_id, sufficient) against the gold passages: complete (all shown), hidden (all retrieved) or missing."""
    def count(part: DataFrame, name: str) -> DataFrame:
        return gold.select("question_id", "passage_id").join(part.select("question_id", "passage_id").distinct(), ["question_id", "passage_id"], "left_semi").groupBy("question_id").agg(F.count("*").alias(name))

    need = gold.groupBy("question_id").agg(F.count("*").alias("gold")).join(count(shown, "shown"), "question_id", "left").join(count(retrieved, "had"), "question_id", "left").na.fill(0)
    state = F.when(F.col("shown") == F.col("gold"), "complete").when(F.col("had") == F.col("gold"), "hidden").otherwise("missing")
    return verdicts.join(need.select("question_id", state.alias("state")), "question_id").groupBy("sufficient").pivot("state", ["complete", "hidden", "missing"]).count().na.fill(0)


def ranking_faults(rankings: DataFrame) -> DataFrame:
    """By method: questions whose ranks are not 1..n, whose scores rise with the rank, and that hold a passage twice."""
    order = Window.partitionBy("question_id", "method").orderBy("rank")
    each = rankings.withColumns({"place": F.row_number().over(order), "before": F.lag("score").over(order)})
    per = each.groupBy("method", "question_id").agg(F.count_if(F.col("place") != F.col("rank")).alias("gaps"), F.count_if(F.col("score") > F.col("before")).alias("rises"), (F.count("*") - F.count_distinct("passage_id")).alias("doubles"))
    flag = lambda n: F.count_if(F.col(n) > 0).alias(n)
    return per.groupBy("method").agg(F.count("*").alias("questions"), flag("gaps"), flag("rises"), flag("doubles"))


def return_counts(questions: DataFrame, rankings: DataFrame, depth: int) -> DataFrame:
    """How many questions got how many passages of each method, none included, and the empty places up to ``depth``."""
    cells = questions.select("question_id").distinct().crossJoin(F.broadcast(rankings.select("method").distinct()))
    per = cells.join(rankings.groupBy("question_id", "method").agg(F.count("*").alias("returned")), ["question_id", "method"], "left").na.fill({"returned": 0})
    return per.groupBy("method", "returned").agg(F.count("*").alias("questions"), F.sum(F.greatest(F.lit(depth) - F.col("returned"), F.lit(0))).alias("empty_places"))


def ablation_grid(rankings: DataFrame, judgments: DataFrame, depths: tuple[int, ...], constants: tuple[int, ...], k: int) -> DataFrame:
    """Fused rankings for every candidate depth and fusion constant: mean precision at k and reciprocal rank, and the questions."""
    grid = rankings.sparkSession.createDataFrame([(d, c) for d in depths for c in constants], "depth int, constant int")
    cells = rankings.crossJoin(F.broadcast(grid)).where(F.col("rank") <= F.col("depth"))
    fused = cells.groupBy("depth", "constant", "question_id", "passage_id").agg(F.sum(1 / (F.col("constant") + F.col("rank"))).alias("s"))
    order = Window.partitionBy("depth", "constant", "question_id").orderBy(F.round("s", 9).desc(), "passage_id")
    top = fused.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).join(judgments.where("grade > 0").select("question_id", "passage_id", F.lit(1).alias("hit")), ["question_id", "passage_id"], "left")
    per = top.groupBy("depth", "constant", "question_id").agg((F.count("hit") / k).alias("p"), F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("place"))), F.lit(0.0)).alias("r"))
    return per.groupBy("depth", "constant").agg(F.count("*").alias("questions"), T.rounded(F.avg("p")).alias("precision"), T.rounded(F.avg("r")).alias("mrr"))


def outcome(sufficient: Column, citations: Column) -> Column:
    return F.when(~sufficient, REFUSED).when(F.size(citations) == 0, NO_CITATION).otherwise(ANSWERED)


def arm_flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """Questions whose outcome differs between two arms, with the reason as far as contexts tell, and how alike these are.

    Both arms have question_id, sufficient, citations and context (arrays of passages).
    """
    def arm(d: DataFrame, side: str) -> DataFrame:
        return d.select("question_id", outcome(F.col("sufficient"), F.col("citations")).alias("outcome_" + side), F.col("citations").alias("cited_" + side), F.col("context").alias("context_" + side))

    both = arm(before, "before").join(arm(after, "after"), "question_id").where("outcome_before <> outcome_after")
    dropped = F.size(F.array_except("cited_before", "context_after"))
    lost = F.when(F.size("cited_before") == 0, "same_evidence").when(dropped == F.size(F.array_distinct("cited_before")), "evidence_dropped").when(dropped > 0, "evidence_partly_dropped").otherwise("same_evidence")
    why = (
        F.when(F.col("outcome_after") == ANSWERED, F.when(F.size(F.array_except("cited_after", "context_before")) > 0, "new_evidence").otherwise("same_evidence"))
        .when((F.col("outcome_before") == ANSWERED) & (F.col("outcome_after") == REFUSED), lost).otherwise("other")
    )
    union = F.size(F.array_union("context_before", "context_after"))
    return both.select("question_id", "outcome_before", "outcome_after", why.alias("why"), T.rounded(F.when(union > 0, F.size(F.array_intersect("context_before", "context_after")) / union)).alias("jaccard"))


def final_labels(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """One label a pair (key, a, b): a decision where there is one, else what both say; disputed pairs without a decision stay open (null)."""
    joined = pairs.join(decisions.select("key", "final"), "key", "left")
    label = F.coalesce("final", F.when(F.col("a") == F.col("b"), F.col("a")))
    source = F.when(F.col("final").isNotNull(), "decided").when(F.col("a") == F.col("b"), "agreed").otherwise("open")
    return joined.select("key", label.alias("label"), source.alias("source"))
