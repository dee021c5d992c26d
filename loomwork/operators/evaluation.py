"""Evaluation: ranking metrics, pools, comparison with bootstrap intervals, agreement, answers, latency and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators.numbering import numbered
from loomwork.operators.order_statistics import quantiles


def binary_metrics(rankings: DataFrame, qrels: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """precision, recall, mrr and ndcg at k of each question and method; recall and ndcg are null without relevant passages."""
    judged = rankings.where(F.col("rank") <= k).join(qrels.select("question_id", "passage_id", F.lit(1).alias("hit")), ["question_id", "passage_id"], "left")
    got = judged.groupBy("question_id", "method").agg(
        F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"))
    relevant = qrels.groupBy("question_id").agg(F.count("*").alias("relevant"))
    all_q = questions.select("question_id").crossJoin(rankings.select("method").distinct())
    full = all_q.join(got, ["question_id", "method"], "left").join(relevant, "question_id", "left").na.fill({"hits": 0, "relevant": 0, "dcg": 0.0})
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = F.col("relevant") > 0
    return full.select(
        "question_id", "method", "relevant", "hits",
        T.rounded(F.col("hits") / k).alias("precision"), T.rounded(F.when(some, F.col("hits") / F.col("relevant"))).alias("recall"),
        T.rounded(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), T.rounded(F.when(some, F.col("dcg") / ideal)).alias("ndcg"),
    )


def macro(metrics: DataFrame) -> DataFrame:
    """Means by method, each over the questions that have the figure, with their number."""
    names = ("precision", "recall", "mrr", "ndcg")
    return metrics.groupBy("method").agg(F.count("*").alias("questions"), *(T.rounded(F.avg(n)).alias(n) for n in names), *(F.count(n).alias(n + "_n") for n in names))


def coverage(rankings: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """Judged share of each top k, over what was returned and over k; and ranks compressed to judged passages (mrr)."""
    top = rankings.where(F.col("rank") <= k).join(judgments, ["question_id", "passage_id"], "left")
    judged = F.col("grade").isNotNull()
    order = Window.partitionBy("question_id", "method").orderBy(F.when(judged, 0).otherwise(1), "rank")
    place = top.withColumn("place", F.when(judged, F.row_number().over(order)))
    return place.groupBy("question_id", "method").agg(
        F.count("*").alias("returned"), F.count("grade").alias("judged"), T.rounded(F.count("grade") / F.count("*")).alias("of_returned"),
        T.rounded(F.count("grade") / k).alias("of_k"), T.rounded(F.coalesce(1 / F.min(F.when(F.col("grade") > 0, F.col("place"))), F.lit(0.0))).alias("judged_mrr"))


def pool(rankings: DataFrame, gold: DataFrame, size: int = 10) -> DataFrame:
    """Up to ``size`` candidates a question: gold first, then passages by best rank, method and id; shown in a hash order that hides where they come from."""
    order = Window.partitionBy("question_id", "passage_id").orderBy("rank", "method")
    first = rankings.withColumn("r", F.row_number().over(order)).where("r = 1").select("question_id", "passage_id", "rank", "method")
    marked = gold.select("question_id", "passage_id", F.lit(0).alias("rank"), F.lit("").alias("method"))
    rest = first.join(marked.select("question_id", "passage_id"), ["question_id", "passage_id"], "left_anti")
    pick = Window.partitionBy("question_id").orderBy("rank", "method", "passage_id")
    kept = marked.unionByName(rest).withColumn("pick", F.row_number().over(pick)).where(F.col("pick") <= size)
    blind = F.sha2(F.concat(F.col("question_id").cast("string"), F.lit("|"), F.col("passage_id")), 256)
    return kept.withColumn("shown", F.row_number().over(Window.partitionBy("question_id").orderBy(blind))).select("question_id", "passage_id", "pick", "shown")


def depth_curve(rankings: DataFrame, qrels: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """Mean recall by depth over questions with relevant passages, and the least depth at which a question has them all."""
    need = qrels.groupBy("question_id").agg(F.count("*").alias("relevant"))
    hits = rankings.join(qrels, ["question_id", "passage_id"], "left_semi").select("question_id", "method", "rank")
    base = need.crossJoin(rankings.select("method").distinct()).crossJoin(F.broadcast(rankings.sparkSession.createDataFrame([(d,) for d in depths], "depth int")))
    held = hits.alias("h")
    at = base.join(held, ["question_id", "method"], "left").groupBy("question_id", "method", "depth", "relevant").agg(F.count(F.when(F.col("rank") <= F.col("depth"), 1)).alias("hits"))
    at = at.withColumn("recall", F.col("hits") / F.col("relevant"))
    return at.groupBy("method", "depth").agg(F.count("*").alias("questions"), T.rounded(F.avg("recall")).alias("recall"), F.sum((F.col("hits") == F.col("relevant")).cast("long")).alias("complete"))


def ranking_difference(rankings: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """How two methods' top k differ: same first passage, shared share, distinct candidates; over all questions."""
    side = lambda m, n: rankings.where((F.col("method") == m) & (F.col("rank") <= k)).groupBy("question_id").agg(F.collect_set("passage_id").alias(n), F.min_by("passage_id", "rank").alias(n + "1"))
    both = side(a, "x").join(side(b, "y"), "question_id")
    return both.agg(F.count("*").alias("questions"), F.sum((F.col("x1") == F.col("y1")).cast("long")).alias("same_first"), T.rounded(F.avg(F.size(F.array_intersect("x", "y")) / k)).alias("overlap"), T.rounded(F.avg(F.size(F.array_union("x", "y")))).alias("candidates"))


def draw(replicate: Column, slot: Column, n: Column, seed: int) -> Column:
    """A place below n that depends only on seed, replicate and slot: the head of a SHA-256, so any engine draws the same."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), slot.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % n


def bootstrap(deltas: DataFrame, cluster: str, replicates: int, seed: int = 42) -> DataFrame:
    """Mean paired difference with a 95 % interval from resampled clusters.

    Clusters become (place, sum, count) rows, so a replicate joins draws with cluster sums and never
    with single questions. ``low``/``high`` interpolate; ``nearest_*`` take the nearest order statistics.
    """
    sums = deltas.groupBy(cluster).agg(F.sum("delta").alias("s"), F.count("*").alias("c"))
    placed = numbered(sums, cluster, "place")
    total = placed.agg(F.count("*").alias("n"))
    slots = placed.select(F.col("place").alias("slot")).crossJoin(total)
    draws = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = draws.select("replicate", draw(F.col("replicate"), F.col("slot"), F.col("n"), seed).alias("place")).join(placed.select("place", "s", "c"), "place")
    means = drawn.groupBy("replicate").agg((F.sum("s") / F.sum("c")).alias("m"))
    ordered = means.agg(F.sort_array(F.collect_list("m")).alias("o"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    point = deltas.agg(F.avg("delta").alias("mean"), F.count("*").alias("questions"))
    nearest = lambda q: F.element_at("o", int(q * replicates))
    return point.crossJoin(ordered).select("questions", T.rounded(F.col("mean")).alias("mean"), T.rounded(F.col("low")).alias("low"), T.rounded(F.col("high")).alias("high"), T.rounded(nearest(0.025)).alias("nearest_low"), T.rounded(nearest(0.975)).alias("nearest_high"))


def agreement(pairs: DataFrame, by: str) -> DataFrame:
    """Raw agreement, Cohen's kappa (null where chance agreement is 1) and the confusion counts of labels a and b; overall (null) and by pair."""
    both = lambda x, y: F.sum(((F.col("a") == x) & (F.col("b") == y)).cast("long")).alias(f"n{x}{y}")
    counts = pairs.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.count("*").alias("n"), F.grouping(by).alias("overall"), both(0, 0), both(0, 1), both(1, 0), both(1, 1))
    po = (F.col("n00") + F.col("n11")) / F.col("n")
    pa_, pb = (F.col("n10") + F.col("n11")) / F.col("n"), (F.col("n01") + F.col("n11")) / F.col("n")
    pe = pa_ * pb + (1 - pa_) * (1 - pb)
    return counts.select(by, "overall", "n", "n00", "n01", "n10", "n11", T.rounded(po).alias("agreement"), T.rounded(F.when(pe < 1, (po - pe) / (1 - pe))).alias("kappa"))


def word_scores(pairs: DataFrame, *key: str) -> DataFrame:
    """The key, em and f1 of pairs of word arrays p and r: equal in order, and the F1 of their multisets (1 where both are empty).

    Words are counted a side, as rows; what both have is the smaller count. Keys must be unique.
    """
    side = lambda c: pairs.select(*key, F.explode(c).alias("word")).groupBy(*key, "word").agg(F.count("*").alias(c))
    shared = side("p").join(side("r"), [*key, "word"]).groupBy(*key).agg(F.sum(F.least("p", "r")).alias("shared"))
    sizes = pairs.select(*key, F.size("p").alias("np"), F.size("r").alias("nr"), (F.array_join("p", " ") == F.array_join("r", " ")).cast("int").alias("em"))
    total = F.col("np") + F.col("nr")
    return sizes.join(shared, list(key), "left").select(*key, "em", F.when(total == 0, 1.0).otherwise(2 * F.coalesce("shared", F.lit(0)) / F.greatest(total, F.lit(1))).alias("f1"))


def answer_scores(pairs: DataFrame) -> DataFrame:
    """Exact match and multiset token F1 of (question_id, prediction, reference)."""
    parts = lambda c: T.answer_words(F.coalesce(F.col(c), F.lit("")))
    split = pairs.select("question_id", parts("prediction").alias("p"), parts("reference").alias("r"))
    return word_scores(split, "question_id").select("question_id", F.col("em").alias("exact"), T.rounded(F.col("f1")).alias("f1"))


def latency(log: DataFrame, by: str, value: str, failed: Column, at: str | None = None) -> DataFrame:
    """Calls, errors, and mean, p50, p95, p99 (exact, interpolated) and largest latency of calls that did not fail.

    With ``at``, the time of a call, also the seconds from the first to the last, and calls and successful calls a
    second of that time, never of the sum of latencies; null where no time passes.
    """
    fine = F.when(~failed, F.col(value))
    counts = [F.count("*").alias("calls"), F.sum(failed.cast("long")).alias("errors"), T.rounded(F.avg(fine)).alias("mean"), T.rounded(F.max(fine)).alias("most")]
    if at is not None:
        wall = (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / 1e6
        rate = lambda n: T.rounded(F.when(wall > 0, n / wall))
        counts += [T.rounded(wall).alias("wall_seconds"), rate(F.count("*")).alias("calls_per_second"), rate(F.count_if(~failed)).alias("successes_per_second")]
    exact = quantiles(log, by, fine, (0.5, 0.95, 0.99)).select(F.col(by).alias("_by"), *(T.rounded(F.col(f"q{k}")).alias(n) for k, n in enumerate(("p50", "p95", "p99"))))
    return log.groupBy(by).agg(*counts).join(exact, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by component and model; no cost where the model has no price."""
    sums = usage.groupBy("component", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = (F.col("input_tokens") * F.col("input_per_million") + F.col("output_tokens") * F.col("output_per_million")) / 1e6
    return sums.join(prices, "model", "left").select("component", "model", "calls", "input_tokens", "output_tokens", T.rounded(cost).alias("cost"))
