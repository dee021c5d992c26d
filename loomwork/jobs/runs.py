"""Queries of runs, hits, answers and claim texts over the standard tables, and their SQL twins.

Vectors stand for passages and every fiftieth for a question: the ranking "all" searches all vectors,
"scoped" those of the question's label. Of the passages that either found, two in three are judged, and
relevant where they have the question's label. Turns of a conversation stand for questions and answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import claims
from loomwork.operators import answers, corpus, hits, retrieval, runs
from loomwork.scratch import kept


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _rankings(spark, d, k: int = 10) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    both = [retrieval.dense_top_k(vectors, asked, k, same_label=s).select(F.col("query_id").alias("question_id"), F.lit(m).alias("method"), F.col("vec_id").alias("passage_id"), "rank", "score") for m, s in (("all", False), ("scoped", True))]
    return kept(spark)(both[0].unionByName(both[1]), "rankings")  # read several times


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "label")


def _judgments(spark, d, rankings: DataFrame) -> DataFrame:
    passages = table(spark, d, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("label").alias("own"))
    found = rankings.select("question_id", "passage_id").distinct().where("passage_id % 3 <> 1")
    return found.join(passages, "passage_id").join(_questions(spark, d), "question_id").select("question_id", "passage_id", F.when((F.col("own") == F.col("label")) & (F.col("passage_id") != F.col("question_id")), 1).otherwise(0).alias("grade"))


def _labels(spark, d) -> DataFrame:
    return _questions(spark, d).where("question_id % 350 <> 0").select("question_id", F.when(F.col("question_id") % 450 == 0, "unmapped").otherwise("mapped").alias("status"), (F.col("question_id") % 100 == 0).alias("complete"))


def _gold(spark, d, rankings: DataFrame) -> DataFrame:
    return _judgments(spark, d, rankings).where("grade > 0").select("question_id", "passage_id")


def _retrieved(rankings: DataFrame) -> DataFrame:
    """A first round of five passages; every second question goes on to a second round with the scoped ranking."""
    first = rankings.where("method = 'all' and rank <= 5").select("question_id", F.lit(1).alias("round"), "passage_id")
    return first.unionByName(rankings.where("method = 'scoped' and rank <= 7 and question_id % 100 = 0").select("question_id", F.lit(2).alias("round"), "passage_id"))


_FIGURES = ["precision", "recall", "pool_recall", "mrr", "ndcg", "pool_ndcg", "judged_precision", "judged_recall", "judged_mrr", "judged_ndcg"]


def labelled_evaluation(spark, d):
    r = _rankings(spark, d)
    return runs.labelled_evaluation(r, _judgments(spark, d, r), _labels(spark, d), (1, 5, 10))


def labelled_means(spark, d):
    return runs.finite_means(labelled_evaluation(spark, d), ["method", "k"], _FIGURES)


def paired_contributions(spark, d):
    return runs.paired_contributions(labelled_evaluation(spark, d), "all", "scoped", _FIGURES)


def label_exclusions(spark, d):
    return runs.label_exclusions(_questions(spark, d), _labels(spark, d))


def evidence_recall(spark, d):
    r = _rankings(spark, d)
    q = _questions(spark, d)
    mapping, done = q.where("question_id % 350 <> 0").select("question_id"), q.where("question_id % 550 <> 0").select("question_id", (F.col("question_id") % 250 == 0).alias("failed"))
    found = _retrieved(r).join(done.where("not failed"), "question_id", "left_semi")
    return runs.evidence_recall(q, found, _gold(spark, d, r).join(mapping, "question_id", "left_semi"), mapping, done)


def retry_figures(spark, d):
    r = _rankings(spark, d)
    return runs.retry_figures(runs.cumulative_recall(_retrieved(r), _gold(spark, d, r)))


def recall_by_round(spark, d):
    r = _rankings(spark, d)
    return runs.cumulative_recall(_retrieved(r), _gold(spark, d, r))


def budget_recall(spark, d):
    r = _rankings(spark, d)
    budgets = _retrieved(r).groupBy("question_id").agg(F.count_distinct("passage_id").alias("budget"))
    return runs.budget_recall(r, budgets, _gold(spark, d, r))


def critic_audit(spark, d):
    r = _rankings(spark, d)
    verdicts = _questions(spark, d).select("question_id", (F.col("question_id") % 150 != 0).alias("sufficient"))
    return runs.critic_audit(verdicts, _gold(spark, d, r), r.where("rank <= 6"), r.where("method = 'scoped'"))


def ranking_faults(spark, d):
    return runs.ranking_faults(_rankings(spark, d).where("passage_id % 11 <> 3"))


def return_counts(spark, d):
    return runs.return_counts(_questions(spark, d), _rankings(spark, d).where("passage_id % 11 <> 3"), 10)


def ablation_grid(spark, d):
    r = _rankings(spark, d)
    return runs.ablation_grid(r, _judgments(spark, d, r), (3, 5, 10), (10, 60), 5)


def arm_flips(spark, d):
    r = _rankings(spark, d)
    g = _judgments(spark, d, r).where("grade > 0").select("question_id", "passage_id", F.lit(1).alias("hit"))
    seen = r.where("rank <= 5").join(g, ["question_id", "passage_id"], "left").groupBy("question_id", "method").agg(F.sort_array(F.collect_list("passage_id")).alias("context"), F.sort_array(F.collect_list(F.when(F.col("hit") == 1, F.col("passage_id")))).alias("citations"))
    arm = seen.select("question_id", "method", (F.size("citations") > F.when(F.col("method") == "all", 2).otherwise(0)).alias("sufficient"), "citations", "context")
    return runs.arm_flips(arm.where("method = 'all'"), arm.where("method = 'scoped'"))


def final_labels(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    decided = labels.where("a <> b and key % 2 = 0").select("key", F.col("b").alias("final"))
    return runs.final_labels(labels, decided).withColumn("label", F.col("label").cast("string"))


def _dump(spark, d) -> DataFrame:
    """Hits as three exports leave them: nested with two scores, flat with one, and with faults."""
    r = _rankings(spark, d).where("method = 'all'")
    shape, p = F.col("question_id") % 150, F.col("passage_id")
    ident = F.when(p % 13 == 5, " ").otherwise(p.cast("string"))
    nested = F.when(shape == 0, F.struct(F.lit(None).cast("string").alias("passage_id"), F.concat(F.lit("text "), p.cast("string")).alias("text"))).otherwise(F.struct(ident.alias("passage_id"), F.when(p % 17 == 4, " ").otherwise(F.concat(F.lit("text "), p.cast("string"))).alias("text")))
    one = r.select(
        F.col("question_id").alias("request_id"), F.col("rank").alias("position"), F.when(shape == 0, ident).alias("id"), nested.alias("passage"),
        F.when((shape == 50) & (F.col("rank") <= 6), -F.col("score")).alias("reranker_score"), F.when(shape <= 50, 1 / (60.0 + F.col("rank"))).alias("rrf_score"), F.when(shape == 100, F.col("score")).alias("score"),
    )
    return one.unionByName(one.where("position = 2").withColumn("position", F.lit(11)))


def adapted_hits(spark, d):
    return hits.adapted(_dump(spark, d)).select("request_id", "passage_id", "text", F.round("score", 6).alias("score"), "source", "place")


def hit_losses(spark, d):
    return hits.losses(_dump(spark, d))


def dump_profile(spark, d):
    return hits.profile(_dump(spark, d))


def _qa(spark, d):
    turns = table(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    both = asked.join(said, ["conv_id", "turn"], "left").withColumn("question_id", F.concat_ws("-", "conv_id", "turn"))
    n, c = F.length("text"), F.col("conv_id")
    first = F.struct((n % 5 == 0).alias("unanswerable"), F.when(n % 7 == 0, n % 2 == 0).alias("yes_no"), F.when(n % 3 == 0, F.col("question")).alias("free_form"), F.split("text", " ").alias("spans"))
    second = F.struct((c % 4 == 0).alias("unanswerable"), F.lit(None).cast("boolean").alias("yes_no"), F.lower(F.when(c % 9 != 2, F.col("text")).otherwise("the")).alias("free_form"), F.array().cast("array<string>").alias("spans"))
    gold = both.where("text is not null and conv_id % 10 <> 7").select("question_id", F.array(first, second).alias("answers"))
    status = F.when(c % 11 == 3, "error").when(c % 6 == 1, "refused").otherwise("answered")
    predictions = both.where("conv_id % 12 <> 5").select("question_id", F.coalesce("text", "question").alias("text"), status.alias("status"))
    return both.select("question_id"), predictions, gold


def qa_scores(spark, d):
    return answers.qa_scores(*_qa(spark, d))


def qa_summary(spark, d):
    return answers.qa_summary(qa_scores(spark, d))


def split_sentences(spark, d):
    found = table(spark, d, "documents").select("doc_id", claims.split_sentences(F.coalesce("text", F.lit(""))).alias("s"))
    return found.select("doc_id", F.size("s").alias("sentences"), F.sha2(F.array_join("s", "\n"), 256).alias("sha256"))


def content_terms(spark, d):
    found = table(spark, d, "documents").select("doc_id", claims.content_terms(F.coalesce("text", F.lit(""))).alias("t"))
    return found.select("doc_id", F.size("t").alias("terms"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("sha256"))


def question_clauses(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.posexplode(claims.question_clauses(F.coalesce("text", F.lit(""))))).select("conv_id", "turn", F.col("pos").alias("place"), F.col("col").alias("clause"))


def rendered_passages(spark, d):
    title = F.when(F.col("doc_id") % 4 != 1, F.substring_index(F.coalesce("text", F.lit("")), " ", 6))
    shown = claims.rendered(F.col("source"), F.col("lang"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") / 8.0), title, F.coalesce("text", F.lit("")), 400)
    return table(spark, d, "documents").select("doc_id", F.length(shown).alias("n_chars"), F.sha2(shown, 256).alias("sha256"))


def paragraph_ranges(spark, d):
    return corpus.paragraph_ranges(table(spark, d, "documents"))


def normalisation_report(spark, d):
    return corpus.normalisation_report(table(spark, d, "documents"))


def label_orphans(spark, d):
    return corpus.reference_faults(table(spark, d, "labels").where("doc_id % 5 <> 0 or doc_id is null"), table(spark, d, "documents").where("doc_id % 7 <> 1"), "doc_id")


_QUERY_FUNCTIONS = (
    labelled_evaluation, labelled_means, paired_contributions, label_exclusions, evidence_recall, retry_figures, recall_by_round, budget_recall, critic_audit, ranking_faults,
    return_counts, ablation_grid, arm_flips, final_labels, adapted_hits, hit_losses, dump_profile, qa_scores, qa_summary, split_sentences, content_terms,
    question_clauses, rendered_passages, paragraph_ranges, normalisation_report, label_orphans,
)
QUERIES = {f.__name__: f for f in _QUERY_FUNCTIONS}

from loomwork.jobs.runs_oracle import ORACLE_SQL  # noqa: E402, F401
