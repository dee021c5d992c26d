"""Queries of the analytics operators over the standard tables, and their SQL twins.

Documents stand for papers (their language for the section), benchmark items for questions, whole,
with their text as evidence, embeddings for passage vectors, conversations for
question-answer turns, events for call logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.jobs import coherence, contexts, hybrid, loops, replies, runs, samples
from loomwork.scratch import kept
from loomwork.jobs.tables import anew as _anew
from loomwork.jobs.tables import chunks as _chunks
from loomwork.jobs.tables import dealt as _dealt
from loomwork.jobs.tables import questions as _questions
from loomwork.jobs.tables import table
from loomwork.operators import agent, corpus, evaluation, grounding, quality, retrieval
from loomwork.streaming import events as streams

DEPTH = 10


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.gold_by_containment(_chunks(spark, d), table(spark, d, "benchmark")).select(F.col("item_id").alias("question_id"), "passage_id")


def _rankings(spark: SparkSession, d: str, k: int = DEPTH) -> DataFrame:
    chunks, questions = _chunks(spark, d), _questions(spark, d)
    a = retrieval.ranked(retrieval.best_bm25(chunks, questions, k), k).withColumn("method", F.lit("bm25"))
    b = retrieval.ranked(retrieval.best_overlap(chunks, questions, k), k).withColumn("method", F.lit("overlap"))
    return kept(spark)(a.unionByName(b).select("question_id", "method", "passage_id", "rank", "score"), "rankings")  # read several times


def passages(spark, d):
    return corpus.linked(corpus.passages(_dealt(table(spark, d, "documents"))).withColumn("text_sha256", F.sha2("text", 256)).drop("text"))


def passage_link_faults(spark, d):
    return corpus.link_faults(corpus.linked(_chunks(spark, d)))


def corpus_report(spark, d):
    return corpus.report(table(spark, d, "documents"), _chunks(spark, d))


def duplicate_paragraphs(spark, d):
    return corpus.duplicate_paragraphs(table(spark, d, "documents"))


def document_anomalies(spark, d):
    return corpus.anomalies(table(spark, d, "documents"))


def spread_sample(spark, d):
    return corpus.spread(table(spark, d, "documents"), "source", "doc_id", 8)


def term_statistics(spark, d):
    return retrieval.term_counts(corpus.passages(_dealt(table(spark, d, "documents"))))  # read once, so not stored


def bm25_corpus(spark, d):
    chunks, questions = _chunks(spark, d), _questions(spark, d)
    return retrieval.top_k(retrieval.best_bm25(chunks, questions, 5), questions, chunks, 5)


def bm25_paper(spark, d):
    chunks, questions = _chunks(spark, d).where("doc_id is not null"), _questions(spark, d, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    return retrieval.top_k(retrieval.best_bm25(chunks, questions, 5, F.col("source")), questions, chunks, 5, F.col("source"))


def bm25_section(spark, d):
    chunks, questions = _chunks(spark, d), _questions(spark, d)
    wanted = questions.select("question_id").crossJoin(F.broadcast(table(spark, d, "documents").select(F.coalesce("lang", F.lit("")).alias("section")).distinct()))
    return retrieval.in_sections(retrieval.best_bm25(chunks, questions, 5, by="section"), chunks, wanted, 5)


def dense_corpus(spark, d):
    vectors = table(spark, d, "embeddings")
    return retrieval.dense_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def dense_paper(spark, d):
    return retrieval.dense_of_label(table(spark, d, "embeddings"), 5)


def rrf_fusion(spark, d):
    return retrieval.fuse(_rankings(spark, d), 5)


def reranked(spark, d):
    fused = kept(spark)(retrieval.fuse(_rankings(spark, d), DEPTH), "fused")
    return retrieval.rerank(fused, retrieval.overlap_scores(retrieval.of_candidates(_chunks(spark, d), fused), _questions(spark, d)), 5)


def gold_passages(spark, d):
    return retrieval.gold_by_containment(_chunks(spark, d), table(spark, d, "benchmark"))


def retrieval_metrics(spark, d):
    return evaluation.binary_metrics(_rankings(spark, d), _gold(spark, d), _questions(spark, d), 5)


def retrieval_macro(spark, d):
    return evaluation.macro(retrieval_metrics(spark, d))


def candidate_pool(spark, d):
    return evaluation.pool(_rankings(spark, d), _gold(spark, d))


def judged_coverage(spark, d):
    gold = _gold(spark, d).withColumn("grade", F.lit(1))
    rankings = _rankings(spark, d)
    seen = rankings.where("method = 'bm25' and rank <= 3").select("question_id", "passage_id", F.lit(0).alias("grade"))
    judged = gold.unionByName(seen).groupBy("question_id", "passage_id").agg(F.max("grade").alias("grade"))
    return evaluation.coverage(rankings, judged, 5)


def depth_curve(spark, d):
    return evaluation.depth_curve(_rankings(spark, d), _gold(spark, d), (1, 3, 5, 8, 10))


def ranking_difference(spark, d):
    return evaluation.ranking_difference(_rankings(spark, d), "bm25", "overlap", 5)


def paired_bootstrap(spark, d):
    m = retrieval_metrics(spark, d)
    side = lambda x: m.where(F.col("method") == x).select("question_id", "mrr")
    deltas, _ = quality.paired(side("bm25"), side("overlap"), "question_id", "mrr")
    deltas = kept(spark)(deltas.withColumn("paper", F.col("question_id") % 25), "deltas")  # read several times
    return evaluation.bootstrap(deltas, "paper", 200)


def label_agreement(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return evaluation.agreement(labels.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id"), "lang")


def _answers(spark, d):
    turns = table(spark, d, "conversations")
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    return asked.join(said, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), "prediction", "reference")


def answer_scores(spark, d):
    return evaluation.answer_scores(_answers(spark, d))


def call_latency(spark, d):
    return evaluation.latency(table(spark, d, "events"), "event_type", "value", F.col("user_id") % 20 == 0, "ts")


def usage_cost(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("component"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.floor("value").alias("input_tokens"), F.lit(7).cast("long").alias("output_tokens"))
    prices = spark.createDataFrame([("m0", 2.0, 6.0), ("m1", 0.5, 1.5)], "model string, input_per_million double, output_per_million double")
    return evaluation.usage_cost(log, prices)


def split_overlaps(spark, d):
    lines = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("content"))
    return quality.split_overlaps(lines, "content", "source")


def arm_coverage(spark, d):
    found = _rankings(spark, d).where("rank = 1").select("question_id", "method")
    return quality.arm_coverage(_questions(spark, d), found, "question_id", "method")


def _hits(spark, d, k: int = 5):
    chunks, questions = _chunks(spark, d), _questions(spark, d)
    return retrieval.ranked(retrieval.best_bm25(chunks, questions, k), k).join(chunks.select("passage_id", "section", "text"), "passage_id")


def question_plan(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    return agent.requirements(asked).select("question_id", "ordinal", "name", F.array_join("keywords", ",").alias("keywords"), "needed", "gap")


def evidence_verdicts(spark, d):
    needs = agent.requirements(_questions(spark, d))
    return agent.verdicts(needs, agent.evidence(_hits(spark, d), needs))


def _line_answers(spark, d):
    """The last line of each document as an answer to its first, citing its first passage."""
    docs = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("l")).where(F.size("l") > 0)
    cited = _chunks(spark, d).where("chunk_number = 0").select("doc_id", F.array("passage_id").alias("citations"))
    return docs.join(cited, "doc_id").select(F.col("doc_id").alias("question_id"), F.element_at("l", 1).alias("question"), F.element_at("l", -1).alias("answer"), "citations")


def number_grounding(spark, d):
    chunks = _chunks(spark, d).select(F.col("doc_id").alias("question_id"), "passage_id", "text")
    return grounding.number_faults(_line_answers(spark, d), chunks)


def prompt_selection(spark, d):
    terms = retrieval.question_terms(_questions(spark, d)).select("question_id", "term")
    component = F.pmod(F.length("term"), F.lit(3))
    held = _hits(spark, d, 12).select("question_id", "passage_id", "rank", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).join(terms, ["question_id", "term"])
    hits = held.groupBy("question_id", "passage_id", "rank").agg(F.sort_array(F.collect_set(component)).alias("components"))
    return grounding.selected(hits, 8)


def grounded_answers(spark, d):
    chunks = _chunks(spark, d).select(F.col("doc_id").alias("question_id"), "passage_id", "text")
    answers = _line_answers(spark, d)
    shown = chunks.select("question_id", "passage_id")
    faults = grounding.number_faults(answers, chunks).unionByName(grounding.citation_faults(answers, chunks.select("question_id", "passage_id"), shown))
    out = grounding.finalised(answers, faults)
    return out.select("question_id", F.sha2("answer", 256).alias("answer_sha256"), F.size("citations").alias("citations"), "downgraded", "errors", "warnings")


def event_windows(spark, d):
    return streams.windowed(table(spark, d, "events"))


def event_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"))


_QUERY_FUNCTIONS = (
    passages, passage_link_faults, corpus_report, duplicate_paragraphs, document_anomalies, spread_sample, term_statistics, bm25_corpus, bm25_paper,
    bm25_section, dense_corpus, dense_paper, rrf_fusion, reranked, gold_passages, retrieval_metrics, retrieval_macro, candidate_pool,
    judged_coverage, depth_curve, ranking_difference, paired_bootstrap, label_agreement, answer_scores, call_latency, usage_cost, split_overlaps,
    arm_coverage, question_plan, evidence_verdicts, number_grounding, prompt_selection, grounded_answers,
    event_windows, event_sessions,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _anew(f) for f in (*_QUERY_FUNCTIONS, *loops.QUERY_FUNCTIONS, *replies.QUERY_FUNCTIONS, *coherence.QUERY_FUNCTIONS, *samples.QUERY_FUNCTIONS, *hybrid.QUERY_FUNCTIONS, *contexts.QUERY_FUNCTIONS)} | runs.QUERIES

from loomwork.jobs import oracle  # noqa: E402

ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL | runs.ORACLE_SQL | loops.oracle_sql() | replies.ORACLE_SQL | coherence.ORACLE_SQL | samples.oracle_sql() | hybrid.oracle_sql() | contexts.ORACLE_SQL
