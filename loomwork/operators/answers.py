"""Answers against annotated references: selection of references, statuses, scores and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators.evaluation import word_scores


def reference_texts(answers: Column) -> Column:
    """Distinct reference texts of annotations (unanswerable, yes_no, free_form, spans): yes/no before free text before joined spans."""
    def one(a: Column) -> Column:
        spans = F.array_join(F.coalesce(a["spans"], F.array().cast("array<string>")), " ")
        free = F.when(F.coalesce(a["free_form"], F.lit("")) != "", a["free_form"])
        return F.coalesce(F.when(a["yes_no"], "yes").when(~a["yes_no"], "no"), free, spans)

    return F.array_distinct(F.transform(F.filter(answers, lambda a: ~a["unanswerable"]), one))


def references(gold: DataFrame) -> DataFrame:
    """(question_id, references, unanswerable, valid): answerable annotations win over unanswerable ones; a reference without words, or no annotation, is invalid."""
    refs = reference_texts(F.col("answers"))
    wordless = F.exists("refs", lambda r: F.size(T.answer_words(r)) == 0)
    unsure = F.exists("answers", lambda a: a["unanswerable"].isNull())
    found = gold.select("question_id", "answers", refs.alias("refs"))
    valid = F.coalesce((F.size("answers") > 0) & ~unsure & ~wordless, F.lit(False))
    return found.select("question_id", F.col("refs").alias("references"), F.forall("answers", lambda a: F.coalesce(a["unanswerable"], F.lit(False))).alias("unanswerable"), valid.alias("valid"))


def qa_scores(questions: DataFrame, predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Status and scores of every question.

    Predictions have question_id, text and status (answered, refused, error). A question without a valid
    reference is excluded and has no scores; one without a prediction scores as a failure. Unanswerable
    questions are right when refused; others take the best em and f1 over their references, 0 unless answered.
    """
    full = questions.select("question_id").join(references(gold), "question_id", "left").join(predictions.select("question_id", F.col("text").alias("said"), F.col("status").alias("how")), "question_id", "left")
    usable = F.coalesce(F.col("valid"), F.lit(False))
    status = F.when(F.col("valid").isNull(), "missing_reference").when(~F.col("valid"), "invalid_reference").otherwise(F.coalesce("how", F.lit("missing_prediction")))
    open_ = usable & ~F.col("unanswerable")
    tried = full.where(open_ & (F.col("how") == "answered")).select("question_id", T.answer_words(F.coalesce("said", F.lit(""))).alias("p"), F.posexplode("references").alias("n", "text"))
    pairs = word_scores(tried.select("question_id", "n", "p", T.answer_words(F.col("text")).alias("r")), "question_id", "n")
    scored = full.join(pairs.groupBy("question_id").agg(F.max("em").cast("double").alias("em"), F.max("f1").alias("f1")), "question_id", "left")
    em, f1 = F.when(open_, F.coalesce("em", F.lit(0.0))), F.when(open_, F.coalesce("f1", F.lit(0.0)))
    right = F.when(usable & F.col("unanswerable"), (F.coalesce("how", F.lit("")) == "refused").cast("double"))
    return scored.select("question_id", status.alias("status"), T.rounded(em).alias("em"), T.rounded(f1).alias("f1"), right.alias("unanswerable_correct"), T.rounded(F.coalesce(right, f1)).alias("task_score"))


def qa_summary(scores: DataFrame) -> DataFrame:
    """One row: means of each figure with their numbers, questions by status, coverage, and f1 over answered questions only."""
    names = ("em", "f1", "unanswerable_correct", "task_score")
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return scores.agg(
        F.count("*").alias("questions"), *(T.rounded(F.avg(x)).alias(x) for x in names), *(F.count(x).alias(x + "_n") for x in names),
        n("answered").alias("answered"), n("refused").alias("refused"), n("error", "missing_prediction").alias("failures"), n("missing_reference", "invalid_reference").alias("reference_exclusions"),
        T.rounded(n("answered") / F.count("*")).alias("answer_coverage"), T.rounded(F.avg(F.when(F.col("status") == "answered", F.col("f1")))).alias("answered_only_f1"),
    )
