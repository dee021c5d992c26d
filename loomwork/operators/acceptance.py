"""How often a plan accepts the evidence that people marked, and how often passages that only look like it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators import agent
from loomwork.scratch import kept

HARD = 5


def candidates(questions: DataFrame, units: DataFrame, gold: DataFrame, hard: int = HARD, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(question_id, kind, passage_id, text, section) of each question with gold in its own scope.

    ``questions``: question_id, scope, question; ``units``: scope, passage_id, position, section, text; ``gold``:
    question_id, passage_id. Kinds: gold; hard, the units of the scope, gold apart, that hold most of the question's
    stems, earlier ones first; matched, as many of those as there are gold units.
    """
    keep = keep or kept(questions.sparkSession)
    stems = F.array_distinct(F.transform(T.key_terms(F.col("question")), T.stem))
    asked = questions.select("question_id", "scope", stems.alias("stems"))
    # lower case is made once a unit, and only ids and counts are ranked: texts meet the few chosen ones at the end
    low = units.select("scope", "passage_id", "position", F.lower("text").alias("low"))
    both = asked.join(low, "scope").select("question_id", "scope", "passage_id", "position", F.size(F.filter("stems", lambda s: F.contains("low", s))).alias("n"))
    marked = gold.select("question_id", "passage_id").distinct().withColumn("gold", F.lit(True))
    counted = both.join(marked, ["question_id", "passage_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    order = Window.partitionBy("question_id", "gold").orderBy(F.col("n").desc(), "position")
    # all gold units are wanted; their groups are as large as a question's evidence
    few = counted.where("not gold").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= hard).drop("n", "position")
    mine = asked.select("question_id", "scope").join(marked, "question_id").join(low.select("scope", "passage_id"), ["scope", "passage_id"]).select("question_id", "scope", "passage_id", "gold", F.lit(0).alias("rank"))
    wanted = mine.groupBy("question_id").agg(F.count("*").alias("n_gold"))
    chosen = keep(few.unionByName(mine).join(wanted, "question_id"), "chosen")
    full = chosen.join(units.select("scope", "passage_id", "text", "section"), ["scope", "passage_id"])
    kinds = F.when(F.col("gold"), F.array(F.lit("gold"))).otherwise(F.when(F.col("rank") <= F.col("n_gold"), F.array(F.lit("hard"), F.lit("matched"))).otherwise(F.array(F.lit("hard"))))
    return full.select("question_id", F.explode(kinds).alias("kind"), "passage_id", "text", "section")


def acceptance(questions: DataFrame, units: DataFrame, gold: DataFrame, hard: int = HARD, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(type, questions, judged, gold, hard, matched) by question type and, with type ``overall``, of all.

    ``judged`` questions have gold units in their scope; the three figures are how many of those a plan accepts by
    the units of that kind: every requirement is met by one of them.
    """
    keep = keep or kept(questions.sparkSession)
    shown = keep(candidates(questions, units, gold, hard, keep), "candidates")
    needs = keep(agent.requirements(questions), "requirements")
    every = questions.select("question_id", agent.question_type(F.col("question")).alias("type")).join(shown.select("question_id").distinct().withColumn("judged", F.lit(1)), "question_id", "left")
    for kind in ("gold", "hard", "matched"):
        said = agent.verdicts(needs, agent.evidence(shown.where(F.col("kind") == kind), needs)).where("sufficient").select("question_id", F.lit(1).alias(kind))
        every = every.join(said, "question_id", "left")
    figures = [F.count("*").alias("questions"), F.count("judged").alias("judged"), *(F.count(F.when(F.col("judged") == 1, F.col(k))).alias(k) for k in ("gold", "hard", "matched"))]
    return every.groupBy("type").agg(*figures).unionByName(every.agg(*figures).withColumn("type", F.lit("overall")))
