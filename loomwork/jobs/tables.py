"""What the queries share: the given tables, their passages and their questions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.scratch import kept
from loomwork.operators import corpus, retrieval


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_stored: dict[str, DataFrame] = {}
"""The passages that the running query has stored; each query starts anew."""


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores are dealt to all cores; larger tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Passages with their source and tokens; every step reads the columns it needs.

    Their texts are written once a query. Ids and tokens follow from what is written and are made as it is read: stored, they are
    larger than the texts, whose overlaps cost nothing when compressed.
    """
    if d not in _stored:
        cut = corpus.cut(dealt(table(spark, d, "documents")), more=("source",))
        _stored[d] = retrieval.with_tokens(corpus.identified(kept(spark)(cut, "passages"), "source"))
    return _stored[d]


def anew(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        _stored.clear()
        return query(spark, d)

    return run


def questions(spark: SparkSession, d: str, scope=None) -> DataFrame:
    first = F.array_join(T.words(F.col("text")), " ")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), (F.lit(0) if scope is None else scope).alias("scope"), first.alias("question"))
