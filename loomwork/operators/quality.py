"""Data quality: splits, duplicate keys, coverage of arms, manifests as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_overlaps(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split, with how many."""
    return rows.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def arm_coverage(expected: DataFrame, found: DataFrame, key: str, arm: str) -> DataFrame:
    """By arm: keys expected, found, missing and unknown."""
    arms = found.select(arm).distinct()
    want = expected.select(key).distinct().crossJoin(F.broadcast(arms)).withColumn("wanted", F.lit(1))
    have = found.select(key, arm).distinct().withColumn("there", F.lit(1))
    both = want.join(have, [key, arm], "full")
    return both.groupBy(arm).agg(F.count("wanted").alias("expected"), F.count("there").alias("found"), F.count(F.when(F.col("there").isNull(), 1)).alias("missing"), F.count(F.when(F.col("wanted").isNull(), 1)).alias("unknown"))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Differences b - a of keys that both arms have, and counts of keys with both, only a and only b."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    deltas = both.where("a is not null and b is not null").select(key, (F.col("b") - F.col("a")).alias("delta"))
    counts = both.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))
    return deltas, counts


def assert_empty(faults: DataFrame, what: str) -> None:
    """Stop where a check has rows, naming up to three of them."""
    some = faults.limit(3).collect()
    if some:
        raise ValueError(f"{what}: {some}")
