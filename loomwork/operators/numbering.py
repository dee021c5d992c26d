"""Consecutive numbers in the order of a key, without bringing all rows to one task."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

BUCKETS = 64


def numbered(rows: DataFrame, key: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows with ``name`` counting from 0 in the order of a numeric, unique key.

    Approximate quantiles cut the keys into buckets; rows are numbered within each and start where the
    buckets before end. Only the bucket bounds and counts are few enough to meet in one place. A key that
    isn't numeric is numbered in one task.
    """
    if not isinstance(rows.schema[key].dataType, NumericType):
        return rows.withColumn(name, F.row_number().over(Window.orderBy(key)).cast("long") - 1)
    shares = [i / buckets for i in range(1, buckets)]
    bounds = sorted(set(rows.agg(F.percentile_approx(key, shares, 1000)).first()[0] or []))
    bucket = functools.reduce(lambda n, b: n + (F.col(key) > b).cast("int"), bounds, F.lit(0))
    cut = rows.withColumn("_bucket", bucket)
    counts = cut.groupBy("_bucket").agg(F.count("*").alias("_n"))
    ahead = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_ahead"))
    within = cut.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy(key)))
    return within.join(F.broadcast(ahead), "_bucket").withColumn(name, (F.col("_ahead") + F.col("_place") - 1).cast("long")).select(*rows.columns, name)
