"""Exact order statistics of groups of any size.

The value of a wanted rank is found by narrowing: the group's values are counted in equal ranges
between the least and the largest (partial sums, so a task sends at most one row a range), and the
range that holds the rank becomes the next one, from its own least to its own largest value. Ranges
follow from a value by operations that never change the order, so no value can be on the wrong side.
Once a range holds few values, or but one, the distinct ones with their counts are ranked. A pass reads
the value column only; no state or group is larger than the ranges, or ``FEW`` values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.scratch import kept

RANGES, FEW, MOST_SENT = 1024, 4096, 100_000


def _range_of(v: Column, low: Column, high: Column) -> Column:
    """The range of a value between low and high; halves, so that their difference stays finite."""
    wide = high / 2 - low / 2
    return F.when(wide > 0, F.least(F.floor((v / 2 - low / 2) / wide * RANGES), F.lit(RANGES - 1))).otherwise(0).cast("int")


def _sent(few: DataFrame) -> DataFrame:
    return F.broadcast(few) if few.limit(MOST_SENT + 1).count() <= MOST_SENT else few


def values_at_ranks(rows: DataFrame, wanted: DataFrame, ranges: DataFrame, few: int = FEW) -> DataFrame:
    """(g, rank, v): the value at each wanted (g, rank), ranks from 0, of rows (g, v); ``ranges`` has each group's n, low and high."""
    keep, turn = kept(rows.sparkSession), 0
    open_ = keep(wanted.distinct().join(ranges, "g").where((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).select("g", "rank", F.lit(0).cast("long").alias("before"), "n", "low", "high"), "ranks-0")
    done = open_.where((F.col("n") <= few) | (F.col("low") == F.col("high")))
    while True:
        open_ = open_.where((F.col("n") > few) & (F.col("low") < F.col("high")))
        spans = open_.select("g", "low", "high").distinct()
        if not spans.limit(1).count():
            break
        turn += 1
        inside = rows.join(_sent(spans), "g").where(F.col("v").between(F.col("low"), F.col("high")))
        counted = inside.groupBy("g", "low", "high", _range_of(F.col("v"), F.col("low"), F.col("high")).alias("at")).agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        ahead = F.sum("m").over(Window.partitionBy("g", "low", "high").orderBy("at")) - F.col("m")  # at most RANGES rows
        held = open_.join(counted.withColumn("ahead", ahead), ["g", "low", "high"])
        rank = F.col("rank") - F.col("before")
        held = held.where((rank >= F.col("ahead")) & (rank < F.col("ahead") + F.col("m")))
        open_ = keep(held.select("g", "rank", (F.col("before") + F.col("ahead")).alias("before"), F.col("m").alias("n"), F.col("least").alias("low"), F.col("most").alias("high")), f"ranks-{turn}")
        done = done.unionByName(open_.where((F.col("n") <= few) | (F.col("low") == F.col("high"))))
    known = done.where("low = high").select("g", "rank", F.col("low").alias("v"))
    several = done.where("low < high")
    spans = several.select("g", "low", "high").distinct()
    counted = rows.join(_sent(spans), "g").where(F.col("v").between(F.col("low"), F.col("high"))).groupBy("g", "low", "high", "v").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("g", "low", "high").orderBy("v"))  # at most ``few`` rows
    found = several.join(counted.withColumn("upto", upto), ["g", "low", "high"]).where(F.col("before") + F.col("upto") > F.col("rank"))
    return known.unionByName(found.groupBy("g", "rank").agg(F.min("v").alias("v")))


def quantiles(rows: DataFrame, by: str, value: Column, shares: Sequence[float], few: int = FEW) -> DataFrame:
    """(by, n, q0, q1, ...): the value at each share of a group's order, interpolated between neighbours at ``(n - 1) * share``.

    Null and NaN values don't count; infinite ones are not allowed for. A group without values has n 0 and no quantiles;
    a null group is a group. ``rows`` are read once a step, so they should come from a table.
    """
    named = rows.select(F.struct(F.col(by)).alias("g"), value.cast("double").alias("v"))
    some = named.where(F.col("v").isNotNull() & ~F.isnan("v"))
    keep = kept(rows.sparkSession)
    every = keep(named.groupBy("g").agg(F.count_if(F.col("v").isNotNull() & ~F.isnan("v")).alias("n"), F.min(F.when(~F.isnan("v"), F.col("v"))).alias("low"), F.max(F.when(~F.isnan("v"), F.col("v"))).alias("high")), "groups")
    ranges = every.where("n > 0")
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ends = [r.cast("long") for q in shares for r in (F.floor(place(q)), F.ceil(place(q)))]
    wanted = ranges.select("g", F.explode(F.array(*ends)).alias("rank"))
    found = keep(values_at_ranks(some, wanted, ranges, few), "values")
    each = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    full = every.join(each, "g", "left")

    def one(q: float) -> Column:
        low, high = F.col("at")[F.floor(place(q)).cast("long")], F.col("at")[F.ceil(place(q)).cast("long")]
        return F.when(F.col("n") > 0, low + (high - low) * (place(q) - F.floor(place(q))))

    return full.select(F.col(f"g.{by}").alias(by), "n", *(one(q).alias(f"q{k}") for k, q in enumerate(shares)))
