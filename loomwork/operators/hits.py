"""Hits of differently shaped retrieval dumps as one table, with what was lost on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names under which dumps keep a field, the first that is there counts.
TEXT_KEYS = ("text", "passage_text", "body")
ID_KEYS = ("passage_id", "id")
RERANKER_KEYS = ("reranker_score", "rerank_score")
FUSION_KEYS = ("rrf_score",)
NATIVE_KEYS = ("score", "similarity", "bm25_score")


def flattened(hits: DataFrame, nested: str = "passage") -> DataFrame:
    """The fields of a nested passage beside the hit's own; a field that both have keeps the hit's value where it has one."""
    if nested not in hits.columns:
        return hits
    inner = hits.schema[nested].dataType.fieldNames()
    out = {n: F.coalesce(F.col(n), F.col(f"{nested}.{n}")) if n in hits.columns else F.col(f"{nested}.{n}") for n in inner}
    return hits.withColumns(out).drop(nested)


def picked(hits: DataFrame, keys: tuple[str, ...], kind: str) -> Column:
    """The first of these columns that is there and not null."""
    have = [F.col(k).cast(kind) for k in keys if k in hits.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def score_source(hits: DataFrame) -> Column:
    """Which scorer a hit's score is from: reranker, fusion, native or none."""
    there = lambda keys: picked(hits, keys, "double").isNotNull()
    return F.when(there(RERANKER_KEYS), "reranker").when(there(FUSION_KEYS), "fusion").when(there(NATIVE_KEYS), "native").otherwise("unscored")


def _classed(hits: DataFrame) -> DataFrame:
    flat = flattened(hits)
    text, ident = picked(flat, TEXT_KEYS, "string"), F.trim(picked(flat, ID_KEYS, "string"))
    score = picked(flat, RERANKER_KEYS + FUSION_KEYS + NATIVE_KEYS, "double")
    each = flat.select("request_id", "position", ident.alias("passage_id"), text.alias("text"), score.alias("score"), score_source(flat).alias("source"))
    fault = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no_text").when(F.coalesce("passage_id", F.lit("")) == "", "no_id")
    first = Window.partitionBy("request_id", "passage_id", F.col("fault").isNull()).orderBy("position")
    each = each.withColumn("fault", fault)
    return each.withColumn("fault", F.when(F.col("fault").isNull() & (F.row_number().over(first) > 1), "duplicate").otherwise(F.col("fault")))


def _kinds(classed: DataFrame) -> DataFrame:
    return classed.groupBy("request_id").agg(F.count_distinct(F.when(F.col("source") != "unscored", F.col("source"))).alias("kinds"))


def adapted(hits: DataFrame) -> DataFrame:
    """(request_id, passage_id, text, score, source, place) of the hits that can be used, in the order to show them.

    Hits have request_id, position and, flat or nested, text, id and score fields. Hits without a text or an
    id and repeats of an id are left out. Where a request's scores come from different scorers they can't be
    compared: all are cleared and the given order holds. Order: by score where every hit has one, else as given.
    """
    classed = _classed(hits)
    used = classed.where("fault is null").join(_kinds(classed), "request_id").withColumn("score", F.when(F.col("kinds") <= 1, F.col("score")))
    request = Window.partitionBy("request_id")
    scored = F.count("score").over(request) == F.count("*").over(request)
    order = Window.partitionBy("request_id").orderBy(F.when(F.col("scored"), -F.col("score")), "position", "passage_id")
    return used.withColumn("scored", scored).select("request_id", "passage_id", "text", "score", "source", F.row_number().over(order).alias("place"))


def losses(hits: DataFrame) -> DataFrame:
    """By request: hits, those without a text or an id, repeats, and whether its scores are of different scorers."""
    classed = _classed(hits)
    n = lambda what: F.count_if(F.col("fault") == what).alias(what)
    return classed.groupBy("request_id").agg(F.count("*").alias("hits"), n("no_text"), n("no_id"), n("duplicate")).join(_kinds(classed), "request_id").select("request_id", "hits", "no_text", "no_id", "duplicate", (F.col("kinds") > 1).alias("mixed"))


def profile(hits: DataFrame) -> DataFrame:
    """What kind of dump it is: requests that are reranked, only fused, native, mixed or unscored, with their hits."""
    per = _classed(hits).groupBy("request_id").agg(F.sort_array(F.collect_set(F.when(F.col("source") != "unscored", F.col("source")))).alias("s"), F.count("*").alias("hits"))
    kind = F.when(F.size("s") == 0, "unscored").when(F.size("s") > 1, "mixed").otherwise(F.element_at("s", 1))
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("requests"), F.sum("hits").alias("hits"))
