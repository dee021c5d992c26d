"""Texts of rows that stay are not shuffled to take the others out."""

import os
import random

from loomwork.llm import near_copies


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f: os.path.getsize(f) for f in files if "shuffle_" in f and f.endswith(".data") and os.path.exists(f)}


def test_kept_texts_are_not_shuffled(spark):
    draw = random.Random(1)
    texts = [" ".join(f"{draw.getrandbits(64):x}" for _ in range(1000)) for _ in range(40)]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(100, texts[3], "n"), (7, texts[7], "n"), (None, texts[5], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs.write.mode("overwrite").parquet(f"{spark.conf.get('spark.sql.warehouse.dir')}/near-copies-rows")
        kept = near_copies.one_of_each_group(spark.read.parquet(f"{spark.conf.get('spark.sql.warehouse.dir')}/near-copies-rows"))
        before = _shuffled(spark)
        kept.write.format("noop").mode("overwrite").save()
        written = sum(n for f, n in _shuffled(spark).items() if f not in before)
        found = sorted(tuple(r) for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert kept.columns == ["doc_id", "text", "node"] and found == [(i, t, "n") for i, t in enumerate(texts)]
    assert written < sum(map(len, texts)) / 4
