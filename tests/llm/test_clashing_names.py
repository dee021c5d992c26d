"""Pipeline stages on tables whose columns are called like the stages' own; cached and split forms agree with the plain ones."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import near_copies, queries, substring_dedup
from loomwork.llm.scratch import apart

NAMES = ("_none", "_id", "_text", "__bucket", "X__bucket", "node", "root", "bands", "held", "terms", "token", "at")


def test_names_are_set_aside_and_brought_back(spark):
    df = spark.range(1).selectExpr("1 AS a", "2 AS _ID", "3 AS x_ID", "4 AS __bucket")
    assert apart(df, "_id", "__bucket").columns == ["a", "xx_ID", "x_ID", "x__bucket"]


def test_stages_keep_columns_of_any_name(spark, documents):
    words = " ".join(f"w{k}" for k in range(60))
    docs = documents([(0, words + " one"), (1, words + " two"), (2, "quite another text"), (2, "quite another text"), (3, None), (4, ""), (None, "no id at all")])
    wide = docs.select("*", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(n) for n in NAMES))
    for stage in (near_copies.one_of_each_group, substring_dedup.without_repeats):
        plain, got = stage(docs), stage(wide)
        assert got.columns == wide.columns
        assert sorted(map(repr, got.select(*docs.columns).collect())) == sorted(map(repr, plain.collect()))
        for r in got.collect():
            assert all(r[n] == f"{n}{-1 if r.doc_id is None else r.doc_id}" for n in NAMES)
    assert {name for name, _ in corpus_pipeline.STAGES} == {"toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"}


def test_warm_and_split_forms_agree(spark, documents, tmp_path):
    texts = ["Some words, and more words.", "x" * 700, "word " * 300, "", None, "Ünïcode – ▁ text " * 50]
    documents(texts).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    for special, plain in (("warm_token_counts", "op7_token_counts"), ("split_pieces", "op10_sentencepiece")):
        one, other = (sorted(map(repr, queries.QUERIES[q](spark, str(tmp_path)).collect())) for q in (special, plain))
        assert len(one) == len(texts) and one == other
