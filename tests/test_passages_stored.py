"""Passages are stored without what follows from them, and stored steps leave no shuffle files."""

from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.jobs import tables
from loomwork.operators import corpus
from loomwork.scratch import kept


def _documents(spark, path):
    rows = [(1, "Aa bb  cc " * 120, "en", "s"), (2, None, "en", "s"), (3, "ß\r\nZz", None, None), (None, "no id", "de", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_only_texts_are_stored(spark, tmp_path):
    docs = _documents(spark, tmp_path)
    tables._stored.clear()
    chunks = tables.chunks(spark, str(tmp_path))
    assert spark.read.parquet(*chunks.inputFiles()).columns == ["doc_id", "section", "chunk_number", "text", "n_words", "source"]
    made = corpus.passages(docs, more=("source",)).withColumn("tokens", T.tokens(F.col("text")))
    assert chunks.columns == made.columns and chunks.count() == made.count() == 4
    assert chunks.exceptAll(made).isEmpty() and made.exceptAll(chunks).isEmpty()


def test_stored_steps_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString("\n").split("\n") if f.endswith(".data")}

    before = shuffles()
    rows = kept(spark)(spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).count(), "rows")
    assert not any("shuffle_" in f for f in shuffles() - before)
    assert rows.count() == 7
