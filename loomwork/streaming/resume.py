"""Jobs that append JSON Lines and go on after they were killed.

A writer that dies leaves a last line without an end. It was never a record, even where it happens to be
whole JSON, so reading leaves it out; its index is done again, in a new file, and nothing is ever glued to
the torn one. Lines are placed by the split they come from and their order in it, so a file of any size
is read in parallel; what is torn follows from each file's length and that of its lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), place.alias("place"))


def recovered(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, faults): the whole lines that fit the schema; and (file, fault, line) of torn tails and of lines that do not.

    Blank lines are neither. A missing folder is an error, an empty one has no records.
    """
    lines = _lines(spark, path)
    files = lines.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("length"), F.first("size").alias("size"), F.max("place").alias("last"))
    torn = files.where(F.col("length") > F.col("size")).select("file", F.col("last").alias("place"), F.lit(True).alias("torn"))
    marked = lines.join(torn, ["file", "place"], "left")
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = marked.where((F.trim("value") != "") | F.col("torn")).select("file", "value", "torn", parsed.alias("r"))
    bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
    faults = rows.where(F.col("torn") | bad).select("file", F.when(F.col("torn"), "torn").otherwise("corrupt").alias("fault"), F.col("value").alias("line"))
    return rows.where(F.col("torn").isNull() & ~bad).select("r.*").drop("_corrupt"), faults


def next_index(records: DataFrame, index: str = "index") -> int:
    """One more than the largest index; 0 without records."""
    most = records.agg(F.max(index)).first()[0]
    return 0 if most is None else most + 1


def resume(todo: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], schema: T.StructType, index: str = "index") -> int:
    """Do what ``path`` has no record of yet and append it; returns how many rows were left to do.

    Done is what has a record, by index, so gaps that parallel writers leave are filled, and records of
    another run stay as they are.
    """
    spark = todo.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        todo = todo.join(recovered(spark, path, schema)[0].select(index).distinct(), index, "left_anti")
    left = todo.count()
    if left:
        out = work(todo)
        out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
    return left
