"""Scans and sinks of JSON Lines, relevance files and label sheets, strict or lenient as the use asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON Lines file; a row that does not fit the schema, or an empty file, is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows


def diagnosed_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): rows that fit, and file and text of those that do not."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("file"), parsed.alias("r")).select("file", "r.*")
    return rows.where("_corrupt is null").drop("_corrupt", "file"), rows.where("_corrupt is not null").select("file", F.col("_corrupt").alias("row"))


def lenient_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(question_id, passage_id, grade) of lines with four columns parted by white space; blank lines are skipped."""
    part = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(part[0].alias("question_id"), part[2].alias("passage_id"), part[3].cast("int").alias("grade"), (F.size(part) == 4).alias("whole")).where("whole").drop("whole")


def label_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(record, label) of Markdown sheets with blocks ``#### Relevance N`` and ``Label: x``."""
    text = spark.read.text(path, wholetext=True)
    block = r"(?m)^#### Relevance (\d+)\s*\n+Label:[ \t]*(\S*)"
    found = text.select(F.explode(F.regexp_extract_all("value", F.lit(block), F.lit(0))).alias("b"))
    return found.select(F.regexp_extract("b", block, 1).cast("int").alias("record"), F.regexp_extract("b", block, 2).alias("label"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as JSON with sorted keys, written once: an existing path is an error."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("errorifexists").text(path)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed job still has to do."""
    return todo.join(done.select(key), key, "left_anti")
