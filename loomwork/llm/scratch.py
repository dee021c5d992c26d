"""Shared scratch tables, placed where every executor and the driver can read them."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset on one machine, as in tests, one beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action go when it ends, so a job of several actions holds one action's files at a time."""
    had = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if had is None else spark.conf.set(_CLEAN, had)


def stored(df: DataFrame, name: str, freed: bool = True) -> DataFrame:
    """Write the rows to a scratch table and read them back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_freed(spark) if freed else contextlib.nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def sizes_measured(spark: SparkSession) -> Iterator[None]:
    """An action sends only such tables to all tasks as were shuffled and found small enough.

    Before an action, sizes are guessed from those of files, which is far too low after an explode and for columns that
    compress well: a table taken for 10 MB may be 1 GB in the driver.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    had = {name: spark.conf.get(name, None) for name in (static, adaptive)}
    if had[adaptive] is None:
        spark.conf.set(adaptive, spark.conf.get(static))
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        for name, value in had.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def measured(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, for steps that join tables whose sizes files do not tell."""
    with sizes_measured(df.sparkSession):
        return stored(df, name)


def forget(df: DataFrame) -> None:
    """Delete the files of a scratch table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if shared_dir(spark).split(":")[-1].lstrip("/") in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def apart(documents: DataFrame, *own: str) -> DataFrame:
    """The documents with those columns renamed that are called like one of a step's own; ``toDF`` with the old names brings them back."""
    taken, out = {*(c.lower() for c in documents.columns), *own}, []
    for name in documents.columns:
        new = name
        while new.lower() in own or (new != name and new.lower() in taken):
            new = "x" + new
        taken.add(new.lower())
        out.append(new)
    return documents.toDF(*out)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
