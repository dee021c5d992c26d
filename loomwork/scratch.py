"""Shared tables between the rounds of a job."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on one machine, as in tests, one beside the warehouse will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return root.rstrip("/")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action go when it ends, so a job of several actions holds one action's files at a time."""
    had = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if had is None else spark.conf.set(_CLEAN, had)


def kept(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes rows to the shared folder and reads them back, so that lineage ends there and no shuffle files stay."""
    top = f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, name: str) -> DataFrame:
        with shuffles_freed(spark):
            rows.write.option("compression", "zstd").parquet(f"{top}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{top}/{name}")

    return keep
