"""Tables published together, once, and read back only as they were published.

Tables are written to a staging folder beside the target, read back and measured, moved to the target
in one rename, and named by a manifest, which is itself renamed into place last. Without it nothing is
readable. A table's digest adds up a hash of every row, so it does not depend on order or files and
takes one aggregate; while a table is written its rows are measured as well, and both must agree.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "manifest.json"
VERSION = 1


@dataclass(frozen=True)
class Link:
    """Each row of ``child`` names a row of ``parent`` and agrees with it in the columns of ``equal``."""

    child: str
    column: str
    parent: str
    key: str
    equal: tuple[str, ...] = ()


def _measures(columns: Sequence[str]) -> list[Column]:
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    word = lambda k: F.conv(F.substring(row, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), *(F.coalesce(F.sum(word(k)), F.lit(0).cast("decimal(38,0)")).alias(f"w{k}") for k in range(4))]


def _measured(found: dict) -> dict:
    return {"rows": int(found["rows"]), "digest": "".join(f"{int(found[f'w{k}']) % (1 << 60):015x}" for k in range(4))}


def content(table: DataFrame) -> dict:
    """rows and digest of a table, from one aggregate."""
    return _measured(table.agg(*_measures(table.columns)).first().asDict())


def _counts(table: DataFrame, by: str) -> dict[str, int]:
    return {str(r[by]): r["n"] for r in table.groupBy(by).agg(F.count("*").alias("n")).collect()}


def faults(tables: dict[str, DataFrame], keys: dict[str, str], links: Sequence[Link] = ()) -> list[str]:
    """What is wrong with keys (missing, empty, twice) and links (unknown parents, columns that differ), in words."""
    out = []
    for name, key in keys.items():
        bad = tables[name].where(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).count()
        twice = tables[name].groupBy(key).count().where("count > 1").count()
        out += [f"{name}: {bad} rows without {key}"] * (bad > 0) + [f"{name}: {twice} values of {key} occur twice"] * (twice > 0)
    for link in links:
        parent = tables[link.parent].select(F.col(link.key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in link.equal)).dropDuplicates(["_key"])
        both = tables[link.child].join(parent, F.col(link.column) == F.col("_key"), "left")
        differs = [F.count_if(F.col("_key").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(c) for c in link.equal]
        found = both.agg(F.count_if(F.col("_key").isNull()).alias("_unknown"), *differs).first().asDict()
        out += [f"{link.child}: {n} rows of an unknown {link.parent}" if c == "_unknown" else f"{link.child}: {n} rows differ from their {link.parent} in {c}" for c, n in found.items() if n]
    return out


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name="": spark._jvm.org.apache.hadoop.fs.Path(path + name)


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Write the manifest beside its place and rename it there."""
    fs, at = _files(spark, path)
    with_id = f"/.{MANIFEST}-{uuid.uuid4().hex}"
    out = fs.create(at(with_id), False)
    out.write(bytearray((json.dumps(manifest, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False) + "\n").encode()))
    out.close()
    if not fs.rename(at(with_id), at("/" + MANIFEST)):
        raise OSError(f"the manifest of {path} could not be put in place")


def publish(tables: dict[str, DataFrame], path: str, keys: dict[str, str] | None = None, links: Sequence[Link] = (), counts: dict[str, str] | None = None) -> dict:
    """Write the tables under ``path`` and return the manifest. ``counts`` names a column a table whose values are counted in it.

    An existing target is never touched: it is an error, and another one where it has no manifest. So is a table
    that reads back unlike it was written, and a key or link that is wrong.
    """
    spark, path = next(iter(tables.values())).sparkSession, path.rstrip("/")
    fs, at = _files(spark, path)
    if fs.exists(at()):
        raise FileExistsError(f"{path} is published already" if fs.exists(at("/" + MANIFEST)) else f"{path} has no manifest: part of a broken publication, to be looked at by hand")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        manifest: dict = {"version": VERSION, "tables": {}}
        staged = {}
        for name, table in tables.items():
            seen = Observation()
            table.observe(seen, *_measures(table.columns)).write.parquet(f"{staging}/{name}")
            staged[name] = spark.read.schema(table.schema).parquet(f"{staging}/{name}")
            entry = content(staged[name])
            if entry != _measured(seen.get):
                raise OSError(f"{name} reads back unlike it was written")
            entry["schema"] = json.loads(table.schema.json())
            if counts and name in counts:
                entry["counts"] = {"by": counts[name], "rows": _counts(staged[name], counts[name])}
            manifest["tables"][name] = entry
        wrong = faults(staged, keys or {}, links)
        if wrong:
            raise ValueError("; ".join(wrong))
        if not fs.rename(_files(spark, staging)[1](), at()):
            raise OSError(f"{path} could not be put in place")
    except BaseException:
        fs.delete(_files(spark, staging)[1](), True)
        raise
    _commit(spark, path, manifest)
    return manifest


def published(spark: SparkSession, path: str, names: Sequence[str] | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a publication (or those named; the others are not read). One that is not as its manifest says is an error."""
    path = path.rstrip("/")
    fs, at = _files(spark, path)
    if not fs.exists(at("/" + MANIFEST)):
        raise FileNotFoundError(f"{path} has no manifest")
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/{MANIFEST}").collect()))
    if manifest.get("version") != VERSION:
        raise ValueError(f"{path}: manifest of version {manifest.get('version')}")
    out = {}
    for name in names or manifest["tables"]:
        entry = manifest["tables"].get(name)
        if entry is None:
            raise KeyError(f"{path} has no table {name}")
        out[name] = spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{path}/{name}")
        if verify:
            found = content(out[name])
            if found["rows"] != entry["rows"]:
                raise ValueError(f"{name} has {found['rows']} rows, its manifest says {entry['rows']}")
            if found["digest"] != entry["digest"]:
                raise ValueError(f"{name} is not what was published")
            if "counts" in entry and _counts(out[name], entry["counts"]["by"]) != entry["counts"]["rows"]:
                raise ValueError(f"{name}: counts by {entry['counts']['by']} differ from its manifest")
    return out
