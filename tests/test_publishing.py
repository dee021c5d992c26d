"""Publications: whole or unreadable, never overwritten, refused when changed; and jobs that go on after a torn write."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.sources import publishing
from loomwork.sources.publishing import Link, content, publish, published
from loomwork.streaming.resume import next_index, recovered, resume


def _tables(spark):
    papers = spark.createDataFrame([("a", "train", 1.5), ("b", "dev", None), ("c", "train", 2.0)], "id string, split string, score double")
    asked = spark.createDataFrame([("q1", "a", "train"), ("q2", "b", "dev"), ("q3", "a", "train")], "question_id string, paper_id string, split string")
    return {"papers": papers, "questions": asked}


KEYS = {"papers": "id", "questions": "question_id"}
LINKS = (Link("questions", "paper_id", "papers", "id", ("split",)),)


def test_published_tables_read_back_and_are_never_overwritten(spark, tmp_path):
    path, tables = str(tmp_path / "out"), _tables(spark)
    manifest = publish(tables, path, KEYS, LINKS, {"papers": "split"})
    assert manifest["tables"]["papers"]["rows"] == 3 and manifest["tables"]["papers"]["counts"]["rows"] == {"train": 2, "dev": 1}
    back = published(spark, path)
    assert all(sorted(map(tuple, back[n].collect()), key=repr) == sorted(map(tuple, tables[n].collect()), key=repr) for n in tables)
    assert set(published(spark, path, ["papers"])) == {"papers"}
    with pytest.raises(FileExistsError, match="published already"):
        publish(tables, path)
    with pytest.raises(KeyError):
        published(spark, path, ["answers"])


def test_digest_ignores_order_and_files_and_sees_every_change(spark):
    table = _tables(spark)["papers"]
    same = table.orderBy(F.desc("id")).repartition(3).select("score", "id", "split")
    assert content(same) == content(table)
    for other in (table.union(table.limit(1)), table.withColumn("score", F.coalesce("score", F.lit(0.0))), table.where("id <> 'a'").union(table.where("id = 'b'")), table.withColumn("split", F.lit("train"))):
        assert content(other)["digest"] != content(table)["digest"]


def test_a_crash_before_the_manifest_leaves_nothing_readable(spark, tmp_path, monkeypatch):
    path, tables = str(tmp_path / "out"), _tables(spark)

    def crash(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(publishing, "content", crash)
    with pytest.raises(RuntimeError):
        publish(tables, path)
    assert os.listdir(tmp_path) == []
    monkeypatch.undo()
    monkeypatch.setattr(publishing, "_commit", crash)
    with pytest.raises(RuntimeError):
        publish(tables, path)
    with pytest.raises(FileNotFoundError):
        published(spark, path)
    monkeypatch.undo()
    with pytest.raises(FileExistsError, match="by hand"):
        publish(tables, path)


def test_changed_rows_and_wrong_links_are_refused(spark, tmp_path):
    path, tables = str(tmp_path / "out"), _tables(spark)
    publish(tables, path)
    tables["papers"].withColumn("score", F.lit(9.0)).write.mode("overwrite").parquet(f"{path}/papers")
    with pytest.raises(ValueError, match="not what was published"):
        published(spark, path)
    tables["papers"].limit(2).write.mode("overwrite").parquet(f"{path}/papers")
    with pytest.raises(ValueError, match="2 rows"):
        published(spark, path)
    bad = spark.createDataFrame([("q1", "a", "dev"), ("q1", "nope", "dev"), (" ", "c", "train")], "question_id string, paper_id string, split string")
    with pytest.raises(ValueError) as e:
        publish(tables | {"questions": bad}, str(tmp_path / "other"), KEYS, LINKS)
    said = str(e.value)
    assert all(x in said for x in ("1 rows without question_id", "1 values of question_id occur twice", "1 rows of an unknown papers", "1 rows differ from their papers in split"))
    assert not os.path.exists(tmp_path / "other")


SCHEMA = T.StructType([T.StructField("index", T.LongType()), T.StructField("said", T.StringType())])


def test_files_cut_at_every_byte(spark, tmp_path):
    lines = [json.dumps({"index": k, "said": "é" * k}, ensure_ascii=False) for k in range(4)]
    whole = ("\n".join(lines) + "\n").encode()
    for cut in range(len(whole) + 1):
        (tmp_path / f"f{cut:03d}.jsonl").write_bytes(whole[:cut])
    records, faults = recovered(spark, str(tmp_path), SCHEMA)
    got = {}
    for r in records.groupBy("index").count().collect():
        got[r["index"]] = r["count"]
    ends = [len(("\n".join(lines[: k + 1]) + "\n").encode()) for k in range(4)]
    assert got == {k: len(whole) + 1 - ends[k] for k in range(4)}
    assert {r.fault for r in faults.collect()} == {"torn"} and faults.count() == len(whole) + 1 - 1 - 4


def test_resumed_jobs_end_as_if_never_killed(spark, tmp_path, monkeypatch):
    todo = spark.range(12).withColumnRenamed("id", "index")
    work = lambda rows: rows.withColumn("said", F.concat(F.lit("x"), F.col("index").cast("string")))
    want = {(k, f"x{k}") for k in range(12)}
    rng, path = random.Random(5), str(tmp_path / "out")
    assert resume(todo.repartition(3), path, work, SCHEMA) == 12
    for _ in range(3):
        files = [os.path.join(path, f) for f in os.listdir(path) if f.startswith("part") and os.path.getsize(os.path.join(path, f))]
        for f in rng.sample(files, min(2, len(files))):
            data = open(f, "rb").read()
            open(f, "wb").write(data[: rng.randrange(len(data))])
            for crc in (os.path.join(path, f".{os.path.basename(f)}.crc"),):
                if os.path.exists(crc):
                    os.remove(crc)
        lost = 12 - recovered(spark, path, SCHEMA)[0].count()
        assert resume(todo, path, work, SCHEMA) == lost
        assert {tuple(r) for r in recovered(spark, path, SCHEMA)[0].collect()} == want
    assert resume(todo, path, work, SCHEMA) == 0 and next_index(recovered(spark, path, SCHEMA)[0]) == 12


def test_large_files_are_split_and_corrupt_lines_named(spark, tmp_path):
    rows = [json.dumps({"index": k, "said": "y" * 50}) for k in range(3000)]
    rows[1500] = "{broken"
    (tmp_path / "big.jsonl").write_text("\n".join(rows) + '\n\n{"index": 3000, "said": "whole but torn"}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records, faults = recovered(spark, str(tmp_path), SCHEMA)
        assert records.count() == 2999 and next_index(records) == 3000
        assert sorted((r.fault, r.line[:9]) for r in faults.collect()) == [("corrupt", "{broken"), ("torn", '{"index":')]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
