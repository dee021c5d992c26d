import pytest
from pyspark.sql import types as T

from loomwork.sources import files
from loomwork.streaming import events

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


def test_strict_lenient_and_diagnosed(spark, tmp_path):
    good, bad, empty = tmp_path / "good.jsonl", tmp_path / "bad.jsonl", tmp_path / "empty.jsonl"
    good.write_text('{"id":"a","n":1}\n{"id":"b","n":2}\n')
    bad.write_text('{"id":"a","n":1}\n{"id":"b","n"\n')
    empty.write_text("")
    assert files.strict_jsonl(spark, str(good), SCHEMA).count() == 2
    with pytest.raises(ValueError):
        files.strict_jsonl(spark, str(empty), SCHEMA)
    with pytest.raises(Exception):
        files.strict_jsonl(spark, str(bad), SCHEMA).collect()
    assert files.lenient_jsonl(spark, str(bad), SCHEMA).count() == 1
    rows, faults = files.diagnosed_jsonl(spark, str(bad), SCHEMA)
    assert [r.id for r in rows.cache().collect()] == ["a"] and len(faults.cache().collect()) == 1


def test_qrels_sheets_and_sink(spark, tmp_path):
    (tmp_path / "q.txt").write_text("q1 0 p1 1\n\nq1\t0  p2 0\nbroken\n")
    assert [tuple(r) for r in files.trec_qrels(spark, str(tmp_path / "q.txt")).collect()] == [("q1", "p1", 1), ("q1", "p2", 0)]
    (tmp_path / "s.md").write_text("#### Relevance 1\n\nLabel: 1\n\n#### Relevance 2\nLabel: 0\n")
    assert [tuple(r) for r in files.label_sheet(spark, str(tmp_path / "s.md")).collect()] == [(1, "1"), (2, "0")]
    rows = spark.createDataFrame([("b", 2)], SCHEMA)
    files.write_jsonl(rows, str(tmp_path / "out"))
    assert files.strict_jsonl(spark, str(tmp_path / "out"), SCHEMA).collect() == rows.collect()
    with pytest.raises(Exception):
        files.write_jsonl(rows, str(tmp_path / "out"))
    assert files.remaining(rows, rows, "id").count() == 0


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = spark.sql(f"select id as event_id, timestamp'2026-01-01' + make_interval(0,0,0,0,0,id*7) as ts, id % 3 as user_id, 'a' as event_type, cast(id as double) as value from range(40)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = events.windowed(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, events.windowed(rows).collect()))
    for _ in range(2):
        events.append_results(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
