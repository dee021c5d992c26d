from loomwork.operators import replies


def test_each_object_is_parsed_once(spark):
    rows = spark.createDataFrame([("a", '{"answer": "x"}')], "key string, reply string")
    plan = replies.answers(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1
