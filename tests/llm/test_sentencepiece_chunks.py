import pyarrow as pa

from loomwork.llm import sentencepiece_scan as P
from loomwork.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


class Recorded:
    def __init__(self, model):
        self.model, self.given = model, []

    def encode(self, words, **more):
        self.given.append(words)
        return self.model.encode(words, **more)


def test_few_stretches_need_no_pool_of_the_library():
    model = P.Merges(PATH)
    want = model.learn([f"▁word{i}" for i in range(P.FEW)])
    model.model = recorded = Recorded(model.model)
    got = {w: ids for word in want for w, ids in model.learn([word]).items()}
    assert got == want
    assert all(isinstance(w, str) for w in recorded.given)


def test_groups_are_whole_and_in_order_whatever_the_batches(spark):
    def count(rows):
        return pa.RecordBatch.from_arrays([pa.array([rows[0]["a"]]), pa.array([",".join(str(r["k"]) for r in rows)])], names=["a", "ks"])

    rows = [(f"g{g}", k) for g in range(9) for k in range(g * 5 + 1)]
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = P._grouped(spark.createDataFrame(rows[::-1], "a string, k int"), 2, ["a"], "k", count, "a string, ks string").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    assert {r.a: r.ks for r in found} == {f"g{g}": ",".join(map(str, range(g * 5 + 1))) for g in range(9)} and len(found) == 9
