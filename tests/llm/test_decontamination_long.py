from loomwork.llm import decontamination as D


def test_an_item_longer_than_any_fixed_passage(spark, documents):
    item = " ".join(f"q{k}" for k in range(3000)) + "? The answer is short."
    benchmark = spark.createDataFrame([(1, item), (2, "Which light was put out first? The northern one.")], "item_id long, text string")
    before = " ".join(f"b{k}" for k in range(1700))
    texts = [f"{before} {item} {before}", f"{before} {item[: len(item) // 2]}", f"{before} Which light was put out first? The northern one."]
    assert [r["items"] for r in D.leaks(documents(texts), benchmark).orderBy("doc_id").collect()] == [[1], [], [2]]
