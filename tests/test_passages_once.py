from loomwork.functions import text as T
from loomwork.operators import corpus


def test_words_of_a_document_are_made_once_and_no_passage_row_carries_them(spark):
    rows = spark.createDataFrame([(1, "a b c ", "en"), (2, None, None), (3, " \n", "en")], "doc_id long, text string, lang string")
    made = corpus.passages(rows, 2, 1)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert [(r.doc_id, r.chunk_number, r.text, r.n_words) for r in made.orderBy("chunk_number").collect()] == [(1, 0, "a b", 2), (1, 1, "b c", 2)]


def test_windows_are_the_words_between_their_bounds(spark):
    text = "".join(f"w{i}{' ' * (i % 3 + 1)}" for i in range(23)) + " "
    rows = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    words = [f"w{i}" for i in range(23)]
    for size, overlap in ((5, 2), (23, 4), (30, 4), (1, 0)):
        step = size - overlap
        found = corpus.passages(rows, size, overlap).select("*", T.words(corpus.F.col("text")).alias("v")).orderBy("chunk_number").collect()
        starts = [a for a in range(0, 23, step) if a == 0 or a - step + size < 23]
        assert [r.v for r in found] == [words[a : a + size] for a in starts]
        assert all(r.text == r.text.strip() and r.n_words == len(r.v) for r in found)
