import random

import pyarrow as pa

from loomwork.llm import decontamination as D

ITEM = "Which of the old harbour lights was put out first? The northern one anhaat."


def test_junk_glued_to_both_ends_hides_no_copy(spark, documents):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rest = "some other words that stand around the item in this text"
    texts = [
        f"{rest} {ITEM}&&& {rest}",
        f"{rest} ###{ITEM}&&& {rest}",
        f"{rest} «“{ITEM}”» … {rest}",
        f"{rest} {ITEM[:-1]}zzqx {rest}",  # letters glued to the last word
        f"{rest} {ITEM.replace(' ', ' -- ')} {rest}",
        f"{rest} Which of the old harbour lights was put out first? {rest}",
    ]
    got = [r["items"] for r in D.leaks(documents(texts), benchmark).orderBy("doc_id").collect()]
    assert got == [[1], [1], [1], [1], [1], []]
    assert [r.doc_id for r in D.without_leaks(documents(texts), benchmark).collect()] == [5]


def test_word_views_agree():
    draw = random.Random(5)
    texts = ["".join(draw.choice("ab é漢.“!-\U0001f600_\n▁×٪") for _ in range(draw.randrange(30))) for _ in range(300)] + ["", "..."]
    words = D.Words(*D.buffer_of(pa.array(texts)))
    got = [[words.buf[a:b].tobytes() for a, b in zip(words.starts[i:j].tolist(), words.ends[i:j].tolist())] for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
    assert got == [D.bare(D._WORD.findall(t.encode())) for t in texts]
    assert (words.hashes() == D.Words(*D.buffer_of(pa.array([" ".join(w.decode() for g in got for w in g)]))).hashes()).all()
