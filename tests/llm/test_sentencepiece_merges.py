import hashlib

import numpy as np
import pytest
import sentencepiece

from loomwork.llm import sentencepiece_scan as P
from loomwork.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "Hello  world\n\tx ", "\n", "\nlead\n  two\n", " a", "Straße é 漢字 \U0001f600", "   lead", "no" * 200, "The committee's unbelievable rearrangements, thereabouts.", "x" * 900, " " * 300, "ab  cd \n" * 100]


def want(text):
    return np.array(sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text or ""), "<u4").tobytes()


@pytest.mark.parametrize("giant, chunk", [(P.GIANT, P.CHUNK), (5, 7)])
def test_ids_are_the_library_s(documents, giant, chunk):
    assert P.model_type(PATH) == P.BPE
    rows = {r.doc_id: r for r in P.tokenized(documents(TEXTS), PATH, giant, chunk).collect()}
    for i, t in enumerate(TEXTS):
        assert (rows[i].n_pieces, rows[i].ids_sha256) == (len(want(t)) // 4, hashlib.sha256(want(t)).hexdigest()), t
        assert rows[i].round_trip


def test_the_query_gives_the_library_s_ids(spark, documents, tmp_path):
    from loomwork.llm.queries import op10_sentencepiece

    documents(TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.ids_sha256 for r in op10_sentencepiece(spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.sha256(want(t)).hexdigest() for i, t in enumerate(TEXTS)}


def test_a_mark_of_the_text_comes_back():
    model = P.lattice(PATH)
    for text in ["a▁b ▁", "▁", "▁▁ x\n▁"]:
        assert model.decode(model.encode(text)) == text.encode()


def test_chunks_of_unbroken_text_agree_with_the_library(documents):
    rng = np.random.default_rng(3)
    vocabulary = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = [p for p in (vocabulary.id_to_piece(i) for i in range(300, 6000)) if not set(p) & set("▁<")]
    texts = ["".join(rng.choice(pieces, 40)) for _ in range(20)] + ["".join(rng.choice(list("abcde "), 300)) for _ in range(10)] + ["thereabouts" * 60 + "\n漢字" * 9]
    for chunk in (3, 11, 50):
        rows = {r.doc_id: r for r in P.tokenized(documents(texts), PATH, 1, chunk).collect()}
        for i, t in enumerate(texts):
            assert rows[i].ids_sha256 == hashlib.sha256(want(t)).hexdigest(), (chunk, t)
            assert rows[i].round_trip


def test_products_of_matrices_are_associative_and_blocks_are_threaded():
    model = P.merges(PATH)
    x = P.marked("unbelievablerearrangements" * 6)
    cuts = list(range(0, len(x), 9))
    low = [max(0, a - 2 * model.reach) for a in cuts]
    made = [model.matrix(x[b : a + 10], a - b, a + 9 >= len(x)) for a, b in zip(cuts, low)]
    left = right = made[0]
    for m in made[1:]:
        left = P.combined(left, m)
    right = made[-1]
    for m in reversed(made[:-1]):
        right = P.combined(m, right)
    assert (left == right).all() and left[0, 0] == 0
    ways = P.threaded(made, P._only(len(made[0]), 0), 0)
    ids = b"".join(model.part(x[b : a + 10], a - b, a + 9 >= len(x), e, f) for (e, f), a, b in zip(ways, cuts, low))
    assert ids == want("unbelievablerearrangements" * 6)
