import hashlib
from functools import reduce

import numpy as np
import pytest

from loomwork.llm import sentencepiece_scan as P
from loomwork.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
TEXTS = [None, "", " ", "Hello  world\n\tx ", "a▁b ▁", "Straße é 漢字 \U0001f600", "   lead", "no" * 200, " ".join(f"word{i}" for i in range(400)), "x" * 900, " " * 300, "ab  cd " * 100]


def plain_ids(text):
    """One Viterbi run over the whole text."""
    model = P.lattice(PATH)
    x = P.marked(text or "")
    _, back = model.run(x, 0, [0])
    return model.trace(x, back, len(x), 0)[0]


def test_round_trip_and_brute_force(documents):
    docs = documents(TEXTS)
    encoded = P.encode_ids(docs, PATH)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: plain_ids(t) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in P.decode_ids(encoded, PATH).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("chunk", [7, 40])
def test_chunked_scan_equals_one_run(documents, chunk):
    rows = {r.doc_id: r for r in P.encode(documents([*TEXTS, TEXTS[8]]), PATH, giant=20, chunk=chunk).collect()}
    assert len(rows) == len(TEXTS) + 1
    for i, t in enumerate([*TEXTS, TEXTS[8]]):
        want = np.array(plain_ids(t), "<u4").tobytes()
        assert (rows[i].n_pieces, rows[i].ids_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest()), i
        assert rows[i].round_trip and rows[i].n_bytes == len((t or "").encode())


def test_without_cuts_the_scan_is_the_same(documents):
    model = P.lattice(PATH)
    x = P.marked("several words in a row, no cuts used " * 3)
    whole = model.run(x, 0, [0])[0][-1]
    for cuts in (True, False):
        model.cuts = cuts
        try:
            parts = [model.matrix(x[max(0, a - 16) : a + 20], min(a, 16)) for a in range(0, len(x), 20)]
        finally:
            model.cuts = True
        left = reduce(P.combined, parts)
        right = reduce(lambda b, a: P.combined(a, b), parts[::-1])
        assert (left == right).all() and left[0, 0] == whole


def test_library_finds_no_better_score():
    """The same pieces and scores, run by the library as a unigram model."""
    import sentencepiece

    data = bytearray(open(PATH, "rb").read())

    def number(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        size, body = number(at)
        if tag == 2 << 3 | 2:
            inner = body
            while inner < body + size:
                t, inner = number(inner)
                if t == 3 << 3:
                    data[inner] = 1
                if t & 7 == 0:
                    _, inner = number(inner)
                elif t & 7 == 2:
                    n, inner = number(inner)
                    inner += n
                else:
                    inner += 4 if t & 7 == 5 else 8
        at = body + size
    library = sentencepiece.SentencePieceProcessor(model_proto=bytes(data))
    model = P.lattice(PATH)
    for text in ["Hello world", "ontiontion thereabouts unbelievable", "the oftention andableness xqzzy"]:
        total = sum(library.get_score(i) for i in library.encode(text))
        assert model.run(P.marked(text), 0, [0])[0][-1] >= total


def test_every_segmentation_of_short_texts():
    model = P.lattice(PATH)

    def best(x):
        return max((s + best(x[:i]) for i, s in model.edges(x, len(x), 0)), default=P.NEVER) if x else 0

    for text in ["the thing", "a  b", "é漢x", "ononon"]:
        x = P.marked(text)
        assert model.run(x, 0, [0])[0][-1] == best(x)


def test_empty_table(documents):
    assert P.encode(documents([]), PATH).count() == 0
