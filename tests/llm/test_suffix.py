import hashlib

import numpy as np
import pytest

from loomwork.llm import suffix_dedup as S


def plain(texts, window):
    first, out = {}, []
    for d, t in enumerate(texts):
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], (d, i))
    for d, t in enumerate(texts):
        b = (t or "").encode()
        gone = {j for i in range(len(b) - window + 1) if first[b[i : i + window]] < (d, i) for j in range(i, i + window)}
        spans = sum(j - 1 not in gone for j in gone)
        out.append((d, len(b), len(gone), spans, hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("window", [5, 100])
def test_matches_brute_force(documents, window):
    rng = np.random.default_rng(5)
    shared = ["".join(rng.choice(list("ab é"), n)) for n in (30, 130, 260)]
    texts = [None, "", "x" * 230, "ab" * 150, shared[1]]
    for k in range(25):
        texts.append("".join(rng.choice(list("abc "), rng.integers(0, 60))) + shared[k % 3][rng.integers(0, 20) :] + "".join(rng.choice(list("abc "), rng.integers(0, 60))))
    rows = S.removed_bytes(documents(texts), window).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == plain(texts, window)
    assert sum(r.n_removed for r in rows) > 300


def test_empty(documents):
    assert S.removed_bytes(documents([])).count() == 0
    assert [r.n_removed for r in S.removed_bytes(documents(["short", None])).collect()] == [0, 0]
