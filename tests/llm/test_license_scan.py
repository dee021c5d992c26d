import re

import numpy as np

from loomwork.llm import license_scan
from loomwork.llm.license_scan import PHRASES, TEMPLATES, need_of, scan, stride_of, template_matches

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_matches(text, templates, contained=90):
    """(first word, template, overlap) of every block and template, compared one by one."""
    w, out = WORD.findall((text or "").translate(FOLD)), []
    for k, (_, t) in enumerate(templates):
        t = t.split()
        stride, whole = stride_of(len(t)), set(t)
        at = 0
        while at == 0 or at + stride < len(w):
            n = len(whole & set(w[at : at + 2 * stride]))
            if 100 * n >= contained * len(whole):
                out.append((at, k, n))
            at += stride
    return out


def plain(doc_id, text, templates=TEMPLATES, phrases=PHRASES):
    w = WORD.findall((text or "").translate(FOLD))
    base = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = [(templates[k][0], n / len(set(templates[k][1].split()))) for _, k, n in plain_matches(text, templates)]
    labels = sorted({label for _, label in base})
    score = 1.0 if base else max((c for _, c in found), default=0.0)
    at = [i for i, _ in base]
    return (doc_id, len(w), len(base), min(at, default=None), max(at, default=None), ",".join(labels), ",".join(sorted({*labels, *(x for x, _ in found)})), score)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts():
    rng = np.random.default_rng(2)
    known = sorted({w for _, t in TEMPLATES for w in t.split()})
    out = [" ".join(rng.choice(known, rng.integers(0, 400))) for _ in range(60)]
    for k in range(120):
        t = TEMPLATES[k % len(TEMPLATES)][1].split()
        for _ in range(k // len(TEMPLATES)):
            t[rng.integers(len(t))] = "other"
        out.append(" ".join(["und"] * int(rng.integers(0, 90)) + t + ["mit"] * int(rng.integers(0, 90))))
    out += ["Licensed under CC BY-NC 4.0. CC-BY cc by", "ALL RIGHTS\nreserved; all rights all rights reserved", "cc", "by cc", "general public license " * 4, "", None, " .,;", "Éall rights reserved", "all rights reservedé"]
    out += ["the " * 50_000 + "released under the mit license " + "the of " * 30_000, "This work is licensed under the GNU General Public License, version 3."] * 2
    return out


def test_equals_plain_scan(spark, documents):
    docs = [*enumerate(texts()), (None, "cc by"), (3, "released under the MIT license")]
    want = sorted((plain(i, t) for i, t in docs), key=repr)
    assert sum(r[6] not in ("", r[5]) for r in want) > 40
    assert rows_of(scan(documents(docs).repartition(4))) == want
    assert rows_of(scan(documents(docs).selectExpr("*", "1 AS row", "2 AS blocks", "'x' AS labels", "3 AS n_words"))) == want


def test_every_block_is_found(spark, documents):
    docs = list(enumerate(texts()))
    want = sorted((i, at, 2 * stride_of(len(TEMPLATES[k][1].split())), k, TEMPLATES[k][0], n / len(set(TEMPLATES[k][1].split()))) for i, t in docs for at, k, n in plain_matches(t, TEMPLATES, 70))
    assert len(want) > 100
    assert rows_of(template_matches(documents(docs), contained=70)) == sorted(want, key=repr)


def test_no_templates_and_empty_tables(spark, documents):
    assert scan(documents([])).count() == 0
    only = [tuple(r) for r in scan(documents(["all rights reserved", "released under the mit license"]), templates=()).orderBy("doc_id").collect()]
    assert only == [plain(0, "all rights reserved"), (1, 5, 0, None, None, "", "", 0.0)]
    assert template_matches(documents(["a b"]), (("x", "a b c"),), 66).collect()[0].containment == 2 / 3
    assert need_of(5) == 5 and need_of(10) == 9 and license_scan.words_of("A-b É") == [b"a", b"b", "É".encode()]
