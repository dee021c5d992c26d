import re

import pytest

from loomwork.llm import quality_rules, token_counts, url_filters
from loomwork.llm.queries import tokenizer_file

TEXTS = ["a b c a b c\na b c\na b c\n", "", None, " \n\n \x0b", "x", "é è # $ |\n\n#\n#", "one\ttwo  three\r\nfour" * 40, "Straße 12 don't!! <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "a  b c ́d é", "very " * 30000]


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)} if len(words) < 3000 else set(range(len(words)))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts_match_a_plain_loop(documents):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.base_counts(documents(TEXTS)).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(TEXTS)}


def test_binomial_tail_and_acceptance():
    assert quality_rules.at_most(1, 3, 0.5) == pytest.approx(0.5)
    assert quality_rules.accepted([0, 0, 3], 1000, 0.01, 0.05) == 2
    assert quality_rules.accepted([0, 0, 3], 20, 0.01, 0.05) is None
    assert quality_rules.accepted([9, 0, 0], 1000, 0.01, 0.05) is None


def test_judge_with_no_labels_uses_base_rules_only(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_rules.judge(documents([*TEXTS, " ".join(f"w{i}" for i in range(60))]), labels).collect()}
    assert rows[0].base_failed and rows[2].base_failed and rows[9].base_failed
    assert rows[10].kept and rows[10].rejected_by is None
    assert quality_rules.judge(documents([]), labels).count() == 0


def test_accepted_cutoffs_drop_few_good_texts(spark, documents):
    body = " ".join(f"w{i}" for i in range(300))
    texts = [(i, f"{i} {body}") for i in range(900)] + [(900 + i, f"{i} {body} " + "# " * 400) for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900)] + [(900 + i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judge(documents(texts), labels, alpha=0.06).collect()
    assert all(r.kept for r in rows if r.doc_id < 900) and not any(r.kept for r in rows if r.doc_id >= 900)


def test_token_counts_equal_the_library(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    plain = [len(library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    cache = str(tmp_path / "cache")
    for _ in range(2):  # from an absent cache, then from a full one
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(documents(TEXTS), path, cache).collect()}
        assert got == {i: (len((t or "").encode()), n, n > 2048) for i, (t, n) in enumerate(zip(TEXTS, plain))}
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.count_tokens(documents([]), path, cache).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_count_exact_texts(documents, tmp_path, name):
    path = tokenizer_file(name)
    rows = token_counts.count_tokens(documents(["a  b", "a b", None]), path, str(tmp_path / "c")).collect()
    plain = token_counts.Counter(path)
    assert {r.doc_id: r.n_tokens for r in rows} == {0: plain.count("a  b"), 1: plain.count("a b"), 2: plain.count("")}


def test_urls(spark):
    urls = [None, "", "example.org/es/x", "HTTP://A.Example.ORG/es/1?q#f", "http://example.org/en/12", "http://x.com/fr/casino", "https://x.com/de/", "http://org", "http://a.net/casino-x", "http://a.net/casinos", "http://free-bets.net/free", "http://a.net/free", "http://a.net?x/y", "http://notorg/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages).collect()}
    assert rows == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"),
        3: ("a.example.org", "/es/1", "example.org/es/", "block"), 4: ("example.org", "/en/12", "example.org/en/1", "block"),
        5: ("x.com", "/fr/casino", "com/fr/", "allow"), 6: ("x.com", "/de/", "com/de/", "block"), 7: ("org", "", None, "allow"),
        8: ("a.net", "/casino-x", None, "block"), 9: ("a.net", "/casinos", None, "allow"), 10: ("free-bets.net", "/free", None, "block"),
        11: ("a.net", "/free", None, "allow"), 12: ("a.net", "", None, "allow"), 13: ("notorg", "/", None, "allow"),
    }
