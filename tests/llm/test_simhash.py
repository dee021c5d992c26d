import re

import numpy as np
import xxhash

from loomwork.llm import simhash_dedup as S
from loomwork.llm.components import components
from loomwork.llm.xxh64 import xxh64


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def plain_components(prints):
    group = {p: p for p in prints.values()}
    for a in sorted(set(group)):
        for b in sorted(set(group)):
            if bin(a ^ b).count("1") <= 3:
                old, new = group[b], group[a]
                group = {k: new if g == old else g for k, g in group.items()}
    return {d: min(e for e, q in prints.items() if group[q] == group[p]) for d, p in prints.items()}


def test_hash_equals_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    starts = rng.integers(0, 4000, 300)
    sizes = np.concatenate([np.arange(100), rng.integers(0, 1000, 200)])
    assert xxh64(data, starts, sizes).tolist() == [xxhash.xxh64_intdigest(data[a : a + n], 42) for a, n in zip(starts.tolist(), sizes.tolist())]


def test_near_duplicates_match_brute_force(documents):
    rng = np.random.default_rng(2)
    base = [f"Wörd{rng.integers(0, 999)}" for _ in range(400)]
    texts = [None, "", " \n", "One", "one", "one Two", "a b c d " * 400, " ".join(base), " ".join(base[:-1]), " ".join(base).replace(" ", " \t")]
    for k in range(40):
        other = list(base)
        for at in rng.integers(0, 400, k % 7):
            other[at] = f"x{k}"
        texts.append(" ".join(other))
    rows = S.near_duplicates(documents(texts)).collect()
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)


def test_close_pairs_lose_none(spark):
    rng = np.random.default_rng(3)
    values = {0, -1, 1, 7, 15}
    for v in rng.integers(-(2**63), 2**63 - 1, 30):
        values.add(int(v))
        for _ in range(4):
            x = int(v) & (2**64 - 1)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            values.add(x - 2**64 if x >= 2**63 else x)
    got = [(r.u, r.v) for r in S.close_pairs(spark.createDataFrame([(v,) for v in values], "fp long")).collect()]
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert len(got) == len(want) and set(got) == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 3), (5, 5)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert roots == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(20)}


def test_one_of_each_group_and_empty(documents, spark):
    docs = documents([(5, "a b c d"), (3, "A b c d"), (3, "A b c d"), (9, "other words here now"), (11, None), (12, "")])
    assert sorted(r.doc_id for r in S.one_of_each_group(docs).collect()) == [3, 9, 11]
    assert S.near_duplicates(documents([])).count() == 0


def test_keys_of_fingerprints_are_not_sent_to_all_tasks(spark):
    """68 keys a fingerprint are many times what Spark takes them for by the file of fingerprints."""
    rng = np.random.default_rng(5)
    near = [int(v) for v in rng.integers(-(2**63), 2**63 - 1, 3000)]
    prints = S.stored(spark.createDataFrame([(v ^ k,) for v in near for k in (0, 1)], "fp long"), "prints")
    limits = {"spark.sql.autoBroadcastJoinThreshold": "1m", "spark.sql.maxBroadcastTableSize": "4m"}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        assert S.close_pairs(prints).count() == 3000
    finally:
        for name in limits:
            spark.conf.unset(name)
