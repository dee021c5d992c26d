import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import near_copies as N
from loomwork.llm import scratch


def similarity(a, b):
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def kept(texts):
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return sorted(set(group))


def test_the_stage_links_what_brute_force_links(spark, documents, tmp_path):
    rng = np.random.default_rng(7)
    say = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    texts = [None, "", " \n", "One", "one", "a b c d", "a b c d e"]
    for size in (40, 90, 300, 900):
        for _ in range(6):
            base = say(size)
            texts.append(" ".join(base))
            for share in (0.01, 0.02, 0.025, 0.05):
                other = list(base)
                for at in rng.integers(0, size, max(1, int(share * size))):
                    other[at] = "changed"
                texts.append(" ".join(other).capitalize())
    got = corpus_pipeline.drop_near_duplicates(spark, documents(texts), str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == kept(texts)
    assert len(kept(texts)) < len(texts) - 40


def test_rows_with_repeated_or_no_ids(spark, documents, tmp_path):
    one, two, three = ("".join(f"{w}{k} " for k in range(30)) for w in "abc")
    rows = [(1, one), (7, two), (7, one), (7, two), (None, three), (None, three), (None, one), (9, two + "x")]
    got = corpus_pipeline.drop_near_duplicates(spark, documents(rows), str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, three), (1, one), (7, two)]
    assert not corpus_pipeline.drop_near_duplicates(spark, documents([]), str(tmp_path)).collect()


def test_chains_link_though_their_ends_are_unlike(spark, documents, tmp_path):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(3):
        words = [f"w{k}" for k in rng.integers(0, 9000, 200)]
        for step in range(20):
            words[step * 9 : step * 9 + 3] = [f"new{step}", f"put{step}", f"set{step}"]
            texts.append(" ".join(words))
    got = corpus_pipeline.drop_near_duplicates(spark, documents(texts), str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == kept(texts) == [0, 20, 40]


def test_leaders_meet_their_key_only(spark):
    keys = spark.createDataFrame([(n, 10, 1, 1) for n in range(1, 9)] + [(20, 10, 1, 20), (21, 10, 1, 20), (30, 99, 1, 30), (5, 10, 2, 1)], "node long, n long, key long, root long")
    assert sorted(N._led(keys).collect()) == [(1, v) for v in [*range(2, 9), 20, 21]]


def tables(spark, sets, root):
    """The tables that groups are joined by, from sets of hashes: nodes count from 1."""
    hashes = [sorted(s) for s in sets]
    odd = N._parities(pa.array(hashes, pa.list_(pa.int64()))).to_pylist()
    nodes = spark.createDataFrame([(k, len(h), root[k - 1]) for k, h in enumerate(hashes, 1)], "node long, n long, root long")
    return nodes, spark.createDataFrame([(k, h, o) for k, (h, o) in enumerate(zip(hashes, odd), 1)], "node long, hashes array<long>, odd array<long>").repartition(4)


def links(spark, sets, root):
    nodes, table = tables(spark, sets, root)
    pairs = N._across(nodes, table)
    return pairs.count(), {tuple(sorted((r.u, r.v))) for r in N._verified(pairs.select("u", "v"), table).collect()}


def plain_links(sets, root):
    return {(i + 1, j + 1) for j in range(len(sets)) for i in range(j) if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def test_a_hot_group_and_its_outsiders_meet_only_where_they_may_be_similar(spark):
    rng = np.random.default_rng(11)
    new = lambda n: {int(x) for x in rng.integers(-(2**63), 2**63, n)}
    base = sorted(new(140))

    def edited(own):
        return set(rng.choice(base, 140 - own, replace=False).tolist()) | new(own)

    sets = [edited(int(k)) for k in rng.integers(1, 10, 1300)] + [edited(int(k)) for k in rng.integers(14, 40, 230)]
    root = [1] * 1300 + list(range(1301, 1531))
    made, found = links(spark, sets, root)
    assert found == plain_links(sets, root) and found
    assert made < 20 * len(found) and made < 60_000


def test_links_between_groups_are_exactly_the_similar_pairs(spark):
    rng = np.random.default_rng(12)
    sets, root = [], []
    for g in range(40):
        base = sorted({int(x) for x in rng.integers(0, 400, rng.integers(1, 60))})
        for k in range(6):
            keep = rng.random(len(base)) > rng.choice([0.0, 0.04, 0.12, 0.2])
            sets.append({b for b, x in zip(base, keep) if x} | {int(x) for x in rng.integers(400, 440, rng.integers(0, 4))} or {base[0]})
            root.append(6 * g + (k if g % 2 else 1))
    found = links(spark, sets, root)[1]
    assert found == plain_links(sets, root) and len(found) > 50
    edge, owner = [], []
    for k, n in enumerate((1, 2, 4, 5, 9, 10, 45, 50)):  # exactly at the least similarity, and just below it
        whole = range(1000 * k, 1000 * k + n)
        edge += [set(whole), set(whole[: -(-4 * n // 5)]), set(whole[: max(1, -(-4 * n // 5) - 1)])]
        owner += range(3 * k, 3 * k + 3)
    edge, owner = zip(*{frozenset(e): (e, o) for e, o in zip(edge, owner)}.values())
    assert links(spark, edge, owner)[1] == plain_links(edge, owner)


def test_close_fingerprints_of_other_groups_meet_and_each_has_one_leader(spark):
    prints = spark.createDataFrame([(1, 100, 0b0, 1), (2, 100, 0b111, 2), (3, 100, 0b111, 3), (4, 100, 0b1111000, 4), (5, 10, 0b1, 5), (6, 100, 1 << 40, 1)], "node long, n long, fp long, root long")
    chain = N.close_pairs(prints.select("fp").distinct())
    close = {(a, b) for a, b in ((x, y) for x in (1, 2, 3, 4, 6) for y in (1, 2, 3, 4, 6) if x < y)} - {(1, 4), (2, 4), (3, 4), (4, 6), (2, 6), (3, 6)}
    assert {tuple(sorted((r.u, r.v))) for r in N._chain_across(prints, chain).collect()} == close - {(1, 6)}
    led = {tuple(sorted((r.u, r.v))) for r in N._chain_led(prints.drop("root"), chain).collect()}
    assert led <= close and len(led) == 3 and (2, 3) in led


def test_groups_link_by_fingerprints_alone(spark, documents):
    """Nodes without any common band key are linked if their fingerprints are close and their sets similar."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["end"]), " ".join(reversed(words))]
    rows = documents(texts).select("doc_id", F.col("text").alias("text"), F.lit(0).cast("long").alias("text_hash"))
    scanned = rows.mapInArrow(N._scan, "doc_id long, text_hash long, node long, n long, fp long, bands array<long>")
    apart = scanned.select("node", "n", "fp", F.array(F.col("node")).alias("bands"))
    found = {r.node: r.root for r in N.groups(rows.select("text"), apart).collect()}
    nodes = {r.doc_id: r for r in scanned.collect()}
    assert bin((nodes[0].fp ^ nodes[1].fp) & (2**64 - 1)).count("1") <= 3
    assert found == {nodes[k].node: min(nodes[0].node, nodes[1].node) for k in (0, 1)}


def test_no_step_of_joins_broadcasts_by_the_size_of_files(spark, documents, monkeypatch):
    """Prefixes by class of sizes were 178 MB in the driver, from a file taken for less than 10 MB."""
    plans, stored = {}, scratch.stored

    def seen(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name, *more)

    for module in (scratch, N):
        monkeypatch.setattr(module, "stored", seen)
    words = [f"w{k}" for k in range(100)]
    assert N.one_of_each_group(documents([" ".join([*words[:-k], *[f"v{k}"] * k]) for k in range(1, 30)])).count() == 1
    joins = {"keys", "near", "shingles", "led", "nodes", "first", "prefixes", "across", "judged"}
    assert joins <= plans.keys() and not [name for name in joins if "Broadcast" in plans[name]]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
