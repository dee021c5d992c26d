import numpy as np

from loomwork.jobs import catalogue
from loomwork.operators import retrieval


def vectors(spark, n, labels):
    """Some vectors are copies, so that scores tie; some have no label."""
    rng = np.random.default_rng(4)
    made = np.round(rng.normal(size=(n, 8)), 2)
    made[n // 2 : n // 2 + 20] = made[:20]
    made[20:30] = made[3]
    return spark.createDataFrame([(i * 7 % n, made[i].tolist(), None if i % 11 == 5 else int(i % labels)) for i in range(n)], "vec_id long, embedding array<float>, label int")


def plain(rows, k):
    out = []
    unit = {r.vec_id: np.float64(np.float32(r.embedding)) / np.linalg.norm(np.float32(r.embedding).astype(np.float64)) for r in rows}
    for q in rows:
        found = sorted((-round(float(unit[q.vec_id] @ unit[x.vec_id]), 6), x.vec_id) for x in rows if q.label is not None and x.label == q.label)
        out += [(q.vec_id, v, -s, rank) for rank, (s, v) in enumerate(found[:k], 1)]
    return sorted(out)


def got(found):
    return sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in found.collect())


def test_every_vector_asks_all_of_its_label_however_they_are_dealt(spark, monkeypatch):
    table = vectors(spark, 150, 3)
    want = plain(table.collect(), 5)
    assert len(want) > 600
    assert got(retrieval.dense_of_label(table, 5)) == want
    monkeypatch.setattr(retrieval, "GROUP", 9)
    assert got(retrieval.dense_of_label(table, 5)) == want
    assert got(retrieval.dense_of_label(table.where("vec_id < 4"), 5)) == plain(table.where("vec_id < 4").collect(), 5)
    assert not got(retrieval.dense_of_label(table.limit(0), 5))


def test_dense_paper_asks_with_every_vector(spark, tmp_path):
    table = vectors(spark, 120, 4)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(catalogue.QUERIES["dense_paper"](spark, str(tmp_path))) == plain(table.collect(), 5)
    assert "% 50" not in catalogue.ORACLE_SQL["dense_paper"]
