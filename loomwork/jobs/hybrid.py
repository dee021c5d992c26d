"""Four systems over the same passages and questions: BM25, dense, both fused, and those reranked; SQL twins.

The standard tables hold no vectors of their texts, so passages and questions are encoded by hashed words;
any encoder takes its place.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.jobs import oracle
from loomwork.jobs.tables import chunks as _chunks
from loomwork.jobs.tables import questions as _questions
from loomwork.jobs.tables import table
from loomwork.operators import evaluation, retrieval
from loomwork.scratch import kept

DEPTH, K, DIMS = 10, 5, 64


def _two(spark, d, keep):
    """The stored rankings of BM25 and of dense search, DEPTH deep."""
    chunks, questions = _chunks(spark, d), _questions(spark, d)
    sparse = retrieval.ranked(retrieval.best_bm25(chunks, questions, DEPTH), DEPTH)
    vectors = keep(retrieval.encoded(chunks, "passage_id", "text"), "passage-vectors")
    found = retrieval.dense_top_k(vectors, keep(retrieval.encoded(questions, "question_id", "question"), "question-vectors"), DEPTH)
    dense = found.select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("passage_id"), "rank", "score")
    columns = ["question_id", "method", "passage_id", "rank", "score"]
    return keep(sparse.withColumn("method", F.lit("bm25")).select(*columns).unionByName(dense.withColumn("method", F.lit("dense")).select(*columns)), "rankings")


def hybrid_fusion(spark, d):
    return retrieval.fuse(_two(spark, d, kept(spark)), K)


def four_systems(spark, d):
    keep = kept(spark)
    two = _two(spark, d, keep)
    chunks, questions = _chunks(spark, d), _questions(spark, d)
    fused = keep(retrieval.fuse(two, DEPTH), "fused")
    reranked = retrieval.rerank(fused, retrieval.overlap_scores(retrieval.of_candidates(chunks, fused), questions), K)
    named = lambda rows, method: rows.select("question_id", F.lit(method).alias("method"), "passage_id", "rank", F.lit(0.0).alias("score"))
    every = keep(two.unionByName(named(fused, "hybrid")).unionByName(named(reranked, "hybrid_reranked")), "systems")
    gold = keep(retrieval.gold_by_containment(chunks, table(spark, d, "benchmark")).select(F.col("item_id").alias("question_id"), "passage_id"), "gold")
    return evaluation.macro(evaluation.binary_metrics(every, gold, questions, K))


QUERY_FUNCTIONS = (hybrid_fusion, four_systems)

_HASH = "CAST('0x' || substr(md5(term), 1, 8) AS BIGINT)"
_VECTOR = lambda key, rows: f"SELECT {key}, h % {DIMS} AS place, CAST(sum(n * ((h // {DIMS}) % 2 * 2 - 1)) AS DOUBLE) AS x FROM (SELECT {key}, n, {_HASH} AS h FROM {rows}) GROUP BY ALL"
_TWO = f"""
pv AS MATERIALIZED ({_VECTOR("passage_id", "(SELECT passage_id, term, tf AS n FROM post)")}),
qv AS MATERIALIZED ({_VECTOR("question_id", "(SELECT question_id, term, qtf AS n FROM qt)")}),
pn AS (SELECT passage_id, sqrt(sum(x * x)) AS n FROM pv GROUP BY 1 HAVING sum(x * x) > 0), qn AS (SELECT question_id, sqrt(sum(x * x)) AS n FROM qv GROUP BY 1 HAVING sum(x * x) > 0),
dot AS (SELECT question_id, passage_id, sum(q.x * p.x) AS s FROM qv q JOIN pv p USING (place) GROUP BY ALL),
cosine AS (SELECT question_id, passage_id, round(coalesce(s, 0) / (q.n * p.n), 6) AS score FROM qn q CROSS JOIN pn p LEFT JOIN dot USING (question_id, passage_id)),
rankings AS MATERIALIZED (
  SELECT * FROM (SELECT question_id, 'bm25' AS method, passage_id, {oracle._RANK} AS rank FROM bm25) WHERE rank <= {DEPTH}
  UNION ALL SELECT * FROM (SELECT question_id, 'dense' AS method, passage_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS INT) AS rank FROM cosine) WHERE rank <= {DEPTH}
), {oracle._FUSED}"""
_START = f"WITH {oracle.CHUNKS}, {oracle.questions()}, {oracle.scores()}"


def oracle_sql() -> dict[str, str]:
    metrics = oracle._METRICS.replace("rankings", "systems")
    return {
        "hybrid_fusion": f"{_START}, {_TWO} SELECT * FROM fused WHERE rank <= {K}",
        "four_systems": f"""{_START}, {oracle._OVERLAP}, {_TWO}, {oracle._GOLD},
pairs AS (SELECT f.question_id, f.passage_id, coalesce(o.score, 0) AS pair_score, f.score FROM fused f LEFT JOIN overlap o USING (question_id, passage_id) WHERE f.rank <= {DEPTH}),
again AS (SELECT question_id, passage_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(pair_score, 9) DESC, score DESC, passage_id) AS INT) AS rank FROM pairs),
systems AS (
  SELECT * FROM rankings UNION ALL SELECT question_id, 'hybrid', passage_id, rank FROM fused WHERE rank <= {DEPTH}
  UNION ALL SELECT question_id, 'hybrid_reranked', passage_id, rank FROM again WHERE rank <= {K}
), {metrics}
SELECT method, count(*) AS questions, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
count(precision) AS precision_n, count(recall) AS recall_n, count(mrr) AS mrr_n, count(ndcg) AS ndcg_n FROM metrics GROUP BY 1""",
    }
