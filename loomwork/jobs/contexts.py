"""Contexts of runs over the benchmark's retrieved passages, rebuilt, and the SQL twin.

Of the requests, every third has passages without scores, every fifth run is of no answer; the rest of the runs
fail by their ids: another prompt version, a request that was changed since, or a passage without text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.jobs import oracle
from loomwork.jobs.tables import chunks as _chunks
from loomwork.jobs.tables import questions as _questions
from loomwork.jobs.tables import table
from loomwork.operators import contexts, retrieval
from loomwork.scratch import kept

CONFIG = {"version": contexts.VERSION, "max_passages": 3, "max_chars": 300, "show_scores": True}


def rebuilt_contexts(spark, d):
    keep, chunks = kept(spark), _chunks(spark, d)
    top = retrieval.ranked(retrieval.best_bm25(chunks, _questions(spark, d), 5), 5)
    held = top.join(chunks.select("passage_id", "doc_id", "section", "text"), "passage_id").join(table(spark, d, "documents").select("doc_id", F.col("source").alias("paper")), "doc_id")
    text = F.when((F.col("question_id") % 11 == 4) & (F.col("rank") == 2), " ").otherwise(F.col("text"))
    score = F.when(F.col("question_id") % 3 != 0, -F.round("score", 6))
    passage = F.struct("passage_id", "paper", "section", F.lit(None).cast("string").alias("title"), score.alias("score"), "rank", text.alias("text"))
    requests = held.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", passage.alias("p")))), lambda x: x["p"]).alias("passages"))
    requests = keep(requests.withColumn("gap", F.when(F.col("question_id") % 4 == 0, "NONE")).where("question_id % 13 <> 6"), "requests")
    n = F.col("question_id")
    asked = _questions(spark, d).select("question_id").join(contexts.fingerprints(requests), "question_id", "left")
    runs = asked.select("question_id", F.when(n % 5 == 2, "refused").otherwise("answered").alias("status"), F.when(n % 17 == 3, "prompt-0").otherwise(contexts.VERSION).alias("prompt_version"), F.when(n % 7 == 1, "stale").otherwise(F.col("fingerprint")).alias("fingerprint"))
    found, faults = contexts.reconstructed(runs, requests, CONFIG, "as in the runs")
    shown = found.select("question_id", F.lit("ok").alias("state"), F.array_join("passage_ids", ",").alias("passage_ids"), F.sha2(F.array_join("contexts", "\n"), 256).alias("contexts_sha256"))
    none = F.lit(None).cast("string")
    return shown.unionByName(faults.select("question_id", F.col("fault").alias("state"), none.alias("passage_ids"), none.alias("contexts_sha256")))


QUERY_FUNCTIONS = (rebuilt_contexts,)

ORACLE_SQL = {
    "rebuilt_contexts": f"""WITH {oracle.CHUNKS}, {oracle.questions()}, {oracle.scores()},
held AS (
  SELECT question_id, passage_id, rank, source, c.section, CASE WHEN question_id % 11 = 4 AND rank = 2 THEN ' ' ELSE c.text END AS text, CASE WHEN question_id % 3 <> 0 THEN -round(score, 6) END AS score
  FROM (SELECT *, {oracle._RANK} AS rank FROM bm25) JOIN chunks c USING (passage_id) JOIN documents USING (doc_id) WHERE rank <= 5
), placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN score IS NULL THEN 0 ELSE -score END, rank, passage_id) AS i FROM held),
shown AS (
  SELECT question_id, i, passage_id, '[' || i || '] passage_id: ' || passage_id || chr(10) || '    ' || concat_ws(chr(10) || '    ',
    nullif(concat_ws(' | ', CASE WHEN source <> '' THEN 'paper: ' || source END, CASE WHEN section <> '' THEN 'section: ' || section END, CASE WHEN score IS NOT NULL THEN 'score: ' || printf('%.3f', score) END), ''),
    'text: ' || CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(substr(text, 1, 294), '\\s+$', '') || ' [...]' END) AS t FROM placed WHERE i <= 3
), state AS (
  SELECT question_id AS n, CASE WHEN question_id % 17 = 3 THEN 'version' WHEN question_id % 13 = 6 OR NOT EXISTS (SELECT 1 FROM held h WHERE h.question_id = q.question_id) THEN 'no_request' WHEN question_id % 7 = 1 THEN 'request_differs'
    WHEN EXISTS (SELECT 1 FROM held h WHERE h.question_id = q.question_id AND trim(text) = '') THEN 'dropped' ELSE 'ok' END AS state FROM questions q WHERE question_id % 5 <> 2
)
SELECT n AS question_id, state, CASE WHEN state = 'ok' THEN (SELECT string_agg(passage_id, ',' ORDER BY i) FROM shown WHERE question_id = n) END AS passage_ids,
       CASE WHEN state = 'ok' THEN sha256((SELECT string_agg(t, chr(10) ORDER BY i) FROM shown WHERE question_id = n)) END AS contexts_sha256 FROM state""",
}
