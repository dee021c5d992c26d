"""A sample of whole documents of an exact number of passages, and the acceptance of plans by gold and lookalike passages; SQL twins.

Sources stand for papers, documents for containers and, under the names of the scoped loop, for sections. A
question is of the paper that holds its first gold passage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.jobs import loops, oracle
from loomwork.jobs.tables import chunks as _chunks
from loomwork.jobs.tables import questions as _questions
from loomwork.jobs.tables import table
from loomwork.operators import acceptance, containers, retrieval, spans
from loomwork.scratch import kept

TARGET = 200
DEPTH, BUDGETS = 10, (150, 500, 1000, 2000)


def exact_sample(spark, d):
    sizes = _chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("size"))
    rows = sizes.join(table(spark, d, "documents").select("doc_id", F.col("source").alias("paper")), "doc_id")
    return containers.exact_choice(rows.withColumnRenamed("doc_id", "container"), TARGET)


def plan_acceptance(spark, d):
    keep = kept(spark)
    chunks = loops.sectioned(spark, d)
    gold = keep(retrieval.gold_by_containment(chunks, table(spark, d, "benchmark")).select(F.col("item_id").alias("question_id"), "passage_id"), "gold")
    own = gold.join(chunks.select("passage_id", "source", "doc_id", "chunk_number"), "passage_id").groupBy("question_id").agg(F.min_by("source", F.struct("doc_id", "chunk_number")).alias("scope"))
    questions = keep(loops.cued(_questions(spark, d)).drop("scope").join(own, "question_id", "left"), "questions")
    units = chunks.select(F.col("source").alias("scope"), "passage_id", F.struct("doc_id", "chunk_number").alias("position"), "section", "text")
    return acceptance.acceptance(questions, units, gold, keep=keep)


def word_budgets(spark, d):
    chunks, questions, keep = _chunks(spark, d), _questions(spark, d), kept(spark)
    top = retrieval.ranked(retrieval.best_bm25(chunks, questions, DEPTH), DEPTH).withColumn("method", F.lit("bm25"))
    more = retrieval.ranked(retrieval.best_overlap(chunks, questions, DEPTH), DEPTH).withColumn("method", F.lit("overlap"))
    ranked = keep(top.unionByName(more).join(chunks.select("passage_id", "n_words"), "passage_id").select("question_id", "method", "passage_id", "rank", "n_words"), "ranked")
    evidence = table(spark, d, "benchmark")
    gold = retrieval.gold_by_containment(chunks, evidence).select(F.col("item_id").alias("question_id"), "passage_id")
    places = keep(spans.evidence_places(chunks, evidence.select(F.col("item_id").alias("question_id"), "text"), gold), "places")
    return spans.budget_hits(ranked, places, list(BUDGETS))


QUERY_FUNCTIONS = (exact_sample, plan_acceptance, word_budgets)


def oracle_sql() -> dict[str, str]:
    chunks, cue = loops.sectioned_sql(), loops.cue_sql()
    asked = oracle.questions().replace("array_to_string(", f"trim({cue} || ' ' || array_to_string(", 1).replace(" AS question FROM", ") AS question FROM", 1)
    stems = f"list_transform(t, lambda w: {oracle._stem('w')})"
    accepted = lambda kind: f"""(SELECT question_id FROM needs LEFT JOIN (
    SELECT DISTINCT question_id, ordinal, true AS met FROM shown JOIN needs USING (question_id) WHERE kind = '{kind}' AND (len(list_filter(coalesce(hints, []), lambda h: contains(lower(section), h))) > 0
      OR len(list_filter(words, lambda w: regexp_matches(lower(text), '(^|[^A-Za-z0-9_])' || regexp_escape(w)))) >= needed)) USING (question_id, ordinal) GROUP BY 1 HAVING bool_and(met IS NOT NULL))"""  # noqa: E731
    figure = lambda kind: f"count(*) FILTER (judged AND question_id IN {accepted(kind)}) AS {kind}"
    figures = f"count(*) AS questions, count(*) FILTER (judged) AS judged, {figure('gold')}, {figure('hard')}, {figure('matched')}"
    return {
        "word_budgets": f"""{oracle._BASE}, {oracle._GOLD},
spaced AS (
  SELECT question_id, passage_id, n_words, len(regexp_extract_all(b.text, '{oracle.WORD}')) AS nv, ' ' || array_to_string(regexp_extract_all(c.text, '{oracle.WORD}'), ' ') || ' ' AS w, ' ' || array_to_string(regexp_extract_all(b.text, '{oracle.WORD}'), ' ') || ' ' AS v
  FROM gold JOIN chunks c USING (passage_id) JOIN benchmark b ON b.item_id = question_id
), places AS (
  SELECT question_id, passage_id, CASE WHEN instr(w, v) > 0 THEN len(string_split(substr(w, 1, instr(w, v)), ' ')) - 2 + nv ELSE n_words END AS last_word FROM spaced
), placed AS (SELECT question_id, method, passage_id, rank, n_words, sum(n_words) OVER (PARTITION BY question_id, method ORDER BY rank) - n_words AS before FROM rankings JOIN chunks USING (passage_id)),
shown AS (SELECT *, least(n_words, budget - before) AS shown FROM placed, (SELECT unnest({list(BUDGETS)}) AS budget) WHERE before < budget),
each_ AS (
  SELECT question_id, method, budget, max(CASE WHEN last_word <= shown THEN 1 ELSE 0 END) AS hit, sum(shown) AS words, max(CASE WHEN shown < n_words THEN 1 ELSE 0 END) AS cut
  FROM shown LEFT JOIN places USING (question_id, passage_id) GROUP BY ALL
)
SELECT method, CAST(budget AS INT) AS budget, count(*) AS questions, CAST(sum(hit) AS BIGINT) AS hits, round(avg(words), 6) AS words, CAST(sum(cut) AS BIGINT) AS partial FROM each_ GROUP BY method, budget""",
        "exact_sample": f"""WITH RECURSIVE {oracle.CHUNKS},
sizes AS (SELECT source AS paper, c.doc_id AS container, count(*) AS size FROM chunks c JOIN documents d USING (doc_id) GROUP BY ALL),
options AS MATERIALIZED (SELECT paper, size, min(container) AS container, dense_rank() OVER (ORDER BY paper) AS k FROM sizes WHERE size <= {TARGET} GROUP BY paper, size),
step AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS total, []::STRUCT(paper VARCHAR, container BIGINT, size BIGINT)[] AS choice
  UNION ALL
  SELECT k, total, choice FROM (
    SELECT s.k + 1 AS k, s.total + coalesce(o.size, 0) AS total, CASE WHEN o.size IS NULL THEN s.choice ELSE list_append(s.choice, {{'paper': o.paper, 'container': o.container, 'size': o.size}}) END AS choice
    FROM step s JOIN (SELECT k, paper, container, size FROM options UNION ALL SELECT DISTINCT k, NULL, NULL, NULL FROM options) o ON o.k = s.k + 1)
  WHERE total <= {TARGET} QUALIFY row_number() OVER (PARTITION BY total ORDER BY len(choice) DESC, choice) = 1
)
SELECT c.paper, c.container, CAST(c.size AS INT) AS size FROM (SELECT unnest(choice) AS c FROM step WHERE total = {TARGET} AND k = (SELECT max(k) FROM options))""",
        "plan_acceptance": f"""WITH {chunks}, {asked}, {oracle._GOLD}, queried AS (SELECT question_id, question FROM questions), {oracle._NEEDS},
own AS (SELECT question_id, arg_min(source, row(doc_id, chunk_number)) AS source FROM gold JOIN chunks USING (passage_id) GROUP BY 1),
stems AS (SELECT question_id, list_distinct({stems}) AS stems FROM kind),
unit AS MATERIALIZED (
  SELECT question_id, c.passage_id, c.section, c.text, doc_id, chunk_number, g.passage_id IS NOT NULL AS gold, len(list_filter(stems, lambda s: contains(lower(c.text), s))) AS n
  FROM own JOIN stems USING (question_id) JOIN chunks c USING (source) LEFT JOIN gold g ON g.question_id = own.question_id AND g.passage_id = c.passage_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, gold ORDER BY n DESC, doc_id, chunk_number) AS rank, count(*) FILTER (gold) OVER (PARTITION BY question_id) AS n_gold FROM unit),
shown AS MATERIALIZED (
  SELECT question_id, 'gold' AS kind, text, section FROM ranked WHERE gold UNION ALL SELECT question_id, 'hard', text, section FROM ranked WHERE NOT gold AND rank <= {acceptance.HARD}
  UNION ALL SELECT question_id, 'matched', text, section FROM ranked WHERE NOT gold AND rank <= least({acceptance.HARD}, n_gold)
), every AS (SELECT k.kind AS type, k.question_id, k.question_id IN (SELECT question_id FROM shown) AS judged FROM kind k)
SELECT type, {figures} FROM every GROUP BY 1 UNION ALL SELECT 'overall', {figures} FROM every""",
    }
