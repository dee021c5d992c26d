"""Answers with every kind of fault, made of the benchmark items and their retrieved passages; their codes, and the SQL twins.

An item is an answer to its own first and last words; what it cites, claims and says of its evidence
goes by its id. Five passages are retrieved, of which the fifth is not shown.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import claims
from loomwork.functions import text as T
from loomwork.jobs import oracle, runs_oracle
from loomwork.scratch import kept
from loomwork.jobs.tables import chunks as _chunks
from loomwork.jobs.tables import questions as _questions
from loomwork.jobs.tables import table
from loomwork.operators import coherence, grounding, retrieval, spans

K, SHOWN = 5, 4


def _passages(spark, d):
    """The retrieved passages; every 13th item has none."""
    chunks = _chunks(spark, d)
    top = retrieval.ranked(retrieval.best_bm25(chunks, _questions(spark, d), K), K).where("question_id % 13 <> 5")
    return top.join(chunks.select("passage_id", "text"), "passage_id").select("question_id", "passage_id", F.col("rank").alias("place"), "text", (F.col("rank") <= SHOWN).alias("shown"))


def _answers(spark, d, passages):
    ids = passages.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "passage_id"))).alias("p"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text").join(ids, "question_id", "left")
    n, at = F.col("question_id"), lambda k: F.coalesce(F.get(F.transform("p", lambda x: x["passage_id"]), k - 1), F.lit("unknown"))
    words = T.words(F.col("text"))
    question = F.concat(F.lit("What is "), F.array_join(F.slice(words, 1, 5), " "), F.lit(" and how does "), F.array_join(F.slice(words, -4, 4), " "), F.lit(" differ?"))
    none = F.array().cast("array<string>")
    cited = F.when(n % 5 == 0, F.array(at(1))).when(n % 5 == 1, F.array(at(1), at(5))).when(n % 5 == 2, F.array(F.lit("nowhere"))).when(n % 5 == 3, none).otherwise(F.array(at(2), at(1)))
    named = F.when(n % 3 == 0, F.array(at(2))).when(n % 3 == 1, none).otherwise(F.array(at(1)))
    support = F.when(n % 4 == 0, "partial").when(n % 4 == 1, "unsupported").otherwise("direct")
    claimed = F.transform(claims.split_sentences(F.col("text")), lambda s: F.struct(s.alias("claim"), named.alias("passage_ids"), support.alias("support")))
    part = lambda name, x: F.struct(F.lit(name).alias("name"), x.alias("passage_ids"))
    parts = F.array(part("result", F.array(at(1), at(2))), part("method", F.when(n % 4 == 0, none).otherwise(F.array(at(5)))))
    return items.select(
        "question_id", question.alias("question"), F.col("text").alias("answer"), F.when(n % 7 == 0, "INSUFFICIENT").otherwise("SUFFICIENT").alias("evidence_status"), cited.alias("citations"), claimed.alias("provenance"),
        parts.alias("components"), F.when(n % 11 == 0, "INSUFFICIENT_INFORMATION").otherwise("NONE").alias("gap"), (n % 6 != 0).alias("sufficient"),
    )


def _codes(spark, d):
    keep = kept(spark)
    passages = keep(_passages(spark, d), "passages-of-answers")
    answers = keep(coherence.terminal(_answers(spark, d, passages), passages), "answers")
    return answers, coherence.codes(answers, passages)


def answer_codes(spark, d):
    return _codes(spark, d)[1]


def answer_verdicts(spark, d):
    return coherence.summed(*_codes(spark, d))


def flagged_spans(spark, d):
    answers, found = _codes(spark, d)
    return spans.flagged(answers, found)


def claim_support(spark, d):
    answers = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("answer"))
    found = grounding.claim_support(answers, _passages(spark, d))
    return found.select("question_id", "claim", F.sha2("sentence", 256).alias("sentence_sha256"), F.array_join("passage_ids", ",").alias("passage_ids"), "score", "support")


def supported_quotes(spark, d):
    """Quotes of an item's first eight and last five words with an ellipsis between, one word changed in every third, in its passages."""
    words = T.words(F.col("text"))
    head = F.when(F.col("item_id") % 3 == 0, F.concat(F.slice(words, 1, 7), F.array(F.lit("changed")))).otherwise(F.slice(words, 1, 8))
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.concat_ws(" ... ", F.array_join(head, " "), F.array_join(F.slice(words, -4, 4), " ")).alias("quote"))
    return _passages(spark, d).join(quotes, "question_id").select("question_id", "passage_id", grounding.quote_supported(F.col("quote"), F.col("text")).alias("supported"))


QUERY_FUNCTIONS = (answer_codes, answer_verdicts, flagged_spans, claim_support, supported_quotes)

_HITS = f"""
hits AS MATERIALIZED (
  SELECT question_id, passage_id, rank AS place, text, rank <= {SHOWN} AS shown FROM (SELECT *, {oracle._RANK} AS rank FROM bm25 WHERE question_id % 13 <> 5) JOIN chunks USING (passage_id) WHERE rank <= {K}
)"""
_WORDS = f"regexp_extract_all(text, '{oracle.WORD}')"
_ID = lambda k: f"coalesce(p[{k}], 'unknown')"
_CODES = f"""
items AS (SELECT item_id AS n, text, p FROM benchmark LEFT JOIN (SELECT question_id, list(passage_id ORDER BY place) AS p FROM hits GROUP BY 1) ON question_id = item_id),
raw AS (
  SELECT n AS question_id, 'What is ' || array_to_string(list_slice({_WORDS}, 1, 5), ' ') || ' and how does ' || array_to_string(list_slice({_WORDS}, -4, -1), ' ') || ' differ?' AS question,
         CASE WHEN n % 7 = 0 THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END AS status,
         CASE n % 5 WHEN 0 THEN [{_ID(1)}] WHEN 1 THEN [{_ID(1)}, {_ID(5)}] WHEN 2 THEN ['nowhere'] WHEN 3 THEN []::VARCHAR[] ELSE [{_ID(2)}, {_ID(1)}] END AS citations,
         CASE n % 3 WHEN 0 THEN [{_ID(2)}] WHEN 1 THEN []::VARCHAR[] ELSE [{_ID(1)}] END AS named, CASE n % 4 WHEN 0 THEN 'partial' WHEN 1 THEN 'unsupported' ELSE 'direct' END AS support,
         {runs_oracle._sentences("text")} AS sentences, [{_ID(1)}, {_ID(2)}] AS result, CASE WHEN n % 4 = 0 THEN []::VARCHAR[] ELSE [{_ID(5)}] END AS method,
         CASE WHEN p IS NULL THEN 'EMPTY_CONTEXT' WHEN n % 11 = 0 THEN 'AGENT_INSUFFICIENT' WHEN n % 6 = 0 THEN 'GENERATED_WITH_INSUFFICIENT_EVIDENCE' END AS ended FROM items
), answers AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN stop THEN 'INSUFFICIENT' ELSE status END AS status, CASE WHEN stop THEN []::VARCHAR[] ELSE citations END AS citations, CASE WHEN stop THEN []::VARCHAR[] ELSE sentences END AS sentences)
  FROM (SELECT *, coalesce(ended IN ('EMPTY_CONTEXT', 'AGENT_INSUFFICIENT'), false) AS stop FROM raw)
), ref0 AS (
  SELECT question_id, passage_id, max(cited) AS cited, max(attributed) AS attributed FROM (
    SELECT question_id, unnest(citations) AS passage_id, 1 AS cited, 0 AS attributed FROM answers
    UNION ALL SELECT question_id, unnest(named), 0, 1 FROM answers WHERE len(sentences) > 0) GROUP BY ALL
), refs AS MATERIALIZED (
  SELECT r.*, h.passage_id IS NOT NULL AS retrieved, coalesce(shown, false) AS shown, cited = 1 AND coalesce(shown, false) AS valid, text FROM ref0 r LEFT JOIN hits h USING (question_id, passage_id)
), sums AS (
  SELECT question_id, count(*) FILTER (valid) AS n_valid, list_sort(list(passage_id) FILTER (attributed = 1 AND cited = 0)) AS uncited, list_sort(list(passage_id) FILTER (attributed = 0 AND cited = 1)) AS unclaimed,
         list_distinct(flatten(list({runs_oracle._terms("text")}) FILTER (valid))) AS cited_terms FROM refs GROUP BY 1
), full_ AS MATERIALIZED (
  SELECT a.*, coalesce(n_valid, 0) AS n_valid, uncited, unclaimed, cited_terms, (SELECT count(*) FROM hits h WHERE h.question_id = a.question_id) AS n_passages FROM answers a LEFT JOIN sums USING (question_id)
), claims AS (SELECT question_id, named, support, unnest(sentences) AS claim, unnest(range(len(sentences))) AS place FROM answers),
borne AS (
  SELECT question_id, place, support, claim, max(CASE WHEN len(t) = 0 THEN 1 ELSE len(list_intersect(t, {runs_oracle._terms("text")})) / len(t) END) AS score
  FROM (SELECT *, {runs_oracle._terms("claim")} AS t FROM claims) JOIN refs USING (question_id) WHERE valid GROUP BY ALL
), bare AS (SELECT question_id, cited_terms, regexp_replace(trim(question), '[?.]+$', '') AS q FROM full_ WHERE status = 'SUFFICIENT' AND n_valid > 0),
halves AS (SELECT question_id, cited_terms, string_split_regex(q, '(?i)\\s*(?:;|,\\s*and\\s+|\\s+and\\s+)\\s*') AS parts FROM bare),
clauses AS (
  SELECT question_id, cited_terms, unnest(c) AS clause FROM (SELECT *, list_filter(list_transform(parts, lambda x: trim(x)), lambda x, i: x <> '' AND (i = 1 OR regexp_matches(x, '{runs_oracle._ASKS}'))) AS c FROM halves) WHERE len(c) > 1
), parts AS (
  SELECT question_id, 'result' AS name, unnest(result) AS passage_id FROM full_ WHERE status = 'SUFFICIENT'
  UNION ALL SELECT question_id, 'method', unnest(CASE WHEN len(method) = 0 THEN ['-'] ELSE method END) FROM full_ WHERE status = 'SUFFICIENT'
), all_ AS (
  SELECT question_id, CASE WHEN NOT retrieved THEN 'HALLUCINATED_CITATION' WHEN NOT shown THEN 'CITATION_NOT_IN_PROMPT' END AS code, passage_id AS subject FROM refs
  UNION ALL SELECT question_id, 'CLAIM_WITHOUT_EVIDENCE', substr(claim, 1, 120) FROM claims WHERE len(named) = 0 AND support <> 'unsupported'
  UNION ALL SELECT question_id, 'CITATION_PROVENANCE_MISMATCH', array_to_string(uncited, ',') FROM full_ WHERE status = 'SUFFICIENT' AND len(sentences) > 0 AND len(uncited) > 0
  UNION ALL SELECT question_id, 'CITATION_PROVENANCE_MISMATCH', array_to_string(unclaimed, ',') FROM full_ WHERE status = 'SUFFICIENT' AND len(sentences) > 0 AND len(unclaimed) > 0
  UNION ALL SELECT question_id, 'PROVENANCE_OVERSTATED', substr(claim, 1, 120) FROM borne WHERE (support = 'direct' AND score < {grounding.DIRECT}) OR (support = 'partial' AND score < {grounding.PARTIAL})
  UNION ALL SELECT question_id, CASE WHEN n_passages = 0 THEN 'MISSING_REFUSAL' ELSE 'SUFFICIENT_WITHOUT_CITATION' END, '' FROM full_ WHERE status = 'SUFFICIENT' AND n_valid = 0
  UNION ALL SELECT question_id, 'REFUSAL_WITH_CITATIONS', array_to_string(citations, ',') FROM full_ WHERE status <> 'SUFFICIENT' AND len(citations) > 0
  UNION ALL SELECT question_id, 'UNCOVERED_QUESTION_CLAUSE', substr(clause, 1, 120) FROM (SELECT *, {runs_oracle._terms("clause")} AS t FROM clauses) WHERE len(t) > 0 AND len(list_intersect(t, cited_terms)) / len(t) < {coherence.CLAUSE_RECALL}
  UNION ALL SELECT p.question_id, 'UNCOVERED_REQUIRED_COMPONENT', name FROM parts p LEFT JOIN refs r ON r.question_id = p.question_id AND r.passage_id = p.passage_id AND r.valid GROUP BY p.question_id, name HAVING count(r.passage_id) = 0
  UNION ALL SELECT question_id, ended, '' FROM full_
), severity(code, severity) AS (VALUES {", ".join(f"('{c}', '{s}')" for c, s in coherence.SEVERITY.items())}),
codes AS (SELECT DISTINCT question_id, code, severity, subject FROM all_ JOIN severity USING (code))"""
_QUOTE_WORDS = lambda x: f"regexp_extract_all(lower({x}), '{grounding.QUOTE_WORD.replace(chr(39), chr(39) * 2)}')"
_TRIPLES = lambda x: f"list_distinct(list_transform(range(1, greatest(len({x}) - 2, 1) + 1), lambda i: array_to_string(list_slice({x}, i, i + 2), ' ')))"
_START = f"WITH {oracle.CHUNKS}, {oracle.questions()}, {oracle.scores()}, {_HITS}"

ORACLE_SQL = {
    "answer_codes": f"{_START}, {_CODES} SELECT * FROM codes",
    "answer_verdicts": f"""{_START}, {_CODES}, each_ AS (
  SELECT question_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM codes GROUP BY 1)
SELECT question_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(codes, '') AS codes, CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'warning' ELSE 'ok' END AS worst FROM answers LEFT JOIN each_ USING (question_id)""",
    "flagged_spans": f"""{_START}, {_CODES},
said_ AS (SELECT item_id AS question_id, CASE WHEN a.stop THEN '{grounding.REFUSAL}' ELSE text END AS answer FROM benchmark JOIN answers a ON a.question_id = item_id),
cut_ AS (SELECT question_id, unnest(m) AS s, unnest(range(len(m))) AS i FROM (SELECT question_id, regexp_extract_all(answer, '(?s)\\s*\\S.*?(?:[.!?](?:\\s|$)|$)') AS m FROM said_)),
sentence AS (
  SELECT question_id, stop_ - CASE WHEN regexp_matches(s, '\\s$') THEN 1 ELSE 0 END AS stop, stop_ - length(s) + length(s) - length(ltrim(s, chr(32) || chr(9) || chr(10) || chr(13))) AS start, list_distinct(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+')) AS w
  FROM (SELECT *, sum(length(s)) OVER (PARTITION BY question_id ORDER BY i) AS stop_ FROM cut_)
), flag AS (
  SELECT question_id, code, subject, answer, trim(subject) AS bare, CASE WHEN len(regexp_extract_all(subject, '\\S+')) >= {spans.LEAST_WORDS} THEN instr(answer, trim(subject)) - 1 ELSE -1 END AS start,
         list_distinct(regexp_extract_all(lower(subject), '[\\p{{L}}\\p{{N}}_]+')) AS want FROM codes JOIN said_ USING (question_id)
), span AS (
  SELECT DISTINCT question_id, start, CASE WHEN length(subject) < {spans.CUT} THEN start + length(bare)
         ELSE start + length(bare) + coalesce(length(regexp_extract(substr(answer, CAST(start + length(bare) + 1 AS BIGINT)), '(?s)^(.*?[.!?])(?:\\s|$)', 1)), 0) END AS stop FROM flag WHERE start >= 0
  UNION
  SELECT question_id, start, stop FROM (
    SELECT f.question_id, s.start, s.stop, row_number() OVER (PARTITION BY f.question_id, f.code, f.subject ORDER BY len(list_intersect(want, w)) DESC, s.start DESC) AS r
    FROM flag f JOIN sentence s USING (question_id) WHERE f.start < 0 AND code IN {spans.PARAPHRASED} AND len(list_intersect(want, w)) / greatest(len(want), 1) >= {spans.CLOSE}) WHERE r = 1
), parted AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY question_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM span),
island AS (SELECT *, sum(new) OVER (PARTITION BY question_id ORDER BY start, stop) AS k FROM parted)
SELECT question_id, CAST(min(start) AS INT) AS start, CAST(max(stop) AS INT) AS "end" FROM island GROUP BY question_id, k""",
    "supported_quotes": f"""{_START}, quoted AS (
  SELECT item_id AS question_id, array_to_string(CASE WHEN item_id % 3 = 0 THEN list_concat(list_slice(w, 1, 7), ['changed']) ELSE list_slice(w, 1, 8) END, ' ') || ' ... ' || array_to_string(list_slice(w, -4, -1), ' ') AS quote
  FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)
), parts AS (SELECT question_id, unnest(string_split_regex(quote, '\\.\\.\\.|…')) AS part FROM quoted),
p AS (SELECT question_id, w FROM (SELECT question_id, {_QUOTE_WORDS("part")} AS w FROM parts) WHERE len(w) > 0),
h AS (SELECT question_id, passage_id, {_QUOTE_WORDS("text")} AS t FROM hits),
each_ AS (
  SELECT question_id, passage_id, len(w) AS n, contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(w, ' ') || ' ') OR (len(w) >= 3 AND len(list_intersect({_TRIPLES("w")}, {_TRIPLES("t")})) / len({_TRIPLES("w")}) >= {grounding.QUOTE_SHARE}) AS stands
  FROM h JOIN p USING (question_id)
)
SELECT question_id, passage_id, coalesce(sum(n) >= {grounding.QUOTE_WORDS} AND bool_and(stands), false) AS supported FROM h LEFT JOIN each_ USING (question_id, passage_id) GROUP BY ALL""",
    "claim_support": f"""{_START}, sent AS (SELECT item_id AS question_id, unnest(s) AS sentence, CAST(unnest(range(len(s))) AS INT) AS claim FROM (SELECT item_id, {runs_oracle._sentences("text")} AS s FROM benchmark)),
claims AS (SELECT *, {runs_oracle._terms("sentence")} AS t FROM sent),
scored AS (SELECT question_id, claim, sentence, passage_id, place, len(list_intersect(t, {runs_oracle._terms("text")})) / len(t) AS score FROM claims JOIN hits USING (question_id) WHERE len(t) >= {grounding.LEAST_TOKENS}),
top AS (SELECT *, row_number() OVER (PARTITION BY question_id, claim ORDER BY score DESC, place) AS r FROM scored)
SELECT question_id, claim, sha256(any_value(sentence)) AS sentence_sha256, round(max(score), 6) AS score, CASE WHEN max(score) >= {grounding.DIRECT} THEN 'direct' WHEN max(score) >= {grounding.PARTIAL} THEN 'partial' ELSE 'unsupported' END AS support,
       coalesce(string_agg(passage_id, ',' ORDER BY r) FILTER (score >= {grounding.DIRECT} OR (best < {grounding.DIRECT} AND best >= {grounding.PARTIAL} AND r = 1)), '') AS passage_ids
FROM (SELECT *, max(score) OVER (PARTITION BY question_id, claim) AS best FROM top WHERE r <= {grounding.MOST_PASSAGES}) GROUP BY question_id, claim""",
}
