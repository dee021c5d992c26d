"""SQL twins of the queries of ``runs``, written for an independent engine."""

from __future__ import annotations

from loomwork.functions.claims import ABBREVIATIONS, AUXILIARIES, INTERROGATIVES, LIST_MARKER, PLURAL_ES, TERM, TERM_STOPWORDS
from loomwork.jobs.oracle import _answer

_BASE = """
unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), norm AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM unit),
pair AS (SELECT q.vec_id AS question_id, q.label AS ql, x.label AS xl, x.vec_id AS passage_id, round(list_dot_product(q.v, x.v) / (q.n * x.n), 6) AS score FROM norm q, norm x WHERE q.vec_id % 50 = 0),
rankings AS (
  SELECT question_id, 'all' AS method, passage_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS INT) AS rank, score FROM pair QUALIFY rank <= 10
  UNION ALL SELECT question_id, 'scoped', passage_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, passage_id) AS INT) AS rank, score FROM pair WHERE ql = xl QUALIFY rank <= 10),
questions AS (SELECT vec_id AS question_id, label FROM embeddings WHERE vec_id % 50 = 0),
judgments AS (SELECT DISTINCT question_id, passage_id, CASE WHEN q.label = p.label AND passage_id <> question_id THEN 1 ELSE 0 END AS grade
  FROM rankings JOIN questions q USING (question_id) JOIN embeddings p ON p.vec_id = passage_id WHERE passage_id % 3 <> 1),
gold AS (SELECT question_id, passage_id FROM judgments WHERE grade > 0),
labels_ AS (SELECT question_id, CASE WHEN question_id % 450 = 0 THEN 'unmapped' ELSE 'mapped' END AS status, question_id % 100 = 0 AS complete FROM questions WHERE question_id % 350 <> 0),
retrieved AS (SELECT question_id, 1 AS round, passage_id FROM rankings WHERE method = 'all' AND rank <= 5
  UNION ALL SELECT question_id, 2, passage_id FROM rankings WHERE method = 'scoped' AND rank <= 7 AND question_id % 100 = 0)"""
_EVALUATED = """
seen AS (SELECT r.question_id, r.method, r.rank, j.grade, count(j.grade) OVER (PARTITION BY r.question_id, r.method ORDER BY r.rank) AS place FROM rankings r LEFT JOIN judgments j USING (question_id, passage_id)),
cells AS (SELECT question_id, complete, method, k FROM labels_, (SELECT DISTINCT method FROM rankings), (VALUES (1), (5), (10)) t(k) WHERE status = 'mapped'),
got AS (SELECT c.question_id, c.method, k, complete, count(*) FILTER (rank <= k) AS returned, count(grade) FILTER (rank <= k) AS known, count(*) FILTER (rank <= k AND grade > 0) AS hits,
  min(rank) FILTER (rank <= k AND grade > 0) AS first, count(*) FILTER (grade > 0 AND place <= k) AS jh, min(place) FILTER (grade > 0 AND place <= k) AS jf,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k AND grade > 0), 0) AS dcg, coalesce(sum(1 / log2(place + 1)) FILTER (grade > 0 AND place <= k), 0) AS jdcg FROM cells c LEFT JOIN seen USING (question_id, method) GROUP BY ALL),
need AS (SELECT question_id, count(*) AS relevant FROM gold GROUP BY 1),
evaluated AS (SELECT question_id, method, k, returned,
  CASE WHEN returned = 0 THEN 'no_passages' WHEN NOT full_ THEN 'unjudged_top_k' WHEN relevant = 0 THEN 'no_relevant_judgments' WHEN hits = 0 THEN 'no_known_positive_at_k' ELSE 'known_positive_hit' END AS category,
  round(CASE WHEN returned > 0 THEN known / returned ELSE 1 END, 6) AS coverage, round(CASE WHEN full_ THEN hits / k END, 6) AS precision,
  round(CASE WHEN full_ AND complete AND relevant > 0 THEN hits / relevant END, 6) AS recall, round(CASE WHEN full_ AND NOT complete AND relevant > 0 THEN hits / relevant END, 6) AS pool_recall,
  round(CASE WHEN full_ THEN coalesce(1 / first, 0) END, 6) AS mrr, round(jh / k, 6) AS judged_precision, round(coalesce(1 / jf, 0), 6) AS judged_mrr, relevant - hits AS missing,
  round(CASE WHEN full_ AND complete AND relevant > 0 THEN dcg / best END, 6) AS ndcg, round(CASE WHEN full_ AND NOT complete AND relevant > 0 THEN dcg / best END, 6) AS pool_ndcg,
  round(CASE WHEN relevant > 0 THEN jh / relevant END, 6) AS judged_recall, round(CASE WHEN relevant > 0 THEN jdcg / best END, 6) AS judged_ndcg
  FROM (SELECT *, complete OR known = returned AS full_, list_sum(list_transform(range(1, greatest(1, least(k, relevant)) + 1), lambda i: 1 / log2(i + 1))) AS best FROM (SELECT got.*, coalesce(need.relevant, 0) AS relevant FROM got LEFT JOIN need USING (question_id))))"""
_FIGURES = ["precision", "recall", "pool_recall", "mrr", "ndcg", "pool_ndcg", "judged_precision", "judged_recall", "judged_mrr", "judged_ndcg"]
_ROUNDS = """
found AS (SELECT question_id, passage_id, min(round) AS round FROM retrieved GROUP BY ALL),
added AS (SELECT f.question_id, f.round, count(*) AS new, count(g.passage_id) AS new_gold FROM found f LEFT JOIN gold g USING (question_id, passage_id) GROUP BY ALL),
by_round AS (SELECT r.question_id, r.round, coalesce(new, 0) AS new, coalesce(new_gold, 0) AS new_gold, CAST(sum(coalesce(new, 0)) OVER w AS BIGINT) AS seen, CAST(sum(coalesce(new_gold, 0)) OVER w AS BIGINT) AS matched, coalesce(gold, 0) AS gold
  FROM (SELECT DISTINCT question_id, round FROM retrieved) r LEFT JOIN added USING (question_id, round) LEFT JOIN (SELECT question_id, count(*) AS gold FROM gold GROUP BY 1) USING (question_id)
  WINDOW w AS (PARTITION BY r.question_id ORDER BY r.round))"""
_DUMP = """
dump AS (SELECT question_id AS request_id, rank AS position, passage_id AS p, question_id % 150 AS shape, score AS s FROM rankings WHERE method = 'all'),
dumped AS (SELECT * FROM dump UNION ALL SELECT request_id, 11, p, shape, s FROM dump WHERE position = 2),
flat AS (SELECT request_id, position, trim(CASE WHEN p % 13 = 5 THEN ' ' ELSE p::VARCHAR END) AS passage_id, CASE WHEN shape <> 0 AND p % 17 = 4 THEN ' ' ELSE 'text ' || p END AS text,
  CASE WHEN shape = 50 AND (CASE WHEN position = 11 THEN 2 ELSE position END) <= 6 THEN -s END AS reranker, CASE WHEN shape <= 50 THEN 1 / (60 + (CASE WHEN position = 11 THEN 2 ELSE position END)) END AS fusion, CASE WHEN shape = 100 THEN s END AS native FROM dumped),
classed0 AS (SELECT request_id, position, passage_id, text, coalesce(reranker, fusion, native) AS score, CASE WHEN reranker IS NOT NULL THEN 'reranker' WHEN fusion IS NOT NULL THEN 'fusion' WHEN native IS NOT NULL THEN 'native' ELSE 'unscored' END AS source,
  CASE WHEN trim(text) = '' THEN 'no_text' WHEN passage_id = '' THEN 'no_id' END AS fault FROM flat),
classed AS (SELECT * REPLACE (CASE WHEN fault IS NULL AND row_number() OVER (PARTITION BY request_id, passage_id, fault IS NULL ORDER BY position) > 1 THEN 'duplicate' ELSE fault END AS fault) FROM classed0),
kinds AS (SELECT request_id, count(DISTINCT source) FILTER (source <> 'unscored') AS kinds FROM classed GROUP BY 1)"""
_QA = f"""
both_ AS (SELECT a.conv_id, a.turn, a.text AS question, b.text, a.conv_id || '-' || a.turn AS question_id FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'),
notes AS (
  SELECT question_id, length(text) % 5 = 0 AS un, CASE WHEN length(text) % 7 = 0 THEN CASE WHEN length(text) % 2 = 0 THEN 'yes' ELSE 'no' END WHEN length(text) % 3 = 0 AND question <> '' THEN question ELSE text END AS ref FROM both_ WHERE text IS NOT NULL AND conv_id % 10 <> 7
  UNION ALL SELECT question_id, conv_id % 4 = 0, lower(CASE WHEN conv_id % 9 <> 2 THEN text ELSE 'the' END) FROM both_ WHERE text IS NOT NULL AND conv_id % 10 <> 7),
refs AS (SELECT question_id, bool_and(un) AS unanswerable, NOT bool_or(NOT un AND len({_answer("ref")}) = 0) AS valid FROM notes GROUP BY 1),
said AS (SELECT question_id, coalesce(text, question) AS said, CASE WHEN conv_id % 11 = 3 THEN 'error' WHEN conv_id % 6 = 1 THEN 'refused' ELSE 'answered' END AS how FROM both_ WHERE conv_id % 12 <> 5),
pairs AS (SELECT question_id, {_answer("said")} AS p, {_answer("ref")} AS r FROM said JOIN notes USING (question_id) WHERE how = 'answered' AND NOT un),
scored AS (SELECT question_id, max((p = r)::INT::DOUBLE) AS em,
  max(CASE WHEN len(p) + len(r) = 0 THEN 1 ELSE 2 * coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(r, lambda x: x = t))))), 0) / (len(p) + len(r)) END) AS f1 FROM pairs GROUP BY 1),
qa AS (SELECT question_id, CASE WHEN valid IS NULL THEN 'missing_reference' WHEN NOT valid THEN 'invalid_reference' ELSE coalesce(how, 'missing_prediction') END AS status,
  round(CASE WHEN valid AND NOT unanswerable THEN coalesce(em, 0) END, 6) AS em, round(CASE WHEN valid AND NOT unanswerable THEN coalesce(f1, 0) END, 6) AS f1,
  CASE WHEN valid AND unanswerable THEN (coalesce(how, '') = 'refused')::INT::DOUBLE END AS unanswerable_correct
  FROM both_ LEFT JOIN refs USING (question_id) LEFT JOIN said USING (question_id) LEFT JOIN scored USING (question_id)),
qa_rows AS (SELECT *, coalesce(unanswerable_correct, f1) AS task_score FROM qa)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sentences(x: str) -> str:
    dots = "|".join(a[:-1].replace(".", r"\.") for a in ABBREVIATIONS)
    masked = f"regexp_replace({x}, {_quoted(rf'(?i)(^|[^\p{{L}}\p{{N}}_])({dots})\.')}, '\\1\\2' || chr(1), 'g')"
    lines = f"list_transform(string_split_regex({masked}, '\\r\\n|\\r|\\n'), lambda l: trim(regexp_replace(l, {_quoted(LIST_MARKER)}, ''), ' '))"
    ended = f"flatten(list_transform({lines}, lambda l: string_split(regexp_replace(l, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2))))"
    return f"list_filter(list_transform({ended}, lambda s: trim(replace(s, chr(1), '.'), ' ')), lambda s: s <> '')"


def _terms(x: str) -> str:
    plain = f"lower(trim(regexp_replace(translate({x}, '‘’‚“”„‐‑‒–—−', '''''''\"\"\"------'), '\\s+', ' ', 'g'), ' '))"
    stop = ", ".join(_quoted(w) for w in TERM_STOPWORDS)
    folded = f"CASE WHEN length(w) <= 4 THEN w WHEN regexp_matches(w, {_quoted(PLURAL_ES)}) THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"
    return f"list_distinct(list_transform(list_filter(regexp_extract_all({plain}, {_quoted(TERM)}), lambda w: length(w) >= 3 AND w NOT IN ({stop})), lambda w: {folded}))"


_MEANS = ", ".join(f"round(avg({n}), 6) AS {n}, count({n}) AS {n}_n" for n in _FIGURES)
_TALL = " UNION ALL ".join(f"SELECT question_id, method, k, '{n}' AS metric, {n} AS value FROM evaluated" for n in _FIGURES)
_ASKS = f"(?i)^(?:{'|'.join(INTERROGATIVES)})\\b|\\b(?:{'|'.join(AUXILIARIES)})\\b"

ORACLE_SQL: dict[str, str] = {
    "labelled_evaluation": f"WITH {_BASE}, {_EVALUATED} SELECT * FROM evaluated",
    "labelled_means": f"WITH {_BASE}, {_EVALUATED} SELECT method, k, count(*) AS questions, {_MEANS} FROM evaluated GROUP BY ALL",
    "paired_contributions": f"""WITH {_BASE}, {_EVALUATED}, tall AS ({_TALL})
SELECT k, metric, round(avg(b.value - a.value), 6) AS mean_delta, count(*) AS paired_questions FROM tall a JOIN tall b USING (question_id, k, metric) WHERE a.method = 'all' AND b.method = 'scoped' AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL""",
    "label_exclusions": f"""WITH {_BASE} SELECT question_id, CASE WHEN status IS NULL THEN 'missing_labels' ELSE 'unmapped_labels' END AS reason FROM questions LEFT JOIN labels_ USING (question_id) WHERE status IS NULL OR status <> 'mapped'""",
    "evidence_recall": f"""WITH {_BASE}, done AS (SELECT question_id, question_id % 250 = 0 AS failed FROM questions WHERE question_id % 550 <> 0),
found AS (SELECT question_id, passage_id, min(round) AS round FROM retrieved WHERE question_id IN (SELECT question_id FROM done WHERE NOT failed) GROUP BY ALL),
own AS (SELECT * FROM gold WHERE question_id % 350 <> 0),
sums AS (SELECT f.question_id, count(*) AS retrieved, count(o.passage_id) AS matched, count(o.passage_id) FILTER (round = 1) AS first FROM found f LEFT JOIN own o USING (question_id, passage_id) GROUP BY 1),
rounds AS (SELECT question_id, max(round) AS rounds FROM retrieved WHERE question_id IN (SELECT question_id FROM done WHERE NOT failed) GROUP BY 1),
need AS (SELECT question_id, count(*) AS gold FROM own GROUP BY 1),
full_ AS (SELECT q.question_id, q.question_id % 350 <> 0 AS mapped, failed, coalesce(gold, 0) AS gold, coalesce(retrieved, 0) AS retrieved, coalesce(matched, 0) AS matched, coalesce(first, 0) AS first, coalesce(rounds, 0) AS rounds
  FROM questions q LEFT JOIN done USING (question_id) LEFT JOIN need USING (question_id) LEFT JOIN sums USING (question_id) LEFT JOIN rounds USING (question_id)),
named AS (SELECT *, CASE WHEN NOT mapped THEN 'missing_mapping' WHEN gold = 0 THEN 'empty_mapping' WHEN failed IS NULL THEN 'missing_prediction' WHEN failed THEN 'retrieval_error' ELSE 'ok' END AS status FROM full_)
SELECT question_id, status, gold, retrieved, matched, rounds, round(CASE WHEN gold > 0 THEN matched / gold END, 6) AS recall, round(CASE WHEN status = 'ok' THEN matched / gold END, 6) AS successful_recall, round(CASE WHEN gold > 0 THEN first / gold END, 6) AS first_round_recall FROM named""",
    "recall_by_round": f"WITH {_BASE}, {_ROUNDS} SELECT * FROM by_round",
    "retry_figures": f"""WITH {_BASE}, {_ROUNDS}, ends AS (SELECT question_id, max(round) AS rounds, max(gold) AS gold, arg_min(matched, round) AS a, arg_max(matched, round) AS z, max(seen) AS seen FROM by_round GROUP BY 1)
SELECT * FROM (SELECT count(*) AS questions, round(avg(rounds), 6) AS mean_rounds, round(avg(seen), 6) AS mean_passages, count(*) FILTER (gold > 0) AS with_gold, round(avg(a / gold) FILTER (gold > 0), 6) AS recall_before, round(avg(z / gold) FILTER (gold > 0), 6) AS recall_after,
  round(count(*) FILTER (gold > 0 AND a < gold AND z = gold) / nullif(count(*) FILTER (gold > 0 AND a < gold), 0), 6) AS recovery_rate FROM ends),
(SELECT count(*) FILTER (round > 1) AS retries, round(count(*) FILTER (round > 1 AND gold > 0 AND matched - new_gold = gold) / nullif(count(*) FILTER (round > 1 AND gold > 0), 0), 6) AS unnecessary,
  round(count(*) FILTER (round > 1 AND gold > 0 AND new_gold = 0) / nullif(count(*) FILTER (round > 1 AND gold > 0), 0), 6) AS ineffective, round(count(*) FILTER (round > 1 AND new = 0) / nullif(count(*) FILTER (round > 1), 0), 6) AS redundant FROM by_round)""",
    "budget_recall": f"""WITH {_BASE}, budgets AS (SELECT question_id, count(DISTINCT passage_id) AS budget FROM retrieved GROUP BY 1), need AS (SELECT question_id, count(*) AS gold FROM gold GROUP BY 1),
hits AS (SELECT r.question_id, method, count(*) AS hits FROM rankings r JOIN gold USING (question_id, passage_id) JOIN budgets USING (question_id) WHERE rank <= budget GROUP BY ALL)
SELECT method, count(*) AS questions, round(avg(coalesce(hits, 0) / gold), 6) AS recall, round(avg(budget), 6) AS mean_budget FROM (SELECT * FROM need JOIN budgets USING (question_id), (SELECT DISTINCT method FROM rankings)) LEFT JOIN hits USING (question_id, method) GROUP BY 1""",
    "critic_audit": f"""WITH {_BASE}, need AS (SELECT question_id, count(*) AS gold, count(*) FILTER (EXISTS (SELECT 1 FROM rankings r WHERE r.question_id = g.question_id AND r.passage_id = g.passage_id AND rank <= 6)) AS shown,
  count(*) FILTER (EXISTS (SELECT 1 FROM rankings r WHERE r.question_id = g.question_id AND r.passage_id = g.passage_id AND method = 'scoped')) AS had FROM gold g GROUP BY 1)
SELECT question_id % 150 <> 0 AS sufficient, count(*) FILTER (shown = gold) AS complete, count(*) FILTER (shown <> gold AND had = gold) AS hidden, count(*) FILTER (shown <> gold AND had <> gold) AS missing FROM need GROUP BY 1""",
    "ranking_faults": f"""WITH {_BASE}, e AS (SELECT *, row_number() OVER w AS place, lag(score) OVER w AS before FROM rankings WHERE passage_id % 11 <> 3 WINDOW w AS (PARTITION BY question_id, method ORDER BY rank)),
per AS (SELECT method, question_id, count(*) FILTER (place <> rank) AS gaps, count(*) FILTER (score > before) AS rises, count(*) - count(DISTINCT passage_id) AS doubles FROM e GROUP BY ALL)
SELECT method, count(*) AS questions, count(*) FILTER (gaps > 0) AS gaps, count(*) FILTER (rises > 0) AS rises, count(*) FILTER (doubles > 0) AS doubles FROM per GROUP BY 1""",
    "return_counts": f"""WITH {_BASE}, part_ AS (SELECT * FROM rankings WHERE passage_id % 11 <> 3), per AS (SELECT q.question_id, m.method, count(s.passage_id) AS returned FROM questions q CROSS JOIN (SELECT DISTINCT method FROM part_) m LEFT JOIN part_ s ON s.question_id = q.question_id AND s.method = m.method GROUP BY ALL)
SELECT method, returned, count(*) AS questions, CAST(sum(greatest(10 - returned, 0)) AS BIGINT) AS empty_places FROM per GROUP BY ALL""",
    "ablation_grid": f"""WITH {_BASE}, fused AS (SELECT depth, constant, question_id, passage_id, sum(1 / (constant + rank)) AS s FROM rankings, (VALUES (3), (5), (10)) d(depth), (VALUES (10), (60)) c(constant) WHERE rank <= depth GROUP BY ALL),
top AS (SELECT f.*, g.passage_id IS NOT NULL AS hit FROM (SELECT *, row_number() OVER (PARTITION BY depth, constant, question_id ORDER BY round(s, 9) DESC, passage_id) AS place FROM fused QUALIFY place <= 5) f LEFT JOIN gold g USING (question_id, passage_id)),
per AS (SELECT depth, constant, question_id, count(*) FILTER (hit) / 5 AS p, coalesce(1 / min(place) FILTER (hit), 0) AS r FROM top GROUP BY ALL)
SELECT depth, constant, count(*) AS questions, round(avg(p), 6) AS precision, round(avg(r), 6) AS mrr FROM per GROUP BY ALL""",
    "arm_flips": f"""WITH {_BASE}, seen AS (SELECT r.question_id, method, list(r.passage_id) AS context, coalesce(list(r.passage_id) FILTER (g.passage_id IS NOT NULL), []) AS cited FROM rankings r LEFT JOIN gold g USING (question_id, passage_id) WHERE rank <= 5 GROUP BY ALL),
arms AS (SELECT question_id, method, context, cited, CASE WHEN len(cited) <= (CASE WHEN method = 'all' THEN 2 ELSE 0 END) THEN 'refused' ELSE 'answered' END AS outcome FROM seen),
flips AS (SELECT a.question_id, a.outcome AS outcome_before, b.outcome AS outcome_after, a.cited AS ca, b.cited AS cb, a.context AS xa, b.context AS xb, len(list_filter(a.cited, lambda c: NOT list_contains(b.context, c))) AS dropped
  FROM arms a JOIN arms b USING (question_id) WHERE a.method = 'all' AND b.method = 'scoped' AND a.outcome <> b.outcome)
SELECT question_id, outcome_before, outcome_after, CASE WHEN outcome_after = 'answered' THEN CASE WHEN len(list_filter(cb, lambda c: NOT list_contains(xa, c))) > 0 THEN 'new_evidence' ELSE 'same_evidence' END
  WHEN len(ca) = 0 THEN 'same_evidence' WHEN dropped = len(ca) THEN 'evidence_dropped' WHEN dropped > 0 THEN 'evidence_partly_dropped' ELSE 'same_evidence' END AS why,
  round(len(list_intersect(xa, xb)) / len(list_distinct(xa || xb)), 6) AS jaccard FROM flips""",
    "final_labels": """SELECT doc_id AS key, CAST(CASE WHEN quality <> 1 - toxic AND doc_id % 2 = 0 THEN 1 - toxic WHEN quality = 1 - toxic THEN quality END AS VARCHAR) AS label,
CASE WHEN quality <> 1 - toxic AND doc_id % 2 = 0 THEN 'decided' WHEN quality = 1 - toxic THEN 'agreed' ELSE 'open' END AS source FROM labels""",
    "adapted_hits": f"""WITH {_BASE}, {_DUMP}, used AS (SELECT c.request_id, position, passage_id, text, source, CASE WHEN kinds <= 1 THEN score END AS score FROM classed c JOIN kinds USING (request_id) WHERE fault IS NULL),
marked AS (SELECT *, count(score) OVER (PARTITION BY request_id) = count(*) OVER (PARTITION BY request_id) AS scored FROM used)
SELECT request_id, passage_id, text, round(score, 6) AS score, source, CAST(row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN scored THEN -score END, position, passage_id) AS INT) AS place FROM marked""",
    "hit_losses": f"""WITH {_BASE}, {_DUMP} SELECT c.request_id, count(*) AS hits, count(*) FILTER (fault = 'no_text') AS no_text, count(*) FILTER (fault = 'no_id') AS no_id, count(*) FILTER (fault = 'duplicate') AS duplicate, any_value(kinds) > 1 AS mixed FROM classed c JOIN kinds USING (request_id) GROUP BY 1""",
    "dump_profile": f"""WITH {_BASE}, {_DUMP}, per AS (SELECT request_id, CASE WHEN count(DISTINCT source) FILTER (source <> 'unscored') = 0 THEN 'unscored' WHEN count(DISTINCT source) FILTER (source <> 'unscored') > 1 THEN 'mixed' ELSE min(source) FILTER (source <> 'unscored') END AS kind, count(*) AS hits FROM classed GROUP BY 1)
SELECT kind, count(*) AS requests, CAST(sum(hits) AS BIGINT) AS hits FROM per GROUP BY 1""",
    "qa_scores": f"WITH {_QA} SELECT * FROM qa_rows",
    "qa_summary": f"""WITH {_QA} SELECT count(*) AS questions, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(unanswerable_correct), 6) AS unanswerable_correct, round(avg(task_score), 6) AS task_score,
count(em) AS em_n, count(f1) AS f1_n, count(unanswerable_correct) AS unanswerable_correct_n, count(task_score) AS task_score_n, count(*) FILTER (status = 'answered') AS answered, count(*) FILTER (status = 'refused') AS refused,
count(*) FILTER (status IN ('error', 'missing_prediction')) AS failures, count(*) FILTER (status IN ('missing_reference', 'invalid_reference')) AS reference_exclusions, round(count(*) FILTER (status = 'answered') / count(*), 6) AS answer_coverage,
round(avg(f1) FILTER (status = 'answered'), 6) AS answered_only_f1 FROM qa_rows""",
    "split_sentences": f"SELECT doc_id, CAST(len(s) AS INT) AS sentences, sha256(coalesce(array_to_string(s, chr(10)), '')) AS sha256 FROM (SELECT doc_id, {_sentences('coalesce(text, chr(32))')} AS s FROM documents)",
    "content_terms": f"SELECT doc_id, CAST(len(t) AS INT) AS terms, sha256(coalesce(array_to_string(list_sort(t), ' '), '')) AS sha256 FROM (SELECT doc_id, {_terms('coalesce(text, chr(32))')} AS t FROM documents)",
    "question_clauses": f"""WITH parts AS (SELECT conv_id, turn, list_transform(string_split_regex(b, '(?i)\\s*(?:;|,\\s*and\\s+|\\s+and\\s+)\\s*'), lambda p: trim(p, ' ')) AS p FROM (SELECT conv_id, turn, trim(regexp_replace(trim(coalesce(text, ''), ' '), '[?.]+$', ''), ' ') AS b FROM conversations WHERE role = 'user') WHERE b <> ''),
kept AS (SELECT conv_id, turn, list_filter(list_concat(p[1:1], list_filter(p[2:], lambda x: regexp_matches(x, {_quoted(_ASKS)}))), lambda x: x <> '') AS c FROM parts)
SELECT conv_id, turn, CAST(generate_subscripts(c, 1) - 1 AS INT) AS place, unnest(c) AS clause FROM kept""",
    "rendered_passages": """WITH r AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, CASE WHEN doc_id % 4 <> 1 THEN array_to_string(list_slice(string_split(coalesce(text, ''), ' '), 1, 6), ' ') END AS title, CASE WHEN doc_id % 3 = 0 THEN n_chars / 8.0 END AS score FROM documents),
s AS (SELECT doc_id, concat_ws(chr(10) || '    ', nullif(concat_ws(' | ', CASE WHEN source <> '' THEN 'paper: ' || source END, CASE WHEN lang <> '' THEN 'section: ' || lang END, CASE WHEN score IS NOT NULL THEN 'score: ' || printf('%.3f', score) END), ''),
  CASE WHEN title <> '' THEN 'title: ' || title END, 'text: ' || CASE WHEN length(t) <= 400 THEN t ELSE regexp_replace(substr(t, 1, 394), '\\s+$', '') || ' [...]' END) AS t FROM r)
SELECT doc_id, CAST(length(t) AS INT) AS n_chars, sha256(t) AS sha256 FROM s""",
    "paragraph_ranges": """WITH l AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: length(x)) AS n FROM documents)
SELECT doc_id, CAST(len(n) AS INT) AS paragraphs, CAST(list_sum(n) + 2 * len(n) - 2 - n[-1] AS BIGINT) AS last_start, CAST(list_sum(n) + 2 * len(n) - 2 AS BIGINT) AS last_end FROM l WHERE len(n) > 0""",
    "normalisation_report": r"""SELECT count(*) AS documents, CAST(sum(length(t)) AS BIGINT) AS characters, count(*) FILTER (trim(t, ' ') = '') AS empty, count(*) FILTER (contains(t, chr(13))) AS carriage_returns, count(*) FILTER (t <> trim(t, ' ')) AS outer_space,
count(*) FILTER (regexp_matches(t, '\n[ \t]*\n')) AS blank_lines, count(*) FILTER (contains(t, '  ')) AS double_spaces, count(*) FILTER (contains(t, chr(9))) AS tabs, count(*) FILTER (strlen(t) > length(t)) AS non_ascii, count(*) FILTER (length(t) <> coalesce(n_chars, -1)) AS count_differs
FROM (SELECT coalesce(text, '') AS t, n_chars FROM documents)""",
    "label_orphans": """WITH r AS (SELECT doc_id, count(*) AS n FROM labels WHERE doc_id % 5 <> 0 OR doc_id IS NULL GROUP BY 1), p AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 7 <> 1)
SELECT CAST((SELECT coalesce(sum(n), 0) FROM r WHERE doc_id IS NULL) AS BIGINT) AS without_key, (SELECT count(*) FROM r WHERE doc_id IS NOT NULL AND doc_id NOT IN (FROM p)) AS orphan_keys,
CAST((SELECT coalesce(sum(n), 0) FROM r WHERE doc_id IS NOT NULL AND doc_id NOT IN (FROM p)) AS BIGINT) AS orphan_rows, (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE doc_id IS NOT NULL)) AS unused_parents""",
}
