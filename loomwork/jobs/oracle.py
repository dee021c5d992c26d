"""SQL twins of the queries, written for an independent engine."""

from __future__ import annotations

from loomwork.functions.text import STOPWORDS
from loomwork.operators.grounding import REFUSAL
from loomwork.operators.agent import COMPARISON_CUES, CUES, DESCRIPTIVE, REQUIREMENTS, SETUP_CUES

WORD, TOKEN = r"[^\s\p{Z}]+", r"[\p{L}\p{N}_]+"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '{TOKEN}')"


_ID = """'passage-v1-' || sha256('{"coordinate":{"chunk_index":' || chunk_number || ',"paper_id":"' || doc_id || '","section_index":0,"source_kind":"full_text"},"dataset":{"dataset_id":"documents"},"scheme":"passage-v1","transform":{"chunk_overlap_words":40,"chunk_size_words":200}}')"""
CHUNKS = rf"""
norm AS (
  SELECT doc_id, coalesce(lang, '') AS section, regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'),
         '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '{WORD}[\s\p{{Z}}]*') AS w FROM documents
), cut AS (
  SELECT doc_id, section, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 200) / 160.0)) AS BIGINT) + 1)) AS chunk_number FROM norm WHERE len(w) > 0
), part AS (SELECT doc_id, section, CAST(chunk_number AS INT) AS chunk_number, list_slice(w, chunk_number * 160 + 1, chunk_number * 160 + 200) AS b FROM cut),
chunks AS (
  SELECT {_ID} AS passage_id, doc_id, section, chunk_number, regexp_replace(array_to_string(b, ''), '[\s\p{{Z}}]+$', '') AS text, CAST(len(b) AS INT) AS n_words FROM part
)"""


def questions(scope: str = "0") -> str:
    return f"questions AS (SELECT item_id AS question_id, {scope} AS scope, array_to_string(regexp_extract_all(text, '{WORD}'), ' ') AS question FROM benchmark)"


def scores(scope: str = "0") -> str:
    return f"""
tok AS (SELECT {scope} AS scope, passage_id, {_tokens("text")} AS t FROM chunks),
post AS (SELECT scope, passage_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT scope, passage_id, t, unnest(t) AS term FROM tok) GROUP BY ALL),
size AS (SELECT scope, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY scope),
df AS (SELECT scope, term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM (SELECT scope, term, count(*) AS df FROM post GROUP BY ALL) JOIN size USING (scope)),
mean AS (SELECT scope, avg(idf0) AS mean_idf FROM df GROUP BY scope),
qt AS (SELECT question_id, scope, term, count(*) AS qtf FROM (SELECT question_id, scope, unnest({_tokens("question")}) AS term FROM questions) GROUP BY ALL),
asked AS (SELECT question_id, scope, term, qtf, avgdl, CASE WHEN idf0 < 0 THEN 0.25 * mean_idf ELSE idf0 END AS idf FROM qt JOIN df USING (scope, term) JOIN mean USING (scope)),
bm25 AS (
  SELECT question_id, passage_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN asked USING (scope, term) GROUP BY ALL
)"""


_OVERLAP = """
overlap AS (
  SELECT question_id, passage_id, shared / sqrt(terms) AS score
  FROM (SELECT question_id, passage_id, count(*) AS shared FROM post JOIN qt USING (scope, term) GROUP BY ALL)
  JOIN (SELECT passage_id, count(*) AS terms FROM post GROUP BY ALL) USING (passage_id)
)"""
_RANK = "CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, passage_id) AS INT)"
_RANKINGS = f"""
rankings AS (
  SELECT * FROM (SELECT question_id, 'bm25' AS method, passage_id, {_RANK} AS rank, score FROM bm25) WHERE rank <= 10
  UNION ALL SELECT * FROM (SELECT question_id, 'overlap' AS method, passage_id, {_RANK} AS rank, score FROM overlap) WHERE rank <= 10
)"""
_GOLD = f"""
gold AS (
  SELECT item_id AS question_id, passage_id FROM
    (SELECT item_id, array_to_string(regexp_extract_all(text, '{WORD}'), ' ') AS v, len(regexp_extract_all(text, '{WORD}')) AS nv FROM benchmark),
    (SELECT passage_id, array_to_string(regexp_extract_all(text, '{WORD}'), ' ') AS w, n_words FROM chunks)
  WHERE nv >= 5 AND (contains(' ' || w || ' ', ' ' || v || ' ') OR (n_words >= 5 AND contains(' ' || v || ' ', ' ' || w || ' ')))
)"""
_BASE = f"WITH {CHUNKS}, {questions()}, {scores()}, {_OVERLAP}, {_RANKINGS}"
_METRICS = """
need AS (SELECT question_id, count(*) AS relevant FROM gold GROUP BY 1),
got AS (
  SELECT question_id, method, count(g.passage_id) AS hits, min(CASE WHEN g.passage_id IS NOT NULL THEN rank END) AS first, coalesce(sum(CASE WHEN g.passage_id IS NOT NULL THEN 1 / log2(rank + 1) END), 0) AS dcg
  FROM rankings r LEFT JOIN gold g USING (question_id, passage_id) WHERE rank <= 5 GROUP BY ALL
), metrics AS (
  SELECT question_id, method, coalesce(relevant, 0) AS relevant, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / 5, 6) AS precision,
         round(CASE WHEN relevant > 0 THEN coalesce(hits, 0) / relevant END, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr,
         round(CASE WHEN relevant > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(5, relevant) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg
  FROM (SELECT question_id, method FROM questions, (SELECT DISTINCT method FROM rankings)) LEFT JOIN got USING (question_id, method) LEFT JOIN need USING (question_id)
)"""


def _top(scope: str) -> str:
    return f"""
least AS (SELECT * FROM (SELECT {scope} AS scope, passage_id, row_number() OVER (PARTITION BY {scope} ORDER BY passage_id) AS r FROM chunks) WHERE r <= 5),
both_ AS (SELECT question_id, passage_id, max(score) AS score FROM (SELECT * FROM bm25 UNION ALL SELECT question_id, passage_id, 0.0 FROM questions JOIN least USING (scope)) GROUP BY ALL)
SELECT question_id, passage_id, rank, round(score, 6) AS score FROM (SELECT *, {_RANK} AS rank FROM both_) WHERE rank <= 5"""


def _dense(pairs: str) -> str:
    return f"""
WITH unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), norm AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM unit),
pair AS (SELECT q.vec_id AS query_id, x.vec_id, round(list_dot_product(q.v, x.v) / (q.n * x.n), 6) AS score FROM norm q, norm x WHERE {pairs})
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM pair) WHERE rank <= 5"""


_FUSED = """
fused AS (
  SELECT question_id, passage_id, methods, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, passage_id) AS INT) AS rank
  FROM (SELECT question_id, passage_id, sum(1 / (60 + rank)) AS score, count(*) AS methods FROM (SELECT question_id, passage_id, method, min(rank) AS rank FROM rankings GROUP BY ALL) GROUP BY ALL)
)"""
_PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def _answer(x: str) -> str:
    return f"list_filter(string_split_regex(trim(regexp_replace(lower(coalesce({x}, '')), '{_PUNCT}', '', 'g')), '\\s+'), lambda t: t NOT IN ('a', 'an', 'the', ''))"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


ORACLE_SQL: dict[str, str] = {
    "passages": f"""WITH {CHUNKS}
SELECT passage_id, doc_id, section, chunk_number, n_words, sha256(text) AS text_sha256, lag(passage_id) OVER w AS previous_passage_id, lead(passage_id) OVER w AS next_passage_id
FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_number)""",
    "passage_link_faults": f"""WITH {CHUNKS}, links AS (
  SELECT passage_id, lag(passage_id) OVER w AS previous, lead(passage_id) OVER w AS next_passage_id FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_number))
SELECT a.passage_id, a.next_passage_id FROM links a LEFT JOIN links b ON b.passage_id = a.next_passage_id WHERE a.next_passage_id IS NOT NULL AND b.previous IS DISTINCT FROM a.passage_id""",
    "corpus_report": f"""WITH {CHUNKS}, src AS (
  SELECT coalesce(lang, '') AS section, count(*) AS documents, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS BIGINT) AS source_words,
         CAST(sum(CASE WHEN len(regexp_extract_all(coalesce(text, ''), '{WORD}')) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_documents FROM documents GROUP BY 1),
made AS (SELECT section, count(*) AS passages, CAST(sum(n_words) AS BIGINT) AS passage_words, min(n_words) AS least, median(n_words) AS median, max(n_words) AS most FROM chunks GROUP BY 1)
SELECT * FROM src LEFT JOIN made USING (section)""",
    "duplicate_paragraphs": """WITH lines AS (
  SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) WHERE line <> '' GROUP BY ALL),
many AS (SELECT line, count(*) AS docs, sum(n) AS n FROM lines GROUP BY 1 HAVING count(*) > 1)
SELECT 'within' AS kind, count(*) AS groups, CAST(sum(n) AS BIGINT) AS lines, count(DISTINCT doc_id) AS documents FROM lines WHERE n > 1
UNION ALL SELECT 'across', count(*), CAST(sum(n) AS BIGINT), (SELECT count(DISTINCT doc_id) FROM lines WHERE line IN (SELECT line FROM many)) FROM many""",
    "document_anomalies": f"""WITH odd AS (
  SELECT doc_id, 'no_text' AS kind FROM documents WHERE coalesce(text, '') = '' UNION ALL SELECT doc_id, 'one_line' FROM documents WHERE NOT contains(text, chr(10))
  UNION ALL SELECT doc_id, 'count_differs' FROM documents WHERE length(text) <> n_chars UNION ALL SELECT doc_id, 'outer_space' FROM documents WHERE text <> trim(text, ' ')
  UNION ALL SELECT doc_id, 'short' FROM documents WHERE len(regexp_extract_all(text, '{WORD}')) < 20)
SELECT kind, count(*) AS n, array_to_string(list_slice(list_sort(list(doc_id)), 1, 10), ',') AS examples FROM odd GROUP BY kind""",
    "spread_sample": """WITH one AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS total FROM one)
SELECT source, doc_id FROM placed WHERE total <= 8 OR place IN (SELECT CAST(floor(i * (SELECT count(*) FROM one) / 8) AS BIGINT) FROM range(8) t(i))""",
    "term_statistics": f"WITH {CHUNKS}, tok AS (SELECT passage_id, unnest({_tokens('text')}) AS term FROM chunks) SELECT term, count(DISTINCT passage_id) AS df, count(*) AS tf FROM tok GROUP BY 1",
    "bm25_corpus": f"WITH {CHUNKS}, {questions()}, {scores()}, {_top('0')}",
    "bm25_paper": f"WITH {CHUNKS.replace('chunks AS (', 'chunks0 AS (')}, chunks AS (SELECT c.*, d.source FROM chunks0 c JOIN documents d USING (doc_id)), {questions("'src' || (item_id % 20)")}, {scores('source')}, {_top('source')}",
    "bm25_section": f"""WITH {CHUNKS}, {questions()}, {scores()}
SELECT question_id, section, passage_id, rank, round(score, 6) AS score FROM (SELECT question_id, section, passage_id, score, {_RANK.replace('question_id ORDER', 'question_id, section ORDER')} AS rank FROM bm25 JOIN chunks USING (passage_id)) WHERE rank <= 5""",
    "dense_corpus": _dense("q.vec_id % 50 = 0 "),
    "dense_paper": _dense("q.label = x.label"),
    "rrf_fusion": f"{_BASE}, {_FUSED} SELECT * FROM fused WHERE rank <= 5",
    "reranked": f"""{_BASE}, {_FUSED}, pairs AS (SELECT f.question_id, f.passage_id, coalesce(o.score, 0) AS pair_score, f.score FROM fused f LEFT JOIN overlap o USING (question_id, passage_id) WHERE f.rank <= 10)
SELECT question_id, passage_id, rank, round(pair_score, 6) AS pair_score, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(pair_score, 9) DESC, score DESC, passage_id) AS INT) AS rank FROM pairs) WHERE rank <= 5""",
    "gold_passages": f"WITH {CHUNKS}, {_GOLD} SELECT question_id AS item_id, passage_id FROM gold",
    "retrieval_metrics": f"{_BASE}, {_GOLD}, {_METRICS} SELECT * FROM metrics",
    "retrieval_macro": f"""{_BASE}, {_GOLD}, {_METRICS} SELECT method, count(*) AS questions, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg,
count(precision) AS precision_n, count(recall) AS recall_n, count(mrr) AS mrr_n, count(ndcg) AS ndcg_n FROM metrics GROUP BY 1""",
    "candidate_pool": f"""{_BASE}, {_GOLD}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, passage_id ORDER BY rank, method) AS r FROM rankings) WHERE r = 1),
cand AS (SELECT question_id, passage_id, 0 AS rank, '' AS method FROM gold UNION ALL SELECT question_id, passage_id, rank, method FROM first f WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.question_id = f.question_id AND g.passage_id = f.passage_id)),
kept AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank, method, passage_id) AS INT) AS pick FROM cand) WHERE pick <= 10)
SELECT question_id, passage_id, pick, CAST(row_number() OVER (PARTITION BY question_id ORDER BY sha256(question_id || '|' || passage_id)) AS INT) AS shown FROM kept""",
    "judged_coverage": f"""{_BASE}, {_GOLD}, judged AS (SELECT question_id, passage_id, max(grade) AS grade FROM (SELECT *, 1 AS grade FROM gold UNION ALL SELECT question_id, passage_id, 0 FROM rankings WHERE method = 'bm25' AND rank <= 3) GROUP BY ALL),
top AS (SELECT *, CASE WHEN grade IS NOT NULL THEN row_number() OVER (PARTITION BY question_id, method ORDER BY grade IS NULL, rank) END AS place FROM rankings LEFT JOIN judged USING (question_id, passage_id) WHERE rank <= 5)
SELECT question_id, method, count(*) AS returned, count(grade) AS judged, round(count(grade) / count(*), 6) AS of_returned, round(count(grade) / 5, 6) AS of_k, round(coalesce(1 / min(CASE WHEN grade > 0 THEN place END), 0), 6) AS judged_mrr
FROM top GROUP BY ALL""",
    "depth_curve": f"""{_BASE}, {_GOLD}, need AS (SELECT question_id, count(*) AS relevant FROM gold GROUP BY 1),
curve AS (SELECT question_id, m.method, depth, relevant, (SELECT count(*) FROM rankings r JOIN gold g USING (question_id, passage_id) WHERE r.question_id = need.question_id AND r.method = m.method AND r.rank <= depth) AS hits
  FROM need, (SELECT DISTINCT method FROM rankings) m, (SELECT unnest([1, 3, 5, 8, 10]) AS depth))
SELECT method, depth, count(*) AS questions, round(avg(hits / relevant), 6) AS recall, CAST(sum(CASE WHEN hits = relevant THEN 1 ELSE 0 END) AS BIGINT) AS complete FROM curve GROUP BY ALL""",
    "ranking_difference": f"""{_BASE}, side AS (SELECT question_id, method, list(passage_id) AS x, arg_min(passage_id, rank) AS x1 FROM rankings WHERE rank <= 5 GROUP BY ALL)
SELECT count(*) AS questions, CAST(sum(CASE WHEN a.x1 = b.x1 THEN 1 ELSE 0 END) AS BIGINT) AS same_first, round(avg(len(list_intersect(a.x, b.x)) / 5), 6) AS overlap, round(avg(len(list_distinct(list_concat(a.x, b.x)))), 6) AS candidates
FROM side a JOIN side b USING (question_id) WHERE a.method = 'bm25' AND b.method = 'overlap'""",
    "paired_bootstrap": f"""{_BASE}, {_GOLD}, {_METRICS}, deltas AS (SELECT a.question_id % 25 AS paper, b.mrr - a.mrr AS delta FROM metrics a JOIN metrics b USING (question_id) WHERE a.method = 'bm25' AND b.method = 'overlap'),
sums AS (SELECT paper, sum(delta) AS s, count(*) AS c, row_number() OVER (ORDER BY paper) - 1 AS place FROM deltas GROUP BY paper),
draws AS (SELECT replicate, ('0x' || substr(sha256('42|' || replicate || '|' || place), 1, 12))::BIGINT % (SELECT count(*) FROM sums) AS place FROM sums, range(200) t(replicate)),
means AS (SELECT replicate, sum(s) / sum(c) AS m FROM draws JOIN sums USING (place) GROUP BY 1), o AS (SELECT list_sort(list(m)) AS o, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means)
SELECT (SELECT count(*) FROM deltas) AS questions, round((SELECT avg(delta) FROM deltas), 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(o[5], 6) AS nearest_low, round(o[195], 6) AS nearest_high FROM o""",
    "label_agreement": """WITH p AS (SELECT lang, quality AS a, 1 - toxic AS b FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, grouping(lang) AS overall, count(*) AS n, count(*) FILTER (a = 0 AND b = 0) AS n00, count(*) FILTER (a = 0 AND b = 1) AS n01, count(*) FILTER (a = 1 AND b = 0) AS n10, count(*) FILTER (a = 1 AND b = 1) AS n11 FROM p GROUP BY GROUPING SETS ((), (lang))),
e AS (SELECT *, (n00 + n11) / n AS po, (n10 + n11) / n * ((n01 + n11) / n) + (n00 + n01) / n * ((n00 + n10) / n) AS pe FROM c)
SELECT lang, CAST(overall AS TINYINT) AS overall, n, n00, n01, n10, n11, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM e""",
    "answer_scores": f"""WITH t AS (SELECT u.conv_id || '-' || u.turn AS question_id, {_answer("a.text")} AS p, {_answer("u.text")} AS r FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn WHERE u.role = 'user' AND a.role = 'assistant'),
f AS (SELECT question_id, p, r, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))), 0) AS shared FROM t)
SELECT question_id, CAST(array_to_string(p, ' ') = array_to_string(r, ' ') AS INT) AS exact, round(CASE WHEN len(p) + len(r) = 0 THEN 1 ELSE 2 * shared / (len(p) + len(r)) END, 6) AS f1 FROM f""",
    "call_latency": """SELECT event_type, count(*) AS calls, CAST(sum(CASE WHEN user_id % 20 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(max(v), 6) AS most,
round(w, 6) AS wall_seconds, round(CASE WHEN w > 0 THEN count(*) / w END, 6) AS calls_per_second, round(CASE WHEN w > 0 THEN sum(CASE WHEN user_id % 20 <> 0 THEN 1 ELSE 0 END) / w END, 6) AS successes_per_second
FROM (SELECT *, CASE WHEN user_id % 20 <> 0 THEN value END AS v, (epoch_us(max(ts) OVER g) - epoch_us(min(ts) OVER g)) / 1e6 AS w FROM events WINDOW g AS (PARTITION BY event_type)) GROUP BY event_type, w""",
    "usage_cost": """WITH u AS (SELECT event_type AS component, 'm' || (user_id % 3) AS model, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS input_tokens, 7 * count(*) AS output_tokens FROM events GROUP BY ALL)
SELECT component, u.model, calls, input_tokens, output_tokens, round((input_tokens * i + output_tokens * o) / 1e6, 6) AS cost FROM u LEFT JOIN (VALUES ('m0', 2.0::DOUBLE, 6.0::DOUBLE), ('m1', 0.5::DOUBLE, 1.5::DOUBLE)) p(model, i, o) ON u.model = p.model""",
    "split_overlaps": "SELECT sha256(text) AS content, count(DISTINCT source) AS splits, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "arm_coverage": f"""{_BASE}, have AS (SELECT DISTINCT question_id, method FROM rankings WHERE rank = 1), want AS (SELECT question_id, method FROM questions, (SELECT DISTINCT method FROM have))
SELECT method, count(w.question_id) AS expected, count(h.question_id) AS found, count(*) FILTER (h.question_id IS NULL) AS missing, count(*) FILTER (w.question_id IS NULL) AS unknown
FROM want w FULL JOIN have h USING (question_id, method) GROUP BY 1""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
}


def _cue(cues) -> str:
    return f"regexp_matches(lower(question), '(^|[^A-Za-z0-9_])(" + "|".join(cues) + ")($|[^A-Za-z0-9_])')"


def _texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _stem(x: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({x}, '{e}') AND length({x}) - {len(e)} >= 4 THEN {x}[:length({x}) - {len(e)}]" for e in ("ing", "ed", "es", "s")) + f" ELSE {x} END"


_NEEDS = f"""
kind AS (
  SELECT question_id, question, CASE {" ".join(f"WHEN {_cue(c)} THEN '{k}'" for k, c in CUES.items())} ELSE 'factual' END AS kind,
         {_cue([c for c in COMPARISON_CUES if c not in DESCRIPTIVE])} AS named, {_cue(SETUP_CUES)} AS setup,
         list_filter(regexp_extract_all(lower(question), '[a-z0-9][a-z0-9\\-]*'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP})) AS t FROM queried
), base AS (
  SELECT *, CASE kind WHEN 'method' THEN ['method'] WHEN 'result' THEN ['result'] WHEN 'limitation' THEN ['limitation']
         WHEN 'comparison' THEN CASE WHEN named THEN ['result', 'comparison'] ELSE ['comparison'] END ELSE ['direct_answer'] END AS names, list_transform(t, lambda w: {_stem("w")}) AS stems FROM kind
), row_ AS (
  SELECT question_id, unnest(range(0, len(names))) AS ordinal, unnest(names) AS name, list_filter(stems, lambda w, i: list_position(stems, w) = i) AS stems
  FROM (SELECT * REPLACE (CASE WHEN setup THEN list_append(names, 'experiment_context') ELSE names END AS names) FROM base)
), fixed(name, hints, words, needed, gap) AS (VALUES {", ".join(f"('{n}', {_texts(h)}, {_texts(w)}, {m}, '{g}')" for n, (h, w, m, g) in REQUIREMENTS.items())}),
needs AS (
  SELECT question_id, CAST(ordinal AS INT) AS ordinal, row_.name, hints, coalesce(words, stems) AS words, coalesce(needed, least(2, greatest(len(stems), 1))) AS needed, coalesce(gap, 'TERMINOLOGY_MISMATCH') AS gap
  FROM row_ LEFT JOIN fixed USING (name)
)"""
_NUMBER = r"(?:^|[^A-Za-z0-9_.])(\d+(?:,\d{3})*(?:\.\d+)?)"


def _numbers(x: str) -> str:
    plain = r"regexp_replace(regexp_replace(regexp_replace(replace(n, ',', ''), '(\.\d*?)0+$', '\1'), '\.$', ''), '^0+(\d)', '\1')"
    return f"list_transform(regexp_extract_all({x}, '{_NUMBER}', 1), lambda n: {plain})"


_NUMBER_FAULTS = f"""WITH {CHUNKS}, l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents),
a AS (SELECT doc_id AS question_id, l[1] AS question, l[-1] AS answer FROM l WHERE len(l) > 0),
said AS (SELECT DISTINCT question_id, number FROM (SELECT question_id, unnest({_numbers("answer")}) AS number, {_numbers("question")} AS own FROM a) WHERE NOT list_contains(own, number)),
stated AS (SELECT DISTINCT doc_id AS question_id, chunk_number, unnest({_numbers("text")}) AS number FROM chunks),
judged AS (SELECT question_id, number, coalesce(bool_or(chunk_number = 0), false) AS cited, count(chunk_number) AS n FROM said LEFT JOIN stated USING (question_id, number) GROUP BY ALL),
faults AS (SELECT question_id, number, CASE WHEN n > 0 THEN 'NUMBER_FROM_UNCITED_PASSAGE' ELSE 'UNSUPPORTED_NUMBER' END AS code, CASE WHEN n > 0 THEN 'warning' ELSE 'error' END AS severity FROM judged WHERE NOT cited)"""

ORACLE_SQL |= {
    "question_plan": f"""WITH queried AS (SELECT conv_id || '-' || turn AS question_id, text AS question FROM conversations WHERE role = 'user'), {_NEEDS}
SELECT question_id, ordinal, name, array_to_string(words, ',') AS keywords, CAST(needed AS INT) AS needed, gap FROM needs""",
    "evidence_verdicts": f"""WITH {CHUNKS}, {questions()}, {scores()}, queried AS (SELECT question_id, question FROM questions), {_NEEDS},
hits AS (SELECT question_id, section, text FROM (SELECT *, {_RANK} AS rank FROM bm25) JOIN chunks USING (passage_id) WHERE rank <= 5),
met AS (
  SELECT DISTINCT question_id, ordinal, true AS met FROM hits JOIN needs USING (question_id)
  WHERE len(list_filter(coalesce(hints, []), lambda h: contains(lower(section), h))) > 0 OR len(list_filter(words, lambda w: regexp_matches(lower(text), '(^|[^A-Za-z0-9_])' || regexp_escape(w)))) >= needed
)
SELECT question_id, bool_and(met IS NOT NULL) AS sufficient, coalesce(arg_min(gap, ordinal) FILTER (met IS NULL), 'NONE') AS gap FROM needs LEFT JOIN met USING (question_id, ordinal) GROUP BY 1""",
    "number_grounding": f"""{_NUMBER_FAULTS}
SELECT question_id, code, severity, number AS subject FROM faults""",
    "grounded_answers": f"""{_NUMBER_FAULTS}, n AS (SELECT question_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM faults GROUP BY 1)
SELECT question_id, sha256(CASE WHEN errors > 0 THEN '{REFUSAL}' ELSE answer END) AS answer_sha256, CASE WHEN errors > 0 THEN 0 ELSE 1 END AS citations, coalesce(errors, 0) > 0 AS downgraded, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings
FROM a LEFT JOIN n USING (question_id)""",
    "prompt_selection": f"""WITH RECURSIVE {CHUNKS}, {questions()}, {scores()},
top AS (SELECT * FROM (SELECT *, {_RANK} AS rank FROM bm25) WHERE rank <= 12),
held AS (SELECT DISTINCT question_id, passage_id, rank, length(term) % 3 AS c FROM top JOIN post USING (passage_id) JOIN qt USING (question_id, term)),
step AS (
  SELECT question_id, -1 AS c, []::VARCHAR[] AS taken FROM (SELECT DISTINCT question_id FROM held)
  UNION ALL
  SELECT question_id, c + 1, list_concat(taken, coalesce((SELECT [arg_min(p.passage_id, p.rank)] FROM held p WHERE p.question_id = step.question_id AND p.c = step.c + 1 AND NOT list_contains(step.taken, p.passage_id) HAVING count(*) > 0), []))
  FROM step WHERE c < 2
), others AS (SELECT question_id, list(passage_id ORDER BY rank) AS ids FROM (SELECT DISTINCT question_id, passage_id, rank FROM held) GROUP BY 1),
full_ AS (SELECT question_id, list_slice(list_concat(taken, list_filter(ids, lambda x: NOT list_contains(taken, x))), 1, 8) AS ids FROM step JOIN others USING (question_id) WHERE c = 2)
SELECT question_id, CAST(unnest(range(0, len(ids))) AS INT) AS place, unnest(ids) AS passage_id FROM full_""",
}
