"""The agent loop over the standard tables, over the whole corpus and within papers and their sections, and its SQL twins.

A source stands for a paper and its documents for the sections, under six names in turn; questions
of the scoped loop have a cue put before the benchmark text, so that each kind of gap occurs. Item
ids modulo 24 name the paper, so some questions are of papers that hold nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.jobs import oracle
from loomwork.scratch import kept
from loomwork.jobs.tables import chunks as _chunks
from loomwork.jobs.tables import questions as _questions
from loomwork.operators import agent, retrieval

K, PAPERS = 5, 24
SECTIONS = ("Introduction", "Our Approach", "Experiments ::: Setup", "Experiments ::: Results", "Related Work", "Conclusion")
CUES = ("", "what method is proposed:", "what accuracy is reported on which dataset:", "how does it compare with others:")


def adaptive_loop(spark, d):
    chunks, keep = _chunks(spark, d), kept(spark)
    weights = keep(retrieval.term_weights(chunks), "weights")

    def retrieve(queries: DataFrame) -> DataFrame:
        top = retrieval.ranked(retrieval.best_bm25(chunks, queries.withColumnRenamed("query", "question"), K, weights=weights), K)
        return top.join(chunks.select("passage_id", "section", "text"), "passage_id").select("question_id", "passage_id", "rank", "text", "section")

    log = agent.run_loop(_questions(spark, d), retrieve, keep=keep)
    return log.select("question_id", "round", "query", "retrieved", "sufficient", "gap", "stop_reason")


def sectioned(spark, d):
    """Passages with their source, in sections."""
    name = F.element_at(F.array(*(F.lit(s) for s in SECTIONS)), (F.pmod("doc_id", F.lit(len(SECTIONS))) + 1).cast("int"))
    return _chunks(spark, d).where("doc_id is not null").withColumn("section", name)


def cued(questions):
    """Questions with a cue before their text."""
    cue = F.element_at(F.array(*(F.lit(c) for c in CUES)), (F.col("question_id") % len(CUES) + 1).cast("int"))
    return questions.withColumn("question", F.trim(F.concat_ws(" ", cue, F.col("question"))))


def sectioned_loop(spark, d):
    """Retries go to the section that fits the gap; a question without any passage ends for lack of information."""
    keep = kept(spark)
    chunks = sectioned(spark, d)
    questions = cued(_questions(spark, d, F.concat(F.lit("src"), (F.col("item_id") % PAPERS).cast("string"))))
    weights = keep(retrieval.term_weights(chunks, F.col("source"), questions), "weights")

    def retrieve(queries: DataFrame) -> DataFrame:
        scores = retrieval.best_bm25(chunks, queries.withColumnRenamed("query", "question"), K, F.col("source"), weights, by="section")
        return agent.scoped_hits(scores, chunks, queries, K)

    def judge(hits: DataFrame, needs: DataFrame) -> DataFrame:
        said = agent.judged_by_rules(hits, needs).join(hits.select("question_id").distinct().withColumn("any", F.lit(True)), "question_id", "left")
        return said.select("question_id", "sufficient", F.when(F.col("any").isNull(), agent.NO_INFORMATION).otherwise(F.col("gap")).alias("gap"))

    log = agent.run_loop(questions, retrieve, keep=keep, sections=keep(agent.sections_of(chunks, F.col("source")), "sections"), judge=judge)
    return log.select("question_id", "round", F.sha2("query", 256).alias("query_sha256"), "triggered_by", "section", "fallback", "retrieved", "sufficient", "gap", "stop_reason")


QUERY_FUNCTIONS = (adaptive_loop, sectioned_loop)


def _key_terms(x: str) -> str:
    found = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9\\-]*'), lambda w: length(w) >= 3 AND w NOT IN ({oracle._STOP}))"
    return f"list_filter({found}, lambda w, i: list_position({found}, w) = i)"


def _round(r: int, last: bool, sectioned: bool) -> str:
    """The CTEs of one round: hits, pool, verdicts and log of ``state_r``, and the state of the next."""
    end = "'max_rounds'" if last else "NULL"
    before = f"SELECT question_id, passage_id, round, rank FROM pool{r - 1} UNION ALL " if r > 1 else ""
    no_information = "WHEN NOT any_ THEN 'INSUFFICIENT_INFORMATION'" if sectioned else ""
    out = f"""
asked{r} AS MATERIALIZED (
  SELECT question_id, scope, section AS wanted, term, count(*) AS qtf FROM (SELECT question_id, scope, section, unnest({oracle._tokens("query")}) AS term FROM state{r}) GROUP BY ALL
), scored{r} AS MATERIALIZED (
  SELECT question_id, passage_id, c.section IS NOT DISTINCT FROM wanted AND wanted IS NOT NULL AS inside, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked{r} JOIN weight USING (scope, term) JOIN post USING (scope, term) JOIN chunks c USING (passage_id) GROUP BY ALL
), hits{r} AS MATERIALIZED (
  SELECT question_id, passage_id, {r} AS round, {oracle._RANK} AS rank, inside
  FROM (SELECT *, bool_or(inside) OVER (PARTITION BY question_id) AS any_ FROM scored{r}) WHERE inside OR NOT any_ QUALIFY {oracle._RANK} <= {K}
), pool{r} AS MATERIALIZED (
  SELECT question_id, passage_id, round, rank FROM ({before} SELECT question_id, passage_id, round, rank FROM hits{r})
  QUALIFY row_number() OVER (PARTITION BY question_id, passage_id ORDER BY round, rank) = 1
), mine{r} AS MATERIALIZED (
  SELECT question_id, passage_id, round * 1000 + rank AS rank, text, section FROM pool{r} JOIN chunks USING (passage_id) WHERE question_id IN (SELECT question_id FROM state{r})
), met{r} AS (
  SELECT DISTINCT question_id, ordinal, true AS met FROM mine{r} JOIN needs USING (question_id)
  WHERE len(list_filter(coalesce(hints, []), lambda h: contains(lower(section), h))) > 0 OR len(list_filter(words, lambda w: regexp_matches(lower(text), '(^|[^A-Za-z0-9_])' || regexp_escape(w)))) >= needed
), said{r} AS MATERIALIZED (
  SELECT question_id, bool_and(met IS NOT NULL) AS sufficient, CASE {no_information or "WHEN false THEN NULL"} ELSE coalesce(arg_min(gap, ordinal) FILTER (met IS NULL), 'NONE') END AS gap
  FROM (SELECT *, question_id IN (SELECT question_id FROM mine{r}) AS any_ FROM needs) LEFT JOIN met{r} USING (question_id, ordinal) WHERE question_id IN (SELECT question_id FROM state{r}) GROUP BY question_id, any_
), log{r} AS MATERIALIZED (
  SELECT s.*, CAST({r} AS INT) AS round, sufficient, gap, (SELECT count(*) FROM mine{r} m WHERE m.question_id = s.question_id) AS retrieved,
         s.section IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hits{r} h WHERE h.question_id = s.question_id AND h.inside) AS fallback,
         CASE WHEN sufficient THEN 'sufficient' WHEN gap = 'INSUFFICIENT_INFORMATION' THEN 'insufficient_information' ELSE {end} END AS stop_reason
  FROM state{r} s JOIN said{r} USING (question_id)
)"""
    if last:
        return out
    gap_words = "CASE gap " + " ".join(f"WHEN '{g}' THEN '{w}'" for g, w in agent.GAP_WORDS.items()) + " ELSE '' END"
    hints = "CASE gap " + " ".join(f"WHEN '{g}' THEN {oracle._texts(h)}" for g, h in agent.GAP_HINTS.items()) + " ELSE []::VARCHAR[] END"

    def query(extra: int) -> str:
        terms = f"list_slice(terms, 1, {agent.PAPER_TERMS + extra})" if extra else f"CASE WHEN gap IN ('TERMINOLOGY_MISMATCH', 'WEAK_EVIDENCE') THEN list_slice(terms, 1, {agent.PAPER_TERMS}) ELSE []::VARCHAR[] END"
        words = f"list_concat(string_split({gap_words}, ' '), {terms})"
        new = f"list_filter({words}, lambda w, i: w <> '' AND list_position({words}, w) = i AND NOT list_contains(own_low, lower(w)))"
        return f"array_to_string(list_concat(own, list_slice({new}, 1, greatest({agent.QUERY_WORDS} - len(own), {agent.LEAST_ADDED}))), ' ')"

    options = [query(x) for x in range(0, 3 * agent.PAPER_TERMS + 1, agent.PAPER_TERMS)]
    fresh = "CASE " + " ".join(f"WHEN NOT list_contains(used, o{k}) THEN o{k}" for k in range(len(options))) + f" ELSE o{len(options) - 1} END"
    chosen = f"""(SELECT first(x.section ORDER BY h, position) FROM (
    SELECT section, position, list_position(list_transform({hints}, lambda h: contains(lower(sections.section), h)), true) AS h FROM sections WHERE sections.scope = o.scope AND NOT list_contains(o.now, sections.section)) x WHERE h > 0)"""
    return f"""{out}, open{r} AS MATERIALIZED (
  SELECT question_id, scope, question, used, gap, CASE WHEN section IS NULL THEN searched ELSE list_append(searched, section) END AS now,
         string_split_regex(trim(question), '\\s+') AS own, string_split_regex(lower(trim(question)), '\\s+') AS own_low FROM log{r} WHERE stop_reason IS NULL
), seen{r} AS (
  SELECT question_id, rank, unnest(t) AS term, unnest(range(len(t))) AS place FROM (SELECT question_id, rank, {_key_terms("text")} AS t FROM mine{r} WHERE question_id IN (SELECT question_id FROM open{r}))
), term{r} AS (
  SELECT question_id, term, count(*) AS n, min(row(rank, place)) AS seen FROM seen{r} JOIN own USING (question_id)
  WHERE length(term) >= {agent.TERM_LENGTH} AND NOT list_contains(terms, term) AND NOT regexp_full_match(term, '[\\d\\-]+') GROUP BY ALL
), terms{r} AS MATERIALIZED (
  SELECT question_id, list(term ORDER BY n DESC, seen) AS terms FROM term{r} JOIN (SELECT question_id, CASE WHEN count(*) > 1 THEN 2 ELSE 1 END AS floor FROM mine{r} GROUP BY 1) USING (question_id) WHERE n >= floor GROUP BY 1
), options{r} AS MATERIALIZED (
  SELECT *, {", ".join(f"{x} AS o{k}" for k, x in enumerate(options))} FROM (SELECT o.*, coalesce(t.terms, []) AS terms FROM open{r} o LEFT JOIN terms{r} t USING (question_id))
), state{r + 1} AS MATERIALIZED (
  SELECT question_id, scope, question, {fresh} AS query, list_append(used, {fresh}) AS used, gap AS triggered_by, {chosen if sectioned else "NULL::VARCHAR"} AS section, now AS searched FROM options{r} o
)"""


def sectioned_sql() -> str:
    name = f"list_extract({oracle._texts(SECTIONS)}, CAST(doc_id % {len(SECTIONS)} AS INT) + 1)"
    return oracle.CHUNKS.replace("chunks AS (", "chunks0 AS (") + f", chunks AS MATERIALIZED (SELECT c.* REPLACE ({name} AS section), d.source FROM chunks0 c JOIN documents d USING (doc_id))"


def cue_sql() -> str:
    return f"list_extract({oracle._texts(CUES)}, CAST(item_id % {len(CUES)} AS INT) + 1)"


def _loop(sectioned: bool, columns: str) -> str:
    chunks, scope, asked = oracle.CHUNKS, "0", oracle.questions()
    if sectioned:
        chunks, cue = sectioned_sql(), cue_sql()
        scope, asked = "source", oracle.questions(f"'src' || (item_id % {PAPERS})").replace("array_to_string(", f"trim({cue} || ' ' || array_to_string(", 1).replace(" AS question FROM", ") AS question FROM", 1)
    rounds = ",".join(_round(r, r == 3, sectioned) for r in (1, 2, 3))
    return f"""WITH {chunks}, {asked},
tok AS (SELECT {scope} AS scope, passage_id, {oracle._tokens("text")} AS t FROM chunks),
post AS MATERIALIZED (SELECT scope, passage_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT scope, passage_id, t, unnest(t) AS term FROM tok) GROUP BY ALL),
size AS (SELECT scope, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY scope),
df AS (SELECT scope, term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM (SELECT scope, term, count(*) AS df FROM post GROUP BY ALL) JOIN size USING (scope)),
mean AS (SELECT scope, avg(idf0) AS mean_idf FROM df GROUP BY scope),
weight AS MATERIALIZED (SELECT scope, term, avgdl, CASE WHEN idf0 < 0 THEN 0.25 * mean_idf ELSE idf0 END AS idf FROM df JOIN mean USING (scope)),
sections AS MATERIALIZED (SELECT {scope} AS scope, section, min(row(doc_id, chunk_number)) AS position FROM chunks GROUP BY ALL),
queried AS (SELECT question_id, question FROM questions), {oracle._NEEDS},
own AS MATERIALIZED (SELECT question_id, {_key_terms("question")} AS terms FROM questions),
state1 AS MATERIALIZED (SELECT question_id, scope, question, question AS query, [question] AS used, 'NONE' AS triggered_by, NULL::VARCHAR AS section, []::VARCHAR[] AS searched FROM questions),
{rounds}
SELECT {columns} FROM (SELECT * FROM log1 UNION ALL SELECT * FROM log2 UNION ALL SELECT * FROM log3)"""


def oracle_sql() -> dict[str, str]:
    return {
        "adaptive_loop": _loop(False, "question_id, round, query, retrieved, sufficient, gap, stop_reason"),
        "sectioned_loop": _loop(True, "question_id, round, sha256(query) AS query_sha256, triggered_by, section, fallback, retrieved, sufficient, gap, stop_reason"),
    }
