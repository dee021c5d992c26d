"""Noisy replies made of the documents, parsed, and the SQL twin.

Every document is an answer in eight dresses by its id: bare, after prose with braces, after reasoning,
after the end of reasoning, fenced, with a lone backslash, cut in half, and after another object under
other names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.jobs.tables import dealt, table
from loomwork.operators import replies

KINDS = 8


def noisy_replies(spark, d):
    """(key, reply) of every document."""
    docs = dealt(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    kind = F.pmod("doc_id", F.lit(KINDS))
    ids = F.array(F.concat(F.lit("p"), F.col("doc_id").cast("string")), F.lit(" p0 "))
    text = F.when(kind == 5, F.concat(F.lit(r"\extnormal "), F.col("text"))).otherwise(F.col("text"))
    plain = F.to_json(F.struct(text.alias("answer"), ids.alias("citations"), F.lit("SUFFICIENT").alias("evidence_status"), F.lit(2).alias("retrieval_rounds")))
    other = F.to_json(F.struct(text.alias("response"), F.lit("p0").alias("references"), F.lit("not enough evidence").alias("status"), F.lit("3").alias("rounds"), F.lit(0.5).alias("confidence")))
    reply = (
        F.when(kind == 1, F.concat(F.lit("Here {as requested}: "), plain, F.lit(" {"))).when(kind == 2, F.concat(F.lit("<think>The \"answer\" is near.</think>\n"), plain))
        .when(kind == 3, F.concat(F.lit("so it is clear.</reasoning>"), plain)).when(kind == 4, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(kind == 5, F.replace(plain, F.lit(r"\\extnormal"), F.lit(r"\extnormal"))).when(kind == 6, F.substring(plain, F.lit(1), F.length(plain) - 1 - F.length("text") % 9))
        .when(kind == 7, F.concat(F.lit('{"note": {"depth": 2}} then '), other)).otherwise(plain)
    )
    return docs.select(F.col("doc_id").cast("string").alias("key"), reply.alias("reply"))


def parsed_answers(spark, d):
    found = replies.answers(noisy_replies(spark, d))
    lists = [F.array_join(c, ",").alias(c) for c in ("citations", "extra", "coerced")]
    return found.select("key", "parsed", "candidate", F.sha2("answer", 256).alias("answer_sha256"), *lists, "evidence_status", "retrieval_rounds", "claims", "thinking", "unclosed", "fence", "repairs", "error")


QUERY_FUNCTIONS = (parsed_answers,)

ORACLE_SQL = {
    "parsed_answers": rf"""WITH k AS (SELECT CAST(doc_id AS VARCHAR) AS key, doc_id % {KINDS} AS kind, CASE WHEN doc_id % {KINDS} = 5 THEN '\extnormal ' ELSE '' END || coalesce(text, '') AS text FROM documents)
SELECT key, kind <> 6 AS parsed, CASE WHEN kind <> 6 THEN CAST(kind IN (1, 7) AS INT) END AS candidate,
       CASE WHEN kind <> 6 THEN sha256(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) END AS answer_sha256,
       CASE WHEN kind = 6 THEN NULL WHEN kind = 7 OR key = '0' THEN 'p0' ELSE 'p' || key || ',p0' END AS citations,
       CASE WHEN kind = 6 THEN NULL WHEN kind = 7 THEN 'confidence' ELSE '' END AS extra,
       CASE WHEN kind = 6 THEN NULL WHEN kind = 7 THEN 'response->answer,references->citations,status->evidence_status,rounds->retrieval_rounds,evidence_status,retrieval_rounds:str->int' ELSE '' END AS coerced,
       CASE WHEN kind = 6 THEN NULL WHEN kind = 7 THEN 'INSUFFICIENT' ELSE 'SUFFICIENT' END AS evidence_status, CASE WHEN kind = 6 THEN NULL WHEN kind = 7 THEN 3 ELSE 2 END::INT AS retrieval_rounds,
       CASE WHEN kind <> 6 THEN 0 END::INT AS claims, kind IN (2, 3) AS thinking, false AS unclosed, kind = 4 OR contains(text, '```') AS fence, CAST(kind = 5 AS INT) AS repairs, CASE WHEN kind = 6 THEN 'no_object' END AS error
FROM k""",
}
