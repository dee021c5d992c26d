"""What a model was shown, rebuilt under a pinned configuration: only for runs whose request is the one that was kept.

Requests: question_id, question, passages (array of passage_id, paper, section, title, score, rank, text) and any further
columns that describe the input. Runs: question_id, status, prompt_version, fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import claims

VERSION = "prompt-1"
CONFIG = {"version", "max_passages", "max_chars", "show_scores"}


def fingerprints(requests: DataFrame) -> DataFrame:
    """(question_id, fingerprint): SHA-256 of a request's canonical JSON.

    Fields are in order of their names; a field that is null or empty is left out, of passages too, so that a column
    added later does not change the fingerprint of requests that do not use it.
    """
    def said(field: T.StructField) -> Column:
        c = F.col(field.name)
        return F.when(F.size(c) > 0, c) if isinstance(field.dataType, T.ArrayType | T.MapType) else c

    fields = [said(f).alias(f.name) for f in sorted(requests.schema.fields, key=lambda f: f.name)]
    return requests.select("question_id", F.sha2(F.to_json(F.struct(*fields)), 256).alias("fingerprint"))


def ordered(passages: Column) -> Column:
    """Passages by score, rank and id where each has a score, else as given."""
    keyed = F.transform(passages, lambda p: F.struct((-p["score"]).alias("s"), F.coalesce(p["rank"], F.lit(0)).alias("r"), p["passage_id"].alias("i"), p.alias("p")))
    return F.when(F.forall(passages, lambda p: p["score"].isNotNull()), F.transform(F.array_sort(keyed), lambda k: k["p"])).otherwise(passages)


def reconstructed(runs: DataFrame, requests: DataFrame, config: dict, review: str) -> tuple[DataFrame, DataFrame]:
    """(contexts, faults) of the answered runs.

    Contexts: question_id, passage_ids and contexts as shown, in order. Faults: question_id and why there is none:
    ``version`` of another prompt, ``no_request``, ``request_differs`` by fingerprint, ``dropped`` passages (without an
    id or a text). A configuration that leaves a field to a default, is of another version or was not reviewed is an error.
    """
    if set(config) != CONFIG:
        raise ValueError(f"the configuration must give each of {', '.join(sorted(CONFIG))}")
    if config["version"] != VERSION or not review.strip():
        raise ValueError("the configuration must be reviewed and of this version")
    answered = runs.where("status = 'answered'").select("question_id", "prompt_version", "fingerprint")
    mine = requests.select("question_id", "passages").join(fingerprints(requests).withColumnRenamed("fingerprint", "_own"), "question_id")
    both = answered.join(mine, "question_id", "left")
    lost = F.exists("passages", lambda p: (F.coalesce(F.trim(p["passage_id"]), F.lit("")) == "") | (F.coalesce(F.trim(p["text"]), F.lit("")) == ""))
    fault = (
        F.when(~F.col("prompt_version").eqNullSafe(F.lit(VERSION)), "version").when(F.col("_own").isNull(), "no_request")
        .when(~F.col("fingerprint").eqNullSafe(F.col("_own")), "request_differs").when(F.coalesce(lost, F.lit(False)), "dropped")
    )
    judged = both.withColumn("fault", fault)
    shown = F.slice(ordered(F.coalesce("passages", F.expr("filter(passages, x -> false)"))), 1, config["max_passages"])

    def text(p: Column, i: Column) -> Column:
        body = claims.rendered(p["paper"], p["section"], p["score"] if config["show_scores"] else F.lit(None).cast("double"), p["title"], p["text"], config["max_chars"])
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] passage_id: "), p["passage_id"], F.lit("\n    "), body)

    sound = judged.where("fault is null").withColumn("shown", shown)
    contexts = sound.select("question_id", F.transform("shown", lambda p: p["passage_id"]).alias("passage_ids"), F.transform("shown", text).alias("contexts"))
    return contexts, judged.where("fault is not null").select("question_id", "fault")
