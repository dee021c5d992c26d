"""Quality rules whose cutoffs are chosen under a guaranteed limit on false rejections.

Base counts of every text are made in one pass of array operations. Each rule rejects where a
statistic exceeds a cutoff. Cutoffs come from labelled rows: going from the loosest cutoff of a
fixed grid to tighter ones, a cutoff is accepted while the exact binomial test rejects "the rule
drops more than ``alpha`` of good texts" at level ``delta / (strata x rules)`` (a fixed-sequence test
inside a rule and stratum, a Bonferroni correction across them). A stratum with too few labels
accepts no cutoff, so nothing is rejected there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.scratch import stored
from loomwork.llm.textnp import NEWLINE, Words, buffer_of, cover, mix, slices

SYMBOLS = b"#*$%&|<>"
STRATA = ("en", "de", "fr", "es")
"""Languages with cutoffs of their own; all others share the stratum ``other``."""
ALPHA = 0.02
"""False rejection allowed for all rules together, a share of good texts in a stratum; each rule has an equal part."""
DELTA = 0.05
GRID = tuple(round(x, 6) for x in np.geomspace(0.001, 2.0, 60))
"""Cutoffs tried for each statistic, a fixed grid that does not depend on the data."""

_COUNTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        for part in slices(batch, "text"):
            buf, offs = buffer_of(part.column("text"))
            n = part.num_rows
            words = Words(buf, offs)
            total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offs])
            chars = total(words.solid & ((buf & 0xC0) != 0x80))
            symbols = total(symbol[buf])
            hashed = words.hashes()
            lines = Words(buf, offs, NEWLINE)
            solid = np.concatenate([[0], np.cumsum(words.solid)])
            worded = solid[lines.ends] > solid[lines.starts] if len(lines) else np.zeros(0, bool)
            key = mix(lines.hashes() + lines.row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[worded]
            again = np.ones(len(key), bool)
            again[np.unique(key, return_index=True)[1]] = False
            dup = np.bincount(lines.row[worded], weights=again, minlength=n).astype(np.int64)
            n_lines = np.bincount(lines.row[worded], minlength=n).astype(np.int64)
            whole = np.flatnonzero(words.whole(3))
            gram = mix(words.grams(hashed, 3)[whole] + words.row[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            order = np.argsort(gram)
            same = gram[order][1:] == gram[order][:-1]
            twice = np.zeros(len(gram), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            repeated = cover(whole[twice], 3, len(words))
            repeat = np.bincount(words.row, weights=repeated, minlength=n).astype(np.int64)
            columns = [part.column("doc_id"), part.column("lang"), *(pa.array(x, pa.int64()) for x in (words.counts, chars, symbols, dup, repeat, n_lines))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _COUNTS.split(", ")])


def base_counts(documents: DataFrame) -> DataFrame:
    """Base counts of every text, one row a document row; a null text has none."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measure, _COUNTS)


def statistics() -> dict[str, Column]:
    """The rules: each rejects where its statistic exceeds the accepted cutoff."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": per_word("n_symbols"),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": per_word("n_repeat_words"),
    }


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    term = lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p))
    return min(1.0, sum(term(i) for i in range(k + 1)))


def accepted(rejected: Sequence[int], n: int, alpha: float, level: float) -> int | None:
    """Index of the tightest cutoff accepted. ``rejected``: good texts each cutoff drops, loosest cutoff first."""
    last = None
    for i, k in enumerate(rejected):
        if k > alpha * n or at_most(k, n, alpha) > level:
            break
        last = i
    return last


def cutoffs(counts: DataFrame, labels: DataFrame, strata: Sequence[str] = STRATA, alpha: float = ALPHA, delta: float = DELTA, grid: Sequence[float] = GRID) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff, from texts labelled good. Only counts leave Spark: strata x rules x grid of them.

    Labels of ids with both values are left out, as are base-failed texts, which no cutoff judges.
    """
    rules = statistics()
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low")).where("low = 1").select("doc_id")
    held = counts.where(~_base_failed()).join(good, "doc_id", "left_semi")
    grid = sorted(grid, reverse=True)
    sums = [F.array(*(F.sum((stat > c).cast("long")) for c in grid)).alias(name) for name, stat in rules.items()]
    level = delta / ((len(strata) + 1) * len(rules))
    out = {}
    for row in held.groupBy(_stratum(strata).alias("stratum")).agg(F.count("*").alias("n"), *sums).collect():
        for name in rules:
            k = accepted(row[name], row["n"], alpha / len(rules), level)
            if k is not None:
                out[row["stratum"], name] = grid[k]
    return out


def _stratum(strata: Sequence[str]) -> Column:
    return F.when(F.col("lang").isin(*strata), F.col("lang")).otherwise("other")


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, base counts, base_failed, kept and the rule that rejects, for every document row.

    A null text has no words and fails the base rules. Null or unknown languages use the stratum
    ``other``. Without labels (empty table, or null ones) only the base rules reject. Repeated rows
    are judged alike; other columns are not read.
    """
    counts = stored(base_counts(documents), "quality-counts")
    found = cutoffs(counts, labels, **options)
    strata = options.get("strata", STRATA)
    why = F.lit(None).cast("string")
    for (stratum, name), cut in sorted(found.items(), reverse=True):
        why = F.when((_stratum(strata) == stratum) & (statistics()[name] > cut), name).otherwise(why)
    failed = _base_failed()
    judged = counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), why.alias("rejected_by"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
