"""URL filters: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

One scan of the pages, no shuffle: rules are column expressions, and the automaton (built once a
Python worker from the vocabulary, whose size is the caller's and does not grow with the data)
runs over Arrow batches of URLs; its verdict holds where no rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (verdict, host, path) rules, and the vocabulary with its weights. A weight of
# STRICT rejects alone; soft terms reject when distinct ones add up to the limit.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
STRICT = 100
VOCABULARY = (
    ("adult", STRICT), ("casino", STRICT), ("escort", STRICT), ("porn", STRICT), ("spam", STRICT), ("viagra", STRICT), ("xxx", STRICT),
    ("ads", 1), ("bet", 1), ("bets", 1), ("cheap", 1), ("clicks", 1), ("deals", 1), ("farm", 1), ("free", 1), ("loan", 1), ("pills", 1),
    ("poker", 1), ("track", 1), ("tracker", 1), ("win", 1),
)
SOFT_LIMIT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where no ``://`` stands."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits. Of equal lengths the first listed wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, under in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        name, verdict = F.when(fits, at + under).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


@lru_cache(8)
def _automaton(vocabulary: tuple[tuple[str, int], ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (term, weight) in enumerate(vocabulary):
        found.add_word(term, (k, len(term), weight))
    found.make_automaton()
    return found


def vocabulary_hits(url: str | None, vocabulary: tuple[tuple[str, int], ...]) -> tuple[int, int]:
    """Strict terms and total weight of distinct soft terms in a URL; a term counts where no ASCII letter or digit adjoins it."""
    if not url:
        return 0, 0
    text = url.translate(_FOLD)
    strict, soft = set(), {}
    for end, (k, size, weight) in _automaton(vocabulary).iter(text):
        before, after = end - size, end + 1
        if (before >= 0 and text[before] in _WORD) or (after < len(text) and text[after] in _WORD):
            continue
        if weight >= STRICT:
            strict.add(k)
        else:
            soft[k] = weight
    return len(strict), sum(soft.values())


_FOLD = str.maketrans(UPPER, LOWER)
_WORD = frozenset(LOWER + "0123456789")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    vocabulary: Sequence[tuple[str, int]] = VOCABULARY,
    soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits and soft_weight of every page.

    Null and scheme-less URLs have an empty host and path, fit no rule and are judged by the
    vocabulary (a null or empty URL is allowed). Repeated rows stay; other columns of the input
    are not read; an empty table gives no rows.
    """
    vocabulary = tuple(vocabulary)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [vocabulary_hits(u, vocabulary) for u in batch.column("url").to_pylist()]
            strict = pa.array([h[0] for h in hits], pa.int32())
            soft = pa.array([h[1] for h in hits], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), strict, soft], names=["page_id", "url", "strict_hits", "soft_weight"])

    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    judged = urls.mapInArrow(judge, "page_id long, url string, strict_hits int, soft_weight int")
    host, path = host_and_path(F.col("url"))
    judged = judged.select("page_id", host.alias("host"), path.alias("path"), "strict_hits", "soft_weight")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("strict_hits") > 0) | (F.col("soft_weight") >= soft_limit), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), "strict_hits", "soft_weight")


def _sql() -> str:
    def terms(strict: bool) -> list[str]:
        return [t for t, w in VOCABULARY if (w >= STRICT) == strict]

    u = f"coalesce(translate(url, '{UPPER}', '{LOWER}'), '')"
    edge = lambda t: f"regexp_matches({u}, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    strict = " + ".join(f"{edge(t)}::INT" for t in terms(True))
    weight = dict(VOCABULARY)
    soft = " + ".join(f"{weight[t]} * {edge(t)}::INT" for t in terms(False))
    fit = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    said = "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{v}'" for v, h, p in longest) + " END"
    return f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), hit AS (
  SELECT page_id, host, path, CAST({strict} AS INT) AS strict_hits, CAST({soft} AS INT) AS soft_weight FROM split
)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({said}, CASE WHEN strict_hits > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_weight
FROM hit"""


ORACLE_SQL = _sql()
