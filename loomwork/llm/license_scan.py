"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a stretch of consecutive words. Templates fall into classes by length (stride 16, 64, 256
and so on); blocks of a class are two strides long and begin a stride apart over the whole text, so
any passage as long as a template of the class lies whole in one. A block matches a template when it
holds at least ``CONTAINED`` percent of the template's distinct words.

One scan finds phrases and block sets, reduced to words that templates of the class have; blocks with
too few of them for the least demanding template go at once (length filter), so that hardly anything is
written but a row a document. The scan also counts in how many documents each template word stands.
By these counts all sets are ordered, rarest word first, and joined as usual for exact set similarity:

* prefix filter: a block that holds ``need`` words of a template shares one of the template's first
  ``size - need + 1`` words, and that is among its own first ``size - need + 1``. Only those are joined.
* length filter: a block has at least ``need`` words.
* positional filter: the words shared so far and the rest after the last shared places reach ``need``.

What passes is verified on whole sets. The template side of the join is as large as the list of
templates, which the caller gives and which does not grow with the documents; no pair of blocks and
no pair of a block and a template without a common prefix word is made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.scratch import stored
from loomwork.llm.textnp import slices
from loomwork.llm.vocabulary import Vocabulary, folded_words

# Phrases and templates with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("apache", "licensed under the apache license"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under a creative commons attribution international license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("public-domain", "dedicated to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
CONTAINED = 90
_WORD = re.compile(b"[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+")


def words_of(text: str) -> list[bytes]:
    """Words of a text; only A-Z are lower-cased."""
    return _WORD.findall(text.encode().lower())


def stride_of(n_words: int) -> int:
    """The stride of blocks for a template of so many words."""
    stride = 16
    while stride < n_words:
        stride *= 4
    return stride


def need_of(n_distinct: int, contained: int = CONTAINED) -> int:
    """How many of a template's distinct words a block has to hold."""
    return max(1, -(-contained * n_distinct // 100))


class Plan:
    """Templates as sets of word numbers, with their classes; phrases as lists of word numbers."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], contained: int):
        templates = [(label, words_of(t)) for label, t in templates]
        phrases = [(words_of(p), label) for p, label in phrases]
        self.every = Vocabulary(w for t in (*(t for _, t in templates), *(p for p, _ in phrases)) for w in t)
        number = {w: k for k, w in enumerate(self.every.words)}
        self.phrases = [([number[w] for w in p], label) for p, label in phrases if p]
        self.templates = [(label, stride_of(len(t)), sorted({number[w] for w in t})) for label, t in templates if t]
        self.need = [need_of(len(t), contained) for _, _, t in self.templates]
        self.classes: dict[int, tuple[np.ndarray, int]] = {}
        for (_, stride, t), need in zip(self.templates, self.need):
            known, least = self.classes.get(stride, (np.zeros(len(self.every), bool), need))
            known[t] = True
            self.classes[stride] = known, min(least, need)


_SCANNED = "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<stride:int,at:long,words:array<int>>>, counts array<long>"
_BLOCKS = pa.list_(pa.struct([("stride", pa.int32()), ("at", pa.int64()), ("words", pa.list_(pa.int32()))]))


def _blocks(number: np.ndarray, row: np.ndarray, place: np.ndarray, n_words: np.ndarray, stride: int, known: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, first word, distinct known words) of every block that holds at least ``least`` of them."""
    n_blocks = np.maximum(1, -(-n_words // stride) - 1)
    begin = np.cumsum(n_blocks) - n_blocks
    mine = np.flatnonzero((number >= 0) & known[number])
    slot, row, number = place[mine] // stride, row[mine], number[mine]
    block = [begin[row] + np.minimum(slot, n_blocks[row] - 1), (begin[row] + slot - 1)[slot > 0]]
    held = np.unique(np.concatenate(block) * len(known) + np.concatenate([number, number[slot > 0]]))
    block, number = held // len(known), held % len(known)
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(block))
    for a, z in zip(cuts[ends - cuts >= least].tolist(), ends[ends - cuts >= least].tolist()):
        r = int(np.searchsorted(begin, block[a], "right")) - 1
        yield r, int(block[a] - begin[r]) * stride, number[a:z]


def _scan(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        counts = np.zeros(len(plan.every), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words, n = folded_words(part.column("text")), part.num_rows
                number, place = plan.every.numbers(words), words.place()
                some = np.flatnonzero(number >= 0)
                counts += np.bincount(np.unique(words.row[some] * max(1, len(counts)) + number[some]) % max(1, len(counts)), minlength=len(counts))
                n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
                labels: list[list[str]] = [[] for _ in range(n)]
                for phrase, label in plan.phrases:
                    start = some[number[some] == phrase[0]]
                    start = start[start + len(phrase) <= words.first[1:][words.row[start]]]
                    for k, w in enumerate(phrase[1:], 1):
                        start = start[number[start + k] == w]
                    r = words.row[start]
                    n_base += np.bincount(r, minlength=n)
                    np.minimum.at(first, r, place[start])
                    np.maximum.at(last, r, place[start])
                    for k in np.unique(r).tolist():
                        if label not in labels[k]:
                            labels[k].append(label)
                blocks: list[list[dict]] = [[] for _ in range(n)]
                for stride, (known, least) in plan.classes.items():
                    for r, begin, held in _blocks(number, words.row, place, words.counts, stride, known, least):
                        blocks[r].append({"stride": stride, "at": begin, "words": held.tolist()})
                none = n_base == 0
                columns = [
                    pa.array(at + np.arange(n)), part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([sorted(x) for x in labels], pa.list_(pa.string())), pa.array(blocks, _BLOCKS), pa.nulls(n, pa.list_(pa.int64())),
                ]
                at += n
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in _TYPES] + [pa.array([counts.tolist()], pa.list_(pa.int64()))], names=_NAMES)

    return run


_NAMES = [c.split()[0] for c in _SCANNED.split(", ")]
_TYPES = [pa.int64()] * 6 + [pa.list_(pa.string()), _BLOCKS]


def _matched(rows: DataFrame, plan: Plan, rank: Sequence[int]) -> DataFrame:
    """row, at, stride, template, label, overlap and size of every block that holds enough of a template."""
    spark = rows.sparkSession
    prefixes = []
    for k, ((label, stride, words), need) in enumerate(zip(plan.templates, plan.need)):
        ordered = sorted(rank[w] for w in words)
        prefixes += [(k, label, stride, ordered, len(ordered), need, i, w) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    templates = spark.createDataFrame(prefixes, "template int, label string, stride int, whole array<int>, size int, need int, i int, word int")
    order = F.array(*(F.lit(r) for r in rank))
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.at", "b.stride", F.array_sort(F.transform("b.words", lambda w: F.element_at(order, w + 1))).alias("words"))
    least = F.lit(None).cast("int")
    for stride, (_, need) in plan.classes.items():
        least = F.when(F.col("stride") == stride, need).otherwise(least)
    probes = blocks.select("*", F.size("words").alias("held"), F.posexplode("words").alias("j", "word")).where(F.col("j") <= F.col("held") - least)
    shared = probes.join(F.broadcast(templates), ["stride", "word"]).where((F.col("held") >= F.col("need")) & (F.col("j") <= F.col("held") - F.col("need")))
    pairs = shared.groupBy("row", "stride", "at", "template").agg(
        F.count("*").alias("n"), F.max("i").alias("i"), F.max("j").alias("j"), *(F.first(c).alias(c) for c in ("label", "words", "whole", "held", "size", "need"))
    )
    rest = F.least(F.col("size") - 1 - F.col("i"), F.col("held") - 1 - F.col("j"))
    overlap = F.size(F.array_intersect("words", "whole"))
    return pairs.where(F.col("n") + rest >= F.col("need")).withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need")).select("row", "at", "stride", "template", "label", "overlap", "size")


def _scanned(documents: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Rows of documents with phrases and blocks; and the matches of the blocks."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = stored(texts.mapInArrow(_scan(plan), _SCANNED), "license-blocks")
    rows = table.where(F.col("row").isNotNull()).drop("counts")
    counted = dict(table.where(F.col("row").isNull()).select(F.posexplode("counts")).groupBy("pos").agg(F.sum("col")).collect())
    rank = [0] * len(plan.every)
    for k, w in enumerate(sorted(range(len(rank)), key=lambda w: (counted.get(w, 0), w))):
        rank[w] = k
    return rows, _matched(rows, plan, rank)


def template_matches(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, contained: int = CONTAINED) -> DataFrame:
    """doc_id, first_word, n_words (of the block), template (place in the list), label and containment of every matching block."""
    plan = Plan(templates, (), contained)
    rows, found = _scanned(documents, plan)
    return rows.select("row", "doc_id").join(found, "row").select("doc_id", F.col("at").alias("first_word"), (2 * F.col("stride")).alias("n_words"), "template", "label", (F.col("overlap") / F.col("size")).alias("containment"))


def scan(documents: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, contained: int = CONTAINED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document row.

    The score is 1 where a phrase stands, else the largest containment of a matching template, else 0.
    Null, empty and wordless texts have no words, no labels (empty strings) and score 0. Repeated rows
    and ids are judged each for itself. Equal templates under one label count once in ``labels``. Other
    columns are not read; no templates leave the phrases alone; an empty table gives no rows.
    """
    plan = Plan(templates, phrases, contained)
    rows, found = _scanned(documents, plan)
    best = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("overlap") / F.col("size")).alias("containment"))
    none = rows.where(F.size("blocks") == 0).withColumns({"more": F.array().cast("array<string>"), "containment": F.lit(0.0)})
    some = rows.where(F.size("blocks") > 0).join(best, "row", "left")
    both = none.unionByName(some)
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _sql() -> str:
    templates = ", ".join(f"({k}, '{label}', '{t}')" for k, (label, t) in enumerate(TEMPLATES))
    strides = "CASE " + " ".join(f"WHEN n <= {s} THEN {s}" for s in (16, 64, 256)) + " END"
    at = lambda p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
    places = " UNION ALL ".join(f"SELECT doc, i, '{label}' AS label FROM (SELECT doc, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {at(p)}" for p, label in PHRASES)
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), base AS MATERIALIZED ({places}),
b AS (SELECT doc, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_distinct(list(label)) AS labels FROM base GROUP BY doc),
t AS (SELECT k, label, list_distinct(w) AS w, {strides} AS stride FROM (SELECT k, label, string_split(x, ' ') AS w, len(string_split(x, ' ')) AS n FROM (VALUES {templates}) AS v(k, label, x))),
tw AS (SELECT k, label, stride, len(w) AS size, unnest(w) AS word FROM t),
place AS MATERIALIZED (
  SELECT doc, n, i, word FROM (SELECT doc, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM tw)
), held AS (
  SELECT DISTINCT doc, k, label, size, word, unnest([i // stride, i // stride - 1]) AS block, greatest(1, CAST(ceil(n / stride) AS BIGINT) - 1) AS blocks
  FROM place JOIN tw USING (word)
), matched AS (
  SELECT doc, k, label, size, block, count(DISTINCT word) AS overlap FROM held WHERE block BETWEEN 0 AND blocks - 1
  GROUP BY ALL HAVING count(DISTINCT word) * 100 >= {CONTAINED} * size
), m AS (SELECT doc, list_distinct(list(label)) AS labels, max(overlap / size) AS containment FROM matched GROUP BY doc)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc) LEFT JOIN m USING (doc)"""


ORACLE_SQL = _sql()
