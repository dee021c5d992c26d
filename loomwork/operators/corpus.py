"""Corpus building: word-window passages with stable ids and links, corpus figures, checks and duplicates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as T
from loomwork.operators.numbering import numbered

SIZE, OVERLAP = 200, 40
SCHEME = "passage-v1"


def passage_id(paper_id: Column, section: Column, chunk: Column, context: dict | None = None, scheme: str = SCHEME) -> Column:
    """SHA-256 of the canonical JSON (sorted keys, no spaces) of the source coordinate and the configuration."""
    context = context or {"dataset": {"dataset_id": "documents"}, "transform": {"chunk_overlap_words": OVERLAP, "chunk_size_words": SIZE}}
    tail = json.dumps(context | {"scheme": scheme}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)[1:]
    where = F.to_json(F.struct(chunk.cast("int").alias("chunk_index"), paper_id.cast("string").alias("paper_id"), section.cast("int").alias("section_index"), F.lit("full_text").alias("source_kind")))
    return F.concat(F.lit(scheme + "-"), F.sha2(F.concat(F.lit('{"coordinate":'), where, F.lit("," + tail)), 256))


def passages(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, more: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping word windows of each document (one section, its language), keeping the white space between words.

    A window starts every ``size - overlap`` words until one reaches the end. Documents without words have none.
    ``more`` names columns of the documents that their passages carry.
    """
    return identified(cut(documents, size, overlap, more), *more)


def identified(windows: DataFrame, *more: str) -> DataFrame:
    """Windows with their passage ids, which follow from document and number."""
    return windows.select(passage_id(F.col("doc_id"), F.lit(0), F.col("chunk_number")).alias("passage_id"), "doc_id", "section", "chunk_number", "text", "n_words", *more)


def cut(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, more: tuple[str, ...] = ()) -> DataFrame:
    """The windows of ``passages`` without their ids."""
    step = size - overlap
    kept = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("section"), T.spaced_words(T.normalised(F.coalesce("text", F.lit("")))).alias("w"), *more)
    w, n = F.col("w"), F.size("w")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")

    def window(i: Column) -> Column:
        first = i * step + 1
        end = F.least(first + (size - 1), n)  # only its last word can end in white space
        body = F.concat(F.array_join(F.slice(w, first, end - first), ""), F.regexp_replace(F.element_at(w, end), r"[\s\p{Z}]+\z", ""))
        return F.struct(i.alias("chunk_number"), body.alias("text"), (end - first + 1).alias("n_words"))

    # windows are cut before they become rows, so no row carries its whole document; an outer explode, since an inner one would make all words twice, for its filter
    found = kept.select("doc_id", "section", *more, F.explode_outer(F.when(n > 0, F.transform(F.sequence(F.lit(0), last), window))).alias("window")).where("window is not null")
    return found.select("doc_id", "section", "window.chunk_number", "window.text", "window.n_words", *more)


def linked(chunks: DataFrame) -> DataFrame:
    """Ids of the passages before and after, in the same document."""
    order = Window.partitionBy("doc_id").orderBy("chunk_number")
    return chunks.withColumns({"previous_passage_id": F.lag("passage_id").over(order), "next_passage_id": F.lead("passage_id").over(order)})


def link_faults(links: DataFrame) -> DataFrame:
    """Passages whose next passage does not name them as its previous one; none in a sound corpus."""
    back = links.select(F.col("passage_id").alias("next_passage_id"), F.col("previous_passage_id").alias("back"))
    return links.where("next_passage_id is not null").join(back, "next_passage_id", "left").where("back is null or back <> passage_id").select("passage_id", "next_passage_id")


def report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, passages, words of the source (overlaps counted once) and of the passages, by section."""
    source = documents.select(F.coalesce("lang", F.lit("")).alias("section"), F.size(T.words(F.coalesce("text", F.lit("")))).alias("w"))
    source = source.groupBy("section").agg(F.count("*").alias("documents"), F.sum("w").alias("source_words"), F.sum((F.col("w") == 0).cast("long")).alias("empty_documents"))
    made = chunks.groupBy("section").agg(F.count("*").alias("passages"), F.sum("n_words").alias("passage_words"), F.min("n_words").alias("least"), F.median("n_words").alias("median"), F.max("n_words").alias("most"))
    return source.join(made, "section", "left")


def duplicate_paragraphs(documents: DataFrame) -> DataFrame:
    """Groups of equal lines, within documents and across them: groups, lines involved, documents involved."""
    lines = documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    lines = lines.groupBy("doc_id", F.sha2("line", 256).alias("line")).agg(F.count("*").alias("n"))
    within = lines.where("n > 1").agg(F.lit("within").alias("kind"), F.count("*").alias("groups"), F.sum("n").alias("lines"), F.count_distinct("doc_id").alias("documents"))
    many = lines.groupBy("line").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where("docs > 1")
    involved = lines.join(many.select("line"), "line", "left_semi").agg(F.count_distinct("doc_id").alias("documents"))
    across = many.agg(F.lit("across").alias("kind"), F.count("*").alias("groups"), F.sum("n").alias("lines")).crossJoin(involved)
    return within.unionByName(across)


def anomalies(documents: DataFrame, examples: int = 10) -> DataFrame:
    """Counts of odd documents by kind, with the first example ids in order."""
    kinds = {
        "no_text": F.coalesce(F.col("text"), F.lit("")) == "",
        "one_line": ~F.col("text").contains("\n"),
        "count_differs": F.length("text") != F.col("n_chars"),
        "outer_space": F.col("text") != F.trim("text"),
        "short": F.size(T.words("text")) < 20,
    }
    odd = documents.select("doc_id", F.explode(F.filter(F.array(*(F.when(c, k) for k, c in kinds.items())), lambda x: x.isNotNull())).alias("kind"))
    order = Window.partitionBy("kind").orderBy("doc_id")
    first = odd.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= examples)
    first = first.groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("examples"))
    return odd.groupBy("kind").agg(F.count("*").alias("n")).join(first, "kind")


def spread(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """One row a group (smallest key), then n of them at even distances of their order."""
    one = rows.groupBy(group).agg(F.min(key).alias(key))
    total = one.agg(F.count("*").alias("total"))
    placed = numbered(one, key, "place").crossJoin(total)
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("total") / F.lit(n)))
    return placed.where((F.col("total") <= n) | F.array_contains(picks, F.col("place"))).select(group, key)


def paragraph_ranges(documents: DataFrame) -> DataFrame:
    """By document: its lines with text, and where the last of them starts and ends if the lines are joined by blank lines.

    Line lengths are summed within the row, so no text and no line crosses a shuffle.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    sizes = documents.select("doc_id", F.transform(lines, lambda x: F.length(x).cast("long")).alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x + 2)
    some = sizes.where(F.size("n") > 0)
    return some.select("doc_id", F.size("n").alias("paragraphs"), (total - 2 - F.element_at("n", -1)).alias("last_start"), (total - 2).alias("last_end"))


def normalisation_report(documents: DataFrame) -> DataFrame:
    """One row of counters of what normalising changes, so that reports of parts add up."""
    text = F.coalesce("text", F.lit(""))
    flags = {
        "empty": F.trim(text) == "", "carriage_returns": text.contains("\r"), "outer_space": text != F.trim(text), "blank_lines": text.rlike(r"\n[ \t]*\n"),
        "double_spaces": text.contains("  "), "tabs": text.contains("\t"), "non_ascii": F.octet_length(text) > F.length(text), "count_differs": F.length(text) != F.coalesce("n_chars", F.lit(-1)),
    }
    return documents.agg(F.count("*").alias("documents"), F.sum(F.length(text)).alias("characters"), *(F.count_if(c).alias(n) for n, c in flags.items()))


def reference_faults(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows without a key, with a key that no parent has, and parents without a row, each counted."""
    have = rows.groupBy(key).agg(F.count("*").alias("n"))
    both = have.join(parents.select(key, F.lit(1).alias("there")).distinct(), key, "full")
    return both.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("without_key"), F.count_if(F.col("n").isNotNull() & F.col(key).isNotNull() & F.col("there").isNull()).alias("orphan_keys"),
        F.coalesce(F.sum(F.when(F.col(key).isNotNull() & F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"), F.count_if(F.col("n").isNull()).alias("unused_parents"),
    )
