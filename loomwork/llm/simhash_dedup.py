"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are made in one scan. Links are searched between distinct fingerprints only, so a
group of copies of any size is one row. A fingerprint is cut into four segments on a ring; if two
differ in at most three bits, some rotation has a chain whose first segment differs in no bit, the
first two in at most one, the first three in at most two (each prefix stays within its part of the
budget). One side therefore indexes (rotation, first segment, second segment), the other probes
with the second segment as it is and with each bit turned: 32-bit keys at 17 probes a rotation. The
rest of the chain and the full distance are checked inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.components import components
from loomwork.llm.scratch import stored
from loomwork.llm.textnp import Words, buffer_of, joined, slices
from loomwork.llm.xxh64 import xxh64

BITS, SEGMENTS, MAX_BITS = 64, 4, 3
SHINGLE = 3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_ONES = np.uint64(0x0101010101010101)


def majority_bits(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of hashes (starts in ``first``, one more at the end): the bits set in over half of them; 0 for an empty run.

    Eight packed byte counters at a time are summed over at most 255 hashes, then over the run.
    """
    n = np.diff(first)
    held = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if not len(held):
        return out
    pieces = (n[held] + 254) // 255
    owner = np.repeat(np.arange(len(held)), pieces)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = first[:-1][held][owner] + 255 * inside
    tops = np.cumsum(pieces) - pieces
    for k in range(8):
        packed = np.add.reduceat((hashed >> np.uint64(k)) & _ONES, cuts)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), tops, axis=0)
        over = 2 * counts > n[held][:, None]
        for byte in range(8):
            out[held] |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offs = buffer_of(part.column("text"))
                words = Words(buf, offs)
                rows = part.num_rows
                data, at = joined(_FOLD[buf], words.starts, words.ends, words.row, rows)
                size = words.ends - words.starts + 1
                place = np.cumsum(size) - size  # of each word in the joined bytes
                n = np.where(words.counts > 0, np.maximum(words.counts - shingle + 1, 1), 0)
                first = np.concatenate([[0], np.cumsum(n)])
                row = np.repeat(np.arange(rows), n)
                word = words.first[:-1][row] + np.arange(int(first[-1])) - first[:-1][row]
                last = np.minimum(word + shingle, words.first[1:][row]) - 1
                hashed = xxh64(data, place[word], place[last] + size[last] - 1 - place[word]) if len(word) else np.zeros(0, np.uint64)
                prints = majority_bits(hashed, first).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every document row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _segment(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 16 * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def _chain(x: Column, i: int) -> Column:
    """Whether a difference x passes the prefix budgets 0, 1, 2, 3 of rotation i."""
    a, b, c = F.bit_count(_segment(x, i)), F.bit_count(_segment(x, i + 1)), F.bit_count(_segment(x, i + 2))
    return (a == 0) & (b <= 1) & (a + b + c <= 2) & (F.bit_count(x) <= MAX_BITS)


def close_pairs(prints: DataFrame) -> DataFrame:
    """(u, v), u < v: the distinct values of ``fp`` that differ in at most three bits, each pair once."""
    def keys(name: str, turned: bool) -> DataFrame:
        out = []
        for i in range(SEGMENTS):
            head = F.shiftleft(_segment(F.col("fp"), i), 16) + F.lit(i << 32)
            tail = _segment(F.col("fp"), i + 1)
            out += [head + tail] + [head + tail.bitwiseXOR(F.lit(1 << k)) for k in range(16) if turned]
        return prints.select(F.col("fp").alias(name), F.explode(F.array(*out)).alias("key"))

    x = F.col("u").bitwiseXOR(F.col("v"))
    rotation = F.shiftright(F.col("key"), 32)
    first = F.coalesce(*(F.when(_chain(x, i), i) for i in range(SEGMENTS)))
    # Spark takes the keys for as many as the fingerprints and would send them to all tasks, 68 a fingerprint, from the driver
    pairs = keys("u", False).join(keys("v", True).hint("merge"), "key").where((F.col("u") < F.col("v")) & (first == rotation))
    return pairs.select("u", "v")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every document row.

    Null, empty and wordless texts have fingerprint zero and link like any other. Equal texts and
    repeated rows share a fingerprint and so a component. Other columns are not read; an empty
    table gives no rows.
    """
    docs = stored(fingerprints(documents, shingle), "fingerprints")
    prints = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(close_pairs(prints.select("fp")))
    grouped = prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    # many rows of few fingerprints are a small file, but not a small table
    return docs.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The documents whose id is the smallest of their component, all columns; repeated rows of an id keep one, rows without an id stay."""
    gone = near_duplicates(documents, shingle).where("doc_id <> component_id").select("doc_id").distinct()
    named = documents.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.join(gone, "doc_id", "left_anti").select(*documents.columns).unionByName(documents.where(F.col("doc_id").isNull()))
