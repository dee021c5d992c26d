"""Vector code compression: product codes whose assignment walks a lexicographic trie over distinct parts.

Vectors become integers and are cut into equal parts. Each batch of vectors (``BATCH`` components)
makes one trie a part position: its distinct parts in lexicographic order, each with its weight (how
many vectors have it) and the leaf of every vector. Parts that begin alike share a path, so a copy of
any size costs one leaf and common first components are measured once. The tries are written once;
every round reads them and never the vectors, and nothing of them is shuffled.

A round walks each trie depth first. A node holds the squared distances of its prefix to all codebook
entries; its children add their own component's. Nodes are taken in blocks of neighbours, whose
distances are one array, so at most one block a level is held. A leaf takes the least distance (lowest
entry on ties) and adds its part to the entry's sum by its weight. Sums a task, of at most entries x
components rows, are added up by Spark; the driver gets them and divides, which is bounded by the
codebooks (parts x entries), not by the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.scratch import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BATCH = 1 << 22
"""Components of a batch."""
BLOCK = 4096
"""Nodes of a block."""
LARGEST = 1 << 27
"""Integer components beyond this size count as this size, so that a vector's error fits 64 bits."""
FEW_LABELS = 100_000

_TRIES = "width int, vec_ids array<long>, labels array<long>, leaves array<binary>, weights array<binary>, places array<binary>, least array<struct<vec_id:long,vector:array<long>>>"
Codebooks = list[list[list[int]]]


def distinct_parts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, how often each occurs, and the place of every row among them."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.append(True, (ordered[1:] != ordered[:-1]).any(1))
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], np.diff(np.append(np.flatnonzero(new), len(rows))), place


class Trie:
    """Distinct parts in lexicographic order, seen as a trie: a node of depth d is a run of leaves with equal first d + 1 components."""

    def __init__(self, leaves: np.ndarray):
        self.leaves = leaves
        n, depth = leaves.shape
        shared = np.zeros(n, np.int64)  # components a leaf shares with the one before
        if n > 1:
            differs = leaves[1:] != leaves[:-1]
            shared[1:] = differs.argmax(1)
        self.starts = [np.flatnonzero(np.append(True, shared[1:] <= d)) for d in range(depth)]
        self.first_child = [np.append(np.searchsorted(self.starts[d + 1], self.starts[d]), len(self.starts[d + 1])) for d in range(depth - 1)]

    def nearest(self, entries: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of every leaf and its squared distance; ties go to the lower index."""
        n, depth = self.leaves.shape
        best, distance = np.empty(n, np.int64), np.empty(n, np.int64)
        stack = [(0, 0, len(self.starts[0]), np.zeros((1, len(entries)), np.int64), np.zeros(len(self.starts[0]), np.int64))]
        while stack:
            d, low, high, above, parent = stack.pop()
            if high - low > block:  # the later neighbours wait below on the stack
                stack.append((d, low + block, high, above, parent[block:]))
                high, parent = low + block, parent[:block]
            total = self.leaves[self.starts[d][low:high], d][:, None] - entries[None, :, d]
            total *= total
            total += above[parent]
            if d + 1 == depth:
                best[low:high] = total.argmin(1)
                distance[low:high] = total.min(1)
                continue
            child = self.first_child[d][low : high + 1]
            stack.append((d + 1, int(child[0]), int(child[-1]), total, np.repeat(np.arange(high - low), np.diff(child))))
        return best, distance


def _matrix(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) of the whole vectors of a list column: no null, no null or non-finite component."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    at = np.cumsum(size) - size
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    whole = bad[at + size] == bad[at]
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(whole & (size == n))
        if n and len(rows):
            yield n, rows, values[(at[rows][:, None] + np.arange(n)).ravel()].reshape(-1, n)


def _build(parts: int, entries: int, scale: int):
    def rows_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        for length, rows, vectors in _matrix(table.column("embedding")):
            if length % parts:
                continue
            width = length // parts
            whole = np.clip(np.floor(vectors * scale), -LARGEST, LARGEST).astype(np.int32)
            ids, labels = (table.column(name).take(pa.array(rows)).combine_chunks() for name in ("vec_id", "label"))
            ids, labels = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (ids, labels))
            leaves, weights, places = [], [], []
            for p in range(parts):
                leaf, weight, place = distinct_parts(whole[:, p * width : (p + 1) * width])
                leaves.append(leaf.astype("<i4").tobytes())
                weights.append(weight.astype("<i8").tobytes())
                places.append(place.astype("<i4").tobytes())
            row = {"width": width, "vec_ids": ids, "labels": labels, "leaves": leaves, "weights": weights, "places": places, "least": _least(ids, whole, entries)}
            yield pa.RecordBatch.from_pylist([{k: v.to_pylist() if isinstance(v, pa.Array) else v for k, v in row.items()}], _ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("embedding").flatten())
            if size >= BATCH:
                yield from rows_of(held)
                held, size = [], 0
        if held:
            yield from rows_of(held)

    return run


_ARROW = pa.schema(
    [
        ("width", pa.int32()), ("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("leaves", pa.list_(pa.binary())), ("weights", pa.list_(pa.binary())),
        ("places", pa.list_(pa.binary())), ("least", pa.list_(pa.struct([("vec_id", pa.int64()), ("vector", pa.list_(pa.int64()))]))),
    ]
)


def _least(ids: pa.Array, vectors: np.ndarray, n: int) -> list[dict]:
    """The n rows of the smallest ids (then vectors); rows without an id come last."""
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((*vectors.T[::-1], value, missing))[:n]
    return [{"vec_id": None if missing[k] else int(value[k]), "vector": vectors[k].tolist()} for k in order.tolist()]


def _tries_of(row: dict, parts: int) -> Iterator[tuple[Trie, np.ndarray, np.ndarray]]:
    for p in range(parts):
        leaves = np.frombuffer(row["leaves"][p], "<i4").reshape(-1, row["width"]).astype(np.int64)
        yield Trie(leaves), np.frombuffer(row["weights"][p], "<i8"), np.frombuffer(row["places"][p], "<i4")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _sums(codebooks: Codebooks):
    """Each task's sums of the parts nearest to each entry; the last of a row's columns holds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [np.array(b, np.int64) for b in codebooks]
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for row in _rows(batch):
                for p, (trie, weight, _) in enumerate(_tries_of(row, len(books))):
                    best, _ = trie.nearest(books[p])
                    counts = np.bincount(best, weights=weight, minlength=len(books[p]))  # below 2^53, so exact
                    sums = [np.bincount(best, weights=weight * trie.leaves[:, d], minlength=len(books[p])) for d in range(row["width"])]
                    for e in np.flatnonzero(counts).tolist():
                        more = [int(s[e]) for s in (*sums, counts)]
                        had = total.get((p, e))
                        total[p, e] = [a + b for a, b in zip(had, more)] if had else more
        at = [(p, e, d, s) for (p, e), sums in total.items() for d, s in enumerate(sums)]
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*at), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["part", "entry", "place", "total"])

    return run


def _codes(codebooks: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [np.array(b, np.int64) for b in codebooks]
        for batch in batches:
            for row in _rows(batch):
                code, error = np.empty((len(row["vec_ids"]), len(books)), np.uint8), np.zeros(len(row["vec_ids"]), np.int64)
                for p, (trie, _, place) in enumerate(_tries_of(row, len(books))):
                    best, distance = trie.nearest(books[p])
                    code[:, p] = best[place]
                    error += distance[place]
                text = code.tobytes().hex()
                size = 2 * len(books)
                text = [text[k : k + size] for k in range(0, len(text), size)]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.int64()), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def trained(tries: DataFrame, first: Sequence[Sequence[int]], parts: int, rounds: int) -> Codebooks:
    """The codebooks after all rounds, from the vectors they start from."""
    width = len(first[0]) // parts
    books = [[list(v[p * width : (p + 1) * width]) for v in first] for p in range(parts)]
    for _ in range(rounds):
        sums = tries.mapInArrow(_sums(books), "part int, entry int, place int, total long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        found: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums.collect():
            found.setdefault((r.part, r.entry), {})[r.place] = int(r.total)
        for (p, e), total in found.items():
            books[p][e] = [total[d] // total[width] for d in range(width)]
    return books


def digest(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


_CODED = "vec_id long, label long, code string, error long"


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector kept.

    Dropped are null vectors, vectors with a null or non-finite component, empty ones, ones whose
    length is no multiple of ``parts``, and ones that are not as long as the kept vector of the
    smallest id. Integer components are kept within 2^27 either way. Rows without an id come last
    where ids decide, rows of one id in order of their vectors; repeated rows stay and count each.
    Fewer vectors than entries make smaller codebooks. Null labels are one label; a sum of errors
    beyond 64 bits is null. Other columns are not read; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    tries = stored(vectors.mapInArrow(_build(parts, entries, scale), _TRIES), "tries")
    least = tries.select("width", F.explode("least").alias("v")).select("width", "v.*")
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = least.orderBy(*order).limit(entries).collect()
    if first:
        width = first[0].width
        if any(r.width != width for r in first):
            first = least.where(F.col("width") == width).orderBy(*order).limit(entries).collect()
        tries = tries.where(F.col("width") == width)
        walked = tries.select("width", "leaves", "weights", "places")
        books = trained(walked, [r.vector for r in first], parts, rounds)
        coded = stored(tries.drop("least").mapInArrow(_codes(books), _CODED), "codes")
    else:
        books, coded = [], spark.createDataFrame([], _CODED)
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    if coded.select("label").distinct().limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    found = coded.join(sums.withColumnRenamed("label", "its"), F.col("label").eqNullSafe(F.col("its")))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    floor = "CAST((total - ((total % n) + n) % n) // n AS BIGINT)"
    assign = lambda k: f"""a{k} AS MATERIALIZED (
  SELECT part, vec, v, n, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
    SELECT p.part, p.vec, p.v, p.n, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts p JOIN c{k} c USING (part)) GROUP BY part, vec, v, n
)"""  # noqa: E731
    update = lambda k: f"""c{k + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY i) AS v FROM (
      SELECT part, entry, i, {floor} AS mean FROM (
        SELECT part, entry, i, sum(v[i] * n)::HUGEINT AS total, sum(n)::HUGEINT AS n FROM a{k}, generate_series(1, len(v)) AS g(i) GROUP BY part, entry, i)
    ) GROUP BY part, entry) m USING (part, entry)
)"""  # noqa: E731
    steps = ",\n".join(x for k in range(ROUNDS) for x in (assign(k), update(k)))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS vec, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec, p AS part, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v, 1 AS n FROM kept, range({PARTS}) AS r(p)
), c0 AS MATERIALIZED (
  SELECT part, vec - 1 AS entry, v FROM parts WHERE vec <= {ENTRIES}
),
{steps},
{assign(ROUNDS)},
coded AS (
  SELECT vec, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec
), books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS sha FROM c{ROUNDS}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM coded JOIN kept USING (vec), books"""


ORACLE_SQL = _sql()
