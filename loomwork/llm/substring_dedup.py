"""Substring dedup with fixed-block anchors.

A window of 13 words holds a whole 7-word block of the grid 0, 7, 14, ... of the text it is taken
from. So blocks off that grid need no index: non-overlapping blocks of every text are indexed, every
rolling 7-word window probes them, and only windows whose hash is a block of a smaller document (and
blocks probed by a larger one) are extended to the 13-word windows around them. Equal extensions
whose smallest document is smaller than their own are repeats; overlapping ones merge into maximal runs.

Data moves in packed arrays. The map side of a step sends, for each slice of texts and each part of
the hash space, one row of hashes and the documents they come from; hashes of one part meet in one
group; answers go back to buckets of documents, where they meet the texts again. A hash in a third of
all documents costs each slice its own occurrences and yields no pairs, only a smallest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.scratch import apart, forget, stored
from loomwork.llm.textnp import Words, buffer_of, cover, group_bytes, joined, mix, slices

WINDOW = 13
PART_BYTES, BUCKET_BYTES = 16 << 20, 4 << 20
"""Text behind one part of the hash space and behind one bucket of documents: what one group of a task holds, whatever the input's size."""
BUCKET = "__bucket"
PIECE = 1 << 20
"""Bytes of text that a task of the first step turns into words at a time."""
_PACK = "part int, ids binary, buckets binary, counts binary, keys binary, flags binary"
_BACK = f"{BUCKET} int, ids binary, counts binary, keys binary, flags binary"


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _pack(part: np.ndarray, ids: np.ndarray, buckets: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    """One row a part: runs of ids with their counts, then keys and flags in order."""
    order = np.argsort(part, kind="stable")
    part, ids, buckets, keys, flags = part[order], ids[order], buckets[order], keys[order], flags[order]
    cuts = [*_runs(part).tolist(), len(part)]
    rows: list[tuple] = []
    for a, b in zip(cuts, cuts[1:]):
        runs = _runs(ids[a:b])
        counts = np.diff([*runs, b - a]).astype(np.int32)
        rows.append((int(part[a]), ids[a:b][runs].tobytes(), buckets[a:b][runs].astype(np.int32).tobytes(), counts.tobytes(), keys[a:b].tobytes(), flags[a:b].tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))], names=["part", "ids", "buckets", "counts", "keys", "flags"]
    )


def _all(column: pa.ChunkedArray, kind) -> np.ndarray:
    got = [np.frombuffer(x.as_buffer(), kind) for c in column.chunks for x in c]
    return np.concatenate(got) if got else np.zeros(0, kind)


def _answer(ids: np.ndarray, buckets: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> pa.Table:
    """One row a bucket: its documents' keys and flags."""
    order = np.lexsort((ids, buckets))
    ids, buckets, keys, flags = ids[order], buckets[order], keys[order], flags[order]
    packed = _pack(buckets.astype(np.int32), ids, buckets, keys, flags)
    return pa.table([packed["part"], packed["ids"], packed["counts"], packed["keys"], packed["flags"]], names=[BUCKET, "ids", "counts", "keys", "flags"])


def _least_by_key(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    cuts = _runs(keys)
    return keys[cuts], np.minimum.reduceat(ids, cuts) if len(cuts) else ids[:0]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in a sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _id_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def _own(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys told apart by document."""
    return mix(ids.view(np.uint64)) ^ keys.astype(np.uint64)


class _Steps:
    """The functions that tasks run, for a window size and numbers of parts and buckets."""

    def __init__(self, window: int, n_parts: int):
        self.window, self.block, self.n_parts = window, (window + 1) // 2, n_parts

    def anchors(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every rolling block window of every text, those on the grid flagged. Words are made a ``PIECE`` at a time, rows are packed a larger slice."""
        for batch in batches:
            for rows in slices(batch, "text", 4 << 20):
                found = [x for x in (self._anchors(piece) for piece in slices(rows, "text", PIECE)) if len(x[0])]
                if found:
                    gram, ids, buckets, grid = (np.concatenate(x) for x in zip(*found))
                    yield _pack(((gram >> np.uint64(32)) % np.uint64(self.n_parts)).astype(np.int32), ids, buckets, gram.astype(np.uint32), grid)

    def _anchors(self, rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Hashes of the rolling block windows, their documents and buckets, and whether they are on the grid."""
        words = Words(*buffer_of(rows.column("text")))
        ids, valid = _id_array(rows.column("doc_id"))
        at = np.flatnonzero(words.whole(self.block) & (words.counts >= self.window)[words.row] & valid[words.row])
        row = words.row[at]
        buckets = rows.column(BUCKET).to_numpy(zero_copy_only=False)
        return words.grams(words.hashes(), self.block)[at], ids[row], buckets[row], (words.place()[at] % self.block == 0).astype(np.uint8)

    @staticmethod
    def _unpacked(table: pa.Table, kind) -> tuple[np.ndarray, ...]:
        counts = _all(table["counts"], np.int32)
        return np.repeat(_all(table["ids"], np.int64), counts), np.repeat(_all(table["buckets"], np.int32), counts), _all(table["keys"], kind), _all(table["flags"], np.uint8)

    def probe(self, table: pa.Table) -> pa.Table:
        """Windows that equal a block of a smaller document (flag 1), blocks that a larger document's window equals (flag 2)."""
        ids, buckets, keys, grid = self._unpacked(table, np.uint32)
        on = grid > 0
        index, least = _least_by_key(keys[on], ids[on])
        at, found = _find(index, keys)
        hit = found & (least[at] < ids) if len(index) else found
        most = np.full(len(index), np.iinfo(np.int64).min)
        order = np.argsort(at[hit], kind="stable")
        cuts = _runs(at[hit][order])
        if len(cuts):
            most[at[hit][order][cuts]] = np.maximum.reduceat(ids[hit][order], cuts)
        probed = on & (ids < most[at]) if len(index) else on & False
        flags = hit.astype(np.uint8) + 2 * probed.astype(np.uint8)
        keep = flags > 0
        return _answer(ids[keep], buckets[keep], keys[keep], flags[keep])

    def extend(self, texts: pa.Table, hits: pa.Table) -> pa.Table:
        """The whole windows around each hit, hashed again over all their words."""
        said, keys, flags = self._said(hits, np.uint32)
        out = []
        for rows in slices(texts, "text", 4 << 20) if len(said) else ():
            words = Words(*buffer_of(rows.column("text")))
            ids, valid = _id_array(rows.column("doc_id"))
            whole = words.whole(self.window) & valid[words.row]
            if not whole.any():
                continue
            hashed = words.hashes()
            gram = words.grams(hashed, self.block)
            flag = np.zeros(len(words), np.uint8)
            some = np.flatnonzero(words.whole(self.block) & valid[words.row])
            at, found = _find(said, _own(ids[words.row[some]], gram[some].astype(np.uint32)))
            flag[some[found]] = flags[at[found]]
            flag[(words.place() % self.block != 0) & (flag >= 2)] &= 1
            take = np.zeros(len(words), np.uint8)
            for bit in (1, 2):
                sums = np.concatenate([[0], np.cumsum((flag & bit) > 0)])
                ahead = sums[np.minimum(np.arange(len(words)) + self.block, len(words))] - sums[:-1]
                take += np.where(whole & (ahead > 0), bit, 0).astype(np.uint8)
            at = np.flatnonzero(take)
            if len(at):
                key, other = words.grams(hashed, self.window)[at], words.grams(hashed, self.window, np.uint64(0x9E3779B97F4A7C15))[at]
                bucket = np.full(len(at), rows.column(BUCKET)[0].as_py(), np.int32)
                out.append(_pack((other % np.uint64(self.n_parts)).astype(np.int32), ids[words.row[at]], bucket, key, take[at]))
        return pa.Table.from_batches(out, _PACKED)

    def settle(self, table: pa.Table) -> pa.Table:
        """Windows whose smallest reference document is smaller than their own."""
        ids, buckets, keys, flags = self._unpacked(table, np.uint64)
        index, least = _least_by_key(keys[flags >= 2], ids[flags >= 2])
        at, found = _find(index, keys)
        repeated = found & (flags & 1 > 0)
        if len(index):
            repeated &= least[at] < ids
        return _answer(ids[repeated], buckets[repeated], keys[repeated], flags[repeated])

    @staticmethod
    def _said(hits: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = _all(hits["counts"], np.int32)
        keys, flags = _all(hits["keys"], kind), _all(hits["flags"], np.uint8)
        own = _own(np.repeat(_all(hits["ids"], np.int64), counts), keys)
        order = np.argsort(own)
        own, keys, flags = own[order], keys[order], flags[order]
        cuts = _runs(own)
        return own[cuts], keys[cuts], np.bitwise_or.reduceat(flags, cuts) if len(cuts) else flags

    def repeated_words(self, rows: pa.Table, said: np.ndarray) -> tuple[Words, np.ndarray]:
        words = Words(*buffer_of(rows.column("text")))
        removed = np.zeros(len(words), bool)
        if len(said):
            ids, valid = _id_array(rows.column("doc_id"))
            at = np.flatnonzero(words.whole(self.window) & valid[words.row])
            _, found = _find(said, _own(ids[words.row[at]], words.grams(words.hashes(), self.window)[at]))
            removed = cover(at[found], self.window, len(words))
        return words, removed

    def digest(self, texts: pa.Table, hits: pa.Table) -> pa.Table:
        said, _, _ = self._said(hits, np.uint64)
        out = []
        for rows in slices(texts, "text", 4 << 20):
            words, removed = self.repeated_words(rows, said)
            n = rows.num_rows
            keep = ~removed
            data, offs = joined(words.buf, words.starts[keep], words.ends[keep], words.row[keep], n)
            shas = [hashlib.sha256(x).hexdigest() for x in group_bytes(data, offs)]
            gone = np.bincount(words.row, weights=removed, minlength=n).astype(np.int64)
            before = np.concatenate([[False], removed[:-1]]) if len(removed) else removed
            before[words.first[:-1][words.counts > 0]] = False
            runs = np.bincount(words.row, weights=removed & ~before, minlength=n).astype(np.int64)
            out.append(pa.table([rows["doc_id"], pa.array(words.counts.astype(np.int64)), pa.array(gone), pa.array(runs), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"]))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})

    def cut(self, texts: pa.Table, hits: pa.Table) -> pa.Table:
        """The rows with repeated runs cut out of their texts, and ``n_chars`` after them; a text without any is left as it is."""
        said, _, _ = self._said(hits, np.uint64)
        out = []
        for rows in slices(texts, "text", 4 << 20):
            words, removed = self.repeated_words(rows, said)
            new = rows["text"].to_pylist()
            for row in np.unique(words.row[removed]).tolist():
                a, b = words.first[row], words.first[row + 1]
                kept = np.flatnonzero(~removed[a:b]) + a
                ends = np.minimum(np.append(words.starts[1:], len(words.buf))[kept], words.offs[row + 1])
                ends = np.where(kept == b - 1, words.offs[row + 1], ends)
                new[row] = b"".join(words.buf[s:e].tobytes() for s, e in zip(words.starts[kept].tolist(), ends.tolist())).decode("utf-8", "replace").rstrip(" ")
            rows = rows.set_column(rows.column_names.index("text"), "text", pa.array(new, rows.schema.field("text").type))
            if "n_chars" in rows.column_names:
                at, was = rows.column_names.index("n_chars"), rows["n_chars"].to_pylist()
                for row in np.unique(words.row[removed]).tolist():
                    was[row] = len(new[row])
                rows = rows.set_column(at, "n_chars", pa.array(was, rows.schema.field("n_chars").type))
            out.append(rows)
        return (pa.concat_tables(out) if out else texts).drop_columns([BUCKET])


_PACKED = pa.schema([("part", pa.int32()), *((n, pa.binary()) for n in ("ids", "buckets", "counts", "keys", "flags"))])


def _bucketed(documents: DataFrame, n: int) -> DataFrame:
    """Documents in buckets by id; rows without an id spread by their text."""
    return documents.withColumn(BUCKET, F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(n)).cast("int"))


def _repeats(docs: DataFrame, window: int, n_bytes: int) -> tuple[_Steps, DataFrame]:
    """For bucketed documents (doc_id, text): the window hashes to remove, by bucket, as a written table."""
    steps = _Steps(window, 1 + n_bytes // PART_BYTES)
    hits = stored(docs.mapInArrow(steps.anchors, _PACK).groupBy("part").applyInArrow(lambda t: steps.probe(t), _BACK), "anchors")
    extended = docs.groupBy(BUCKET).cogroup(hits.groupBy(BUCKET)).applyInArrow(lambda t, h: steps.extend(t, h), _PACK)
    repeats = stored(extended.groupBy("part").applyInArrow(lambda t: steps.settle(t), _BACK), "repeats")
    forget(hits)
    return steps, repeats


def _size(documents: DataFrame) -> int:
    return documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def _narrow(documents: DataFrame, n_bytes: int) -> DataFrame:
    return _bucketed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), 1 + n_bytes // BUCKET_BYTES)


def removed_words(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans (maximal removed runs) and kept_sha256 of every document row.

    A word is removed if a window of ``window`` words that covers it also starts in a document with a
    smaller doc_id. Null and empty texts, and texts shorter than a window, lose nothing. Rows without
    an id neither lose words nor count as earlier documents. Rows that repeat an id are not earlier
    than each other. Other columns are not read; an empty table gives no rows.
    """
    n_bytes = _size(documents)
    docs = _narrow(documents, n_bytes)
    steps, repeats = _repeats(docs, window, n_bytes)
    return docs.groupBy(BUCKET).cogroup(repeats.groupBy(BUCKET)).applyInArrow(lambda t, h: steps.digest(t, h), "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, with removed words cut out of ``text``; texts without repeats stay byte for byte.

    Which words go is as in ``removed_words``, with nulls, empty texts, repeated rows and ids treated alike;
    ``n_chars``, where it is a column, follows the text. A column may have any name, also one used here.
    """
    n_bytes = _size(documents)
    steps, repeats = _repeats(_narrow(documents, n_bytes), window, n_bytes)
    rows = apart(documents, BUCKET)
    wide = _bucketed(rows, 1 + n_bytes // BUCKET_BYTES)
    return wide.groupBy(BUCKET).cogroup(repeats.groupBy(BUCKET)).applyInArrow(lambda t, h: steps.cut(t, h), rows.schema).toDF(*documents.columns)


_LEADS = "".join(f" || ' ' || lead(word, {k}) OVER x" for k in range(1, WINDOW))
ORACLE_SQL = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM split),
grams AS (SELECT doc_id, i, word{_LEADS} AS g FROM words WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
least AS (SELECT g, min(doc_id) AS m FROM grams WHERE g IS NOT NULL GROUP BY g),
hit AS (SELECT doc_id, i, i AS h FROM grams JOIN least USING (g) WHERE m < doc_id),
mark AS (
  SELECT doc_id, i, word, max(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN hit USING (doc_id, i)
), run AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM mark),
figures AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM run GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN figures USING (doc_id)"""
