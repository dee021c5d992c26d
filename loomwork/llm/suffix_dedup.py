"""Suffix-array dedup by a difference-cover algorithm, distributed by anchors.

Equal windows hold equal bytes, so the least hash of their short byte strings, their anchor, is the
same. Places therefore split exactly by anchor: windows of different anchors never compare, and an
anchor that occurs once in the corpus holds no repeat.

1. Equal texts become one, that of the first document (a repeat of a whole text is a repeat throughout).
2. A scan finds the anchors of each text; a shuffle of their hashes finds those that occur twice.
3. A second scan cuts what lies around those anchors into runs of windows of one anchor. Runs go to
   parts by anchor; equal runs of a slice or a part are kept once, at the first place. Anchors with
   very many places cut by longer byte strings instead, so no group grows without end.
4. Each part sorts the suffixes of its runs. Symbols are ninths of a window, read at each byte: the triples
   of places 1 and 2 modulo 3 are sorted and named, the names are strings to sort again, until a name
   stands for a window; the places 0 modulo 3 are then sorted by symbol and following rank and merged
   with the others. Neighbours with equal window-long prefixes form groups, and all places of a group
   but the first in document order start a repeat.
5. The repeats meet their texts again by slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.scratch import forget, parts, stored
from loomwork.llm.textnp import buffer_of, cover, mix, slices

WINDOW = 100
SLICE = 2 << 20
"""Bytes of text of a slice, the unit that hashes and repeats belong to."""
PART = 16 << 20
"""Bytes of corpus for each part of the anchors."""
BATCH = 3 << 18
"""Bytes of runs whose suffixes are sorted together; no anchor is cut."""
HOT = 10_000
"""Places from which an anchor's runs are cut by longer byte strings."""

_B, _B_INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FIRST = -(1 << 63)
_STEP = 1 << 19


def _gram(window: int, hot: bool) -> int:
    return max(1, window * (8 if hot else 4) // 10)


def _hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each place that has them."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    power, back = np.full(n + 1, _B, np.uint64), np.full(n - k + 1, _B_INVERSE, np.uint64)
    power[0] = back[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(power, dtype=np.uint64)[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * np.cumprod(back, dtype=np.uint64)) | np.uint64(1)


def _sliding(values: np.ndarray, w: int, how: np.ufunc) -> np.ndarray:
    """``how`` over w values from each place that has them."""
    span, out = 1, values
    while 2 * span <= w:
        out = how(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return how(out[: len(values) - w + 1], out[rest : rest + len(values) - w + 1]) if rest else out


def anchors(data: np.ndarray, room: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window at each place (0 where ``room``, the bytes left of the text, is too small), and the hashes of the places chosen."""
    if len(data) < window:
        return np.zeros(len(data), np.uint64), np.zeros(0, np.uint64)
    w = window - k + 1
    hashed = _hashes(data, k)
    least = _sliding(hashed, w, np.minimum)
    least[room[: len(least)] < window] = 0
    edge = np.zeros(w - 1, np.uint64)
    chosen = hashed == _sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    return np.concatenate([least, np.zeros(len(data) - len(least), np.uint64)]), hashed[chosen]


class _Texts:
    """The texts of a slice in document order, one after another, in steps that bound the arrays over them."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        order = np.lexsort((np.array([d for d in table.column("digest").to_pylist()], object), table.column("id").to_numpy()))
        table = table.take(pa.array(order))
        self.id = table.column("id").to_numpy()
        self.digest = table.column("digest").to_pylist()
        self.buf, self.offs = buffer_of(table.column("text"))

    def steps(self, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first byte, bytes, bytes left of the text at each): steps overlap by a window less one, whose places belong to the next."""
        at, n = 0, len(self.buf)
        end = np.repeat(self.offs[1:], np.diff(self.offs)) if n <= _STEP else None
        while at < n:
            to = min(n, at + _STEP + window - 1)
            if end is not None:
                left = end - np.arange(n)
            else:
                place = np.arange(at, to)
                left = self.offs[np.searchsorted(self.offs, place, "right")] - place
            if to < n:
                left = np.where(np.arange(at, to) < at + _STEP, left, 0)
            yield at, self.buf[at:to], left
            at = n if to == n else at + _STEP


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, number)), *part.columns], names=["slice", *part.schema.names])


_ANCHORS = "part int, slice long, hashes binary, counts binary"


def _anchor_rows(window: int, n_parts: int):
    def emit(number: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = _Texts(table)
        found = [anchors(data, room, window, _gram(window, False))[1] for _, data, room in texts.steps(window)]
        hashed, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        part = (mix(hashed) % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
        count = np.minimum(count, HOT).astype("<u2")
        some = [p for p in range(n_parts) if cuts[p] < cuts[p + 1]]
        rows = [(hashed[order[cuts[p] : cuts[p + 1]]].tobytes(), count[order[cuts[p] : cuts[p + 1]]].tobytes()) for p in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "slice", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("slice").to_numpy()
            cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else []
            for a, z in zip(cuts, [*cuts[1:], len(number)]):
                yield from emit(int(number[a]), pa.Table.from_batches([batch.slice(a, z - a)]))

    return run


def _twice(table: pa.Table) -> pa.Table:
    """The anchors of a part that occur twice, by slice; the least bit of the marks tells those with very many places."""
    number = table.column("slice").to_pylist()
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("counts").to_pylist()]).astype(np.int64)
    size = np.cumsum([len(x) for x in hashes])
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct))[at]
    out = []
    for n, x, a, z in zip(number, hashes, [0, *size[:-1].tolist()], size.tolist()):
        some = total[a:z] > 1
        if some.any():
            out.append((n, x[some].tobytes(), (total[a:z][some] >= HOT).tobytes()))
    return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary())], names=["slice", "hashes", "hot"])


_RUNS = "part int, slice long, bytes binary, length binary, id binary, tie binary, start binary, text binary, anchor binary"
_SPANS = "slice long, text binary, start binary, stop binary"


def _packed(columns: dict[str, list], names: str, n: int) -> pa.Table:
    kinds = {x.split()[0]: {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in names.split(", ")}
    return pa.table([pa.array(columns.get(k, [None] * n), t) for k, t in kinds.items()], names=list(kinds))


def _tie(digest: str) -> int:
    return int(digest[:16], 16) - (1 << 63)


def _cut_runs(window: int, n_parts: int):
    """Runs of a slice around anchors that occur twice, by part; those equal to an earlier one of the slice come out as spans (part -1)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _packed({}, _RUNS, 0)
        texts, number = _Texts(left), left.column("slice")[0].as_py()
        known = np.concatenate([np.frombuffer(x, np.uint64) for x in right.column("hashes").to_pylist()])
        hot = np.concatenate([np.frombuffer(x, bool) for x in right.column("hot").to_pylist()])
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        body, begin, stop, keys = texts.buf.tobytes(), [], [], []
        for at, data, room in texts.steps(window):
            key, _ = anchors(data, room, window, _gram(window, False))
            where = np.minimum(np.searchsorted(known, key), len(known) - 1)
            held = (known[where] == key) & (key > 0)
            if not held.any():
                continue
            many = held & hot[where]
            if many.any():
                longer, _ = anchors(data, room, window, _gram(window, True))
                key = np.where(many, mix(longer), key)
            first = held & np.append(True, ~held[:-1] | (key[1:] != key[:-1]))
            last = held & np.append(~held[1:] | (key[1:] != key[:-1]), True)
            begin.append(np.flatnonzero(first) + at)
            stop.append(np.flatnonzero(last) + at + 1)
            keys.append(key[first])
        if not begin:
            return _packed({}, _RUNS, 0)
        begin, stop, key = np.concatenate(begin), np.concatenate(stop), np.concatenate(keys)
        text = np.searchsorted(texts.offs, begin, "right") - 1
        seen: set[bytes] = set()
        new = np.zeros(len(begin), bool)
        held_bytes = []
        for i, (a, z) in enumerate(zip(begin.tolist(), (stop + window - 1).tolist())):
            x = body[a:z]
            if x not in seen:
                seen.add(x)
                new[i] = True
                held_bytes.append(x)
        out: dict[str, list] = {k.split()[0]: [] for k in _RUNS.split(", ")}

        def add(part: int, some: np.ndarray, data: bytes) -> None:
            at = texts.offs[text[some]]
            row = {
                "part": part, "slice": number, "bytes": data, "length": (stop - begin)[some].astype("<i4").tobytes(), "start": (begin[some] - at).astype("<i8").tobytes(),
                "text": text[some].astype("<i4").tobytes(), "id": texts.id[text[some]].astype("<i8").tobytes(), "tie": ties[text[some]].tobytes(), "anchor": key[some].tobytes(),
            }
            for k, v in row.items():
                out[k].append(v)

        ties = np.array([_tie(d) for d in texts.digest], "<i8")
        kept = np.flatnonzero(new)
        part = (mix(key[kept] ^ _B) % np.uint64(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            some = order[cuts[p] : cuts[p + 1]]
            add(p, kept[some], b"".join([held_bytes[i] for i in some.tolist()]))
        if len(kept) < len(new):
            add(-1, np.flatnonzero(~new), b"")
        return _packed(out, _RUNS, 0)

    return run


def suffix_ranks(symbols: np.ndarray, span: int, window: int) -> np.ndarray:
    """Rank of the suffix at each place of a string of symbols (1 or more) of ``span`` bytes each, right for ``window`` bytes.

    The difference cover {1, 2} modulo 3: sampled triples are sorted and named; the names of the two
    classes are the string of the next level unless a name stands for a window; places 0 modulo 3
    are sorted by symbol and next rank; both orders are merged.
    """
    n = len(symbols)
    padded = np.append(symbols, np.zeros(3, np.int64))
    sample = np.concatenate([np.arange(1, n, 3), np.arange(2, n, 3)])
    if not len(sample):
        return np.zeros(n, np.int64)
    pair = np.unique(padded[sample] << 31 | padded[sample + 1], return_inverse=True)[1].astype(np.int64)
    triple = pair << 31 | padded[sample + 2]
    order = np.argsort(triple)
    new = np.append(True, triple[order[1:]] != triple[order[:-1]])
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(new)
    if 3 * span < window and name[order[-1]] < len(sample):
        name = suffix_ranks(name, 3 * span, window) + 1
        order = np.argsort(name)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(padded[zero] << 31 | rank[zero + 1])]
    by = sample[order]
    one, two = by[by % 3 == 1], by[by % 3 == 2]
    less = np.searchsorted(padded[one] << 31 | rank[one + 1], padded[zero] << 31 | rank[zero + 1])
    pairs = np.unique(np.concatenate([padded[two] << 31 | padded[two + 1], padded[zero] << 31 | padded[zero + 1]]), return_inverse=True)[1] if len(two) else np.zeros(len(zero), np.int64)
    less += np.searchsorted(pairs[: len(two)] << 31 | rank[two + 2], pairs[len(two) :] << 31 | rank[zero + 2])
    less = np.maximum.accumulate(less)
    merged = np.empty(n, np.int64)
    merged[zero] = np.arange(len(zero)) + less
    merged[by] = np.arange(len(by)) + np.searchsorted(less, np.arange(len(by)), "right")
    return merged


def later_windows(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Of the given places, ascending, those whose window also starts at an earlier one of them: neighbours in suffix order with equal prefixes."""
    span = -(-window // 9)
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * span, np.uint8)])
    code = np.zeros(n, np.int64)
    for at in range(0, span, 4):  # names of the symbols, four bytes at a time
        some = np.zeros(n, np.int64)
        for k in range(at, min(at + 4, span)):
            some = some << 8 | padded[k : k + n]
        code = np.unique(code << 32 | some, return_inverse=True)[1].astype(np.int64)
    rows = -(-n // span)
    table = np.zeros((span, rows + 12), np.int64)  # phase by phase, with room after each
    place = np.arange(n)
    table[place % span, place // span] = code + 1
    ranks = suffix_ranks(table.reshape(-1) + 1, span, window).reshape(span, rows + 12)[starts % span, starts // span]
    order = starts[np.argsort(ranks)]
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in sorted({*range(0, window - span + 1, span), window - span}):
        symbol = code[order + k]
        same &= symbol[1:] == symbol[:-1]
    cuts = np.flatnonzero(np.append(True, ~same))
    first = np.repeat(np.minimum.reduceat(order, cuts), np.diff(np.append(cuts, len(order))))
    return np.sort(order[order != first])


def _sorted_part(window: int):
    """Spans of windows of a part that start a repeat."""

    def run(table: pa.Table) -> pa.Table:
        col = {k: np.concatenate([np.frombuffer(x, t) for x in table.column(k).to_pylist()]) for k, t in (("length", "<i4"), ("id", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("text", "<i4"), ("anchor", np.uint64))}
        bodies = table.column("bytes").to_pylist()
        per = [len(x) // 4 for x in table.column("length").to_pylist()]
        number = np.repeat(table.column("slice").to_numpy(), per)
        size = col["length"].astype(np.int64) + window - 1
        row = np.repeat(np.arange(len(per)), per)
        begin = np.cumsum(size) - size
        begin -= np.repeat(begin[np.cumsum(per) - per], per)
        order = np.lexsort((col["start"], col["tie"], col["id"]))  # document order
        batch = np.zeros(len(order), np.int64)
        keys, at = np.unique(col["anchor"], return_inverse=True)
        batch = (np.cumsum(np.bincount(at, weights=size, minlength=len(keys))) // BATCH).astype(np.int64)[at]
        order = order[np.argsort(batch[order], kind="stable")]
        out: dict[str, list] = {"slice": [], "text": [], "start": [], "stop": []}
        for some in np.split(order, np.flatnonzero(np.diff(batch[order])) + 1):
            seen, kept, again, pieces = set(), [], [], []
            for i, r, a, z in zip(some.tolist(), row[some].tolist(), begin[some].tolist(), (begin + size)[some].tolist()):
                x = bodies[r][a:z]
                if x in seen:
                    again.append(i)
                else:
                    seen.add(x)
                    kept.append(i)
                    pieces.append(x)
            kept = np.array(kept, np.int64)
            offs = np.concatenate([[0], np.cumsum(size[kept])])
            places = np.repeat(offs[:-1], col["length"][kept]) + np.arange(int(col["length"][kept].sum())) - np.repeat(np.cumsum(col["length"][kept]) - col["length"][kept], col["length"][kept])
            late = later_windows(np.frombuffer(b"".join(pieces), np.uint8), places, window)
            own = np.searchsorted(offs, late, "right") - 1
            opens = np.append(True, (late[1:] != late[:-1] + 1) | (own[1:] != own[:-1])) if len(late) else np.zeros(0, bool)
            closes = np.append(opens[1:], True) if len(late) else opens
            which = kept[own[opens]]
            start = col["start"][which] + late[opens] - offs[own[opens]]
            stop = start + late[closes] - late[opens] + 1
            again = np.array(again, np.int64)
            which = np.concatenate([which, again])
            start, stop = np.concatenate([start, col["start"][again]]), np.concatenate([stop, col["start"][again] + col["length"][again]])
            by = np.argsort(number[which], kind="stable")
            which, start, stop = which[by], start[by], stop[by]
            cuts = np.flatnonzero(np.append(True, number[which][1:] != number[which][:-1])) if len(which) else np.zeros(0, np.int64)
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(which)]):
                out["slice"].append(int(number[which[a]]))
                out["text"].append(col["text"][which[a:z]].astype("<i4").tobytes())
                out["start"].append(start[a:z].astype("<i8").tobytes())
                out["stop"].append(stop[a:z].astype("<i8").tobytes())
        return _packed(out, _SPANS, 0)

    return run


def _cut_texts(window: int):
    """What is left of the texts of a slice that have repeats."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, out = _Texts(left), []
        if left.num_rows and right.num_rows:
            text, start, stop = (np.concatenate([np.frombuffer(x, t) for x in right.column(k).to_pylist()]) for k, t in (("text", "<i4"), ("start", "<i8"), ("stop", "<i8")))
            order = np.argsort(text, kind="stable")
            cuts = np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1]))
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                some, t = order[a:z], int(text[order[a]])
                data = texts.buf[texts.offs[t] : texts.offs[t + 1]]
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, start[some], 1)
                np.add.at(edge, stop[some] + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(np.count_nonzero(gone & ~np.append(False, gone[:-1])))
                out.append((texts.digest[t], int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["digest", "gone", "runs", "rest"])

    return run


def removed_bytes(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document row.

    A byte is removed if a string of ``window`` bytes that covers it also starts earlier: in a smaller
    document, or at an earlier place of the same one. Null and empty texts have no bytes. Rows that repeat
    an id count as documents one after another, in the order of their texts' SHA-256; rows without an id
    come first, as the smallest long would. Other columns are not read; an empty table gives no rows.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    order = F.coalesce("doc_id", F.lit(_FIRST))
    known = stored(rows.groupBy("digest", "doc_id").agg(F.first(F.octet_length("text")).cast("long").alias("n_bytes"), F.count("*").alias("rows")), "texts-of-rows")
    least = known.groupBy("digest").agg(F.min(order).alias("id"))
    long = rows.where(F.octet_length("text") >= window)
    texts = long.groupBy("digest").agg(F.min(order).alias("id"), F.first("text").alias("text"))
    sliced = stored(texts.mapInArrow(_sliced, "slice long, digest string, id long, text string"), "slices")
    total = known.groupBy("digest").agg(F.first("n_bytes").alias("n")).agg(F.sum("n")).first()[0] or 0
    n_parts = max(1, parts(spark), total // PART)
    found = sliced.mapInArrow(_anchor_rows(window, n_parts), _ANCHORS).repartition(n_parts, "part")
    twice = stored(found.groupBy("part").applyInArrow(_twice, "slice long, hashes binary, hot binary"), "anchors")
    cut = stored(sliced.groupBy("slice").cogroup(twice.groupBy("slice")).applyInArrow(_cut_runs(window, n_parts), _RUNS), "runs")
    again = cut.where("part < 0").mapInArrow(_spans_of_runs, _SPANS)
    late = cut.where("part >= 0").repartition(n_parts, "part").groupBy("part").applyInArrow(_sorted_part(window), _SPANS)
    spans = stored(again.unionByName(late), "spans")
    forget(twice)
    forget(cut)
    left = stored(sliced.groupBy("slice").cogroup(spans.groupBy("slice")).applyInArrow(_cut_texts(window), "digest string, gone long, runs long, rest string"), "cut-texts")
    forget(sliced)
    forget(spans)
    each = known.join(least, "digest").join(left, "digest", "left").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    copy = (F.col("k") > 1) | (order != F.col("id"))
    whole = copy & (F.col("n_bytes") >= window)
    return each.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).when(copy, F.lit(0)).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).when(copy, F.lit(0)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).when(copy, F.col("digest")).otherwise(F.coalesce("rest", "digest")).alias("kept_sha256"),
    )


def _spans_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stop = [(np.frombuffer(a, "<i8") + np.frombuffer(n, "<i4")).tobytes() for a, n in zip(batch.column("start").to_pylist(), batch.column("length").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("text"), batch.column("start"), pa.array(stop, pa.binary())], names=["slice", "text", "start", "stop"])


ORACLE_SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, length(h) // 2 AS n FROM texts),
places AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM sized WHERE n >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM places) WHERE k > 1),
marked AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100 AS opens FROM late),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT g.doc_id, sum(z - a) AS gone, count(*) AS runs, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(z) AS last
        FROM gaps g JOIN sized s ON g.doc_id = s.doc_id GROUP BY g.doc_id)
SELECT s.doc_id, s.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(runs, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM sized s LEFT JOIN cut c ON s.doc_id = c.doc_id
"""
