"""Near copies: documents whose five-word shingle sets have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash fingerprints of the shingle sets first: the pigeonring chain of ``simhash_dedup`` finds all
pairs that differ in at most three bits. At 0.8 fingerprints differ in about ten of 64 bits, and a chain that loses few
of those (15 bits) probes thousands of keys a fingerprint. So pairs beyond three bits are found by MinHash bands:
``BANDS`` keys of ``ROWS`` minima each lose a pair of similarity 0.8 with probability ``(1 - 0.8**ROWS) ** BANDS``, under
one in two thousand. All candidates are verified on the whole shingle sets, in two steps: nodes against one leader (the
smallest fingerprint that is close, the smallest node of a band key); then what is left between groups, which is every
close pair of fingerprints and, for nodes that share a band key with another group, an exact set-similarity join.

Texts with equal sets are one node, named by a hash of the set, so copies never pair, and neither
repeated nor missing document ids matter. Only sets of nodes that have a candidate leave the scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.components import components
from loomwork.llm.scratch import apart, forget, measured, stored
from loomwork.llm.simhash_dedup import _FOLD, close_pairs, majority_bits
from loomwork.llm.textnp import Words, buffer_of, mix, slices

SHINGLE, BANDS, ROWS = 5, 20, 5
SHARE = (4, 5)
"""The least similarity, as a fraction."""
WIDTH = 1.04
"""Sizes of a class differ by less than this factor."""
WORDS = 8
"""64-bit words of a set's parities."""
MASK = 1 << 22
"""Bits of the filter that keeps texts of no candidate from leaving the second scan, and sets of no pair from being shuffled."""
BUCKETS, PORTION = 1 << 23, 1 << 18
"""Buckets that shingles are counted in, a byte each; shingles that a task handles at a time."""

_KEY = ["_none", "_id", "_text"]
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix((np.arange(BANDS * ROWS, dtype=np.uint64) + np.uint64(1)) * _GOLD)
_TURNS = mix(_SEEDS) | np.uint64(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the n + 1 offsets of the texts.

    A text of fewer than five words has one shingle, a wordless one none. A-Z are folded.
    """
    buf, offs = buffer_of(column)
    words = Words(_FOLD[buf], offs)
    word = words.hashes()
    n = np.where(words.counts > 0, np.maximum(words.counts - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    first = words.first[:-1][row] + np.arange(int(n.sum())) - (np.cumsum(n) - n)[row]
    end, total = words.first[1:][row], np.zeros(len(row), np.uint64)
    for k in range(SHINGLE):
        held = first + k < end
        total[held] = mix(total[held] * _GOLD + word[first[held] + k] + np.uint64(k + 1))
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    new = np.append(True, (row[1:] != row[:-1]) | (total[1:] != total[:-1])) if len(row) else np.zeros(0, bool)
    return total[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))])


def _runs(values: np.ndarray, offs: np.ndarray, how: np.ufunc) -> np.ndarray:
    """``how`` over each text's values; 0 for a text without any."""
    out = np.zeros(len(offs) - 1, np.uint64)
    held = np.flatnonzero(np.diff(offs))
    if len(held):
        out[held] = how.reduceat(values, offs[:-1][held])
    return out


def _nodes(hashed: np.ndarray, offs: np.ndarray) -> np.ndarray:
    size = np.diff(offs).astype(np.uint64)
    return mix(_runs(mix(hashed ^ _GOLD), offs, np.add) + size * _GOLD).view(np.int64)


def _bands(hashed: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Band keys of each text, a row a text."""
    out = np.zeros((len(offs) - 1, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(offs) - 1, np.uint64(b + 1))
        for r in range(b * ROWS, b * ROWS + ROWS):
            key = mix(key * _GOLD + _runs((hashed ^ _SEEDS[r]) * _TURNS[r], offs, np.minimum))
        out[:, b] = key
    return out.view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashed, offs = shingle_sets(part.column("text"))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), pa.array(_bands(hashed, offs).reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(_nodes(hashed, offs)), pa.array(np.diff(offs).astype(np.int64)), pa.array(majority_bits(hashed, offs).view(np.int64)), bands], names=["doc_id", "text_hash", "node", "n", "fp", "bands"])


def _sets(mask: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashed, offs = shingle_sets(part.column("text"))
                node = _nodes(hashed, offs)
                some = np.flatnonzero(mask[node & (MASK - 1)])
                sets = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(hashed.view(np.int64))).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), sets, _parities(sets)], names=["node", "hashes", "odd"])

    return run


def _parities(sets: pa.ListArray) -> pa.Array:
    """``64 * WORDS`` bits of each set: whether an odd number of its hashes falls on the bit. Two sets differ in at least as many hashes as bits."""
    n, bits = len(sets), 64 * WORDS
    row = np.repeat(np.arange(n), sets.value_lengths().to_numpy(zero_copy_only=False))
    bit = (sets.flatten().to_numpy().view(np.uint64) >> np.uint64(20)) % np.uint64(bits)
    odd = np.bincount(row * bits + bit.astype(np.int64), minlength=n * bits) & 1
    packed = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * WORDS), pa.array(packed))


def _similar(common: Column, u: Column, v: Column) -> Column:
    return common * SHARE[1] >= (u + v - common) * SHARE[0]


def _mask(nodes: DataFrame, name: str = "node") -> np.ndarray:
    """A filter of ``MASK`` bits that lets all these nodes through, and few others."""
    mask = np.zeros(MASK, bool)
    mask[nodes.select(F.col(name).bitwiseAND(F.lit(MASK - 1)).alias("at")).distinct().toArrow().column("at").to_numpy()] = True
    return mask


def _masked(mask: np.ndarray, passing: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(mask[batch.column("node").to_numpy() & (MASK - 1)] == passing))

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets are similar; only sets of nodes in pairs are shuffled."""
    one, other = (sets.select("node", "hashes").mapInArrow(_masked(_mask(pairs, a)), "node long, hashes array<long>").toDF(a, "h" + a) for a in "uv")
    common = F.size(F.array_intersect("hu", "hv"))
    return pairs.select("u", "v").join(one, "u").join(other, "v").where(_similar(common, F.size("hu"), F.size("hv"))).select("u", "v")


def _chain_led(prints: DataFrame, chain: DataFrame) -> DataFrame:
    """Pairs of nodes with a leader: the smallest node of their own fingerprint, and that of the smallest fingerprint close to theirs."""
    least = prints.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("least"))
    own = prints.join(least, "fp").where(F.col("node") > F.col("least.node")).select(F.col("least").alias("a"), F.struct("node", "n").alias("b"))
    ends = chain.groupBy("v").agg(F.min("u").alias("u"))
    for a, fp in (("a", "u"), ("b", "v")):
        ends = ends.join(least.select(F.col("fp").alias(fp), F.col("least").alias(a)), fp)
    both = own.union(ends.select("a", "b"))
    return both.where(_similar(F.least("a.n", "b.n"), F.col("a.n"), F.col("b.n"))).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def _chain_across(prints: DataFrame, chain: DataFrame) -> DataFrame:
    """(u, v, ru, rv): nodes of different roots, and of sizes that may be similar, whose fingerprints are close. ``prints`` has node, n, fp and root."""
    same = prints.groupBy("fp").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    both = chain.union(same)
    for a in "uv":
        both = both.join(prints.select(F.col("fp").alias(a), F.struct("node", "n", "root").alias("of_" + a)), a)
    u, v = ({c: F.col(f"of_{a}.{c}") for c in ("node", "n", "root")} for a in "uv")
    fits = (u["root"] != v["root"]) & ((F.col("u") != F.col("v")) | (u["node"] < v["node"])) & _similar(F.least(u["n"], v["n"]), u["n"], v["n"])
    return both.where(fits).select(u["node"].alias("u"), v["node"].alias("v"), u["root"].alias("ru"), v["root"].alias("rv"))


def _led(keys: DataFrame) -> DataFrame:
    """Pairs of each band key's smallest node with its other nodes of similar size: at most one a row of ``keys``."""
    least = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"))
    rows = keys.join(least, "key").where(F.col("node") > F.col("least.node"))
    return rows.where(_similar(F.least("n", "least.n"), F.col("n"), F.col("least.n"))).select(F.col("least.node").alias("u"), F.col("node").alias("v")).distinct()


def _least_common(u: Column, v: Column) -> Column:
    """How many shingles two sets of these sizes share at least where they are similar."""
    return F.ceil((u + v) * SHARE[0] / (SHARE[0] + SHARE[1]) - F.lit(1e-9)).cast("long")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(WIDTH)) + F.lit(1e-9)).cast("int")


def _smallest_of(size_class: Column) -> Column:
    """No size of the class is below this."""
    return F.greatest(F.lit(1), F.floor(F.pow(F.lit(WIDTH), size_class) - F.lit(1e-3))).cast("long")


def _portions(batches: Iterator[pa.RecordBatch], mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes that pass the mask, sizes and hashes of their sets, at most ``PORTION`` hashes (or one set) at a time."""
    for batch in batches:
        batch = batch.filter(pa.array(mask[batch.column("node").to_numpy() & (MASK - 1)]))
        node, lists = batch.column("node").to_numpy(), batch.column("hashes")
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        portion = (np.cumsum(n) - 1) // PORTION if len(n) else n
        for a, z in zip(np.searchsorted(portion, np.unique(portion)), np.searchsorted(portion, np.unique(portion), "right")):
            yield node[a:z], n[a:z], lists.slice(a, z - a).flatten().to_numpy()


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1)


def _tallied(mask: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for _, _, hashes in _portions(batches, mask):
            bucket, times = np.unique(_bucket(hashes), return_counts=True)
            total[bucket] += times.astype(np.int32)
        held = np.flatnonzero(total)
        for a in range(0, len(held), PORTION):
            some = held[a : a + PORTION]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "sets"])

    return run


def _first(mask: np.ndarray, tally: np.ndarray):
    """(node, n, at, token): the first shingles of each set by the tally of their bucket, then by hash. Those that are alone in their bucket are only counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, n, hashes in _portions(batches, mask):
            row, sets = np.repeat(np.arange(len(n)), n), tally[_bucket(hashes)]
            order = np.lexsort((hashes, sets, row))
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            longest = n - -(-n * SHARE[0] // SHARE[1]) + 1
            take = np.flatnonzero((at < longest[row]) & (sets[order] > 1))
            of = row[take]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[of], n[of], at[take], hashes[order][take])], names=["node", "n", "at", "token"])

    return run


def _prefixes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root, n, at, token): the first shingles of each node's set, in one order for all sets, the rarest about first.

    Any common order will do; this one goes by how many of the nodes' shingles fall in a shingle's bucket, up to 255. Buckets are
    counted before the shuffle, and prefixes made where the sets lie. Shingles of one root alone meet nothing and are dropped.
    """
    mask = _mask(nodes)
    counted = sets.select("node", "hashes").mapInArrow(_tallied(mask), "bucket int, sets int").groupBy("bucket").agg(F.sum("sets").alias("sets"))
    many = counted.where("sets > 1").select("bucket", F.least("sets", F.lit(255)).cast("short").alias("sets")).toArrow()
    tally = np.ones(BUCKETS, np.uint8)
    tally[many.column("bucket").to_numpy()] = many.column("sets").to_numpy().astype(np.uint8)
    made = sets.select("node", "hashes").mapInArrow(_first(mask, tally), "node long, n long, at long, token long")
    rows = measured(made.join(nodes.select("node", "root"), "node").select("node", "root", F.col("n").cast("int").alias("n"), F.col("at").cast("int").alias("at"), "token"), "first")
    met = rows.groupBy("token").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("token")
    return rows.join(met, "token")


def _across(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, ru, rv): pairs of ``nodes`` (node, n, root) of different roots that pass the filters of an exact set-similarity join.

    Two similar sets share a shingle among the first of both, in the common order: the smaller set's first
    ``n - least common + 1``, and as many of the larger one's as the smaller one's size allows. So each node is
    indexed once by its own prefix and class of sizes, and asks each class of sizes that may hold a smaller
    similar set, with the prefix for that class. Near copies that differ by words of their own have those first,
    so they meet nobody they are not similar to. A pair whose sets' parities differ in more bits than similar sets
    differ in shingles is no pair. A shingle's most frequent root is not joined with itself.
    """
    rows = measured(_prefixes(nodes, sets).join(sets.select("node", "odd"), "node"), "prefixes")
    n, at = F.col("n"), F.col("at")
    main = rows.groupBy("token", "root").agg(F.count("*").alias("rows")).groupBy("token").agg(F.max(F.struct("rows", "root")).alias("main"))
    rows = rows.join(main.select("token", F.col("main.root").alias("main")), "token")
    index = rows.where(at <= n - _least_common(n, n)).select("token", _size_class(n).alias("class"), F.col("node").alias("u"), F.col("root").alias("ru"), n.alias("nu"), at.alias("iu"), F.col("odd").alias("ou"), "main")
    least = F.ceil(n * SHARE[0] / SHARE[1] - F.lit(1e-9))
    asked = rows.withColumn("class", F.explode(F.sequence(_size_class(least), _size_class(n)))).where(at <= n - _least_common(_smallest_of(F.col("class")), n))
    asked = asked.select("token", "class", F.col("node").alias("v"), F.col("root").alias("rv"), n.alias("nv"), at.alias("iv"), F.col("odd").alias("ov"), (F.col("root") == F.col("main")).alias("of_main"))
    need = _least_common(F.col("nu"), F.col("nv"))
    unlike = sum((F.bit_count(F.col("ou")[k].bitwiseXOR(F.col("ov")[k])) for k in range(1, WORDS)), F.bit_count(F.col("ou")[0].bitwiseXOR(F.col("ov")[0])))
    fits = (unlike <= F.col("nu") + F.col("nv") - 2 * need) & (F.col("ru") != F.col("rv")) & ((F.col("nu") < F.col("nv")) | (F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v"))) & (F.col("iu") <= F.col("nu") - need) & (F.col("iv") <= F.col("nv") - need)
    some = index.where(F.col("ru") != F.col("main")).drop("main").join(asked, ["token", "class"]).where(fits)
    rest = index.where(F.col("ru") == F.col("main")).drop("main").join(asked.where("not of_main"), ["token", "class"]).where(fits)
    return some.unionByName(rest).select("u", "v", "ru", "rv").distinct()


def groups(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, root) of the nodes linked to another. ``prints`` has node, n, fp and bands, a row a node.

    Nodes are compared with the leaders of their fingerprint and of each of their band keys first; then close fingerprints of
    different groups are, and nodes that share a key with another group are joined by their shingle sets, across groups
    only, since a link inside a group joins nothing.
    """
    prints = stored(prints.where("n > 0"), "prints")
    chain = measured(close_pairs(prints.select("fp").distinct()), "chain")
    keys = prints.select("node", "n", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1").select("key")
    keys = measured(keys.join(shared, "key"), "keys")
    prints = prints.select("node", "n", "fp")
    close = chain.select(F.explode(F.array("u", "v")).alias("fp")).union(prints.groupBy("fp").agg(F.count("*").alias("nodes")).where("nodes > 1").select("fp")).distinct()
    near = measured(prints.join(close, "fp"), "near")
    needed = keys.select("node").union(near.select("node")).distinct()
    sets = texts.mapInArrow(_sets(_mask(needed)), "node long, hashes array<long>, odd array<long>").join(needed, "node", "left_semi")
    sets = measured(sets.groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("odd").alias("odd")), "shingles")
    led = measured(_chain_led(near, chain).union(_led(keys)).distinct(), "led")
    first = stored(components(_verified(led, sets)), "groups")
    rooted = keys.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("key")
    nodes = measured(rooted.join(mixed, "key", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root")), "nodes")
    forget(keys)
    beyond = _chain_across(near.join(first, "node", "left").withColumn("root", F.coalesce("root", "node")), chain)
    across = measured(_across(nodes, sets).union(beyond).distinct(), "across")
    ends = _verified(across.select("u", "v"), sets).join(across, ["u", "v"]).select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    second = stored(components(ends.distinct()), "groups").select(F.col("node").alias("root"), F.col("root").alias("top"))
    for table in (sets, near, across):
        forget(table)
    # every root of ``first`` is a node of it, but a node alone until now may be an end of ``second`` only
    joined = first.join(second, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = second.join(first.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return joined.union(alone)


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """One row, all columns, of each group linked by similar shingle sets: that of the smallest (doc_id, text hash).

    Rows without an id take part and come last. Wordless texts, null ones too, are one group. Rows equal in id and
    text keep one. A column may have any name, also one used here; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ident, text_hash = F.col("doc_id").cast("long"), F.xxhash64(text)
    rows = documents.select(ident.alias("doc_id"), text_hash.alias("text_hash"), text.alias("text"))
    scanned = stored(rows.mapInArrow(_scan, "doc_id long, text_hash long, node long, n long, fp long, bands array<long>"), "bands")
    prints = scanned.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    roots = groups(rows.select("text"), prints)
    key = F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_text"))
    named = scanned.select(key.alias("row"), "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
    counted = named.groupBy("root", "row").agg(F.count("*").alias("rows"))
    judged = measured(counted.join(named.groupBy("root").agg(F.min("row").alias("least")), "root").select("row.*", "rows", (F.col("row") == F.col("least")).alias("kept")), "judged")
    gone = stored(judged.where("not kept").select(*_KEY), "gone")
    several = stored(judged.where("kept and rows > 1").select(*_KEY), "several")
    mine = apart(documents, *_KEY, "node")
    keys = {"_none": ident.isNull(), "_id": F.coalesce(ident, F.lit(0)), "_text": text_hash}
    # most rows pass no filter of the keys that matter and stay where they lie; only the others' texts are shuffled, if those keys are too many to be sent
    mask = _mask(gone.union(several).select(F.xxhash64(*_KEY).alias("node")))
    marked = mine.withColumn("node", F.xxhash64(*keys.values()))
    sure, maybe = (marked.mapInArrow(_masked(mask, passing), marked.schema).select(*mine.columns) for passing in (False, True))
    rest = maybe.withColumns(keys).join(gone, _KEY, "left_anti")
    once = rest.join(several, _KEY, "left_semi").dropDuplicates(_KEY)
    kept = rest.join(several, _KEY, "left_anti").unionByName(once).select(*mine.columns)
    return sure.unionByName(kept).toDF(*documents.columns)
