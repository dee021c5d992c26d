"""Chat formatting by quotation linking: conversations in reply order, without their quotes.

Lines that start with ``>`` marks are quotes, as deep as they have marks. Runs of lines of one depth
are passages; a passage is normalised (marks gone, A-Z lower-cased, white space made single spaces)
and hashed. Hashes of quoted passages join the hashes of what earlier messages of the conversation
wrote themselves; a message replies to the latest message that its shallowest quotes come from, or,
where none is found, to the message before it. Replies form trees; a conversation is ordered by them.

Quotes and originals meet in order of turns within (conversation, hash), so a conversation spreads by
content and no list of turns is held; both are first brought to one row a hash, turn and depth. Depths and
roots come from pointer doubling over narrow rows, each step a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.scratch import forget, stored

_WHITE = " \t\n\x0b\x0c\r"
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def passages(text: str | None) -> list[tuple[int, str]]:
    """(depth, text) of the runs of lines of one quote depth; blank lines end a run, ``>`` marks and the blanks among them are gone."""
    out: list[tuple[int, list[str]]] = []
    fresh = True
    for line in (text or "").split("\n"):
        depth, at = 0, 0
        if line.lstrip(_WHITE).startswith(">"):
            for at, c in enumerate(line):
                if c == ">":
                    depth += 1
                elif c not in _WHITE:
                    break
            else:
                at = len(line)
        body = line[at:] if depth else line
        if not body.strip(_WHITE):
            fresh = True
            continue
        if fresh or out[-1][0] != depth:
            out.append((depth, []))
        out[-1][1].append(body)
        fresh = False
    return [(d, "\n".join(lines)) for d, lines in out]


def normalised(passage: str) -> str:
    return " ".join(passage.translate(_FOLD).replace("\x0b", " ").replace("\x0c", " ").split())


_PARTS = "conv_id long, turn long, role string, whole string, own string, parts array<struct<depth:int,part:string>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("depth", pa.int32()), ("part", pa.string())]))
    for batch in batches:
        own, parts = [], []
        for text in batch.column("text").to_pylist():
            found = passages(text)
            own.append("\n\n".join(p for d, p in found if d == 0) if any(d for d, _ in found) else text or "")
            parts.append([{"depth": d, "part": normalised(p)} for d, p in found])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), batch.column("text"), pa.array(own, pa.string()), pa.array(parts, kind)], names=["conv_id", "turn", "role", "whole", "own", "parts"])


def _hash(part: Column) -> Column:
    return F.unhex(F.sha2(part, 256))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """One row a message (conv_id, turn): role, n_quotes, n_linked, reply_to, root, depth, position and text without quotes.

    ``reply_to`` is an earlier turn or null for a first message; ``root`` the first message of its tree and
    ``depth`` the replies between; ``position`` counts messages of the conversation in the order root, depth,
    turn, so that each message comes after the one it replies to. Rows that repeat (conv_id, turn)
    are merged: the one with the smallest (role, text) stays. Rows without conv_id or turn are left out of
    conversations and not returned. Null and empty texts quote nothing. Other columns are not read.
    """
    rows = conversations.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    rows = rows.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    rows = rows.groupBy("conv_id", "turn").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"), "role", "text")).alias("m"))
    rows = rows.select("conv_id", "turn", "m.role", "m.text")
    messages = stored(rows.mapInArrow(_parse, _PARTS), "messages")
    parts = messages.select("conv_id", "turn", F.explode("parts").alias("p")).select("conv_id", "turn", "p.depth", _hash(F.col("p.part")).alias("hash"))
    each = parts.groupBy("conv_id", "hash", "turn", "depth").count().drop("count").withColumn("own", (F.col("depth") == 0).cast("int"))
    along = Window.partitionBy("conv_id", "hash").orderBy("turn", "own").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.max(F.when(F.col("own") == 1, F.col("turn"))).over(along)  # a message's own passages stand after its quotes
    found = each.withColumn("source", latest).where("own = 0").select("conv_id", "turn", "depth", "source")
    answered = found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"),
        F.count("source").alias("n_linked"),
        F.max(F.when(F.col("source").isNotNull(), F.struct(-F.col("depth"), F.col("source").alias("source"))))["source"].alias("source"),
    )
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    joined = messages.select("conv_id", "turn", "role", F.col("own").alias("text"), before.alias("before")).join(answered, ["conv_id", "turn"], "left")
    linked = joined.withColumn("reply_to", F.coalesce("source", "before")).withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_quotes", "n_linked")}).drop("source", "before")
    linked = stored(linked, "replies")
    trees = _trees(linked.select("conv_id", "turn", "reply_to"))
    order = Window.partitionBy("conv_id").orderBy("root", "depth", "turn")
    placed = trees.withColumn("position", F.row_number().over(order).cast("long"))
    return linked.join(placed, ["conv_id", "turn"]).select("conv_id", "turn", "role", "n_quotes", "n_linked", "reply_to", "root", "depth", "position", "text")


def _trees(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) by pointer doubling: each step doubles how far up a message has looked; those at their root rest."""
    first = F.col("reply_to").isNull()
    ups = stored(replies.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("root"), F.when(first, 0).otherwise(1).cast("long").alias("depth"), first.alias("done")), "trees")
    while ups.where("not done").limit(1).count():
        above = ups.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"), F.col("done").alias("there"))
        moved = ups.where("not done").join(above, ["conv_id", "root"]).select("conv_id", "turn", F.col("up").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        new = stored(ups.where("done").unionByName(moved), "trees")
        forget(ups)
        ups = new
    return ups.drop("done")


def transcripts(linked: DataFrame) -> DataFrame:
    """Rows in reply order (conversation, position), sorted across the cluster; a transcript is read by scanning a conversation's range."""
    return linked.repartitionByRange("conv_id", "position").sortWithinPartitions("conv_id", "position")


def digest(linked: DataFrame) -> DataFrame:
    return linked.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def with_quotes(conversations: DataFrame) -> DataFrame:
    """The conversations as a mail client would store them: each message but the first two quotes, in full, an earlier one.

    That is the one before, or in conversations of odd id the one before that. What a message quotes is given
    in ``quoted``; its own text follows after a blank line.
    """
    back = F.when(F.col("conv_id") % 2 == 0, 1).otherwise(2)
    later = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") - back).alias("quoted"))
    said = conversations.select("conv_id", F.col("turn").alias("quoted"), F.coalesce("text", F.lit("")).alias("said"))
    both = later.join(said, ["conv_id", "quoted"], "left")
    marked = F.concat(F.lit("> "), F.replace("said", F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"), F.col("text"))
    return both.select("conv_id", "turn", "role", F.when((F.col("turn") >= 2) & F.col("said").isNotNull(), marked).otherwise(F.col("text")).alias("text"), "quoted")


QUOTED_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(text, '') AS text, turn - CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END AS quoted FROM conversations),
p AS (SELECT DISTINCT conv_id, turn, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\s+', ' ', 'g')) AS h
  FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '\n[ \t]*(?:\n[ \t]*)*\n|^[ \t]*\n|\n[ \t]*$')) AS part FROM m) WHERE trim(part, E' \t\n') <> ''),
q AS (SELECT m.conv_id, m.turn, p.h, (SELECT max(o.turn) FROM p o WHERE o.conv_id = m.conv_id AND o.h = p.h AND o.turn < m.turn) AS source FROM m JOIN p ON p.conv_id = m.conv_id AND p.turn = m.quoted WHERE m.turn >= 2),
f AS (SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked, max(source) AS source FROM q GROUP BY ALL),
r AS (SELECT m.conv_id, m.turn, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(source, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn)) AS reply_to FROM m LEFT JOIN f USING (conv_id, turn)),
t AS (SELECT conv_id, turn, turn AS root, CAST(0 AS BIGINT) AS depth FROM r WHERE reply_to IS NULL UNION ALL SELECT r.conv_id, r.turn, t.root, t.depth + 1 FROM r JOIN t ON r.conv_id = t.conv_id AND r.reply_to = t.turn)
SELECT conv_id, turn, n_quotes, n_linked, coalesce(reply_to, -1) AS reply_to, root, depth, row_number() OVER (PARTITION BY conv_id ORDER BY root, depth, turn) AS position FROM r JOIN t USING (conv_id, turn)
"""
