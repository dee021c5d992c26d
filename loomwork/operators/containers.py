"""Whole containers whose sizes sum to an exact target, at most one a paper.

Of all such choices the one of most papers is taken, then the one whose papers and containers come first.
A stretch of neighbouring papers is described by its best choice for each total up to the target;
two stretches combine by adding totals and joining choices, which is associative (a max-plus convolution
that breaks ties by order). So each task reduces its own range of papers, and the results are joined in
order, ``FAN`` at a time. A result holds at most target + 1 choices of at most target papers, whatever
the number of papers; of a paper only the first container of each size matters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.scratch import kept

FAN = 16
Choice = tuple[tuple[str, int, int], ...]
_STATES = "part long, total int, choice array<struct<paper:string,container:long,size:int>>"
_ARROW = pa.schema([("part", pa.int64()), ("total", pa.int32()), ("choice", pa.list_(pa.struct([("paper", pa.string()), ("container", pa.int64()), ("size", pa.int32())])))])


def better(a: Choice, b: Choice | None) -> bool:
    """Whether a choice is of more papers than another one, or comes before it."""
    return b is None or (-len(a), a) < (-len(b), b)


def joined(first: dict[int, Choice], then: dict[int, Choice], target: int) -> dict[int, Choice]:
    """The best choice for each total from two stretches of papers, the first of which comes before the other."""
    out: dict[int, Choice] = {}
    for a, one in first.items():
        for b, other in then.items():
            if a + b <= target and better(one + other, out.get(a + b)):
                out[a + b] = one + other
    return out


def _rows(part: int, states: dict[int, Choice]) -> pa.RecordBatch:
    rows = [{"part": part, "total": t, "choice": [{"paper": p, "container": c, "size": n} for p, c, n in choice]} for t, choice in sorted(states.items())]
    return pa.RecordBatch.from_pylist(rows, _ARROW)


def _reduced(target: int):
    """The states of a task's papers; its rows are sorted by paper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        states: dict[int, Choice] = {0: ()}
        paper, options = None, {}
        for batch in batches:
            for p, size, container in zip(*(batch.column(c).to_pylist() for c in ("paper", "size", "container"))):
                if p != paper and options:
                    states, options = joined(states, options | {0: ()}, target), {}
                paper = p
                options[size] = ((p, container, size),)
        if options:
            states = joined(states, options | {0: ()}, target)
        yield _rows(TaskContext.get().partitionId(), states)

    return run


def _merged(target: int):
    def run(table: pa.Table) -> pa.Table:
        parts: dict[int, dict[int, Choice]] = {}
        for r in table.to_pylist():
            parts.setdefault(r["part"], {})[r["total"]] = tuple((c["paper"], c["container"], c["size"]) for c in r["choice"])
        states: dict[int, Choice] = {0: ()}
        for part in sorted(parts):
            states = joined(states, parts[part], target)
        return pa.Table.from_batches([_rows(min(parts) // FAN, states)])

    return run


def exact_choice(containers: DataFrame, target: int) -> DataFrame:
    """(paper, container, size) of the chosen (paper, container, size) rows; none where no choice sums to the target.

    Sizes below 1 or above the target and rows with nulls are left out. A container listed twice counts once at each of its sizes.
    """
    if target < 1:
        raise ValueError("the target must be 1 or more")
    keep = kept(containers.sparkSession)
    rows = containers.select(F.col("paper").cast("string").alias("paper"), F.col("container").cast("long").alias("container"), F.col("size").cast("int").alias("size"))
    first = keep(rows.where(F.col("size").between(1, target) & F.col("paper").isNotNull()).groupBy("paper", "size").agg(F.min("container").alias("container")).where("container is not null"), "options")
    states = keep(first.repartitionByRange("paper").sortWithinPartitions("paper", "size").mapInArrow(_reduced(target), _STATES), "states-0")
    turn = 0
    while states.select("part").distinct().count() > 1:
        turn += 1
        states = keep(states.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_merged(target), _STATES), f"states-{turn}")
    chosen = states.where(F.col("total") == target).select(F.explode("choice").alias("c")).select("c.*")
    return chosen.select("paper", "container", "size")
