"""Items of very unlike lengths: found as by one index, and a long item costs the short ones little."""

import time

import numpy as np
import pyarrow as pa

from loomwork.llm import decontamination as D


def _benchmark(rng, long):
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 20_000, n))
    items = [(k, f"{say(25)}. {say(12)}.") for k in range(2000)]
    return items + [(5000 + k, ". ".join(say(40) for _ in range(n // 40))) for k, n in enumerate(long)]


def test_items_of_all_lengths_are_found():
    rng = np.random.default_rng(1)
    items = _benchmark(rng, (80, 300, 1200, 3000, 9000, 40000)) + [(9000, "rareword"), (9001, " ,. ")]
    index = D.indexed(items)
    assert isinstance(index, D.Layers) and len(index.indexes) == 4
    filler = lambda n: " ".join(f"f{k}" for k in rng.integers(0, 5000, n))
    chosen = [items[k] for k in (0, 700, 2000, 2001, 2002, 2003, 2004, 2006)]
    texts = [f"{filler(900)} {t} {filler(1100)}" for _, t in chosen] + [filler(3000), "", None]
    _, _, found = index.verified(pa.array(texts))
    assert found == [[i] for i, _ in chosen] + [[], [], []]
    alone = D.indexed([i for i in items if i[0] < 5000])
    assert isinstance(alone, D.Index)
    assert alone.verified(pa.array(texts))[2] == [[i] if i < 5000 else [] for i, _ in chosen] + [[], [], []]


def test_one_long_item_costs_the_short_ones_little():
    rng = np.random.default_rng(2)
    texts = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 20_000, 400)) for _ in range(300)])

    def seconds(index):
        best = 9e9
        for _ in range(3):
            at = time.process_time()
            index.verified(texts)
            best = min(best, time.process_time() - at)
        return best

    items = _benchmark(np.random.default_rng(3), ())
    long = _benchmark(np.random.default_rng(3), (3000,))
    assert seconds(D.indexed(long)) < 2 * seconds(D.indexed(items)) + 0.05
