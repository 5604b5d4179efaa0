"""Links of large groups come from blocks, and hold together all that similar pairs do."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.operators import blocks, stories


def parts(nodes, links):
    root = {i: i for i in nodes}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in nodes}


def alike(sets, a, b, least, shared):
    both = len(sets[a] & sets[b])
    return both >= shared and both / len(sets[a] | sets[b]) >= least


def drawn(n, seed, most=30):
    rng = random.Random(seed)
    return {i: {min(rng.randrange(60), rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, most))} for i in range(n)}


@pytest.mark.parametrize("bits", [64, 256])
@pytest.mark.parametrize(("least", "shared"), [(0.15, 1), (0.34, 2), (0.6, 3), (1.0, 1)])
def test_forest_of_one_block_and_of_two(monkeypatch, bits, least, shared):
    """With few tokens kept as bits, the others are counted along their lists."""
    monkeypatch.setattr(blocks, "BITS", bits)
    sets = {i: s | {60 + i % 7 + 100 * j for j in range(i % 5)} for i, s in drawn(160, 3).items()}
    sets = {i: s for i, s in sets.items() if len(s) >= shared}
    for right in (lambda i: 0, lambda i: i % 2):
        rows = pa.table({"r": ["x"] * len(sets), "id": pa.array(sets, pa.int64()), "_right": pa.array([right(i) for i in sets], pa.int32()), "s": pa.array([sorted(s) for s in sets.values()], pa.list_(pa.int64()))})
        got = blocks.forest(rows, "r", least, shared)
        links = list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
        want = [(a, b) for a in sets for b in sets if a < b and alike(sets, a, b, least, shared) and (right(a) != right(b) or not any(map(right, sets)))]
        assert {(min(x), max(x)) for x in links} <= set(want) and parts(sets, links) == parts(sets, want) and len(links) < len(sets)


def test_links_of_several_blocks(spark, monkeypatch):
    """Names of any kind; rows without one link nothing."""
    monkeypatch.setattr(blocks, "FEW_TOKENS", 1000)
    sets = drawn(150, 4)
    rows = [("g" if i % 10 else "h", f"n{i:03}", sorted(map(str, s))) for i, s in sets.items()] + [("g", None, ["1", "2"]), (None, "n999", ["1", "2"])]
    table = spark.createDataFrame(rows, "kind string, id string, s array<string>")
    links = [tuple(r) for r in stories.similar_links(table, "kind", 0.34, 2).select("a", "b", "kind").collect()]
    want = [(f"n{a:03}", f"n{b:03}") for a in sets for b in sets if a < b and (a % 10 > 0) == (b % 10 > 0) and alike(sets, a, b, 0.34, 2)]
    assert {(a, b) for a, b, _ in links} <= set(want) and len(set(links)) == len(links)
    names = [f"n{i:03}" for i in sets]
    assert parts(names, [x[:2] for x in links]) == parts(names, want)


def test_sets_that_are_all_alike_give_no_table_of_pairs(spark):
    """300 sets, each like all others: 44,850 pairs, of which a few a set are links."""
    rows = spark.range(300).select(F.lit(1).alias("kind"), "id", F.concat(F.array(*(F.lit(f"w{i}") for i in range(20))), F.array(F.col("id").cast("string"))).alias("s"))
    links = [(r["a"], r["b"]) for r in stories.similar_links(rows, "kind", 0.34, 2).collect()]
    assert len(links) < 300 * blocks.MORE and set(parts(range(300), links).values()) == {0}
