"""Links among the sets of large groups, found block by block, so that no table of pairs is ever laid out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of one block of sets, about; a set counts as LEAST_TOKENS at least. Smaller groups are dealt into MORE blocks too, of FEW_TOKENS or more.
BLOCK_TOKENS, LEAST_TOKENS, FEW_TOKENS, MORE = 2_500_000, 50, 250_000, 4
#: Tokens whose holders are kept as bits and not as lists: the most frequent ones of a task.
BITS = 256


def weight(s: str = "s") -> Column:
    """What a set counts for in its block."""
    return F.greatest(F.size(s), F.lit(LEAST_TOKENS)).cast("long")


def numbered(sets: DataFrame, given: DataFrame) -> DataFrame:
    """The sets (..., s) with a number for each token, that no other token of ``given`` (s) has; sorted, so equal sets stay equal."""
    tokens = given.select(F.explode("s").alias("t"))
    for seed in range(9):
        number = lambda t: F.xxhash64(t, F.lit(seed))  # noqa: B023, E731
        if tokens.groupBy(number(F.col("t"))).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo != hi").isEmpty():
            return sets.withColumn("s", F.array_sort(F.transform("s", number)))
    raise RuntimeError("tokens cannot be told apart by their hashes")


def forest(sets: pa.Table, by: str, least: float, shared: int) -> pa.Table:
    """Links (by, a, b) that hold together what the similar pairs of a task's sets do: those of one block, or of one with another (_right).

    Each set counts, along the lists of its tokens, what it shares with every set
    searched; of the most frequent tokens only how many it has is added at first,
    and the bits are compared where that sum is enough. What earlier links connect
    is not looked at again, so there are fewer links than sets.
    """
    size = np.diff(sets.column("s").combine_chunks().offsets.to_numpy())
    # the block that is searched comes last, its sets by size
    sets = sets.take(pa.array(np.lexsort((size, sets.column("_right").to_numpy())))).combine_chunks()
    lists, right = sets.column("s").combine_chunks(), sets.column("_right").to_numpy()
    size, tokens = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()
    n, alone = len(size), not right.any()
    base = 0 if alone else int(n - right.sum())
    queries = n if alone else base
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    rank = np.empty(len(tokens), np.int32)
    rank[order] = np.cumsum(np.concatenate(([False], tokens[1:] != tokens[:-1])), dtype=np.int32)
    del tokens

    held = owner >= base
    count = np.bincount(rank[held], minlength=int(rank.max()) + 1)
    end = np.cumsum(count)
    start = end - count
    member = owner[order[held[order]]] - np.int32(base)
    del order, held
    frequent = np.argsort(count, kind="stable")[-BITS:]
    place = np.full(len(count), -1, np.int16)
    place[frequent] = np.arange(len(frequent))
    common = np.flatnonzero(place[rank] >= 0)
    flags = np.zeros((n, BITS), bool)
    flags[owner[common], place[rank[common]]] = True
    bits, known = np.packbits(flags, axis=1).view(np.uint64), flags.sum(1)
    del flags, common
    listed = (place[rank] < 0) & (count[rank] > (1 if alone else 0))
    at = np.concatenate(([0], np.cumsum(np.bincount(owner[listed], minlength=n))))
    rank = rank[listed]
    del owner, listed

    sizes, bits_of, known_of = size[base:], bits[base:], known[base:]
    first = np.searchsorted(sizes, np.ceil(size * least - 1e-9))
    last = np.searchsorted(sizes, np.floor(size / least + 1e-9), side="right")
    if alone:
        first = np.maximum(first, np.arange(1, n + 1))
    label, members, a, b = np.arange(n), {}, [], []
    for x in range(queries):
        lo, hi = int(first[x]), int(last[x])
        if lo >= hi:
            continue
        own = rank[at[x] : at[x + 1]]
        some = [member[i:j] for i, j in zip(start[own].tolist(), end[own].tolist(), strict=True)]
        needed = max(shared, int(np.ceil((size[x] + sizes[lo]) * (least / (1 + least)) - 1e-9)))  # with the smallest set that fits
        left = needed - int(known[x])
        if left > len(some):
            continue
        have = np.bincount(np.concatenate(some), minlength=n - base) if some else np.zeros(n - base, np.int64)
        near = np.flatnonzero(have[lo:hi] >= left if left > 0 else have[lo:hi] + np.minimum(known_of[lo:hi], known[x]) >= needed) + lo
        near = near[label[near + base] != label[x]]
        if not len(near):
            continue
        both = have[near] + np.bitwise_count(bits_of[near] & bits[x]).sum(1, dtype=np.int64)
        near = near[(both >= shared) & (both / (size[x] + sizes[near] - both) >= least)] + base
        for y in near[np.unique(label[near], return_index=True)[1]].tolist():
            a.append(x)
            b.append(y)
            large, small = (members.pop(k, None) or [k] for k in (int(label[x]), int(label[y])))
            if len(large) < len(small):
                large, small = small, large
            kept = int(label[large[0]])
            label[small] = kept
            large += small
            members[kept] = large
    ids = sets.column("id")
    return pa.table({by: sets.column(by).take(pa.array([0] * len(a), pa.int64())), "a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})


def block_links(sets: DataFrame, by: str, least: float, shared: int) -> DataFrame:
    """Links (by, a, b), a < b, that hold together what the similar pairs of different sets (by, id, s: numbers, _weight: of all in by) do.

    The sets of a group are dealt into blocks, and each two blocks (and each one
    with itself) make a task. So a set is sent once for each block of its group, and
    what a task holds is bounded.
    """
    least_tasks = F.least(F.lit(MORE), F.ceil(F.col("_weight") / FEW_TOKENS))
    rows = sets.filter("id is not null").withColumn("_k", F.greatest(F.ceil(F.col("_weight") / BLOCK_TOKENS), least_tasks, F.lit(1)).cast("int"))
    tasks = rows.select(by, "_k").distinct().agg(F.sum(F.expr("_k * (_k + 1L) div 2"))).first()[0] or 1
    rows = rows.withColumn("_own", F.expr("cast(pmod(xxhash64(id), _k) as int)")).withColumn("_other", F.explode(F.expr("sequence(0, _k - 1)")))
    rows = rows.select(by, F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), (F.col("_own") > F.col("_other")).cast("int").alias("_right"), "id", "s")
    names = [by, "_lo", "_hi"]
    out = T.StructType([T.StructField(by, sets.schema[by].dataType), *(T.StructField(c, sets.schema["id"].dataType) for c in "ab")])
    found = rows.repartition(min(4 * tasks, 2000), *names).groupBy(*names).applyInArrow(lambda t: forest(t, by, least, shared), out)
    return found.select(by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
