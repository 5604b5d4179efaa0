"""Exact Jaccard self-join on word shingles by T-occurrence search, as classes of linked documents.

Documents with equal shingle sets form one class and are searched once. Shingles
are ordered by an upper bound of how many documents hold them, the least count
in two fixed-size sketches over all documents (of the shingle and of each of its
words), then by hash. Two sets that reach the threshold share one of their first
n - ceil(t*n) + 1 shingles, so only these short lists are laid out. Pairs that meet
there pass an exact filter first: as many parities of hashed shingles as the set
has members, of which no more can differ than shingles do. The sets of the others
are dealt out in blocks, a set beside those that it may link with; a block's
inverted lists are laid out once, and every query of the block searches them with
DivideSkip: its short lists are heap-merged, its longest ones probed by binary
search for the sets that still can reach the required overlap, and the sets with
as many occurrences as the threshold asks for are its links. Nothing is
intersected before, and a link that the filter did not name is one all the same.

Only components are wanted, so pairs that links already connect need no test. Two
rounds link the members of each list to one of them: first that with the fewest
rarer shingles before the list's, which in a group of near copies is the one most
like all others, then any. A last round tests every remaining pair of different
components, which makes the result exact. A pair meets in a list only if what
follows the list's shingle in both orders is enough for the required overlap (it
is, in the list of the first shingle they share). All steps are joins on shingle
or class; no list is ever gathered whole.

Identity of words, shingles and sets is that of 64-bit hashes.

Nulls count as texts without words: an empty set, linked with nothing. A text of
fewer than k words is one shingle. Repeated rows repeat in the result. Rows
without doc_id come back with a null component_id and link nothing. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_bytes, discard, give_back, materialise, mix, named_rows, shingle_hashes, text_views, word_hashes
from .components import connected_components

#: Counters of each sketch of frequencies: 2**BITS, and in one row of it 2**ROW.
BITS, ROW = 22, 14
#: Rows of a sketch that a task sends on at once.
SENT = 64
#: Sets searched together at most, for one query and for all of a block, and bytes of a block's sets.
BLOCK, BLOCK_SETS, BLOCK_BYTES = 256, 2048, 8 << 20


def least_overlap(n: int, m: int, percent: int) -> int:
    """Least intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def shingle_set(view: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(view), k))


def _class(shingles: np.ndarray) -> int:
    """64-bit name of a set; 0 is the empty one."""
    if not len(shingles):
        return 0
    return int((mix(shingles + np.uint64(len(shingles))).sum(keepdims=True) | np.uint64(1)).view(np.int64)[0])


def parities(shingles: np.ndarray) -> bytes:
    """Bitmap of a set: bit i is the parity of how many members hash to i; as many bits as members, a power of two."""
    bits = 1 << max(6, (len(shingles) - 1).bit_length())
    at = (mix(shingles) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets; the longer bitmap is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _summaries(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds: a document's class, size and bitmap, and a task's part of the sketches (shingles, then words)."""
    names = ["doc_id", "u", "cls", "n", "parities", "row", "task", "counts"]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        sketch = np.zeros(2 << BITS, np.uint32)
        for batch in by_bytes(batches, "text", tidy=True):
            words = [word_hashes(v) for v in text_views(batch.column(2))]
            sets = [np.unique(shingle_hashes(w, k)) for w in words]
            for base, found in ((0, sets), (1 << BITS, words)):
                at, n = np.unique(_cells(np.concatenate(found)), return_counts=True)
                sketch[base + at] += n.astype(np.uint32)
            none = pa.nulls(len(sets))
            columns = [pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([parities(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        task = TaskContext.get().partitionId()
        filled = [i for i, r in enumerate(sketch.reshape(-1, 1 << ROW)) if r.any()]
        for at in range(0, len(filled), SENT):
            rows = filled[at : at + SENT]
            none = pa.nulls(len(rows), pa.int64())
            packed = [zlib.compress(sketch[i << ROW : (i + 1) << ROW].tobytes(), 1) for i in rows]
            yield pa.RecordBatch.from_arrays([none, pa.nulls(len(rows), pa.int32()), none, none, pa.nulls(len(rows), pa.binary()), pa.array(rows, pa.int32()), pa.array([task] * len(rows), pa.int32()), pa.array(packed, pa.binary())], names)
        del sketch

    return docs.mapInArrow(summarise, "doc_id long, u int, cls long, n long, parities binary, row int, task int, counts binary")


def _tiers(rows: DataFrame) -> np.ndarray:
    """The binary logarithm of each counter of the two sketches (bounded: one byte each)."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << ROW, np.uint32)
        for x in table.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        return pa.table({"row": table.column("row").slice(0, 1), "task": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    shape = "row int, task int, counts binary"
    some = rows.filter("row is not null").select("row", F.expr("pmod(task, 64) task"), "counts")
    total = some.groupBy("row", "task").applyInArrow(add, shape).groupBy("row").applyInArrow(add, shape)
    tiers = np.zeros(2 << BITS, np.uint8)
    for row in total.toLocalIterator():
        counts = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
        tiers[row["row"] << ROW : (row["row"] + 1) << ROW] = np.log2(np.maximum(counts, 1))
    return tiers


def prefix(words: np.ndarray, k: int, percent: int, tiers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all shingles of a text, those of its prefix)."""
    shingles, first = np.unique(shingle_hashes(words, k), return_index=True)
    rare = tiers[(1 << BITS) + _cells(words)]
    n = max(1, len(words) - k + 1)
    least = rare[:n].copy()
    for i in range(1, min(k, len(words))):
        least = np.minimum(least, rare[i : i + n])
    order = np.argsort(np.minimum(tiers[_cells(shingles)], least[first]), kind="stable")
    return shingles, shingles[order[: prefix_length(len(shingles), percent)]]


def _postings(docs: DataFrame, k: int, percent: int, tiers) -> DataFrame:
    """(token, cls, n, at): the shingles of each class's prefix by place; a task lays out a class once, as far as it remembers."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        done: set[int] = set()
        for batch in by_bytes(batches, "text", tidy=True):
            tokens, cls, size, at = [], [], [], []
            for view in text_views(batch.column(0)):
                words = word_hashes(view)
                if not len(words):
                    continue
                shingles, own = prefix(words, k, percent, tiers.value)
                if (c := _class(shingles)) in done:
                    continue
                if len(done) < 200_000:
                    done.add(c)
                tokens.append(own)
                cls.append(np.full(len(own), c))
                size.append(np.full(len(own), len(shingles)))
                at.append(np.arange(len(own), dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(size)), pa.array(np.concatenate(at))], ["token", "cls", "n", "at"])

    return docs.select("text").mapInArrow(lay, "token long, cls long, n long, at int")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) of the wanted classes, from one document each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in by_bytes(batches, "text", tidy=True):
            sets = [shingle_set(v, k) for v in text_views(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([_class(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "shingles"])

    ids = classes.join(wanted, "cls", "left_semi").select(F.col("first").alias("doc_id"))
    ids = materialise(ids, "ids")
    few = ids.count() <= BROADCAST_ROWS  # beyond, the texts are shuffled
    rows = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text").mapInArrow(make, "cls long, shingles binary")
    return materialise(rows.dropDuplicates(["cls"]), "sets")  # rows of one doc_id may be of one class


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out."""
    met = materialise(pairs.selectExpr("a cls").union(pairs.selectExpr("b cls")).distinct(), "met")
    own = materialise(classes.join(met, "cls", "left_semi").select("cls", "n", "parities"), "own")
    both = pairs.join(own.toDF("a", "n", "p"), "a").join(own.toDF("b", "m", "q"), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            most = n + m - 2 * least_overlap(n, m, percent)
            low = np.fromiter((differing(x.as_py(), y.as_py()) for x, y in zip(batch.column(3), batch.column(5), strict=True)), np.int64, len(n))
            yield batch.filter(pa.array(low <= most)).select(["a", "b"])

    near = materialise(both.select("a", "b", "n", "p", "m", "q").mapInArrow(test, "a long, b long"), "near")
    discard(met, own)
    return near


class Lists:
    """The inverted lists of a block of sets: for each shingle the sets that hold it, in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        shingles, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(shingles, kind="stable")
        shingles, self.member = shingles[order], member[order]
        first = np.flatnonzero(np.diff(shingles, prepend=~shingles[:1]))
        self.shingles, self.first = shingles[first], np.append(first, len(shingles))

    def search(self, query: np.ndarray, percent: int) -> list[int]:
        """Which sets reach the threshold with the query set (sorted, distinct hashes), by DivideSkip.

        With T the least overlap that any set of a fitting size needs, the
        L = T / (0.01 * log2(longest list) + 1) longest of the query's lists are
        set aside; the others are heap-merged, and a set found there in need - L
        of them or more is looked up in the long ones by binary search.
        """
        n = len(query)
        fits = (100 * self.sizes >= percent * n) & (100 * n >= percent * self.sizes)
        if not fits.any():
            return []
        need = np.where(fits, least_overlap(n, self.sizes, percent), 1 << 60)
        t = int(need.min())
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        if len(at) < t:
            return []
        start, end = self.first[at], self.first[at + 1]
        lengths = end - start
        n_long = min(t - 1, int(t / (0.01 * math.log2(max(2, lengths.max())) + 1)))
        rank = np.argsort(lengths, kind="stable")
        short, probe = rank[: len(rank) - n_long], rank[len(rank) - n_long :]
        merged = heapq.merge(*(self.member[start[i] : end[i]].tolist() for i in short))
        occurrences = {c: count for c, own in groupby(merged) if (count := sum(1 for _ in own)) >= need[c] - n_long}
        if not n_long:
            return [c for c, count in occurrences.items() if count >= need[c]]
        out = []
        wanted = np.fromiter(occurrences, np.int64, len(occurrences))
        found = np.fromiter(occurrences.values(), np.int64, len(occurrences))
        for i in probe:  # one binary search a long list, for all sets that are left
            own = self.member[start[i] : end[i]]
            place = np.searchsorted(own, wanted)
            found += own[np.minimum(place, len(own) - 1)] == wanted
        out += wanted[found >= need[wanted]].tolist()
        return out


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the sets of ``pairs``, and so all of ``pairs`` that reach the threshold."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    asked = pairs.join(blocks, "a").withColumn("block", F.expr("pmod(xxhash64(b), blocks)"))
    other = asked.join(sets.toDF("b", "shingles"), "b").select("a", "block", "b", "shingles")
    own = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(sets.toDF("a", "shingles"), "a")
    rows = own.select("a", "block", F.lit(None).cast("long").alias("b"), "shingles").union(other)
    laid = rows.repartition("a", "block").sortWithinPartitions("a", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, np.ndarray] = {}
        members: dict[int, np.ndarray] = {}
        held, now = 0, None

        def links() -> Iterator[pa.RecordBatch]:
            if queries and members:
                names, lists = list(members), Lists(list(members.values()))
                out = [(a, names[i]) for a, query in queries.items() for i in lists.search(query, percent) if names[i] != a]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
            queries.clear()
            members.clear()

        for batch in batches:
            for a, block, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if (a, block) != now and (held > BLOCK_BYTES or len(members) > BLOCK_SETS):
                    yield from links()  # a query and all its sets of one block lie in one
                    held = 0
                now, shingles = (a, block), np.frombuffer(raw.as_py(), np.uint64)
                into, name = (queries, a) if b is None else (members, b)
                if name not in into:
                    into[name] = shingles
                    held += shingles.nbytes
        yield from links()

    return laid.mapInArrow(search, "a long, b long")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The lists with each member's component, without those that lie in one component."""
    if labels is None:
        return lists.withColumn("comp", F.col("cls"))
    named = lists.join(labels.toDF("cls", "root"), "cls", "left").selectExpr("token", "cls", "n", "at", "coalesce(root, cls) comp")
    mixed = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("token")
    return named.join(mixed, "token")


def _linked(docs: DataFrame, k: int, percent: int, rounds: int) -> DataFrame:
    """Per row: doc_id, u (a hash that tells texts of one doc_id apart), n, root (of its class), component (least doc_id)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("u"), "text")
    summary = materialise(_summaries(docs, k), "summaries")
    members = summary.filter("row is null").select("doc_id", "u", "cls", "n")
    known = summary.filter("row is null and n > 0")
    classes = known.groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("parities").alias("parities"))
    classes = materialise(classes.filter("first is not null"), "classes")  # min of doc_id: a class without one links nothing
    tiers = spark.sparkContext.broadcast(_tiers(summary))

    laid = _postings(docs.filter("doc_id is not null"), k, percent, tiers).repartition("token").dropDuplicates(["token", "cls"])
    lists = materialise(laid.withColumn("_n", F.count("*").over(Window.partitionBy("token"))).filter("_n > 1").drop("_n"), "lists")
    tiers.unpersist()

    # both have enough left from the shared shingle on; other, m, o and root are of the second
    enough = f"least(n - at, m - o) * {100 + int(percent)} >= {int(percent)} * (n + m) and comp != root"
    links, labels = None, None
    for i in range(rounds + 1):
        now = _labelled(lists, labels)
        first = F.struct("at", F.xxhash64("cls"), "cls", "n", "comp") if i != 1 else F.struct(F.xxhash64("comp"), "at", "cls", "n", "comp")
        lead = now.groupBy("token").agg(F.min(first).alias("l")).selectExpr("token t", "l.cls other", "l.n m", "l.at o", "l.comp root")
        if i < rounds:
            met = now.join(lead, F.expr(f"token = t and {enough}"))
        else:  # members of the lead's component are not tried with each other
            apart = now.join(lead.selectExpr("t", "root"), F.expr("token = t and comp != root")).selectExpr("token t", "cls other", "n m", "at o", "comp root")
            met = now.join(apart, F.expr(f"token = t and {enough}"))
        pairs = materialise(met.selectExpr("least(cls, other) a", "greatest(cls, other) b").distinct(), "pairs")
        near = _near(pairs, classes, percent)
        sets = _sets(docs, classes, near.selectExpr("a cls").union(near.selectExpr("b cls")).distinct(), k)
        found = materialise(_links(near, sets, percent), "links")
        discard(pairs, near, sets)
        links = found if links is None else links.union(found)
        if labels is None or not found.isEmpty():
            old, labels = labels, materialise(connected_components(links), "labels")
            discard(*([old] if old is not None else []))

    named = classes.join(labels.toDF("cls", "root"), "cls", "left").selectExpr("cls", "first", "coalesce(root, cls) root")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    named = materialise(named.join(least, "root").select("cls", "root", "component"), "components")
    discard(lists, classes, labels)
    return members.join(named, "cls", "left").select("doc_id", "u", "n", "root", "component")


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id of its component).

    Documents link when 100 * intersection >= percent * union of their sets of
    k-word shingles (words: runs without ASCII white space, A-Z lower-cased).
    """
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return _linked(docs, k, percent, rounds).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 2) -> DataFrame:
    """The rows of ``docs`` without those linked to one of a smaller doc_id (or, in one doc_id, of a smaller hash of the text).

    Of a repeated row one stays. Rows without doc_id or without a word stay.
    """
    linked = materialise(_linked(docs, k, percent, rounds).filter("doc_id is not null and n > 0"), "linked")
    lead = linked.groupBy("root").agg(F.min(F.struct("doc_id", "u")).alias("lead"))
    lost = materialise(linked.join(lead, "root").filter("struct(doc_id, u) != lead").select("doc_id", "u").distinct(), "lost")
    again = materialise(linked.groupBy("doc_id", "u").count().filter("count > 1").select("doc_id", "u"), "again")
    few = lost.count() <= BROADCAST_ROWS
    rows = named_rows(docs)
    kept = rows.join(F.broadcast(lost) if few else lost, ["doc_id", "u"], "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, ["doc_id", "u"], "left_anti").unionByName(kept.join(again, ["doc_id", "u"], "left_semi").dropDuplicates(["doc_id", "u"]))
    return kept.select("row.*")
