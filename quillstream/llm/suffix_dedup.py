"""Suffix-array dedup: all bytes under a string of ``length`` bytes that starts anywhere else too.

A full suffix array of the corpus is not needed, as only repeats of ``length``
bytes or more matter. Every window of that length picks an anchor, the K-byte
gram within it with the least hash, so equal windows pick equal anchors at equal
distances. The suffixes that start at anchors are therefore dealt by their first K
bytes: each bucket is one interval of the corpus's suffix array, and the buckets
are independent. What is left and right of an anchor, as far as its windows
reach, is its context.

1. Anchors that occur once are dropped (a count, combined map-side, joined back).
2. Equal contexts are one leaf of the tree that carries all its occurrences.
3. In each bucket the contexts' suffixes are sorted, their common prefixes found,
   and a stack scan lists the intervals of the common-prefix tree. The members of
   an interval are sorted by what precedes them, and a second stack scan lists the
   groups of the same left extension. A group whose members differ in the next byte
   on the left (it is an interval of the second scan) and on the right (it does not
   lie in one child of the first) is a maximal repeat; it comes with all its
   occurrences, near or far in the array.
4. A bucket of more than BUCKET contexts is dealt anew by longer common cores (all
   windows of STEP neighbouring distances share length - STEP + 1 bytes), and where
   that is still too many, by whole windows, where equality needs no array. No
   bucket is cut off, and none grows with the corpus.

All strings of a group hold their anchors, so what goes of a context is one range:
from its farthest left to its farthest right extension in any group. Repeats are
maximal within an anchor's reach; a longer one comes as groups that overlap.

Matches never cross rows. Nulls count as empty. A repeated row repeats every
window of the row, so both lose what ``length`` bytes or more there are. Rows
without doc_id are treated like others. An empty table gives an empty result;
other columns are not read. Contexts and windows are named by 64-bit hashes
beside their anchor's.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, _Tables, by_bytes, discard, materialise, mix, prefix_hash, text_views

#: Bytes of an anchor's gram.
K = 64
#: Most contexts sorted together, and neighbouring distances dealt together beyond that.
BUCKET, STEP = 256, 16


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    n, size, m = len(v) - w + 1, 1, v
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[w - size : w - size + n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, context hash, place, far, near) of a text's anchors: its windows start from place - far to place - near."""
    w, out = length - K + 1, []
    for at in range(0, len(data) - length + 1, CHUNK - length + 1):
        piece = data[at : at + CHUNK]
        if len(piece) < length:
            break
        p = prefix_hash(piece)
        down = _Tables.down
        n = len(piece) - K + 1
        h = mix((p[K : K + n] - p[:n]) * down[:n])
        least = sliding_least((h & np.uint64(~((1 << 20) - 1) % (1 << 64))) | np.arange(n, dtype=np.uint64), w)
        place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        new = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(new[1:], len(place)) - 1
        a = place[new]
        far, near = a - new, a - last
        context = mix((p[last + length] - p[new]) * down[new] + (far * 256 + near).astype(np.uint64))
        out.append((h[a].view(np.int64), context.view(np.int64), a + at, far, near))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, np.int64) for _ in range(5))


ROWS = "key long, ctx long, uid long, place long, reach int"


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            parts, own = [], []
            for i, view in enumerate(text_views(batch.column(1))):
                if len(view) >= length:
                    parts.append(anchors(view, length))
                    own.append(np.full(len(parts[-1][0]), i))
            if parts:
                key, ctx, place, far, near = (np.concatenate(x) for x in zip(*parts, strict=True))
                uid = batch.column(0).take(pa.array(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ctx), uid, pa.array(place), pa.array((far * 256 + near).astype(np.int32))], ["key", "ctx", "uid", "place", "reach"])

    return docs.mapInArrow(make, ROWS)


CONTEXTS = "key long, ctx long, far int, near int, bytes binary"


def _with_bytes(contexts: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The contexts (key, ctx, uid, place, reach) with their bytes, as CONTEXTS: the texts that hold one are read again."""
    per_doc = contexts.groupBy("uid").agg(F.collect_list(F.struct("key", "ctx", "place", "reach")).alias("own"))
    joined = docs.join(per_doc, "uid").select("text", "own")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for view, own in zip(text_views(batch.column(0)), batch.column(1), strict=True):
                for r in own.as_py():
                    far, near = divmod(r["reach"], 256)
                    raw = view[r["place"] - far : r["place"] - near + length].tobytes()
                    for x, v in zip(out, (r["key"], r["ctx"], far, near, raw), strict=True):
                        x.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["key", "ctx", "far", "near", "bytes"])

    return joined.mapInArrow(cut, CONTEXTS).dropDuplicates(["key", "ctx"])


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1  # a[:lo] agree, a[:hi + 1] differ
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def common_prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, common prefix) of each interval of the tree over a suffix array; lcp[i] is of entries i - 1 and i, lcp[0] 0."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            value, first = stack.pop()
            yield first, i - 1, value
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, members) of each maximal repeat of ``length`` bytes or more.

    right[i]: what follows from member i's anchor on; left[i]: what precedes it, backwards.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    lcp = [0] + [_common(right[a], right[b]) for a, b in zip(order, order[1:])]
    at = {m: i for i, m in enumerate(order)}
    rank = {m: i for i, m in enumerate(sorted(range(len(left)), key=left.__getitem__))}
    longest = max(map(len, left))
    for first, last, on in common_prefix_intervals(lcp):
        if on + longest < length:
            continue
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        agree = [_common(left[a], left[b]) for a, b in zip(members, members[1:])]
        if max(agree) + on < length:
            continue
        children = [i for i in range(first + 1, last + 1) if lcp[i] == on]  # where a child of the interval ends
        for a, b, back in common_prefix_intervals([0, *(x + 1 for x in agree)]):  # by one more, so that the whole counts
            back -= 1
            if back + on >= length:
                own = members[a : b + 1]
                places = [at[m] for m in own]
                if bisect.bisect_right(children, max(places)) > bisect.bisect_right(children, min(places)):  # in several children
                    yield back, on, own


def _name(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _in_buckets(rows: DataFrame, length: int, whole: bool) -> DataFrame:
    """Of the maximal repeats in the buckets of contexts (key; at most BUCKET), by context: (key, ctx, back, on).

    One row a context with its farthest extensions; if ``whole``, one a context and repeat, with the repeat's name.
    """
    laid = rows.select("key", "ctx", "far", "bytes").repartition("key").sortWithinPartitions("key")
    names = ["key", "ctx", "back", "on", "repeat"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def close() -> list[tuple]:
            if len(group) < 2:
                return []
            ids, far, raw = zip(*group, strict=True)
            left = [b[:f][::-1] for b, f in zip(raw, far, strict=True)]
            right = [b[f:] for b, f in zip(raw, far, strict=True)]
            out, most = [], {}
            for back, on, members in maximal_repeats(left, right, length):
                if whole:
                    name = _name(raw[members[0]][far[members[0]] - back : far[members[0]] + on])
                    out += [(now, ids[m], back, on, name) for m in members]
                else:
                    for m in members:
                        b, o = most.get(m, (0, 0))
                        most[m] = max(b, back), max(o, on)
            return out + [(now, ids[m], b, o, None) for m, (b, o) in most.items()]

        for batch in batches:
            found: list[tuple] = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    found += close()
                    now, group = key, []
                group.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names)
        if found := close():
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return laid.mapInArrow(scan, "key long, ctx long, back int, on int, repeat long")


def _dealt_anew(rows: DataFrame, length: int, step: int) -> DataFrame:
    """Each context (key, ctx) in parts of ``step`` neighbouring distances: (core, part, key, ctx, far, near, bytes), named by the part's common core and by itself."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, ctx, far, near, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for g in range(near // step, far // step + 1):
                    lo, hi = max(near, g * step), min(far, g * step + step - 1)
                    first, end = far - hi, far - lo + length  # the part's bytes within raw
                    core = raw[far - g * step : far - (g * step + step - 1) + length]
                    head = f"{key}:{g}:".encode()
                    for x, v in zip(out, (_name(head + core), _name(head + bytes([lo % 256, hi % 256]) + raw[first:end]), key, ctx, hi, lo, raw[first:end]), strict=True):
                        x.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["core", "part", "key", "ctx", "far", "near", "bytes"])

    return rows.select("key", "ctx", "far", "near", "bytes").mapInArrow(deal, f"core long, part long, {CONTEXTS}")


def _leaves(rows: DataFrame, length: int, whole: bool) -> DataFrame:
    """Contexts that occur twice or more as a whole, as ``_in_buckets`` gives them."""
    name = F.xxhash64("key", "ctx", "bytes") if whole else F.lit(None).cast("long")
    return rows.select("key", "ctx", F.col("far").cast("int").alias("back"), (length - F.col("near")).cast("int").alias("on"), name.alias("repeat"))


def _with_count(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows in buckets of 2 to BUCKET, and of more."""
    sizes = materialise(rows.groupBy(key).count().filter("count > 1").withColumnRenamed("count", "_count"), "sizes")
    counted = rows.join(sizes, key)
    return counted.filter(F.col("_count") <= BUCKET).drop("_count"), counted.filter(F.col("_count") > BUCKET).drop("_count")


def _found(docs: DataFrame, length: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """(key, ctx, back, on, repeat) of the repeats, by context, and the anchors (key, ctx, uid, place) that are the contexts' occurrences."""
    rows = _anchor_rows(docs, length)
    often = materialise(rows.groupBy("key").count().filter("count > 1").select("key"), "often")
    rows = materialise(rows.join(often, "key"), "anchors")
    discard(often)
    contexts = rows.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("uid", "place", "reach")).alias("r"))
    contexts = materialise(contexts.select("key", "ctx", "n", "r.*"), "contexts")
    several = materialise(contexts.groupBy("key").agg(F.count("*").alias("_count")).filter("_count > 1").select("key"), "several")
    wanted = contexts.join(several, "key", "left_semi")
    wanted = wanted.union(contexts.filter("n > 1").join(several, "key", "left_anti")) if whole else wanted
    texts = materialise(_with_bytes(wanted, docs, length), "texts")
    discard(several)
    if whole:
        out = _leaves(texts.join(contexts.filter("n > 1").select("key", "ctx"), ["key", "ctx"], "left_semi"), length, True)
    else:
        out = _leaves(contexts.filter("n > 1").selectExpr("key", "ctx", "reach div 256 far", "reach % 256 near"), length, False)

    few, many = _with_count(texts, "key")
    out = out.union(_in_buckets(few, length, whole))
    # hot keys: parts of contexts stand for contexts, and what is found of them goes back to the contexts that hold them
    cores = materialise(_dealt_anew(many, length, STEP), "cores")
    parts = cores.groupBy("core", "part").agg(F.count("*").alias("n"), F.min(F.struct("far", "near", "bytes")).alias("r"))
    parts = materialise(parts.selectExpr("core key", "part ctx", "n", "r.*"), "parts")
    found = _leaves(parts.filter("n > 1"), length, whole)
    few, many = _with_count(parts.drop("n"), "key")
    found = found.union(_in_buckets(few, length, whole))
    windows = materialise(_dealt_anew(many, length, 1).selectExpr("core", "part", "key", "ctx", "far", "near", "cast(null as binary) bytes"), "windows")
    equal = materialise(windows.groupBy("core", "part").count().filter("count > 1").select("core", "part"), "equal")
    name = F.xxhash64("core", "part") if whole else F.lit(None).cast("long")
    found = found.union(windows.join(equal, ["core", "part"]).select("key", "ctx", F.col("far").alias("back"), (length - F.col("near")).cast("int").alias("on"), name.alias("repeat")))
    found = found.selectExpr("key core", "ctx part", "back", "on", "repeat")
    out = out.union(cores.select("core", "part", "key", "ctx").join(found, ["core", "part"]).select("key", "ctx", "back", "on", "repeat"))
    return out, rows.select("key", "ctx", "uid", "place")


def repeat_groups(docs: DataFrame, length: int = 200) -> DataFrame:
    """(repeat, uid, start, length) of every occurrence of every maximal repeat; docs: uid, text (repeated rows repeat)."""
    groups, rows = _found(docs, length, True)
    groups = materialise(groups.distinct(), "groups")
    return rows.join(groups, ["key", "ctx"]).selectExpr("repeat", "uid", "place - back as start", "back + on as length").distinct()


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(uid, start, end) of byte ranges under repeated strings of ``length`` bytes; docs: uid, text (repeated rows repeat)."""
    if not K <= length <= K + 191:
        raise ValueError(f"length from {K} to {K + 191}")
    groups, rows = _found(docs, length, False)
    cover = materialise(groups.groupBy("key", "ctx").agg(F.max("back").alias("back"), F.max("on").alias("on")), "cover")
    return rows.join(cover, ["key", "ctx"]).selectExpr("uid", "place - back as start", "place + on as end")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"


def suffix_dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of what is left), spans."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text").withColumn("uid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(docs.select("uid", "text"), length)
    per_doc = materialise(spans.groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    joined = docs.join(per_doc, "uid", "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            size, removed, digest, runs = [], [], [], []
            for view, own in zip(text_views(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                gone = merged([(s["start"], s["end"]) for s in own or []])
                kept, last, left = hashlib.sha256(), 0, 0
                for a, b in [*gone, (len(view), len(view))]:
                    kept.update(view[last:a])
                    left += a - last
                    last = b
                size.append(len(view))
                removed.append(len(view) - left)
                digest.append(kept.hexdigest())
                runs.append([{"start": a, "end": b} for a, b in gone])
            columns = [pa.array(x, pa.int64()) for x in (size, removed, list(map(len, runs)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digest, pa.string()), pa.array(runs, shape)], names)

    return joined.mapInArrow(cut, RESULT)
