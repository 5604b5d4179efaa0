"""Token ids as binary shards in training order.

A task's documents, each closed by an end id, are one stream of ids that is cut
into sequences of ``length``; the last one of a task is padded. Sequences are
numbered over the whole corpus (a task's count is one number, added up on the
driver), and a keyed Feistel network over the least even number of bits, walked
along its cycle until it falls below the number of sequences, permutes these
numbers: the result is each sequence's global slot, a bijection that any reader
can recompute from the key. A shard holds a fixed range of slots; every slot has
the same stride, so slot s lies in shard s // per_shard at byte
(s % per_shard) * stride, and a run that stopped after slot s goes on at s + 1 with
one seek.

The ids are written once, packed, before they are numbered, so that the numbers
cannot change with a retried task; they are dealt as packed blocks to range
partitions of the slots. As slots are dense, their bounds are known without a
sample: a partition takes a fixed number of shards in a row and writes them one
after another, and there are at most MOST_PARTITIONS of them.

Nulls count as empty texts (an end id alone). Repeated rows repeat in the stream.
An empty table gives no shard and an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedFiles, by_bytes, materialise, mix, scratch_path
from .subword import byte_ids, vocabulary_path

#: Sequences packed together in the first table, and bytes of ids dealt to shards together.
BLOCK, HELD = 512, 24 << 20
#: Partitions that write shards, at most.
MOST_PARTITIONS = 20_000


def feistel(index: np.ndarray, total: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 .. total - 1."""
    half = max(1, -(-max(1, (total - 1).bit_length()) // 2))
    low = np.uint64((1 << half) - 1)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for r in range(rounds):
            tweak = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % (1 << 64))
            left, right = right, left ^ (mix(right ^ tweak) & low)
        return left << np.uint64(half) | right

    out = network(index.astype(np.uint64))
    while len(walk := np.flatnonzero(out >= np.uint64(total))):
        out[walk] = network(out[walk])
    return out.astype(np.int64)


def _sequences(docs: DataFrame, length: int, end_id: int, path: str) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=9)
        held: list[np.ndarray] = []
        owners: list[tuple[int | None, int]] = []
        n = 0

        def block(last: bool) -> pa.RecordBatch | None:
            nonlocal held, owners, n, first
            count = -(-n // length) if last else min(BLOCK, n // length)
            if not count:
                return None
            stream = np.concatenate(held)
            own = np.repeat(np.arange(len(owners)), [m for _, m in owners])
            used = min(n, count * length)
            ids = np.full(count * length, end_id, np.uint16)
            ids[:used] = stream[:used]
            docs_of = [[owners[j][0] for j in np.unique(own[i : i + length])] for i in range(0, used, length)]
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([count], pa.int32()), pa.array([used], pa.int64()), pa.array([packer.compress(ids.tobytes())], pa.binary()), pa.array([docs_of], pa.list_(pa.list_(pa.int64())))],
                ["part", "first", "n", "used", "ids", "docs"],
            )
            held, rest = [stream[used:]], own[used:]
            owners = [(owners[j][0], int((rest == j).sum())) for j in np.unique(rest)]
            first, n = first + count, n - used
            return row

        for batch in by_bytes(batches, "text", 2 << 20):
            for key, ids in zip(batch.column(0).to_pylist(), byte_ids(path).batch(batch.column(1)), strict=True):
                held.append(np.append(ids, np.uint32(end_id)).astype(np.uint16))
                owners.append((key, len(ids) + 1))
                n += len(ids) + 1
                while n >= BLOCK * length:
                    yield block(False)
        if (row := block(True)) is not None:
            yield row

    return docs.mapInArrow(cut, "part int, first long, n int, used long, ids binary, docs array<array<long>>")


def _dealt(rows: DataFrame, total: int, per_shard: int, length: int, key: int) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, opener = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        ids: list[np.ndarray] = []
        slots: list[np.ndarray] = []
        docs: list[list] = []
        sizes: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            every, at, size = np.concatenate(ids), np.concatenate(slots), np.concatenate(sizes)
            order = np.argsort(at)
            shard = at[order] // per_shard
            for a, b in zip(np.flatnonzero(np.diff(shard, prepend=-1)), np.append(np.flatnonzero(np.diff(shard)) + 1, len(shard)), strict=True):
                own = order[a:b]
                columns = [pa.array([int(shard[a])], pa.int64()), pa.array([at[own].tolist()], pa.list_(pa.int64())), pa.array([size[own].tolist()], pa.list_(pa.int64())), pa.array([packer.compress(every[own].tobytes())], pa.binary()), pa.array([[docs[i] for i in own]], pa.list_(pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "slots", "sizes", "ids", "docs"])
            for x in (ids, slots, docs, sizes):
                x.clear()

        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                ids.append(np.frombuffer(opener.decompress(row["ids"]), np.uint16).reshape(n, length))
                slots.append(feistel(np.arange(n) + row["first"] + row["before"], total, key))
                sizes.append(np.minimum(length, row["used"] - length * np.arange(n)))
                docs.extend(row["docs"])
                held += ids[-1].nbytes
                if held > HELD:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()

    return rows.mapInArrow(deal, "shard long, slots array<long>, sizes array<long>, ids binary, docs array<array<long>>")


MANIFEST = "slot long, shard long, file string, offset long, n_tokens long, ids_crc32 long, doc_ids array<long>"


def write_shards(docs: DataFrame, folder: str | None = None, length: int = 2048, per_shard: int = 4096, key: int = 20240229, end_id: int = 50256, vocabulary: str | None = None) -> DataFrame:
    """Writes the shards and returns one row a sequence: slot, shard, file, offset (bytes), n_tokens (without padding), ids_crc32 (of the stride's bytes), doc_ids.

    ids are little-endian unsigned 16-bit.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    folder = folder or scratch_path(spark, "shards")
    rows = materialise(_sequences(docs.selectExpr("cast(doc_id as long) doc_id", "text"), length, end_id, path), "sequences")
    total, before = 0, []
    for part, n in sorted(rows.groupBy("part").agg(F.sum("n")).collect()):
        before.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    dealt = _dealt(rows.join(starts, "part").select("first", "before", "n", "used", "ids", "docs"), total, per_shard, length, key)
    shards = max(1, -(-total // per_shard))
    run = -(-shards // MOST_PARTITIONS)  # shards in a row of each range partition
    laid = dealt.repartitionById(-(-shards // run), F.expr(f"cast(shard div {run} as int)")).sortWithinPartitions("shard")
    stride = 2 * length

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, opener, task = SharedFiles(folder), zstandard.ZstdDecompressor(), TaskContext.get().taskAttemptId()
        now, data, known = -1, np.empty(0, np.uint16), []

        def close() -> pa.RecordBatch:
            if len(known) != len(data):
                raise RuntimeError(f"shard {now} has {len(known)} of {len(data)} sequences")
            name = f"shard-{now:08d}-{task}.bin"
            with files.create(name) as out:
                out.write(memoryview(data).cast("B"))
            known.sort(key=lambda x: x[0])
            crc = [zlib.crc32(data[s - now * per_shard]) for s, *_ in known]
            n = len(known)
            columns = [pa.array([x[0] for x in known], pa.int64()), pa.array([now] * n, pa.int64()), pa.array([name] * n), pa.array([(x[0] - now * per_shard) * stride for x in known], pa.int64())]
            columns += [pa.array([x[1] for x in known], pa.int64()), pa.array(crc, pa.int64()), pa.array([x[2] for x in known], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["slot", "shard", "file", "offset", "n_tokens", "ids_crc32", "doc_ids"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if now >= 0:
                        yield close()
                    now, known = row["shard"], []
                    data = np.zeros((min(per_shard, total - now * per_shard), length), "<u2")
                at = np.array(row["slots"]) - now * per_shard
                data[at] = np.frombuffer(opener.decompress(row["ids"]), np.uint16).reshape(len(at), length)
                known.extend(zip(row["slots"], row["sizes"], row["docs"], strict=True))
        if now >= 0:
            yield close()

    return materialise(laid.mapInArrow(write, MANIFEST), "manifest")


def read_sequences(manifest: DataFrame, folder: str, first_slot: int = 0, length: int = 2048) -> DataFrame:
    """(slot, ids) from ``first_slot`` on, in training order within each shard: one seek a shard, then sequential."""
    shards = manifest.filter(F.col("slot") >= first_slot).groupBy("shard", "file").agg(F.min("slot").alias("slot"), F.min("offset").alias("offset"), F.count("*").alias("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SharedFiles(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open(row["file"]) as source:
                    source.seek(row["offset"])
                    for i in range(row["n"]):
                        ids = np.frombuffer(source.read(2 * length), "<u2").astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([row["slot"] + i], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int32()))], ["slot", "ids"])

    return shards.mapInArrow(read, "slot long, ids array<int>")
