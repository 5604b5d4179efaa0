"""Packing by power-of-two decomposition.

Each document's ids (closed by an end id) are cut into pieces of ``most`` ids and
then into the binary parts of the rest, longest first: 2,048 ids or less, always
a power of two. A piece is a sequence of its own, so no sequence crosses
documents and none needs padding; equal lengths lie together in one bucket, and
a bucket's sequences have consecutive ids, so batches of one length are ranges.

The ids of a document never move: only the pieces' descriptions (place, length,
checksum) are numbered. Sequence ids count pieces in the order of (length, doc_id,
start): a range sort, then the partitions' counts are added up on the driver,
one number a partition, never one a row.

Null texts count as empty: one piece with the end id. Repeated rows give repeated
pieces with sequence ids of their own. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, give_back, materialise
from .subword import byte_ids, vocabulary_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, most: int = 2048) -> list[int]:
    """Lengths of the pieces of n ids: as many of ``most`` as fit, then the binary parts of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, most: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32 (little-endian unsigned 32-bit ids), doc_tokens."""
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    names = [x.split()[0] for x in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        end = np.array([end_id], "<u4")
        for batch in by_bytes(batches, "text", tidy=True):
            key, row, start, length, crc, total = batch.column(0), [], [], [], [], []
            for i, ids in enumerate(byte_ids(path).batch(batch.column(1))):
                raw = memoryview(np.concatenate([ids.astype("<u4"), end]).tobytes())
                at = 0
                for n in cuts(len(raw) // 4, most):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    total.append(len(raw) // 4)
                    at += n
            columns = [key.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(cut, PIECES)


def numbered(rows: DataFrame, order: list[str], name: str, at: str = "sequence_id") -> DataFrame:
    """``rows`` with a dense number from 0 in the given order.

    The rows are dealt by range and written once, so that each part is fixed
    before it is counted; the driver adds up one count a part file.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = materialise(laid.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    counts = sorted(ranked.groupBy("_part").count().collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
    return ranked.join(starts, "_part").withColumn(at, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def pack(docs: DataFrame, most: int = 2048, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """``pieces`` with sequence_id, offset (0: a piece is alone in its sequence) and the bucket's place in it."""
    rows = materialise(pieces(docs, most, end_id, vocabulary), "pieces")  # else the range sort's sampling encodes twice
    out = numbered(rows, ["length", "doc_id", "start"], "numbered")
    return out.withColumn("offset", F.lit(0).cast("long"))
