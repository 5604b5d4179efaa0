"""Token counts by a map-side two-tier lookup, without a shuffle.

Tier 1 is a broadcast table of frequent pre-tokens and their token counts. Which
pre-tokens are frequent is read off the vocabulary itself: its ids follow the
order in which the merges were learned, so the ``frequent`` first pieces that
begin a word are the most common words of the training text. The table is fixed
by that parameter and does not grow with the corpus. Tier 2 is each worker's own
cache of what tier 1 misses; what both miss is encoded by the library.

Nulls count as empty; an empty text has no token. Rows are independent: repeated
rows and ids repeat in the result; an empty table gives an empty one. Other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, text_views
from .subword import piece_counts, vocabulary_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pieces looked at for tier 1, in the order of the vocabulary.
FREQUENT = 20_000


def frequent_counts(path: str, pieces: int = FREQUENT) -> dict[str, int]:
    """Pre-token (without its leading space) -> tokens, for the first ``pieces`` pieces of the vocabulary."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    words = [p[1:] for p in map(model.id_to_piece, range(min(pieces, model.get_piece_size()))) if p[:1] == "▁" and "▁" not in p[1:]]
    words = [w for w in words if w]
    return dict(zip(words, map(len, model.encode(words)), strict=True))


def token_counts(docs: DataFrame, limit: int = 4096, vocabulary: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens (no begin or end token), over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path("piece_bpe_32k.model")
    table = spark.sparkContext.broadcast(frequent_counts(path, frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = batch.column(1)
            tokens = piece_counts(path, table.value).batch(texts)
            size = np.fromiter((len(v) for v in text_views(texts)), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(count, SCHEMA)
