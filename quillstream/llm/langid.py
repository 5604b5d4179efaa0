"""Language identification with a blended-spectrum string kernel.

Two texts are as alike as the n-grams (1 to 3 characters) that both hold:
k(x, y) = common n-grams / sqrt(n-grams of x * n-grams of y), presence only. On
Nyström landmarks L the kernel becomes features K(x, L) K(L, L)^(-1/2), on which
kernel ridge regression is fitted one-versus-rest. The presence kernel is an
inner product, so scores of a batch of texts are one product of their presence
matrix with (landmark presence x landmark weights), scaled by each text's norm.

n-grams are taken from whole texts, over lower-cased letters with every run of
other characters as one blank, and hashed to DIMS columns.

The fit uses a bounded sample of the training rows (crc32 of the id as text,
modulo 4, not 2; a language given; a letter in the text): of each language up to
``per_language`` different texts, as long as those before have less than
``budget`` characters together, so every language has one at least. Texts of up
to ``usual`` characters come first, then by a hash of the text. Everything else
covers all rows. Only the text goes into a prediction.

Nulls and texts without a letter get ``und`` and score 0. Repeated rows repeat in
the result. An empty table, or one without a training row, gives ``und`` for all.
Rows without doc_id count as not held out. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, give_back, mix

#: Hashed columns of the presence matrix; a power of two.
DIMS = 1 << 15
#: Texts that are scored at once: their matrix of DIMS columns is 8 MB.
SCORED = 64
#: Rows of each language in the sample: landmarks (of all languages together MOST_LANDMARKS), and rows of the
#: regression (landmarks included).
LANDMARKS, MOST_LANDMARKS, TRAIN = 64, 2048, 400
#: Characters of a language's sample, and of a text that comes before longer ones.
BUDGET, USUAL = 2_000_000, 20_000
RIDGE = 0.3
#: Characters whose n-grams are hashed at a time.
BLOCK = 1 << 17

LETTER = r"\p{L}"


def ngram_columns(text: str) -> np.ndarray:
    """Distinct hashed columns of a normalised text's n-grams, n from 1 to 3."""
    every = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
    seen = np.zeros(DIMS, bool)
    for at in range(0, len(every), BLOCK):
        gram = codes = every[at : at + BLOCK + 2].astype(np.uint64)
        for n in (1, 2, 3):
            if n > 1:
                gram = (gram[:-1] << np.uint64(21)) ^ codes[n - 1 :]
            seen[(mix(gram + np.uint64(n << 60)) & np.uint64(DIMS - 1)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def normalised(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[^\pL]+", " "))


def presence(columns: list[np.ndarray]) -> np.ndarray:
    """A row of length 1 for each text, alike in all its columns."""
    out = np.zeros((len(columns), DIMS), np.float32)
    for row, own in zip(out, columns, strict=True):
        row[own] = 1 / np.sqrt(max(1, len(own)))
    return out


class KernelRidge:
    """Weights of the hashed columns for each language, with the classes' names."""

    def __init__(self, classes: list[str], weights: np.ndarray):
        self.classes, self.weights = classes, weights

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelRidge:
        classes = sorted(set(langs))
        landmarks = max(2, min(landmarks, MOST_LANDMARKS // len(classes)))
        columns = [ngram_columns(t).astype(np.int32) for t in normalised(pa.array(texts, pa.string())).to_pylist()]
        nth = {c: 0 for c in classes}
        chosen = []
        for i, c in enumerate(langs):
            if nth[c] < landmarks:
                chosen.append(i)
            nth[c] += 1
        marks = presence([columns[i] for i in chosen])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        sound = values > 1e-6 * values.max()
        whiten = vectors[:, sound] / np.sqrt(values[sound])
        blocks = [presence(columns[i : i + 64]) @ marks.T for i in range(0, len(columns), 64)]  # a full matrix would fill the driver
        features = np.concatenate(blocks).astype(np.float64) @ whiten
        target = np.array([[1.0 if c == x else -1.0 for c in classes] for x in langs])
        share = np.array([1 / (len(classes) * langs.count(x)) for x in langs])[:, None]  # languages weigh alike
        weights = np.linalg.solve(features.T @ (features * share) + ridge / len(texts) * np.eye(features.shape[1]), features.T @ (target * share))
        return cls(classes, marks.T @ (whiten @ weights).astype(np.float32))

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row a normalised text, one column a language: about 1 for its language and -1 for others."""
        return presence([ngram_columns(t) for t in texts]) @ self.weights


def training_sample(docs: DataFrame, per_language: int = TRAIN, budget: int = BUDGET, usual: int = USUAL) -> DataFrame:
    """(lang, _n, text) of the training texts drawn for each language, ``_n`` their place."""
    fit = docs.filter("lang is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 != 2")
    size = F.length("text").cast("long")
    fit = fit.filter(F.col("text").rlike(LETTER)).select("lang", (size > usual).alias("_long"), F.xxhash64("text").alias("_h"), size.alias("_size"), "text")
    # Of each language and kind of length a share of the hashes is ranked that holds about four times the texts needed,
    # by a sketch of how many different ones there are; a rank over all of them would meet in one task a language.
    kinds = fit.groupBy("lang", "_long").agg(F.approx_count_distinct("_h", 0.02).alias("_kinds"))
    share = F.shiftright(F.col("_h"), 1) + F.lit(1 << 62) <= F.lit(float(1 << 63)) * F.least(F.lit(1.0), F.lit(4.0 * per_language + 100) / F.col("_kinds"))
    near = fit.join(F.broadcast(kinds), ["lang", "_long"]).filter(share).select("lang", "_long", "_h", "_size").distinct()
    order = Window.partitionBy("lang").orderBy("_long", "_h", "_size")
    before = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    drawn = near.withColumn("_n", F.row_number().over(order)).withColumn("_before", F.coalesce(before, F.lit(0)))
    drawn = drawn.filter((F.col("_n") <= per_language) & (F.col("_before") < budget)).select("lang", "_h", "_n")
    # ranks move hashes only; the drawn rows, a bounded number, find their texts by a broadcast
    return fit.join(F.broadcast(drawn), ["lang", "_h"]).groupBy("lang", "_n").agg(F.min("text").alias("text"))


def predictor(docs: DataFrame, per_language: int = TRAIN):
    """Learns from ``docs`` (doc_id, text, lang); returns a function from a text column to struct(lang_pred, score)."""
    spark = docs.sparkSession
    rows = training_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), per_language).toLocalIterator()
    sample = sorted((r["lang"], r["_n"], r["text"]) for r in rows)
    model = spark.sparkContext.broadcast(KernelRidge.fit([t for *_, t in sample], [x for x, *_ in sample]) if sample else None)

    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for column in texts:
            langs, score = [], []
            for batch in by_bytes([pa.RecordBatch.from_arrays([column], ["text"])], "text", 1 << 20):
                known = normalised(batch.column(0))
                able = pc.match_substring_regex(known, r"\pL").to_numpy(zero_copy_only=False) & (model.value is not None)
                names, best = np.full(len(known), "und", object), np.zeros(len(known))
                for part in np.array_split(np.flatnonzero(able), -(-int(able.sum()) // SCORED) or 1):
                    if len(part):
                        raw = model.value.scores([known[int(i)].as_py() for i in part])
                        names[part] = np.array(model.value.classes, object)[raw.argmax(1)]
                        best[part] = np.clip((raw.max(1).astype(np.float64) + 1) / 2, 0, 1)
                langs += names.tolist()
                score += best.tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    # Not deterministic to the optimizer, which would else run it once for a filter and once for the result.
    return F.arrow_udf(predict, "lang_pred string, score double").asNondeterministic()


def claimed(docs: DataFrame, least_score: float, per_language: int = TRAIN) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and others) that a learned language claims with ``least_score`` or more."""
    predict = predictor(docs, per_language)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), predict("text").alias("p"))
    return rows.filter(f"p.lang_pred != 'und' and p.score >= {float(least_score)}").select("row.*")


def identify(docs: DataFrame, per_language: int = TRAIN) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score (0 to 1)."""
    predict = predictor(docs, per_language)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predict("text").alias("p"))
    return rows.selectExpr("doc_id", "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false) held_out", "p.lang_pred", "p.score")
