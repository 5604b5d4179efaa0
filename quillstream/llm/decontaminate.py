"""Benchmark decontamination by spaced-seed hashing, with every match that the threshold allows.

Both sides are sequences of words (runs of letters and digits, A-Z lower-cased).
From ``window`` words of an item (or the whole item, if shorter), ``percent`` of
them equal, the document holds a leak. Fixed masks select some of a span's words
and ignore the others; a family of masks is chosen by how many of the words may
differ, such that each way to place these leaves one mask with equal words (the
tests enumerate all). The hashes of the test items under the masks are broadcast,
in blocks of a checked size, and joined with those of the training texts; around
each hit every window that holds it is counted, substitutions included.

Items of fewer than ``least_words`` words are not looked for.

Of an item's windows in a document the one with the most equal words is given,
the earliest of several. Nulls and texts without a word match nothing. Repeated
rows give repeated results; an empty table on either side gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _WORD_MULT, by_bytes, discard, give_back, materialise, mix, text_views
from .substring_dedup import letter_words

#: Characters of test items broadcast together.
BLOCK_CHARS = 4_000_000
#: Items of fewer words are not looked for: they say what other texts say too.
LEAST_WORDS = 8

#: Hits verified together.
BLOCK_HITS = 1 << 14

#: Words that may differ: (least words of the window, masks as the places of the words that they select). With no more
#: words different, one of the masks selects equal words somewhere in the window.
MASKS = {
    1: (5, ((0, 1, 2), (0, 1, 3))),
    2: (10, ((0, 1, 2, 4), (0, 1, 2, 3))),
    3: (15, ((0, 1, 2, 4, 5), (0, 1, 2, 3, 4))),
    4: (20, ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 8, 9), (0, 4, 7, 16, 17, 19))),
}


def masks(n: int, percent: int) -> tuple[tuple[int, ...], ...]:
    """Masks of a window of ``n`` words of which ``percent`` are equal; for other thresholds than the usual ones a run.

    So many equal words, parted by so few others, hold a run of at least that length.
    """
    equal = -(-percent * n // 100)
    least, family = MASKS.get(n - equal, (n + 1, ()))
    return family if n >= least else (tuple(range(max(1, -(-equal // (n - equal + 1))))),)


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash of the words that the mask selects, from each word on."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(len(mask)))
    for i, place in enumerate(mask):
        out = out + words[place : place + n] * _WORD_MULT[i % len(_WORD_MULT)]
    return mix(out)


class Seeds:
    """All seeds of a block of test items, by window and length."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = 20, percent: int = 80):
        self.percent = percent
        self.ids = [i for i, _ in items]
        words = [letter_words(v)[0] for v in text_views(pa.array([t for _, t in items], pa.string()))]
        self.words = np.concatenate([*words, np.empty(0, np.uint64)])
        self.end = np.cumsum([len(w) for w in words], dtype=np.int64)
        self.start = self.end - np.array([len(w) for w in words], np.int64)
        self.tables = []
        for n in sorted({min(window, len(w)) for w in words if len(w)}):
            own = [i for i, w in enumerate(words) if min(window, len(w)) == n]
            for mask in masks(n, percent):
                seeds = [seed_hashes(words[i], mask) for i in own]
                h = np.concatenate(seeds)
                item = np.repeat(own, [len(x) for x in seeds])
                place = np.concatenate([np.arange(len(x)) for x in seeds])
                order = np.argsort(h, kind="stable")
                maybe = np.zeros(1 << 20, bool)
                maybe[(h >> np.uint64(44)).astype(np.int64)] = True
                self.tables.append((n, mask, h[order], item[order], place[order], maybe))

    def leaks(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, first word in the text, first word in the item, words, equal words): each item's best window."""
        best: dict[int, tuple] = {}
        hashes: dict[tuple, np.ndarray] = {}
        for n, mask, keys, item, place, maybe in self.tables:
            if mask not in hashes:
                hashes[mask] = seed_hashes(words, mask)
            at = np.flatnonzero(maybe[(hashes[mask] >> np.uint64(44)).astype(np.int64)])
            lo = np.searchsorted(keys, hashes[mask][at], "left")
            upto = np.cumsum(np.searchsorted(keys, hashes[mask][at], "right") - lo)
            for first in range(0, int(upto[-1]) if len(upto) else 0, BLOCK_HITS):
                hit = np.arange(first, min(first + BLOCK_HITS, int(upto[-1])))
                of = np.searchsorted(upto, hit, "right")
                row = lo[of] + hit - np.where(of > 0, upto[of - 1], 0)
                self._verify(words, n, mask[-1] + 1, at[of], item[row], place[row], best)
        return [(self.ids[i], at, own, n, equal) for i, (equal, at, own, n) in ((i, (-a, b, c, d)) for i, (a, b, c, d) in best.items())]

    def _verify(self, words: np.ndarray, n: int, k: int, at: np.ndarray, item: np.ndarray, place: np.ndarray, best: dict[int, tuple]) -> None:
        """Keeps the best window of each item among those that hold a hit (item's words from place on are the text's from at on)."""
        step = np.arange(k - n, n)  # words of these windows, from the hit on
        mine, other = (self.start[item] + place)[:, None] + step, at[:, None] + step
        sound = (mine >= self.start[item][:, None]) & (mine < self.end[item][:, None]) & (other >= 0) & (other < len(words))
        same = sound & (self.words[np.where(sound, mine, 0)] == words[np.where(sound, other, 0)])
        count, reach = (np.pad(np.cumsum(x, axis=1), ((0, 0), (1, 0))) for x in (same, sound))
        equal = np.where(reach[:, n:] - reach[:, :-n] == n, count[:, n:] - count[:, :-n], -1)
        top = equal.argmax(1)
        for r in np.flatnonzero(100 * equal.max(1) >= self.percent * n):
            i, d = int(item[r]), int(step[top[r]])
            found = (-int(equal[r, top[r]]), int(at[r]) + d, int(place[r]) + d, n)
            best[i] = min(best.get(i, found), found)


def _block_count(items: DataFrame) -> int:
    chars = items.filter("text is not null").agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return max(1, -(-chars // BLOCK_CHARS))


def _blocks(items: DataFrame, blocks: int, window: int, percent: int, least_words: int) -> Iterator:
    """Broadcasts of the Seeds of the items (item_id, text) of ``least_words`` words or more, in so many blocks."""
    spark = items.sparkSession
    items = items.selectExpr("cast(item_id as long) item_id", "text").filter("text is not null")
    for block in range(blocks):
        rows = items.filter(F.expr(f"pmod(xxhash64(item_id, text), {blocks}) = {block}")).collect()
        own = [(r["item_id"], r["text"]) for r in rows if len(letter_words(np.frombuffer(r["text"].encode(), np.uint8))[0]) >= least_words]
        yield spark.sparkContext.broadcast(Seeds(own, window, percent))


def leaks(docs: DataFrame, items: DataFrame, window: int = 20, percent: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per document and test item found in it: doc_id, item_id, word (in the text), item_word, n_words, n_equal.

    docs: doc_id, text; items: item_id, text. The items go to the executors in
    blocks of BLOCK_CHARS characters; every block costs a pass over the documents,
    and of several one is held at a time.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    names = ["doc_id", "item_id", "word", "item_word", "n_words", "n_equal"]

    def found(seeds) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "text"):
                hits = [(i, *hit) for i, view in enumerate(text_views(batch.column(1))) for hit in seeds.value.leaks(letter_words(view)[0])]
                if hits:
                    row, *rest = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in rest)], names)

        return docs.mapInArrow(search, ", ".join(f"{n} long" for n in names))

    blocks, out = _block_count(items), []
    for seeds in _blocks(items, blocks, window, percent, least_words):
        out.append(found(seeds))
        if blocks > 1:
            out[-1] = materialise(out[-1], "leaks")
            seeds.unpersist()
    return reduce(DataFrame.union, out)


def without_leaks(docs: DataFrame, items: DataFrame, window: int = 20, percent: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item: one filter a block of items, without a shuffle; beyond one block, what passes is written."""

    def clean(seeds):
        def test(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            give_back()
            for column in texts:
                yield pa.array([not seeds.value.leaks(letter_words(view)[0]) for view in text_views(column)], pa.bool_())

        return F.arrow_udf(test, "boolean")

    blocks = _block_count(items)
    for seeds in _blocks(items, blocks, window, percent, least_words):
        before, docs = docs, docs.filter(clean(seeds)("text"))
        if blocks > 1:
            docs = materialise(docs, "clean")
            discard(before)
            seeds.unpersist()
    return docs
