"""Periodic runs of words by block matching.

A run is a stretch of consecutive words with smallest period q, of at least
``max(least, times * q)`` words (``times`` is 4 or more), that neither neighbour
extends. Runs are looked for scale by scale: at scale L = 1, 2, 4, ... those with
L <= q < 2 L. Such a run holds a block of L words that begins at a multiple of L
and comes again q words later. So the aligned blocks of a document go as
integer-sequence keys into an Aho-Corasick automaton, the document is searched
with it, and every block met again at a distance of L to 2 L - 1 seeds an exact
extension to both sides.

Two rules keep blocks away that cannot be needed, and lose no run:

* every word of a run but its last q comes again within q words, so at scale L
  only stretches of 3 L words (5 at scale 1) whose next equal word is nearer than
  2 L are searched;
* a block whose surroundings (3 L words) lie in one run found at a smaller scale
  repeats with a multiple of that run's period (Fine and Wilf), which is not the
  smallest.

Steps grow with n log n for n words, whatever the words. Each row is worked on by
itself: no shuffle, batches of bounded bytes.

Nulls count as texts without words; a text without words has no run and an empty
collapsed text. Repeated rows repeat in the result; an empty table gives an empty
one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, text_views

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_ids(words: list[bytes]) -> np.ndarray:
    """A dense number for each word, equal for equal words only."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _gaps(ids: np.ndarray) -> np.ndarray:
    """How many words further each word comes again; the text's length where it does not."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), len(ids), np.int64)
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    gap[order[same]] = order[same + 1] - order[same]
    return gap


def _stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and end place of each maximal stretch of true flags of at least ``least``."""
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=0, append=0))
    first, end = edge[::2], edge[1::2]
    long = end - first >= least
    return list(zip(first[long].tolist(), end[long].tolist(), strict=True))


def _equal_right(ids: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on (i < j)."""
    n, most, step = 0, len(ids) - j, 32
    while n < most:
        step = min(step, most - n)
        differ = ids[i + n : i + n + step] != ids[j + n : j + n + step]
        if differ.any():
            return n + int(differ.argmax())
        n, step = n + step, 4 * step
    return n


def _equal_left(ids: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j (i < j)."""
    n, step = 0, 32
    while n < i:
        step = min(step, i - n)
        differ = (ids[i - n - step : i - n] != ids[j - n - step : j - n])[::-1]
        if differ.any():
            return n + int(differ.argmax())
        n, step = n + step, 4 * step
    return n


def _is_power(ids: np.ndarray, start: int, period: int) -> bool:
    """Are the ``period`` words from ``start`` on several copies of fewer words?"""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            part = period // prime
            if np.array_equal(ids[start : start + period - part], ids[start + part : start + period]):
                return True
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return False


def _seeds(ids: np.ndarray, gap: np.ndarray, scale: int, least: int, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of aligned blocks of ``scale`` words and the distances, from scale to 2 scale - 1, at which they come again.

    inside: for each place the end of a run found before that reaches furthest from there.
    """
    n = len(ids)
    found = _stretches(gap < 2 * scale, least)
    if not found:
        return
    kind = np.full(n // scale + 2, -1, np.int64)  # of each aligned block: its key, if it is one
    keys: dict[tuple, int] = {}
    for first, end in found:
        starts = np.arange(-(-first // scale) * scale, end - scale + 1, scale)
        for b in starts[inside[starts] < np.minimum(starts + 3 * scale - 1, n)].tolist() if len(starts) else ():
            kind[b // scale] = keys.setdefault(tuple(ids[b : b + scale].tolist()), len(keys))
    if not keys:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, number in keys.items():
        automaton.add_word(key, number)
    automaton.make_automaton()
    for first, end in found:
        if not (kind[first // scale : end // scale + 1] >= 0).any():
            continue
        hits = list(automaton.iter(tuple(ids[first : min(n, end + 2 * scale)].tolist())))
        if not hits:
            continue
        at, number = np.array(hits, np.int64).T
        at = at + (first - scale + 1)
        block = at // scale - 1  # the one aligned block that lies scale to 2 scale - 1 words before
        own = (block >= 0) & (kind[np.maximum(block, 0)] == number)
        yield from zip((block[own] * scale).tolist(), (at[own] - block[own] * scale).tolist(), strict=True)


def find_runs(ids: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, by start, then period."""
    if times < 4:
        raise ValueError("times must be 4 or more: a shorter run need not hold a block and its copy")
    n, out, scale = len(ids), [], 1
    if n < least:
        return out
    gap = _gaps(ids)
    inside = np.zeros(n, np.int64)
    while times * scale <= n:
        reached: dict[int, int] = {}  # of each period: the end of the last stretch that keeps it
        fresh = []
        for b, q in _seeds(ids, gap, scale, max((times - 1) * scale, least - 1 if scale == 1 else 0), inside):
            if b + scale + q <= reached.get(q, 0) or inside[b] >= b + q + scale:
                continue
            start = b - _equal_left(ids, b, b + q)
            end = b + q + _equal_right(ids, b, b + q)
            reached[q] = end
            if end - start >= max(least, times * q) and not _is_power(ids, start, q):
                fresh.append((start, end - start, q))
        for start, length, q in fresh:
            np.maximum(inside[start : start + length], start + length, out=inside[start : start + length])
        out += fresh
        scale *= 2
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def repeated_places(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Of n words, those that some run contains after its first period."""
    gone = np.zeros(n, bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return gone


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """Per row: doc_id, n_words, its runs, and collapsed: the text's words but the repeated ones, joined by one space."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            counts, runs, texts = [], [], []
            for view in text_views(batch.column(1)):
                words = view.tobytes().split()
                found = find_runs(word_ids(words), least, times)
                counts.append(len(words))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                if found:
                    gone = repeated_places(found, len(words)).tolist()
                    words = [w for w, x in zip(words, gone, strict=True) if not x]
                texts.append(b" ".join(words))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(detect, SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where about one document in ten repeats p of its words from word a on, as its doc_id's checksum says.

    h = crc32 of the decimal doc_id, g = h div 10; if h is divisible by 10, word
    i >= a becomes word a + (i - a) % p, with a = g % n, p = 1 + (n - a) div (3 + g % 8)
    for n words. A text without words, or without a doc_id, stays.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text", "crc32(cast(cast(doc_id as long) as string)) h")
    # The words are used more than once in the next step, so that Spark keeps the steps apart.
    rows = rows.selectExpr("doc_id", "text", "h div 10 g", "if(h % 10 = 0, filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != ''), null) words")
    rows = rows.selectExpr("doc_id", "text", "g", "words", "if(size(words) > 0, cast(g % size(words) as int), null) a")
    rows = rows.selectExpr("doc_id", "text", "words", "a", "cast(1 + (size(words) - a) div (3 + g % 8) as int) p")
    return rows.selectExpr("doc_id", "if(a is null, text, array_join(transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p])), ' ')) text")


def run_digests(runs: DataFrame) -> DataFrame:
    """The result of ``periodic_runs`` as counts, the longest run (ties: smallest start, then period) and digests."""
    rows = runs.withColumn("top", F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))"))
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return rows.selectExpr(
        "doc_id", "cast(size(runs) as long) n_runs", "top.start start", "-top.length length", "top.period period",
        "(-1000 * top.length) div top.period exponent_milli", f"sha2({listed}, 256) runs_sha256", "sha2(collapsed, 256) collapsed_sha256", "n_words",
    )
