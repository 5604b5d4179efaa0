"""Which of very many phrases a text names, by one automaton for all of them.

A phrase counts where it stands as whole ASCII words, whatever the case: where it
begins (ends) with a letter, digit or _, none of these may stand before (behind)
it; where it begins (ends) with another character, one of these has to.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of phrases that one automaton holds at most (some 100 bytes of memory each).
BLOCK_CHARS = 2_000_000
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def _automaton(phrases: Sequence[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        open_end = p.endswith("*")
        own = p[:-1] if open_end else p
        if own:
            # a phrase with and without an open end share a key
            out.add_word(own, (*out.get(own, ()), (i, len(own), own[0] in _WORD, None if open_end else own[-1] in _WORD)))
    if len(out):
        out.make_automaton()
    return out


def named_in(automaton: ahocorasick.Automaton, text: str) -> list[int]:
    """Numbers of the phrases that a lower-cased text names, in order."""
    found: set[int] = set()
    if not len(automaton):
        return []
    for end, entries in automaton.iter(text):
        behind = end + 1 < len(text) and text[end + 1] in _WORD
        for number, size, starts, ends in entries:
            if number not in found and (at := end - size + 1) >= 0:
                before = at > 0 and text[at - 1] in _WORD
                if before != starts and (ends is None or behind != ends):
                    found.add(number)
    return sorted(found)


_PLAIN = re.compile("[a-z0-9_]+(?: [a-z0-9_]+)*")
_MARKS = re.compile("[^a-z0-9_ ]+")


def phrase_finder(phrases: Sequence[str]) -> Callable[[str], set[str]]:
    """A function that gives those of the phrases (lower-cased, trimmed) that a lower-cased text names.

    Phrases of words parted by single blanks are looked up among the text's own runs of
    so many words, which costs the same however many they are; only others need an automaton.
    """
    runs: dict[int, set] = {}
    marked = []
    for p in phrases:
        if _PLAIN.fullmatch(p):
            words = tuple(p.split(" "))
            runs.setdefault(len(words), set()).add(words if len(words) > 1 else p)
        else:
            marked.append(p)
    automaton = _automaton(marked)

    def find(text: str) -> set[str]:
        found = {marked[i] for i in named_in(automaton, text)}
        if runs:
            # a mark stands between words as a word that no phrase has, a second blank as an empty one
            words = _MARKS.sub(" | ", text).split(" ")
            for n, known in runs.items():
                if n == 1:
                    found |= known.intersection(words)
                else:
                    found.update(map(" ".join, known.intersection(zip(*(words[i:] for i in range(n)), strict=False))))
        return found

    return find


def _finder(spark: SparkSession, phrases: list[str]) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(phrases)

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, own = _automaton(shared.value), shared.value
        for texts in batches:
            yield pa.array([None if t is None else [own[i] for i in named_in(automaton, t.lower())] for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(find, "array<string>")


def named_phrases(spark: SparkSession, text: Column, phrases: Sequence[str]) -> Column:
    """The phrases (lower-cased, trimmed, each once) that a text names, as an array; null for a null text.

    A phrase that ends with * may go on with further letters. A large vocabulary is
    broadcast in blocks of bounded size, all in one pass over the texts.
    """
    own = list(dict.fromkeys(p.strip().lower() for p in phrases if p and p.strip()))
    blocks: list[list[str]] = [[]]
    size = 0
    for p in own:
        if size + len(p) > BLOCK_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(p)
        size += len(p)
    return F.concat(*(_finder(spark, b)(text) for b in blocks))


def phrase_hits(rows: DataFrame, text: str, phrases: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, phrase): every phrase of a table (column phrase) that a row's text names, once a row.

    The vocabulary, not the texts, goes through the driver, in parts of at most
    BLOCK_CHARS characters; each part is one pass over the texts.
    """
    spark = rows.sparkSession
    own = phrases.select(F.lower(F.trim("phrase")).alias("phrase")).filter("phrase != ''").distinct()
    chars = own.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(1.5 * chars / BLOCK_CHARS))
    out = None
    for k in range(parts):
        part = own if parts == 1 else own.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k)
        found = rows.select(*keep, F.explode(named_phrases(spark, F.col(text), sorted(r[0] for r in part.collect()))).alias("phrase"))
        out = found if out is None else out.unionByName(found)
    return out
