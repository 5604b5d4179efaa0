"""Substring dedup by hashing units of lines, lines, paragraphs and long windows.

A unit is a line, or each sentence of a line that holds several; it reaches up to
the next one, so the units of a text concatenate to the text. Normalised, a text
is its words (runs of letters and digits, A-Z lower-cased; all else parts words).
A passage, named by the 128-bit hash of its words, is one of

- each line and each paragraph (lines between blank ones) of ``least_line`` words
  or more: a whole line that comes again is a copy;
- the shortest run of units from each unit on, and up to each unit, of
  ``least_words`` words or more, so that every repeated run of units of that size
  goes as a whole; single sentences recur by chance, so these are longer;
- each window of WINDOW words inside one unit, wherever the passage was pasted.

Words count as such in most scripts; in scripts without spaces a Chinese or
Japanese character is worth half a word, a Thai, Lao, Khmer or Burmese one a
quarter. Passages are grouped over all documents: the earliest occurrence (by
doc_id, then first word) stays, and the bytes of all others are removed, with what
lies between two removed passages without a word. A word that goes stands in the
same passage at an earlier place, so every passage stays somewhere.

A repeated stretch that is neither whole units nor WINDOW words inside one unit
keeps its broken ends; of scripts without spaces, whole units only.

First the hashes alone are counted (combined map-side); only those met twice are
joined back to their places, in a join of two written sides whose hot keys Spark
can split, and only what comes out of it is grouped for its earliest place, again
as a minimum that combines map-side. So a passage that fills a third of the corpus
never meets in one group.

Nulls count as empty. Rows of one doc_id are told apart by their texts: of two
that share a passage the earlier place keeps it, then that of the smaller hash of
the text; an exact repetition of a row removes nothing. Rows without doc_id come
back whole and neither remove nor are kept for others. An empty table gives an
empty result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, _BASE, _BASE_INV, _LOWER, _Tables, _powers, by_bytes, discard, give_back, materialise, mix, named_rows, prefix_hash, text_views

_OTHER = 0xD6E8FEB86659FD93 | 1
_OTHER_INV = pow(_OTHER, -1, 2**64)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
#: Least words of a whole line or paragraph that is removed, and of a run of units: single sentences recur by chance in
#: texts that share nothing else.
LEAST_LINE, LEAST_WORDS = 8, 25
#: Words of the windows laid over units of that many words or more.
WINDOW = 25


class _WordPowers:
    """Powers of two bases and of their inverses, grown to the longest text that the worker met (in words)."""

    tables = [_powers(x, 1 << 12) for x in (_BASE, _BASE_INV, _OTHER, _OTHER_INV)]

    @classmethod
    def upto(cls, n: int) -> list[np.ndarray]:
        if n > len(cls.tables[0]):
            size = 1 << n.bit_length()
            tables = [_powers(x, size) for x in (_BASE, _BASE_INV, _OTHER, _OTHER_INV)]
            if n > 1 << 20:  # too large to keep
                return tables
            cls.tables = tables
        return cls.tables


def letter_words(data: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each run of letters and digits, A-Z lower-cased, parted at ``cuts`` too."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _LETTER[data]
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if cuts is not None and len(cuts):
        inner = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # cuts between two letters
        first, last = np.sort(np.append(first, inner)), np.sort(np.append(last, inner))
    p = prefix_hash(_LOWER[data])
    _, down = _Tables.upto(len(data))
    return mix((p[last] - p[first]) * down[first] + (last - first).astype(np.uint64)), first, last


def unit_starts(data: np.ndarray) -> np.ndarray:
    """First byte of each unit: 0, behind each line end, behind the white space after an end of sentence, and behind a full-width one."""
    if not len(data):
        return np.empty(0, np.int64)
    blank = SPACE[data]
    new = np.zeros(len(data), bool)
    new[0] = True
    new[1:] = data[:-1] == 0x0A
    stop = np.zeros(len(data), bool)
    stop[1:] = _STOP[data[:-1]] & blank[1:]  # the blank behind an end of sentence
    run = np.flatnonzero(stop)
    if len(run):
        full = np.flatnonzero(~blank)
        nxt = np.searchsorted(full, run)
        nxt = full[nxt[nxt < len(full)]]
        new[nxt] = True
    if len(data) > 3:  # full-width . ! ?
        x, y, z = data[:-3], data[1:-2], data[2:-1]
        wide = (x == 0xE3) & (y == 0x80) & (z == 0x82) | (x == 0xEF) & (y == 0xBC) & ((z == 0x81) | (z == 0x9F))
        new[3:] |= wide & ~blank[3:]
    return np.flatnonzero(new)


def quarter_words(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Size of each word in quarters of a word: 4, or what its characters without spaces are worth."""
    worth = np.zeros(len(data) + 1, np.int64)
    if len(data) and data.max() >= 0xE0:
        nxt = np.append(data[1:], 0)
        quarter = (data == 0xE0) & (nxt >= 0xB8) & (nxt <= 0xBB) | (data == 0xE1) & ((nxt >= 0x80) & (nxt <= 0x82) | (nxt >= 0x9E) & (nxt <= 0x9F))
        np.cumsum(2 * ((data >= 0xE3) & (data <= 0xE9)) + quarter, out=worth[1:])
    return np.maximum(4, worth[last] - worth[first])


def passages(data: np.ndarray, least_words: int, least_line: int) -> tuple[np.ndarray, ...]:
    """(hash, other hash, byte of the first word, bytes before it that go along, bytes from it on) of each passage of one text."""
    start = unit_starts(data)
    words, first, last = letter_words(data, start)
    stop = np.append(start, len(data))[1:]
    at = np.searchsorted(first, np.append(start, len(data)))
    full = at[1:] > at[:-1]
    start, stop, a, b = start[full], stop[full], at[:-1][full], at[1:][full]
    size = np.concatenate([np.zeros(1, np.int64), np.cumsum(quarter_words(data, first, last))])
    least = 4 * least_words
    ahead = np.searchsorted(size[b], size[a] + least)
    back = np.searchsorted(size[a], size[b] - least, "right") - 1
    runs = [(a[ahead < len(b)], b[ahead[ahead < len(b)]]), (a[back[back >= 0]], b[back >= 0])]
    ends = np.flatnonzero(data == 0x0A)
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    empty = ends[np.diff(solid[ends], prepend=0) == 0]
    for breaks in (ends, empty):
        new = np.flatnonzero(np.diff(np.searchsorted(breaks, start), prepend=-1))
        p, q = a[new], b[np.append(new[1:], len(start)) - 1] if len(new) else b[:0]
        own = size[q] - size[p] >= 4 * least_line
        runs.append((p[own], q[own]))
    long = np.flatnonzero(b - a >= WINDOW)
    runs += [(p := np.arange(x, y - WINDOW + 1), p + WINDOW) for x, y in zip(a[long], b[long], strict=True)]
    code = np.unique(np.concatenate([p * (len(words) + 1) + q for p, q in runs]))
    p, q = np.divmod(code, len(words) + 1)
    before, end = np.zeros(len(words), np.int64), last.copy()
    before[a], end[b - 1] = first[a] - start, stop
    out = []
    powers = _WordPowers.upto(len(words) + 1)
    for up, down in (powers[:2], powers[2:]):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        out.append(mix((sums[q] - sums[p]) * down[p] + (q - p).astype(np.uint64)).view(np.int64))
    return out[0], (out[1] >> 32).astype(np.int32), first[p].astype(np.int32), before[p].astype(np.int32), (end[q - 1] - first[p]).astype(np.int32)


ROWS = "doc_id long, u int, h long, g int, start int, before int, length int"


def _passage_rows(docs: DataFrame, least_words: int, least_line: int) -> DataFrame:
    names = [x.split()[0] for x in ROWS.split(", ")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in by_bytes(batches, "text", tidy=True):
            parts = [passages(view, least_words, least_line) for view in text_views(batch.column(2))]
            own = pa.array(np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts]))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x) for x in columns)], names)

    return docs.filter("doc_id is not null").mapInArrow(make, ROWS)


def _hash_rows(docs: DataFrame, least_words: int, least_line: int) -> DataFrame:
    """The passages' first hashes alone."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in by_bytes(batches, "text", tidy=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([passages(view, least_words, least_line)[0] for view in text_views(batch.column(0))]))], ["h"])

    return docs.filter("doc_id is not null").select("text").mapInArrow(make, "h long")


def removed_passages(docs: DataFrame, least_words: int = LEAST_WORDS, least_line: int = LEAST_LINE) -> DataFrame:
    """Per removed passage: doc_id, u (a hash that tells texts of one doc_id apart), start, end (bytes of the original)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("u"), "text")
    # hashed twice: kept on disk, the passages would take as much as the texts
    often = materialise(_hash_rows(docs, least_words, least_line).groupBy("h").count().filter("count > 1").select("h"), "often")
    met = materialise(_passage_rows(docs, least_words, least_line).join(often, "h"), "met")
    discard(often)
    first = met.groupBy("h", "g").agg(F.min(F.struct("doc_id", "u", "start")).alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = materialise(first, "first")
    again = met.join(first, ["h", "g"]).filter("struct(doc_id, u, start) != kept")
    return again.selectExpr("doc_id", "u", "cast(start - before as long) start", "cast(start as long) + length end")


def spans_to_cut(view: np.ndarray, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) of a text, from its removed passages (sorted by start); what parts them without a word goes too."""
    word = np.concatenate([[0], np.cumsum(_LETTER[view])])
    out: list[tuple[int, int]] = []
    for a, b in zip(starts, ends, strict=True):
        if out and word[a] <= word[out[-1][1]]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    if len(out) == 1 and word[out[0][0]] == 0 and word[out[0][1]] == word[-1]:
        return [(0, len(view))]
    return out


REMOVAL = "text string, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept_sha256 string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def cut_text(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Texts and their removed passages, sorted by start -> REMOVAL."""
    give_back()
    for texts, marks in columns:
        out: list[list] = [[], [], [], [], [], []]
        for view, known, own in zip(text_views(texts), texts.is_valid().to_pylist(), marks, strict=True):
            own = own.values if own.is_valid else []
            runs = spans_to_cut(view, *(own.field(k).to_pylist() for k in ("start", "end"))) if len(own) else []
            left, last = [], 0
            for a, b in runs:
                left.append(view[last:a].tobytes())
                last = b
            left = b"".join([*left, view[last:].tobytes()])
            spans = [{"start": a, "end": b} for a, b in runs]
            for x, v in zip(out, (left if known else None, len(view), len(view) - len(left), len(runs), spans, hashlib.sha256(left).hexdigest()), strict=True):
                x.append(v)
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.string())
        arrays = [pa.array(x, t) for x, t in zip(out, types, strict=True)]
        yield pa.StructArray.from_arrays([arrays[0].cast(pa.string()), *arrays[1:]], ["text", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])


def cut_rows(docs: DataFrame, least_words: int = LEAST_WORDS, least_line: int = LEAST_LINE) -> DataFrame:
    """Per row: ``row``, a struct of all columns of ``docs`` as they were, and ``removal``, a struct of REMOVAL."""
    cut = removed_passages(docs, least_words, least_line)
    per_doc = cut.groupBy("doc_id", "u").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("marks"))
    # not deterministic to the optimizer, which would else run it once for a filter and once for the result
    cut_out = F.arrow_udf(cut_text, REMOVAL).asNondeterministic()
    return named_rows(docs).join(per_doc, ["doc_id", "u"], "left").select("row", cut_out("row.text", "marks").alias("removal"))


def substring_dedup(docs: DataFrame, least_words: int = LEAST_WORDS, least_line: int = LEAST_LINE) -> DataFrame:
    """Per row: doc_id, text (what is left), n_bytes, n_removed, n_spans, spans, kept_sha256 (of what is left)."""
    return cut_rows(docs.select("doc_id", "text"), least_words, least_line).select(F.col("row.doc_id").cast("long").alias("doc_id"), "removal.*")
