"""Checks and forms of written lines, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import bound, sentence_count, short_hash, source_identity, trimmed


def repeats(a: Column, b: Column) -> Column:
    """Does line ``a`` say what ``b`` says? Equal, one inside the other, or nearly the same words; null and empty lines repeat nothing."""
    x, y = (source_identity(F.coalesce(c, F.lit(""))) for c in (a, b))
    xs, ys = (F.array_distinct(F.filter(F.split(c, "[^a-z0-9]+"), lambda t: F.length(t) > 2)) for c in (x, y))
    n, m, both = F.size(xs), F.size(ys), F.size(F.array_intersect(xs, ys))
    inside = ((F.length(x) >= fixed.REPEAT_CHARS) & F.contains(y, x)) | ((F.length(y) >= fixed.REPEAT_CHARS) & F.contains(x, y))
    alike = (both / (n + m - both) >= fixed.REPEAT_JACCARD) | ((n <= m) & (both / n >= fixed.REPEAT_COVERED))
    return (x != "") & (y != "") & ((x == y) | inside | F.when(F.least(n, m) < fixed.REPEAT_WORDS, False).otherwise(alike))


def length_fits(c: Column) -> Column:
    """One or two sentences of at most 300 characters."""
    fits = lambda text: F.when((text == "") | (F.length(text) > fixed.PROSE_CHARS), False).otherwise(bound(sentence_count(text), lambda n: n.between(1, fixed.PROSE_SENTENCES)))
    return bound(trimmed(F.coalesce(c, F.lit(""))), fits)


def changed_prose(c: Column) -> Column:
    """struct(ok, prose, reason): without a leading "update:" or "latest:", cut to two sentences; what is too long then is refused."""

    def checked(raw: Column, text: Column, prose: Column) -> Column:
        reason = F.when(raw == "", "empty_prose").when(text == "", "empty_after_prefix_strip").when(F.length(prose) > fixed.PROSE_CHARS, "length_overflow")
        return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), prose).otherwise("").alias("prose"), reason.alias("reason"))

    def cut(text: Column) -> Column:
        # a sentence begins where a run does, or where the last one ended: no run is tried from each of its characters
        sentences = F.regexp_extract_all(text, F.lit(r"(?:(?<![^.!?])|\G)[^.!?]++[.!?]++(?:\s+|$)"), F.lit(0))
        return bound(trimmed(F.array_join(F.slice(sentences, 1, fixed.PROSE_SENTENCES), "")), lambda kept: F.when(kept != "", kept).otherwise(text))

    stripped = lambda raw: trimmed(F.regexp_replace(raw, r"(?i)^(?:update|latest)\s*:\s*", ""))
    # each step is bound, so that no text is read once for each of its uses
    return bound(trimmed(F.coalesce(c, F.lit(""))), lambda raw: bound(stripped(raw), lambda text: bound(cut(text), lambda prose: checked(raw, text, prose))))


def keyword_label(c: Column) -> Column:
    """Each word with a capital first letter; words all in capitals stay."""

    def word(t: Column) -> Column:
        lower = F.lower(t)
        return F.when(t.rlike("[A-Za-z]") & (t == F.upper(t)), t).otherwise(F.concat(F.upper(F.substring(lower, 1, 1)), F.substr(lower, F.lit(2))))

    return F.array_join(F.transform(F.split(trimmed(F.coalesce(c, F.lit(""))), r"\s+"), word), " ")


def segments_hash(segments: Column) -> Column:
    """16 hex digits over texts, each framed by its length in UTF-16 units, so that no two splits agree."""
    wide = r"[\x{10000}-\x{10FFFF}]"
    framed = F.transform(segments, lambda s: F.concat((F.length(s) + F.regexp_count(s, F.lit(wide))).cast("string"), F.lit(":"), s))
    return short_hash(F.array_join(framed, ""))
