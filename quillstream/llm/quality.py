"""Quality rules, line first, with DataFrame functions only.

Each line is judged by itself: navigation (separators between few words),
punctuation (no end of sentence in it, or shouted or marked word by word) and
boilerplate (fixed phrases). Lines that fail are removed, and a document is
rejected when it fails the base rules or loses more than ``most_lost`` percent of
its word characters with those lines.

Nulls count as texts without words; such a text fails the base rules. Repeated
rows repeat in the result; an empty table gives an empty one. Other columns are
not read. There is no shuffle: all counts of a text are made within its row, in
n log n steps for n words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed phrases of notices, in lower case; a line of at most NOTICE_WORDS words that holds one is boilerplate.
NOTICES = (
    "all rights reserved", "licensed under", "released under the", "this work is licensed", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "use cookies", "enable javascript", "lorem ipsum", "sign up for", "subscribe to our", "skip to content",
)
NOTICE_WORDS = 20

_SPACE = r"[\x20\x09-\x0D]"
_BARE = "translate({}, ' \\t\\n\\u000b\\u000c\\r', '')"
#: An end of sentence: its mark, closing marks, then white space or the line's end.
SENTENCE_END = r"[.!?…。！？:;][\"'”’»)\]]*([\x20\x09-\x0D]|$)"


def _bare(text: str) -> str:
    """The text without ASCII white space, as an expression."""
    return _BARE.format(text)


def line_fails(line: str = "l") -> str:
    """SQL expression: does the line fail a rule? A line without a word does not."""
    words = f"regexp_count({line}, '[^\\\\x20\\\\x09-\\\\x0D]+')"
    navigation = f"3 * (length({line}) - length(translate({line}, '|»›•', ''))) >= greatest({words}, 6)"
    marked = f"2 * regexp_count({line}, '[#*$%&<>!]{{2,}}') >= {words}"
    unended = f"not regexp_like({line}, r'{SENTENCE_END}')".replace("r'[", "'[").replace("\\", "\\\\").replace("\"'”", "\"\\'”")
    notice = f"({words} <= {NOTICE_WORDS} and ({' or '.join(f'contains(lower({line}), {n!r})' for n in NOTICES)}))"
    return f"(length({_bare(line)}) > 0 and (({navigation}) or ({marked}) or ({unended}) or {notice}))"


def quality(docs: DataFrame, least_words: int = 50, most_repeated: int = 50, most_lost: int = 30) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, chars_removed."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text")
    # Each step's columns are used more than once in the next, so that Spark keeps the steps apart.
    rows = rows.selectExpr(
        "doc_id", "text", f"{_bare('text')} bare",
        "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '') words",
        f"filter(split(text, '\\n'), l -> length({_bare('l')}) > 0) lines",
    )
    rows = rows.selectExpr(
        "doc_id", "length(bare) word_chars", "length(bare) - length(translate(bare, '#*$%&|<>', '')) n_symbols", "size(words) n_words",
        "size(lines) - size(array_distinct(lines)) n_dup_lines", f"filter(lines, l -> {line_fails()}) failed",
        "sort_array(transform(if(size(words) >= 3, sequence(0, size(words) - 3), array()), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) as h, i as p))) grams",
    )
    rows = rows.selectExpr(
        "doc_id", "word_chars", "n_symbols", "n_words", "n_dup_lines", "size(failed) n_lines_removed",
        f"aggregate(failed, 0L, (n, l) -> n + length({_bare('l')})) chars_removed",
        "sort_array(transform(filter(grams, (g, i) -> g.h <=> get(grams, i - 1).h or g.h <=> get(grams, i + 1).h), g -> g.p)) again",
    )
    rows = rows.withColumn("n_repeat_words", F.expr("aggregate(transform(again, (p, i) -> least(3, coalesce(get(again, i + 1) - p, 3))), 0L, (n, x) -> n + x)"))
    rows = rows.withColumn("base_failed", F.expr(f"n_words < {int(least_words)} or 100 * n_repeat_words > {int(most_repeated)} * n_words"))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    kept = F.expr(f"not base_failed and 100 * chars_removed <= {int(most_lost)} * word_chars").alias("kept")
    return rows.select("doc_id", *counts, "base_failed", kept, F.col("n_lines_removed").cast("long").alias("n_lines_removed"), "chars_removed")
