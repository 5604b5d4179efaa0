"""Text, URL and label functions as native Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed

#: White space as scripts define it, spelt out: Java's \s is ASCII only.
BLANK = r"[\x09-\x0D\x20   -     　﻿]"

#: The characters of BLANK.
_BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def trimmed(c: Column) -> Column:
    # not by a pattern, which is tried at each blank of the whole text
    return F.btrim(c, F.lit(_BLANKS))


def collapsed(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def source_identity(c: Column) -> Column:
    return F.lower(collapsed(c))


def normalized_headline(c: Column) -> Column:
    """Lower-cased letters and digits, one blank between words; "" if null."""
    return F.coalesce(collapsed(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]+", " ")), F.lit(""))


def live_subject(headline: Column) -> Column:
    """What a "live updates:" or "live blog:" headline is about, or null."""
    marker = rf"(?i)^{BLANK}*live{BLANK}+(?:updates?|blog){BLANK}*:{BLANK}*"
    subject = normalized_headline(F.regexp_replace(headline, marker, ""))
    return F.when(headline.rlike(marker) & (subject != ""), subject)


def canonical_url(raw: Column) -> Column:
    """http and https URLs in one spelling: lower-case scheme and host, no fragment, no tracking parameters, sorted parameters, no closing slashes; else null."""
    url = F.regexp_replace(trimmed(raw), "#.*$", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    default = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.when(F.length(path) <= 1, F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(rest, r"\?(.*)$", 1)

    def kept(p: Column) -> Column:
        name = F.lower(F.substring_index(p, "=", 1))
        return (p != "") & ~name.isin(*fixed.TRACKING_NAMES) & ~name.rlike("^(?:" + "|".join(fixed.TRACKING_PREFIXES) + ")")

    params = F.filter(F.split(query, "&"), kept)
    # stable by name: equal names keep their order
    numbered = F.transform(params, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.locate("=", p) > 0, p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    search = F.array_join(F.transform(F.array_sort(numbered), lambda s: s["p"]), "&")
    tail = F.when(search != "", F.concat(F.lit("?"), search)).otherwise("")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), default, F.when(path == "", "/").otherwise(path), tail))


def host_of(canonical: Column) -> Column:
    return F.regexp_extract(canonical, r"^https?://([^/:?]*)", 1)


@F.pandas_udf(StringType())
def _decoded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Numeric character references, which no built-in function decodes."""

    def one(m: re.Match) -> str:
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else ""

    for s in parts:
        yield s.map(lambda x: re.sub(r"&#(?:(\d+)|x([0-9a-fA-F]+));", one, x), na_action="ignore")


def strip_html(c: Column, numeric: bool = True) -> Column:
    """Text without tags and with entities decoded. ``numeric=False`` leaves numeric references and stays in the JVM."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    if numeric:
        out = _decoded(out)
    for name, char in fixed.ENTITIES.items():
        if name != "amp":
            out = F.regexp_replace(out, f"(?i)&{name};", char)
    return F.coalesce(collapsed(F.regexp_replace(out, "(?i)&amp;", "&")), F.lit(""))


#: Accented Latin letters of the languages at hand, and what they fold to.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the lower-cased text, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def family_key(headline: Column) -> Column:
    """Sorted distinct words of a headline without stopwords and short words; "" if none is left."""
    words = tokens(F.translate(F.lower(headline), ACCENTED, PLAIN))
    kept = F.filter(words, lambda t: ((F.length(t) >= 3) | t.isin(*fixed.FAMILY_SHORT)) & ~t.isin(*fixed.FAMILY_STOPWORDS))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def evidence_tokens(c: Column, without: Iterable[str] = ()) -> Column:
    """Distinct words of three letters or more, without stopwords and the given ones."""
    out = sorted({*fixed.EVIDENCE_STOPWORDS, *without})
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= 3) & ~t.isin(*out)))


def plain_tokens(text: str) -> list[str]:
    """``tokens`` of a setting, on the driver."""
    return re.findall(r"[^\W_]+", text.lower())


def spellings(geography: str) -> tuple[str, ...]:
    """Other spellings of a configured geography, whatever its case."""
    return next((v for k, v in fixed.GEO_SYNONYMS.items() if k.lower() == geography.strip().lower()), ())


def places_of(geographies: Iterable[str]) -> dict[str, str]:
    """Place -> the first configured geography that it lies in, by name or another spelling."""
    named = [(g, {x.strip().lower() for x in (g, *spellings(g))}) for g in geographies if g and g.strip()]
    return {place: own for place, country in fixed.GEO_ALIASES.items() if (own := next((g for g, all_ in named if country.lower() in all_), None))}


def geography_of(c: Column, geographies: Iterable[str]) -> Column:
    """The configured geography in which a place lies, or null."""
    table = places_of(geographies)
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.lower(F.trim(c)))


def geography_words(geographies: Iterable[str]) -> tuple[str, ...]:
    """Words of the configured geographies, their other spellings and the places in them."""
    own = [g for g in geographies if g and g.strip()]
    return tuple(sorted({w for x in (*own, *(s for g in own for s in spellings(g)), *places_of(own)) for w in plain_tokens(x)}))


def theme_words() -> tuple[str, ...]:
    """Words of three letters or more that say an item is about elections."""
    forms = [f for c in fixed.ELECTION_CONCEPTS for own in fixed.LEXICON[c] for f in own]
    return tuple(sorted({w for f in (*forms, *fixed.ELECTION_EXTRAS) for w in plain_tokens(f) if len(w) >= 3 and w not in fixed.ELECTION_VAGUE}))


def words_of(c: Column) -> Column:
    """Runs of ASCII letters, digits and _ of the lower-cased text."""
    # what is no word character, spelt out: Java matches a negated class of several ranges some ten times more slowly
    return F.split(F.lower(c), r"[\x00-\x2F\x3A-\x5E\x60\x7B-\x{10FFFF}]+")


def token_pattern(terms: Iterable[str]) -> str | None:
    """A pattern that finds any of the lower-cased terms as whole ASCII words of a lower-cased text; None without a term."""
    own = []
    for t in (t.strip().lower() for t in terms if t and t.strip()):
        first, last = (bool(re.match("[a-z0-9_]", x)) for x in (t[0], t[-1]))
        escaped = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", t)
        own.append(f"{'(?<!' if first else '(?<='}[a-z0-9_]){escaped}{'(?!' if last else '(?='}[a-z0-9_])")
    return "|".join(own) if own else None


def mentions(c: Column, terms: Iterable[str], words: Column | None = None) -> Column:
    """Does the text name a term as whole ASCII words, whatever the case? ``words``: words_of(c), where it is at hand.

    Terms of one word are looked up among the text's words; the others need a pattern.
    """
    own = list(dict.fromkeys(t.strip().lower() for t in terms if t and t.strip()))
    single = [t for t in own if re.fullmatch("[a-z0-9_]+", t)]
    pattern = token_pattern(t for t in own if t not in single)
    found = F.lit(False)
    if single:
        found = F.arrays_overlap(words if words is not None else words_of(c), F.array(*map(F.lit, single)))
    if pattern is not None:
        found = found | F.lower(c).rlike(pattern)
    return F.coalesce(found, F.lit(False))


def concept_of(term: str) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    t = term.strip().lower()
    for name, (en, es) in fixed.LEXICON.items():
        if t == name or t in en or t in es:
            return en, es
    return None


def english_forms(term: str) -> list[str]:
    """The term and its concept's English forms that are not Spanish ones too."""
    own = concept_of(term)
    return list(dict.fromkeys([term.strip(), *([w for w in own[0] if w not in own[1]] if own else [])]))


def all_forms(term: str) -> list[str]:
    own = concept_of(term)
    return list(dict.fromkeys([term.strip(), *([*own[0], *own[1]] if own else [])]))


#: Lower-case letters whose capital is one letter only where each letter is mapped by itself: sharp s, and Greek ones with iota subscript.
_ONE_CAPITAL = {"ß": "ẞ"} | {chr(i): chr(i).title() for i in (*range(0x1F80, 0x1FB0), 0x1FB3, 0x1FC3, 0x1FF3) if len(chr(i).title()) == 1}


def upper_letters(c: Column) -> Column:
    """In capitals, letter by letter: as many characters as before, so ß is ẞ and not SS; what has no capital of one letter stays."""
    whole = F.upper(c)
    small, large = "".join(_ONE_CAPITAL), "".join(_ONE_CAPITAL.values())
    one = F.transform(F.split(c, ""), lambda x: F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(F.translate(x, small, large)))
    return F.when(F.length(whole) == F.length(c), whole).otherwise(F.array_join(one, ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def story_id(source_ids: Column, topic: Column) -> Column:
    """16 hex digits that name a set of sources under a topic."""
    return short_hash(F.concat(F.array_join(F.sort_array(source_ids), ","), F.lit("::"), F.lower(F.trim(F.coalesce(topic, F.lit(""))))))


def capped_summary(c: Column, most: int = 500) -> Column:
    """The text, cut behind the last full stop before a blank within ``most`` characters if it comes late enough (0.6 of them), else at the last blank."""
    head = F.regexp_replace(F.substring(c, 1, most), r"\s+$", "")
    stop = F.length(head) - F.length(F.substring_index(head, ". ", -1)) - 2  # before it; -2 where there is none
    blank = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    cut = F.when(stop >= most * 6 // 10, F.substr(head, F.lit(1), stop + 1)).when(blank > 0, F.concat(F.substr(head, F.lit(1), blank), F.lit("…"))).otherwise(F.concat(head, F.lit("…")))
    return F.when(F.length(c) <= most, c).otherwise(cut)


def time_ago(minutes: Column) -> Column:
    m = F.floor(minutes)
    hours, rest, days = F.floor(m / 60), m % 60, F.floor(m / 1440)
    of_day = F.concat(hours.cast("string"), F.lit("h"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit("m"))).otherwise(""), F.lit(" ago"))
    return F.when(m < 1, "just now").when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).when(m < 1440, of_day).otherwise(F.concat(days.cast("string"), F.lit("d ago")))


def sentence_count(c: Column) -> Column:
    """Sentences: runs closed by ., ! or ?, and an unclosed tail."""
    closed = F.regexp_count(c, F.lit(r"(?<=[^.!?])[.!?]"))  # linear: no run is scanned twice
    tail = F.trim(F.when(c.rlike("[.!?]"), F.regexp_extract(c, r"(?s)^.*[.!?](.*)$", 1)).otherwise(c)) != ""
    return (closed + tail.cast("int")).cast("long")
