"""How well a story's tags and entities fit a reader's settings, as Column expressions over arrays.

Null arrays count as empty. ``words``: where they are at hand, the words of the tags that a function looks through, or those of them that are ``terms_of`` the settings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import geo_names, mentioned_geo
from .text import all_forms, mentions, words_of


def _some(tags: Column) -> Column:
    return F.coalesce(tags, F.array().cast("array<string>"))


def _joined(*tags: Column) -> Column:
    return F.array_join(F.concat(*map(_some, tags)), " ")


def words(tags: Column) -> Column:
    """Words of the tags; tags that are lower-cased words already are not split again."""
    plain = F.array_join(_some(tags), "_").rlike(r"\A[\x30-\x39\x5F\x61-\x7A]*+\z")
    return F.when(plain, _some(tags)).otherwise(words_of(_joined(tags)))


def terms_of(settings) -> list[str]:
    """All that the functions here may look up among words, lower-cased."""
    forms = [f for t in (*settings.topics, *settings.keywords) for f in all_forms(t)]
    return sorted({x.strip().lower() for x in (*forms, *(n for g in settings.geographies for n in geo_names(g)))})


def _any_form(text: Column, terms: Sequence[str], words: Column | None) -> Column:
    return mentions(text, [f for t in terms for f in all_forms(t)], words)


def _has_any(tags: Column, values: Sequence[str]) -> Column:
    return F.arrays_overlap(_some(tags), F.array(*map(F.lit, values)))


def topic_fit(topics: Column, entities: Column, configured: Sequence[str], words: Column | None = None) -> Column:
    """1 if a topic tag is a configured topic in any of its forms, or an entity names one; else 0. ``words``: of the entities."""
    if not configured:
        return F.lit(0.0)
    forms = sorted({f.strip().lower() for t in configured for f in all_forms(t)})
    own = F.transform(_some(topics), lambda t: F.lower(F.trim(t)))
    return (_has_any(own, forms) | _any_form(_joined(entities), configured, words)).cast("double")


def keyword_fit(keywords: Column, entities: Column, configured: Sequence[str], words: Column | None = None) -> Column:
    """1 if the keyword tags or entities name a configured keyword in any of its forms; else 0. ``words``: of both."""
    return _any_form(_joined(keywords, entities), configured, words).cast("double") if configured else F.lit(0.0)


def geo_fit(geographies: Column, entities: Column, configured: Sequence[str], words: Column | None = None) -> Column:
    """1 if a geography tag is a configured one, or tags or entities name one; else 0. ``words``: of both."""
    if not configured:
        return F.lit(0.0)
    own = F.transform(_some(geographies), lambda g: F.lower(F.trim(g)))
    return (_has_any(own, [g.strip().lower() for g in configured]) | mentioned_geo(_joined(geographies, entities), configured, words).isNotNull()).cast("double")


def entity_fit(topics: Column, keywords: Column, geographies: Column, entities: Column, settings, words: Column | None = None) -> Column:
    """Share of the configured axes that the entities name; without entities the tags stand in for them. ``words``: of what is looked through."""
    text = F.when(F.size(_some(entities)) > 0, _joined(entities)).otherwise(_joined(topics, keywords, geographies))
    named = [_any_form(text, terms, words) for terms in (settings.topics, settings.keywords) if terms]
    if settings.geographies:
        named.append(mentioned_geo(text, settings.geographies, words).isNotNull())
    return sum((n.cast("double") for n in named), F.lit(0.0)) / len(named) if named else F.lit(0.0)


def on_beat(topics: Column, keywords: Column, entities: Column, settings) -> Column:
    """Does a topic or keyword fit? A geography alone does not; with neither topics nor keywords configured all do."""
    return beat_of(topic_fit(topics, entities, settings.topics), keyword_fit(keywords, entities, settings.keywords), settings)


def beat_of(topic: Column, keyword: Column, settings) -> Column:
    """``on_beat`` by the two fits."""
    return (topic > 0) | (keyword > 0) if settings.topics or settings.keywords else F.lit(True)


def strength(topics: Column, keywords: Column) -> Column:
    """How many of topics and keywords a story is tagged with: 0, 1 or 2."""
    return sum(((F.size(_some(t)) > 0).cast("int") for t in (topics, keywords)), F.lit(0))


def selected(axes: dict[str, Column], wanted: dict[str, Sequence[str]]) -> Column:
    """Has the story a wanted tag on every axis on which some are wanted?"""
    out = F.lit(True)
    for name, values in wanted.items():
        if values:
            out = out & _has_any(axes[name], list(values))
    return out


def scan_labels(topics: Column, keywords: Column) -> Column:
    """Up to two labels in the order of code points: two topics, else a topic and a keyword, else keywords."""
    t, k = (F.array_sort(F.array_distinct(_some(x))) for x in (topics, keywords))
    return F.when(F.size(t) >= 2, F.slice(t, 1, 2)).otherwise(F.slice(F.concat(t, k), 1, 2))
