"""Relevance scores as arithmetic Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import all_forms, mentions


def clamped(c: Column) -> Column:
    """Between 0 and 1; 0 where it is null or not a number."""
    return F.when(c.isNull() | F.isnan(c.cast("double")), 0.0).otherwise(F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0)))


def _age(minutes: Column) -> Column:
    return F.when(~F.isnan(minutes.cast("double")) & (minutes.cast("double") != float("inf")), minutes.cast("double"))


def freshness(minutes: Column) -> Column:
    m = _age(minutes)
    return F.when(m >= 0, 1 / (1 + m / 720)).otherwise(0.0)


def recency(minutes: Column) -> Column:
    m = _age(minutes)
    return F.when(m.isNull(), 0.0).otherwise(F.least(F.greatest(1 - m / fixed.TRAILING_MINUTES, F.lit(0.0)), F.lit(1.0)))


def corroboration(sources: Column) -> Column:
    return F.least(F.greatest(F.coalesce(sources.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(5.0)) / 5


def fraction_mentioned(text: Column, terms: Sequence[str], words: Column | None = None) -> Column:
    """Share of the terms that the text mentions in any of their forms."""
    own = [t for t in terms if t and t.strip()]
    if not own:
        return F.lit(0.0)
    return sum((mentions(text, all_forms(t), words).cast("double") for t in own), F.lit(0.0)) / len(own)


def geo_names(geo: str) -> list[str]:
    """A configured geography and the places in it."""
    wide = {geo.lower(), *(s.lower() for s in fixed.GEO_SYNONYMS.get(geo, ()))}
    return [geo, *(place for place, country in fixed.GEO_ALIASES.items() if country.lower() in wide)]


def mentioned_geo(text: Column, geos: Sequence[str], words: Column | None = None) -> Column:
    """The first configured geography that the text names, by itself, a synonym or a place in it; else null."""
    found = []
    for geo in geos:
        hit = mentions(text, geo_names(geo), words)
        for synonym in fixed.GEO_SYNONYMS.get(geo, ()):
            hit = hit | F.lower(text).rlike("(?<![a-z0-9_])" + synonym.lower().replace(".", r"\."))  # no closing boundary: some end in a mark
        found.append(F.when(hit, F.lit(geo)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def geo_ladder(own: Column, geos: Sequence[str], placed: Column, people: Column) -> tuple[Column, Column]:
    """(score, category) of an item's geographies against the configured ones; placed, people: does its text name one, or its people?"""
    if not geos:
        return F.lit(0.0), F.lit("no_configured_geo")
    overlap = F.arrays_overlap(own, F.array(*map(F.lit, geos)))
    category = F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, "implicit_geo").when(overlap, "explicit_match").otherwise("explicit_conflict")
    score = F.when(category == "explicit_match", 1.0).when(placed, 0.9).when(people, 0.7)
    return score.when(category == "explicit_conflict", 0.0).otherwise(0.5), category


def text_ladder(own: Column, text: Column, geos: Sequence[str]) -> tuple[Column, Column]:
    """``geo_ladder`` of a text by patterns, for few geographies."""
    people = mentions(text, [w for geo in geos for w in fixed.DEMONYMS.get(geo.strip().lower(), ())])
    return geo_ladder(own, geos, mentioned_geo(text, geos).isNotNull(), people)


def beat_fit(topic: Column, keyword: Column, geo: Column, commodity: Column, minutes: Column, semantic: Column | None = None) -> Column:
    """The precision score from three yes/no signals, a framing flag, the age and, if given, a semantic score."""
    w = fixed.BEAT_FIT
    signal = topic.cast("double") * w["topic"] + keyword.cast("double") * w["keyword"] + geo.cast("double") * w["geo"]
    penalty = commodity.cast("double") * w["commodity"] + F.when(~topic & ~keyword & ~geo, w["no_signal"]).otherwise(0.0)
    plain = clamped(signal + recency(minutes) * w["recency"] - penalty)
    if semantic is None:
        return plain
    return F.when(semantic.isNull() | F.isnan(semantic), plain).otherwise(clamped(plain * fixed.BLEND[0] + clamped(semantic) * fixed.BLEND[1]))


def rescue(score: Column, topic: Column, keyword: Column, geo: Column, penalty: Column, threshold: float = fixed.BEAT_THRESHOLD) -> Column:
    """Does an item just below the threshold pass by three positive signals and no penalty? struct(rescued, in_band, strong_signals, blocked_by)."""
    lower = fixed.RESCUE_BOUND if fixed.RESCUE_BOUND < threshold else max(0.05, threshold - 0.05)
    band = (score >= lower) & (score < threshold)
    strong = sum(((x > 0).cast("int") for x in (topic, keyword, geo)), F.lit(0))
    blocked = F.when(band & penalty, "major_penalty").when(band & (strong < fixed.RESCUE_SIGNALS), "insufficient_signals")
    return F.struct((band & blocked.isNull()).alias("rescued"), band.alias("in_band"), F.when(band, strong).otherwise(0).alias("strong_signals"), blocked.alias("blocked_by"))


def semantic_rescue(score: Column, semantic: Column, geo: Column, penalty: Column, threshold: float = fixed.BEAT_THRESHOLD) -> Column:
    """Does an item below the threshold pass by its semantic score and a geography? struct(rescued, blocked_by)."""
    below = score.isNotNull() & ~F.isnan(score) & (score < threshold)
    strong = F.coalesce(~F.isnan(semantic) & (semantic >= fixed.SEMANTIC_RESCUE), F.lit(False))
    blocked = F.when(~below, "above_threshold").when(penalty, "major_penalty").when(~strong, "weak_semantic").when(~F.coalesce(geo > 0, F.lit(False)), "geo_gate")
    return F.struct(blocked.isNull().alias("rescued"), blocked.alias("blocked_by"))


def cosine_score(cosine_of: Column) -> Column:
    """A cosine from -1 to 1 as a score from 0 to 1."""
    return (F.least(F.greatest(cosine_of, F.lit(-1.0)), F.lit(1.0)) + 1) / 2


def relevance(topic: Column, keyword: Column, geo: Column, entity: Column, corroborated: Column, fit: Column, fresh: Column) -> Column:
    w = fixed.RELEVANCE
    return (
        w["topic"] * clamped(topic) + w["keyword"] * clamped(keyword) + w["entity"] * clamped(entity) + w["geo"] * clamped(geo)
        + w["corroboration"] * corroborated + w["beat_fit"] * clamped(fit) + w["freshness"] * fresh
    )


def density(family_size: Column) -> Column:
    """How much an item's headline family corroborates it."""
    peers = F.greatest(family_size - 1, F.lit(0)).cast("double")
    return peers / (peers + fixed.DENSITY_HALF)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 for a zero or empty vector."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)

    def total(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(total(a, a)) * F.sqrt(total(b, b))
    return F.when(norm > 0, total(a, b) / norm).otherwise(0.0)


def mock_embedding(text: Column, dims: int = 32) -> Column:
    """A deterministic vector from the text's SHA-256: (byte - 128) / 128."""
    # the digest's bytes first: within a transform it would be worked out again for each of them
    return F.transform(F.slice(F.regexp_extract_all(F.sha2(text, 256), F.lit("(..)"), F.lit(1)), 1, dims), lambda h: (F.conv(h, 16, 10).cast("double") - 128) / 128)
