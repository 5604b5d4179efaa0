"""Which feeds and items a reader's selected sources name, and the lists that settings hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import collapsed, source_identity, trimmed


def matching_name(c: Column) -> Column:
    """A source's name as it is compared: lower case, no leading "the", letters and digits only."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^the\s+", "")
    return collapsed(F.regexp_replace(F.regexp_replace(bare, "[—–_/-]", " "), r"[^\p{L}\p{N}\s]", " "))


def aliased_name(c: Column, aliases: Mapping[str, str] = fixed.OUTLET_ALIASES) -> Column:
    """``matching_name`` of the name that the alias table gives, or of the name itself."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return matching_name(F.coalesce(F.try_element_at(table, F.lower(trimmed(c))), c))


def label(c: Column, synonyms: Mapping[str, str]) -> Column:
    """The synonym of a topic or keyword label, or the label itself, trimmed."""
    table = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.trim(c))


def social_handle(c: Column) -> Column:
    """"@name" in lower case of a handle; "" of what is none."""
    name = F.regexp_extract(trimmed(F.coalesce(c, F.lit(""))), r"^@?([A-Za-z0-9_]{1,15})$", 1)
    return F.when(name != "", F.concat(F.lit("@"), F.lower(name))).otherwise("")


def publisher(c: Column) -> Column:
    """A feed's publisher: what stands before a dash between blanks."""
    return F.trim(F.regexp_extract(c, r"(?s)^(.+?)(?:\s+[—–-]\s+.*)?$", 1))


def _grams(c: Column, most: int = 3) -> Column:
    """All distinct strings of 1 to ``most`` characters of a name."""

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))

    return F.array_distinct(F.concat(*map(of, range(1, most + 1))))


def resolve_sources(selected: DataFrame, feeds: DataFrame, aliases: Mapping[str, str] = fixed.OUTLET_ALIASES) -> DataFrame:
    """(name, status, feed_ids) of each selected name: matched, unavailable or unmatched, with the feeds it matches.

    selected: name; feeds: feed_id, name, publisher, kind, active. A name matches
    a feed whose name or publisher contains it, once both are normalised; a feed
    is available unless switched off or of a kind without a reader. The substring
    join is an equi-join on a needle's first three characters (all of a shorter
    one), so neither side has to be small.
    """
    clean = selected.select(trimmed("name").alias("name")).filter("name != ''")
    clean = clean.groupBy(F.lower("name").alias("_k")).agg(F.min("name").alias("name")).select("name", aliased_name(F.col("name"), aliases).alias("needle"))
    targets = feeds.select(
        "feed_id", (F.coalesce("active", F.lit(True)) & F.col("kind").isin(*fixed.READABLE_KINDS)).alias("open"),
        F.explode(F.array(matching_name(F.coalesce("name", "feed_id")), matching_name(F.coalesce("publisher", F.lit(""))))).alias("target"),
    ).filter("target != ''")
    keyed = targets.withColumn("gram", F.explode(_grams(F.col("target"))))
    needles = clean.filter("needle != ''").withColumn("gram", F.substring("needle", 1, 3))
    met = needles.join(keyed, "gram").filter(F.contains("target", "needle")).groupBy("name", "feed_id").agg(F.bool_or("open").alias("open"))
    found = met.groupBy("name").agg(F.bool_or("open").alias("_open"), F.array_sort(F.collect_list(F.when(F.col("open"), F.col("feed_id")))).alias("feed_ids"))
    status = F.when(F.col("_open").isNull(), "unmatched").when(F.col("_open"), "matched").otherwise("unavailable")
    return clean.join(found, "name", "left").select("name", status.alias("status"), F.coalesce("feed_ids", F.array().cast("array<string>")).alias("feed_ids"))


def selected_items(items: DataFrame, feed_ids: Sequence[str] = (), outlets: Sequence[str] = (), handles: Sequence[str] = ()) -> DataFrame:
    """Items of a selected feed, of an outlet that contains or is contained in a selected one, or social ones of a selected handle; nothing selected, nothing kept."""
    outlet = source_identity(F.coalesce("outlet", F.lit("")))
    keep = F.coalesce(F.col("feed_id").isin(*feed_ids), F.lit(False))
    for name in outlets:
        own = source_identity(F.lit(name))
        keep = keep | ((outlet != "") & (own != "") & (F.contains(outlet, own) | F.contains(own, outlet)))
    return items.filter(keep | (F.col("kind") == "social") & social_handle(F.col("outlet")).isin(*[h for h in handles if h]))


def feed_verdicts(feeds: DataFrame, publishers: Sequence[str] = (), allowed: Sequence[str] = ()) -> DataFrame:
    """Feeds (feed_id, name, url, kind, active, publisher) with the first reason that keeps them out, or null."""
    name = source_identity(F.coalesce("name", F.lit("")))
    listed = [" ".join(a.lower().split()) for a in allowed if a and a.strip()]
    reason = (
        F.when(F.col("feed_id").isNull() | (F.trim("feed_id") == ""), "invalid_row").when(F.coalesce("kind", F.lit("")) != "rss", "non_rss").when(F.col("active") == F.lit(False), "inactive")
        .when(~F.coalesce(F.col("url").rlike("(?i)^https?://[^/ ]+"), F.lit(False)), "invalid_url")
    )
    if publishers:
        reason = reason.when(~source_identity(F.coalesce("publisher", F.lit(""))).isin(*[" ".join(p.lower().split()) for p in publishers]), "publisher_filter")
    if listed:
        reason = reason.when(~F.exists(F.array(*map(F.lit, listed)), lambda a: F.contains(name, a)), "not_allowed")
    return feeds.withColumn("reason", reason)


def added_labels(existing: Column, draft: Column) -> Column:
    """A settings list with the comma-separated labels of a draft that it lacks, whatever their case, in order."""
    seen = F.transform(existing, lambda x: F.lower(x))
    new = F.filter(F.transform(F.split(draft, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~F.array_contains(seen, F.lower(x)))
    first = F.filter(new, lambda x, i: F.array_position(F.transform(new, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return F.concat(existing, first)


def constrained(values: Column, canonical: Column) -> Column:
    """The values that settings hold, in their order there once, spelt as there."""
    lower = F.transform(canonical, lambda x: F.lower(F.trim(x)))
    at = F.filter(F.array_distinct(F.transform(values, lambda v: F.array_position(lower, F.lower(F.trim(v))))), lambda i: i > 0)
    return F.transform(at, lambda i: F.element_at(canonical, i.cast("int")))


def without_geographies(keywords: Column, geographies: Sequence[str]) -> Column:
    """Keywords that name no configured geography, no synonym and no place in one."""
    wide = {x.lower() for g in geographies for x in (g, *fixed.GEO_SYNONYMS.get(g, ()))}
    named = wide | {place for place, country in fixed.GEO_ALIASES.items() if country.lower() in wide}
    return F.filter(keywords, lambda k: ~F.lower(F.trim(k)).isin(*sorted(named)) & (F.trim(k) != "")) if named else keywords
