"""Readers and adapters that give items: one row a news or social item, with ``seq`` as its stable place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import short_hash, slug, strip_html, trimmed

_TEXT = ("source_id", "feed_id", "lang", "outlet", "byline", "kind", "url", "headline")
RAW_ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField("weight", T.DoubleType()), T.StructField("minutes_ago", T.DoubleType()), T.StructField("body", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("cluster_id", "title", "topic", "priority")]
    + [T.StructField("geographies", T.ArrayType(T.StringType())), T.StructField("seq", T.LongType())]
)
FEED = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "name", "kind", "url", "publisher", "lang")] + [T.StructField("weight", T.IntegerType()), T.StructField("active", T.BooleanType())]
)
REQUIRED = ("source_id", "feed_id", "outlet", "kind", "url", "headline", "body", "minutes_ago")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items from a JSON array file."""
    return spark.read.schema(RAW_ITEM).json(path, multiLine=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Feeds from a JSON file {"feeds": [...]}."""
    whole = T.StructType([T.StructField("feeds", T.ArrayType(FEED))])
    return spark.read.schema(whole).json(path, multiLine=True).select(F.inline("feeds"))


def read_feed_xml(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed RSS files: title, link, guid, pubDate, description."""
    entry = "title string, link string, guid string, pubDate string, description string"
    return spark.read.format("xml").option("rowTag", "item").schema(entry).load(path)


def age_minutes(published: Column, as_of: Column) -> Column:
    """Whole minutes from publication to ``as_of``; 0 where unknown or later."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(published)
    return F.coalesce(F.greatest(F.floor(seconds / 60), F.lit(0)), F.lit(0)).cast("double")


def entry_id(feed_id: Column, identity: Column) -> Column:
    return short_hash(F.concat_ws("::", feed_id, identity))


def published_at(c: Column) -> Column:
    """A feed's date: day, month and time with an offset or a zone's name, the weekday left aside, or an ISO time; null of what is none."""
    bare = F.regexp_replace(trimmed(c), r"^[A-Za-z]+,\s*", "")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss zzz")), F.try_to_timestamp(c))


def map_entries(entries: DataFrame, feed_id: Column, outlet: Column, weight: Column, as_of: Column) -> DataFrame:
    """Feed entries as items: the id from feed and guid, else link, else title and date; an undated entry is of now."""
    text = strip_html(F.col("description"))
    title = F.when(trimmed(F.col("title")) != "", trimmed(F.col("title"))).otherwise("(untitled)")
    published = published_at(F.col("pubDate"))
    return entries.select(
        entry_id(feed_id, F.coalesce("guid", "link", F.concat("title", F.coalesce("pubDate", F.lit(""))))).alias("source_id"), feed_id.alias("feed_id"), outlet.alias("outlet"),
        F.lit("traditional").alias("kind"), weight.cast("double").alias("weight"), F.col("link").alias("url"), age_minutes(published, as_of).alias("minutes_ago"),
        title.alias("headline"), F.array(F.when(text != "", text).otherwise(title)).alias("body"),
    )


def landed_items(spark: SparkSession, path: str, manifest: DataFrame, as_of: Column, wanted: DataFrame | None = None) -> DataFrame:
    """Items of the feeds landed as XML below path/feed_id=<id>/, for feeds of the manifest that may be read (and are among ``wanted``, if it has any).

    manifest: id, name, kind, url, publisher, weight, active; wanted: id. An outlet
    is the feed's publisher, else its name, else its id.
    """
    feeds = feed_reasons(manifest).filter("reason is null")
    if wanted is not None and not wanted.isEmpty():
        feeds = feeds.join(wanted.select("id").distinct(), "id", "left_semi")
    feeds = feeds.select(F.col("id").alias("feed_id"), F.coalesce("publisher", "name", "id").alias("outlet"), F.coalesce(F.col("weight").cast("double"), F.lit(fixed.DEFAULT_WEIGHT)).alias("weight"))
    entries = read_feed_xml(spark, path).withColumn("feed_id", F.col("feed_id").cast("string")).join(feeds, "feed_id")
    return map_entries(entries, F.col("feed_id"), F.col("outlet"), F.col("weight"), as_of)


def checked(items: DataFrame) -> DataFrame:
    """Items with an ``error`` column: the first required field that is missing, or null; nothing is dropped."""
    missing = [F.when(F.col(c).isNull() if c in ("body", "minutes_ago") else F.coalesce(F.trim(c) == "", F.lit(True)), F.lit(f"missing {c}")) for c in REQUIRED if c in items.columns]
    return items.withColumn("error", F.coalesce(*missing))


def documents_as_items(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) as items; ages and weights are derived from doc_id."""
    lines = F.split("text", "\n")
    return docs.select(
        F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("source_id"), F.col("source").alias("feed_id"), F.col("source").alias("outlet"), "lang",
        F.when(F.col("doc_id") % 5 == 0, "social").otherwise("traditional").alias("kind"), (F.col("doc_id") % 101).cast("double").alias("weight"),
        (F.col("doc_id") * 37 % 2000).cast("double").alias("minutes_ago"), F.element_at(lines, 1).alias("headline"),
        F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))).alias("body"), "text",
    )


def cache_rows(items: DataFrame, as_of: Column, ttl_minutes: int = fixed.TTL_MINUTES) -> DataFrame:
    """Cache rows of items with an id: the first of each id, a snippet, and when it expires."""
    from pyspark.sql import Window

    first = Window.partitionBy("source_id").orderBy("seq")
    own = items.filter("source_id is not null and source_id != ''").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return own.select(
        "source_id", "feed_id", "url", "headline", F.substring(F.element_at("body", 1), 1, fixed.SNIPPET).alias("snippet"),
        as_of.alias("fetched_at"), (as_of + F.expr(f"interval {int(ttl_minutes)} minutes")).alias("expires_at"),
    )


def cached_items(rows: DataFrame, manifest: DataFrame, as_of: Column) -> DataFrame:
    """Live cache rows as items, with outlet and weight from the manifest (id, name, weight); social rows weigh alike."""
    live = rows.filter(F.col("expires_at") > as_of)
    social = F.col("feed_id").startswith("x:")
    joined = live.join(manifest.selectExpr("id feed_id", "name", "weight"), "feed_id", "left")
    return joined.select(
        "source_id", "feed_id", F.coalesce("name", "feed_id").alias("outlet"), F.when(social, "social").otherwise("traditional").alias("kind"),
        F.when(social, fixed.SOCIAL_WEIGHT).otherwise(F.coalesce(F.col("weight").cast("double"), F.lit(fixed.DEFAULT_WEIGHT))).alias("weight"),
        age_minutes(F.coalesce("published_at", "fetched_at") if "published_at" in rows.columns else F.col("fetched_at"), as_of).alias("minutes_ago"), "headline",
    )


def feed_reasons(feeds: DataFrame) -> DataFrame:
    """Feeds with the first reason that keeps them out, or null: invalid_row, non_rss, inactive, invalid_url."""
    reason = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "invalid_row").when(F.coalesce(F.col("kind"), F.lit("")) != "rss", "non_rss")
        .when(~F.coalesce("active", F.lit(True)), "inactive").when(~F.coalesce(F.col("url").rlike("^https?://"), F.lit(False)), "invalid_url")
    )
    return feeds.withColumn("reason", reason).withColumn("slug", slug(F.col("name")))
