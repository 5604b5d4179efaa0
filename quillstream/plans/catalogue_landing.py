"""Registered queries of landed pages, due runs, snapshots and model answers, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..operators import snapshots
from ..sources import items as src
from ..sources import social
from ..streaming import feeds, runs
from ..streaming.feeds import shared_folder
from .catalogue import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

_POSTS = r"""p AS (SELECT 'u' || conv_id % 30 AS username, conv_id || '-' || turn AS id, coalesce(text, '') AS t, TIMESTAMP '2024-03-02 00:00:00' - to_minutes(CAST((conv_id * 37 + turn * 11) % 4000 AS BIGINT)) AS ts FROM conversations),
n AS (SELECT *, (row_number() OVER (PARTITION BY username ORDER BY ts DESC, id) - 1) // 5 AS page FROM p),
pages AS (SELECT username, page, min(ts) AS oldest FROM n GROUP BY 1, 2),
kept AS (SELECT username, page FROM (SELECT *, coalesce(min(oldest) OVER (PARTITION BY username ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < TIMESTAMP '2024-03-01 00:00:00', false) AS past FROM pages) WHERE NOT past AND page < 25)"""


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """Conversations as posts of thirty names, landed as pages of five."""
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "concat('u', conv_id % 30) username", "concat(conv_id, '-', turn) post_id", "coalesce(text, '') text", "timestamp'2024-03-02 00:00:00' - make_interval(0, 0, 0, 0, 0, cast((conv_id * 37 + turn * 11) % 4000 as int)) created_at",
        "if(conv_id % 4 = 0, 'es', null) lang",
    )
    path = shared_folder(spark, "pages")
    social.land_pages(rows, path, 5)
    return path


@query(rf"""WITH {_POSTS} SELECT 'x:' || username || ':' || substr(sha256('x:' || username || '::' || id), 1, 16) AS source_id, '@' || username AS outlet, CAST(date_diff('minute', ts, TIMESTAMP '2024-03-02 00:00:00') AS DOUBLE) AS minutes_ago,
 CASE WHEN trim(t) = '' THEN '(untitled)' ELSE trim(t) END AS headline FROM n JOIN kept USING (username, page)""")
def social_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts of each name's newest pages, back to the page that reaches behind the last day."""
    posts = social.read_posts(spark, _landed(spark, sf_dir), since="2024-03-01T00:00:00Z")
    return social.posts_as_items(posts, F.lit("2024-03-02 00:00:00").cast("timestamp")).select("source_id", "outlet", "minutes_ago", "headline")


@query(rf"""WITH {_POSTS} SELECT username, count(*) AS n_posts, min(ts) AS oldest, NULL AS error FROM n JOIN kept USING (username, page) WHERE username IN ('u3', 'u7') GROUP BY 1 UNION ALL SELECT 'nobody', 0, NULL, 'FileNotFoundError'""")
def social_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of three chosen names, one of which has no page."""
    posts = social.read_posts(spark, _landed(spark, sf_dir), " @U3,u7, nobody,u9,u3", "2024-03-01T00:00:00Z", "u3, @u7, NOBODY")
    return social.page_report(posts).withColumn("error", F.substring_index("error", ":", 1))


@query("WITH c AS (SELECT DISTINCT 'u' || conv_id % 30 AS username FROM conversations WHERE turn > 2), s AS (SELECT DISTINCT 'u' || doc_id % 45 AS username FROM documents) SELECT username FROM s WHERE username NOT IN (SELECT username FROM c)")
def missed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = table(spark, sf_dir, "documents").selectExpr("concat(' @U', doc_id % 45) handle")
    return social.missing_names(selected, table(spark, sf_dir, "conversations").filter("turn > 2").selectExpr("concat('@u', conv_id % 30) outlet"))


@query(r"""WITH RECURSIVE e AS (SELECT user_id AS u, ts, event_type AS f FROM events), lim AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM e),
f0 AS (SELECT u, min(ts) AS t0, greatest(max(ts) - INTERVAL 1 MICROSECOND, any_value(wm)) AS til FROM e, lim GROUP BY u),
tick AS (SELECT u, t0 AS t, 0 AS k, t0, til FROM f0 UNION ALL SELECT u, t0 + (k + 1) * INTERVAL 6 HOUR, k + 1, t0, til FROM tick WHERE t0 + (k + 1) * INTERVAL 6 HOUR <= til),
seen AS (SELECT tick.u, tick.t, k, (SELECT arg_max(f, (ts, f)) FROM e WHERE e.u = tick.u AND e.ts <= tick.t) AS f FROM tick)
SELECT CAST(u AS VARCHAR) AS "user", t AS "at", CASE WHEN k > 0 AND f = lag(f) OVER (PARTITION BY u ORDER BY k) THEN 'unchanged' ELSE 'run' END AS action, f AS fingerprint FROM seen""")
def due_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every six hours: does a user's newest event differ from that of the run before?"""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    path = shared_folder(spark, "runs")
    signs = events.selectExpr("user_id user", "ts at", "event_type fingerprint")
    feeds.run_once(runs.due_runs(signs, 360, "2 hours"), "append", feeds.appended_into(path), shared_folder(spark, "progress"))
    return spark.read.parquet(path).select("user", F.col("at").cast("timestamp_ntz").alias("at"), "action", "fingerprint")


_SNAPSHOTS = r"""d AS (SELECT doc_id, doc_id % 50 AS u, string_split(coalesce(text, ''), chr(10)) AS l, source, lang FROM documents),
v AS (SELECT *, 1 AS n FROM d UNION ALL SELECT *, 2 FROM d WHERE u % 3 = 0 AND doc_id % 4 > 0 UNION ALL SELECT *, 3 FROM d WHERE u % 7 = 0 AND doc_id % 5 = 0),
w AS (SELECT v.* FROM v JOIN (SELECT u, max(n) AS n FROM v GROUP BY u) m ON m.u = v.u AND m.n = v.n)"""


def _payloads(rows: DataFrame, n: int) -> DataFrame:
    """A snapshot of each user over documents: every other story in the form of an earlier contract."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    old = F.col("doc_id") % 2 == 0
    source = F.struct(F.col("doc_id").cast("string").alias("sourceId"), F.col("source").alias("outlet"), F.when(F.col("doc_id") % 3 == 0, "social").otherwise("rss").alias("kind"))
    story = F.struct(
        F.col("doc_id").cast("string").alias("metaStoryId"), lines[0].alias("title"), F.when(~old, F.get(lines, F.lit(1))).alias("subtitle"), F.when(old, F.get(lines, F.lit(1))).alias("takeaway"),
        F.when(~old, F.struct(F.array("lang").alias("topics"))).alias("tags"), F.when(F.col("doc_id") % 5 > 0, F.array(source)).alias("sources"),
    )
    user = rows.withColumn("user_id", (F.col("doc_id") % 50).cast("string")).groupBy("user_id").agg(F.collect_list(story).alias("stories"), F.min("doc_id").alias("least"))
    version = F.when(F.col("least") % 2 == 0, "2026-04-22-slice1").otherwise("2026-05-19-meta-story-fields")
    payload = F.to_json(F.struct(version.alias("contractVersion"), "stories", F.transform("stories", lambda s: s["metaStoryId"]).alias("_everSeenMetaStoryIds"), F.struct(F.lit(n).alias("funnel")).alias("_lastRunMeta")))
    return user.select("user_id", payload.alias("payload"), F.lit(f"2024-03-0{n} 00:00:00").cast("timestamp").alias("refreshed_at"))


@query(rf"""WITH {_SNAPSHOTS}, s AS (SELECT u, n, doc_id, l[1] AS title, coalesce(l[2], '') AS subtitle, CASE WHEN doc_id % 2 = 1 THEN lang ELSE '' END AS topics, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'social' ELSE 'traditional' END AS kinds FROM w)
SELECT CAST(u AS VARCHAR) AS user_id, '2026-05-19-meta-story-fields' AS contract_version, count(*) AS n_stories, sha256(array_to_string(list(title || '/' || subtitle || '/' || topics || '/' || kinds ORDER BY doc_id), '|')) AS told,
 CAST(any_value(n) AS VARCHAR) AS funnel, CASE WHEN u % 10 = 0 THEN '2024-03-05T06:07:08Z' END AS last_checked_at FROM s GROUP BY u""")
def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits, a look at some users, a compaction; then what readers see."""
    docs, own = table(spark, sf_dir, "documents"), snapshots.store(spark, shared_folder(spark, "store"))
    for n, rows in enumerate((docs, docs.filter("doc_id % 50 % 3 = 0 and doc_id % 4 > 0"), docs.filter("doc_id % 50 % 7 = 0 and doc_id % 5 = 0")), 1):
        own.commit({snapshots.SNAPSHOTS: _payloads(rows, n)}, f"run {n}")
    looked = own.read(snapshots.SNAPSHOTS).filter("user_id % 10 = 0").select("user_id", F.lit("2024-03-05 06:07:08").cast("timestamp").alias("at"))
    own.commit({snapshots.SNAPSHOTS: snapshots.touched(own.read(snapshots.SNAPSHOTS), looked)}, "look")
    own.compact()
    shown = snapshots.loaded(own.read(snapshots.SNAPSHOTS))
    by_id = F.array_sort("stories", lambda a, b: F.when(a["metaStoryId"].cast("long") < b["metaStoryId"].cast("long"), -1).otherwise(1))
    told = F.transform(by_id, lambda s: F.concat_ws("/", s["title"], F.coalesce(s["subtitle"], F.lit("")), F.array_join(s["tags"]["topics"], ","), F.array_join(F.transform(s["sources"], lambda x: x["kind"]), ",")))
    return shown.select("user_id", "contract_version", F.size("stories").cast("long").alias("n_stories"), F.sha2(F.array_join(told, "|"), 256).alias("told"), F.col("report")["funnel"].alias("funnel"), "last_checked_at")


@query("""WITH s AS (SELECT user_id AS u, max(event_id) AS last FROM events GROUP BY 1), t AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events)
SELECT u AS user_id, 'v' || last % 3 AS version, last AS newest, event_type AS narrative FROM s JOIN t ON t.user_id = u AND k = 1""")
def saved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings and narratives saved together in two commits, the second of which changes every other user."""
    rows, own = table(spark, sf_dir, "events"), snapshots.store(spark, shared_folder(spark, "store"))
    for part in (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), rows):
        users = part.groupBy("user_id").agg(F.max("event_id").alias("last"))
        settings = users.select("user_id", F.to_json(F.struct(F.lit("old").alias("contractVersion"), F.col("last").alias("newest"))).alias("data"), F.concat(F.lit("v"), F.col("last") % 3).alias("contract_version"))
        snapshots.save_settings(own, settings, part.selectExpr("user_id", "ts submitted_at", "event_type raw_text"))
    current = snapshots.current_narratives(own.read(snapshots.NARRATIVES)).filter("is_current").selectExpr("user_id", "raw_text narrative")
    merged = snapshots.merged_settings(own.read(snapshots.SETTINGS))
    return merged.select("user_id", F.col("settings")["contractVersion"].alias("version"), F.col("settings")["newest"].cast("long").alias("newest")).join(current, "user_id")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers of a model, sound and broken in fifteen ways."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') t", "concat('T ', split(coalesce(text, ''), '\n')[0]) title", "string(doc_id) id")

    def story(**own) -> F.Column:
        fields = {
            "title": F.col("title"), "subtitle": F.lit("s"), "source_item_ids": F.array("id"), "summary": F.concat(F.lit("S "), "t"),
            "tags": F.struct(F.array("id").alias("topics"), F.array().cast("array<string>").alias("keywords"), F.array().cast("array<string>").alias("geographies")),
            "factual_claims": F.array("title"), "claim_evidence_map": F.create_map(F.lit("0"), F.array("id")),
        } | own
        return F.struct(*(v.alias(k) for k, v in fields.items() if v is not None))

    def whole(*stories) -> F.Column:
        return F.to_json(F.struct(F.array(*stories).alias("meta_stories")))

    sound, bare = whole(story()), F.to_json(F.array(story()))
    tags = F.struct(F.lit("x").alias("topics"), F.array("id").alias("keywords"), F.array("id").alias("geographies"))
    kinds = [
        sound, F.concat(F.lit("```json\n"), sound, F.lit("\n```")), F.concat(F.lit("Here you are: "), sound, F.lit(" That is all.")), bare, F.lit(" \n"), F.lit("I cannot do that."), F.lit('{"meta_stories": [{"title": {}'),
        F.lit('{"meta_stories": 5}'), whole(*[story()] * 6), whole(story(subtitle=None)), whole(story(title=F.lit(""))), whole(story(), story(source_item_ids=F.array().cast("array<string>"))),
        whole(story(source_item_ids=F.array(*[F.col("id")] * 6))), whole(story(tags=tags)), F.concat(F.lit("```\n"), bare, F.lit("```")), F.concat(F.lit("```"), whole(story(claim_evidence_map=F.create_map(F.lit("0"), "id"))), F.lit("```")),
    ]
    raw = F.coalesce(*(F.when(F.col("doc_id") % 16 == k, c) for k, c in enumerate(kinds)))
    return rows.select("doc_id", raw.alias("raw"))


@query(r"""WITH k(k, attempted, succeeded, failure_reason, raw_class, bucket, coercion, result, error_class) AS (VALUES
 (0, false, false, NULL, NULL, NULL, NULL, 'ok', NULL), (1, true, true, NULL, 'json_parse_error', NULL, NULL, 'fallback', 'json_parse_error'), (2, true, true, NULL, 'json_parse_error', NULL, NULL, 'fallback', 'json_parse_error'),
 (3, true, true, NULL, 'schema_validation_error', 'invalid_type', 'array_wrap', 'fallback', 'schema_validation_error'), (4, true, false, 'no_json_region', 'empty_response', NULL, NULL, 'fail', 'no_json_region'),
 (5, true, false, 'no_json_region', 'json_parse_error', NULL, NULL, 'fail', 'no_json_region'), (6, true, false, 'json_parse_error', 'json_parse_error', NULL, NULL, 'fail', 'json_parse_error'),
 (7, true, false, 'schema_validation_error', 'schema_validation_error', 'missing_meta_stories', NULL, 'fail', 'schema_validation_error'), (8, true, false, 'schema_validation_error', 'schema_validation_error', 'too_many_meta_stories', NULL, 'fail', 'schema_validation_error'),
 (9, true, false, 'schema_validation_error', 'schema_validation_error', 'missing_required_field', NULL, 'fail', 'schema_validation_error'), (10, true, false, 'schema_validation_error', 'schema_validation_error', 'empty_string_field', NULL, 'fail', 'schema_validation_error'),
 (11, true, false, 'schema_validation_error', 'schema_validation_error', 'empty_source_item_ids', NULL, 'fail', 'schema_validation_error'), (12, true, false, 'schema_validation_error', 'schema_validation_error', 'too_many_source_item_ids', NULL, 'fail', 'schema_validation_error'),
 (13, true, false, 'schema_validation_error', 'schema_validation_error', 'invalid_type', NULL, 'fail', 'schema_validation_error'), (14, true, true, NULL, 'json_parse_error', NULL, 'array_wrap', 'fallback', 'json_parse_error'),
 (15, true, false, 'schema_validation_error', 'json_parse_error', 'invalid_type', NULL, 'fail', 'schema_validation_error'))
SELECT doc_id, attempted, succeeded, failure_reason, raw_class, bucket, coercion, result, error_class, CASE WHEN succeeded OR NOT attempted THEN 1 END AS n_stories,
 CASE WHEN succeeded OR NOT attempted THEN sha256('T ' || string_split(coalesce(text, ''), chr(10))[1] || 'S ' || coalesce(text, '') || doc_id) END AS told FROM documents JOIN k ON k = doc_id % 16""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as they were read, and how."""
    rows = answers.parsed_answers(_answers(spark, sf_dir))
    s, seen = F.col("stories")[0], answers.observed(F.col("repair"))
    told = F.sha2(F.concat(s["title"], s["summary"], s["claim_evidence_map"]["0"][0]), 256)
    return rows.select("doc_id", "repair.*", seen["result"].alias("result"), seen["error_class"].alias("error_class"), F.when(F.col("stories").isNotNull(), F.size("stories").cast("long")).alias("n_stories"), told.alias("told"))


def _landed_feeds(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Documents as entries of feeds, landed as XML, and the feeds' manifest, landed as JSON."""
    docs = table(spark, sf_dir, "documents")
    clean = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), clean(c), F.lit(f"</{name}>")), F.lit(""))
    doc = F.col("doc_id").cast("string")
    date = F.date_format(F.lit("2024-01-31 00:00:00").cast("timestamp") - F.make_dt_interval(mins=(F.col("doc_id") * 7 % 3000).cast("int")), "EEE, dd MMM yyyy HH:mm:ss Z")
    item = F.concat(
        F.lit("<item>"), tag("title", F.when(F.col("doc_id") % 10 > 0, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))), tag("link", F.concat(F.lit("http://h/"), doc)), tag("guid", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("g"), doc))),
        tag("pubDate", F.when(F.col("doc_id") % 4 > 0, date)), tag("description", F.concat(F.lit("<b>"), "lang", F.lit("</b> &amp; "), doc)), F.lit("</item>"),
    )
    path, manifest = shared_folder(spark, "feeds"), shared_folder(spark, "manifest")
    # a file of its own for every 500 entries or so of a feed: each is one XML document
    files = docs.withColumn("item", item).groupBy(F.col("source").alias("feed_id"), F.expr("doc_id div 10000").alias("page")).agg(F.array_join(F.collect_list("item"), "").alias("items"))
    files.select("feed_id", "page", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value")).write.partitionBy("feed_id", "page").text(path)
    n = F.substring("source", 4, 9).cast("int")
    feeds = docs.select("source").distinct().select(
        F.col("source").alias("id"), F.upper("source").alias("name"), F.when(n % 7 == 3, "video").otherwise("rss").alias("kind"), F.when(n % 9 == 4, "ftp://x").otherwise("https://x").alias("url"),
        F.when(n % 2 == 0, F.concat(F.lit("Pub "), "source")).alias("publisher"), F.when(n % 5 > 0, n).alias("weight"), (n % 8 != 5).alias("active"),
    )
    feeds.agg(F.to_json(F.struct(F.collect_list(F.struct(*feeds.columns)).alias("feeds"))).alias("value")).write.text(manifest)  # one file of a few hundred feeds
    return path, src.read_manifest(spark, manifest)


_FEEDS = r"""e AS (SELECT doc_id, source AS feed_id, CAST(substr(source, 4) AS INT) AS n, lang, CASE WHEN doc_id % 3 > 0 THEN 'g' || doc_id ELSE 'http://h/' || doc_id END AS ident,
 CASE WHEN doc_id % 10 = 0 OR trim(replace(coalesce(text, ''), chr(10), ' ')) = '' THEN '(untitled)' ELSE trim(replace(text, chr(10), ' ')) END AS headline, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id * 7 % 3000 AS DOUBLE) ELSE 0.0 END AS age FROM documents),
i AS (SELECT substr(sha256(feed_id || '::' || ident), 1, 16) AS source_id, feed_id, CASE WHEN n % 2 = 0 THEN 'Pub ' || feed_id ELSE upper(feed_id) END AS outlet, CAST(CASE WHEN n % 5 > 0 THEN n ELSE 50 END AS DOUBLE) AS weight, age AS minutes_ago, headline,
 lang || ' & ' || doc_id AS body, 'http://h/' || doc_id AS url FROM e WHERE n % 7 <> 3 AND n % 9 <> 4 AND n % 8 <> 5)"""


@query(f"WITH {_FEEDS} SELECT source_id, feed_id, outlet, weight, minutes_ago, headline, body, url FROM i")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of landed feeds that may be read, as items; none of them lacks a required field."""
    items = src.landed_items(spark, *_landed_feeds(spark, sf_dir), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return src.checked(items).filter("error is null").select("source_id", "feed_id", "outlet", "weight", "minutes_ago", "headline", F.col("body")[0].alias("body"), "url")


@query(f"WITH {_FEEDS} SELECT source_id, feed_id, upper(feed_id) AS outlet, 'traditional' AS kind, weight, 30.0::DOUBLE AS minutes_ago, headline FROM i WHERE minutes_ago <= 1440 AND feed_id IN ('src0', 'src2', 'src16')")
def cached_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen feeds' recent items by way of the cache, half an hour later."""
    path, manifest = _landed_feeds(spark, sf_dir)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, ("src0", "src2", "src16", "src3")))).alias("id"))
    items = src.landed_items(spark, path, manifest, now, wanted).filter("minutes_ago <= 1440").withColumn("seq", F.monotonically_increasing_id())
    rows = src.cache_rows(items, now)
    return src.cached_items(rows, manifest, now + F.expr("interval 30 minutes")).select("source_id", "feed_id", "outlet", "kind", "weight", "minutes_ago", "headline")
