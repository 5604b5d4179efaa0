"""Registered queries of roll-ups, evaluation, item joins, registry reports and streams, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, reports
from ..streaming import feeds
from .catalogue import QUERIES, SQL, events, query, rounded, table
from .catalogue_tags import QUERIES as _tags  # registers them


assert _tags is QUERIES
__all__ = ["QUERIES", "SQL"]  # of all four modules

_CHANGES = """event_type, CASE event_id % 5 WHEN 0 THEN 'first-seen' WHEN 1 THEN 'changed' WHEN 2 THEN 'unchanged' END AS state,
 CASE event_id % 4 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' END AS signal, event_id % 3 = 0 AS called, CASE WHEN event_id % 7 > 0 THEN event_id % 2 = 0 END AS material,
 event_id % 11 = 0 AS failed, CASE WHEN event_id % 13 > 0 THEN event_id % 1000 END AS latency_ms"""


@query(f"""WITH r AS (SELECT {_CHANGES} FROM events) SELECT event_type, count(*) FILTER (state = 'first-seen') AS first_seen, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state IS NULL OR state NOT IN ('first-seen', 'changed')) AS unchanged,
 count(*) FILTER (signal = 'strong') AS strong, count(*) FILTER (signal = 'weak') AS weak, count(*) FILTER (signal IS NULL) AS no_signal, count(*) FILTER (called) AS called, count(*) FILTER (called AND material) AS material,
 count(*) FILTER (called AND NOT material) AS immaterial, count(*) FILTER (failed) AS failed, CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS latency_ms FROM r GROUP BY event_type""")
def change_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.change_totals(events(spark, sf_dir).selectExpr(*_exprs(_CHANGES)), ["event_type"])


def _exprs(columns: str) -> list[str]:
    """A SELECT list, split at the commas outside of brackets."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


_REASONS = """event_type, CASE WHEN event_id % 6 > 0 THEN event_id % 5 = 0 END AS fallback, event_id % 3 = 0 AS rewrite_ok, CASE WHEN event_id % 4 > 0 THEN true END AS writer_ok, CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS confidence"""


@query(f"""WITH r AS (SELECT {_REASONS} FROM events), k AS (SELECT *, CASE WHEN fallback THEN 'f' WHEN rewrite_ok THEN 'r' WHEN writer_ok THEN 'w' ELSE '' END AS k FROM r)
SELECT event_type, count(*) AS attempted, count(*) FILTER (k = 'f') AS fallback, count(*) FILTER (k = 'r') AS rewritten, count(*) FILTER (k IN ('r', 'w')) AS passed, count(*) FILTER (confidence = 'low') AS low_confidence FROM k GROUP BY event_type""")
def reason_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reason_totals(events(spark, sf_dir).selectExpr(*_exprs(_REASONS)), ["event_type"])


_AXES = """l_returnflag AS axis, l_orderkey * 10 + l_linenumber AS seq, l_orderkey % 9 = 0 AS enabled, CASE WHEN l_orderkey % 4 > 1 THEN l_orderkey % 50 END AS threshold, l_partkey % 30 AS candidates, l_partkey % 7 AS accepted, l_partkey % 5 AS below,
 l_suppkey % 3 AS timeouts, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 4 END AS calls, l_suppkey % 900 AS latency_ms, CASE l_suppkey % 6 WHEN 0 THEN 'disabled' WHEN 1 THEN 'enabled_scorer_ready' WHEN 2 THEN 'scorer_error_fallback' WHEN 3 THEN 'unheard of' END AS state"""


@query(f"""WITH r AS (SELECT {_AXES} FROM lineitem), s AS (SELECT axis, count(*) AS runs, bool_or(enabled) AS enabled, arg_min(threshold, seq) FILTER (threshold IS NOT NULL) AS threshold, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(below) AS BIGINT) AS below,
 CAST(sum(timeouts) AS BIGINT) AS timeouts, CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls, max(latency_ms) AS slowest_ms, max(CASE state WHEN 'enabled_no_scorer' THEN 1 WHEN 'enabled_scorer_ready' THEN 2 WHEN 'scorer_error_fallback' THEN 3 WHEN 'scorer_timeout_fallback' THEN 4 ELSE 0 END) AS w FROM r GROUP BY axis)
SELECT * EXCLUDE (w), round(accepted / candidates, 6) AS accept_rate, round(below / candidates, 6) AS below_rate, round(timeouts / calls, 6) AS timeout_rate, ['disabled', 'enabled_no_scorer', 'enabled_scorer_ready', 'scorer_error_fallback', 'scorer_timeout_fallback'][w + 1] AS worst_state FROM s""")
def axis_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.axis_totals(table(spark, sf_dir, "lineitem").selectExpr(*_exprs(_AXES)), ["axis"])
    return out.withColumns({c: rounded(F.col(c)) for c in ("accept_rate", "below_rate", "timeout_rate")})


def _cases(array: str) -> str:
    return f"""CASE WHEN o_orderkey % 17 > 0 THEN translate(substr(o_orderpriority, 1, 1), '12345', 'ABCDE') END AS grp, o_orderkey % 8 > 0 AS pass, o_orderkey % 45 = 0 AS hard_fail, o_orderkey % 12 = 0 AS fallback,
 CASE o_orderkey % 9 WHEN 0 THEN {array}('dim:non_duplication', 'length') WHEN 1 THEN {array}('taxonomy_mismatch:a') WHEN 2 THEN {array}('x confidence_mismatch') END AS fail_reasons, CASE WHEN o_orderkey % 10 = 3 THEN {array}('label') END AS label_mismatches"""


_ROLLED = f"""c AS (SELECT {_cases("list_value")} FROM orders), f AS (SELECT coalesce(grp, '?') AS g, pass, hard_fail, fallback, coalesce(len(list_filter(fail_reasons, lambda x: contains(x, 'non_duplication'))) > 0, false) AS dup,
 coalesce(len(list_filter(fail_reasons, lambda x: starts_with(x, 'taxonomy_mismatch') OR starts_with(x, 'confidence_mismatch'))) > 0, false) OR coalesce(len(label_mismatches) > 0, false) AS mis FROM c),
g AS (SELECT g AS "group", count(*) AS total, count(*) FILTER (pass) AS passed, count(*) FILTER (hard_fail) AS hard_fail, count(*) FILTER (fallback) AS fallback, count(*) FILTER (dup) AS duplicated, count(*) FILTER (mis) AS mislabelled FROM f GROUP BY GROUPING SETS ((g), ()))"""


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.eval_rollup(table(spark, sf_dir, "orders").selectExpr(*_exprs(_cases("array").replace("\n", " "))).withColumnRenamed("grp", "group"))


@query(f"""WITH {_ROLLED} SELECT *, round(passed / total, 6) AS passed_rate, round(hard_fail / total, 6) AS hard_fail_rate, round(fallback / total, 6) AS fallback_rate, round(duplicated / total, 6) AS duplicated_rate, round(mislabelled / total, 6) AS mislabelled_rate FROM g""")
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rolled(spark, sf_dir)
    return out.withColumns({c: rounded(F.col(c)) for c in out.columns if c.endswith("_rate")})


@query(f"""WITH {_ROLLED}, t AS (SELECT * FROM g WHERE "group" IS NULL), a AS (SELECT * FROM g WHERE "group" = 'A')
SELECT array_to_string([x FOR x IN [CASE WHEN (SELECT count(*) FROM a WHERE passed < total) > 0 THEN 'group_A_pass_rate' END, CASE WHEN passed / total < 0.9 THEN 'overall_pass_rate' END, CASE WHEN hard_fail / total > 0.02 THEN 'hard_fail_rate' END] IF x IS NOT NULL], ',') AS blockers,
 array_to_string([x FOR x IN [CASE WHEN fallback / total > 0.1 THEN 'fallback_rate' END, CASE WHEN duplicated / total > 0.05 THEN 'duplication_failure_rate' END, CASE WHEN mislabelled > 0 THEN 'label_mismatch_rate' END] IF x IS NOT NULL], ',') AS warnings FROM t""")
def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.eval_gate(_rolled(spark, sf_dir)).select(F.array_join("blockers", ",").alias("blockers"), F.array_join("warnings", ",").alias("warnings"))


STAGES = ("totalNormalized", "afterTimeWindow", "afterSourceSelection", "afterGeoFilter", "afterTopicKeyword", "afterBeatFit", "afterDedupe", "afterClusterInputCap")


@query(f"""WITH e AS (SELECT user_id % 3 = 0 AS social, event_id % 9 AS reached FROM events), s AS (SELECT unnest([{", ".join(f"'{s}'" for s in STAGES)}]) AS stage, unnest(range(8)) AS i),
n AS (SELECT stage, i, CASE WHEN i <> 4 THEN (SELECT count(*) FROM e WHERE social AND reached >= i) END AS n FROM s), d AS (SELECT stage, i, n, CASE WHEN n IS NOT NULL THEN greatest(0, lag(n) OVER (ORDER BY i) - n) END AS d, lag(n) OVER (ORDER BY i) AS p FROM n)
SELECT stage, n, CASE WHEN p IS NOT NULL THEN d END AS dropped, coalesce(i = (SELECT arg_min(i, -d * 100 + i) FROM d WHERE p IS NOT NULL AND d > 0), false) AS "primary" FROM d""")
def social_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = events(spark, sf_dir).selectExpr("if(user_id % 3 = 0, 'social', 'traditional') kind", "event_id % 9 reached")
    return reports.social_funnel(items, STAGES, not_run=["afterTopicKeyword"])


@query("""WITH s AS (SELECT l_returnflag AS stage, l_orderkey AS story, count(*) FILTER (l_suppkey % 5 = 0) AS s FROM lineitem GROUP BY ALL)
SELECT stage, count(*) AS stories, count(*) FILTER (s > 0) AS social_stories, CAST(sum(s) AS BIGINT) AS social_sources FROM s GROUP BY stage""")
def social_in_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag stage", "l_orderkey story", "if(l_suppkey % 5 = 0, 'social', 'traditional') kind")
    return reports.social_in_stories(rows, ["stage"])


@query("""WITH s AS (SELECT l_orderkey AS story, count(*) AS sources, count(DISTINCT l_suppkey % 9) FILTER (l_suppkey % 9 > 0) AS outlets FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN sources >= 6 AND outlets >= 5 THEN 'high' WHEN sources >= 4 AND outlets >= 4 THEN 'medium' ELSE 'low' END AS divergence, CASE WHEN story % 3 = 0 THEN 'accelerating' ELSE 'stable' END AS cadence FROM s""")
def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey story", "if(l_suppkey % 9 = 0, ' ', if(l_partkey % 2 = 0, ' The  Outlet ', 'the outlet ') || l_suppkey % 9) outlet", "if(l_orderkey % 3 = 0, 'changed', 'unchanged') state")
    return reports.evidence_refs(rows.withColumn("outlet", F.when(F.col("outlet") != " ", F.regexp_replace("outlet", " +([0-9])$", " $1")).otherwise(F.col("outlet"))))


@query("""WITH i AS (SELECT doc_id, lang, length(text) AS n, lang IS NOT NULL AND trim(lang) <> '' AND NOT starts_with(lower(trim(lang)), 'en') AS needed, doc_id % 3 = 0 AS done FROM documents)
SELECT doc_id, CASE WHEN done THEN 10 ELSE n END AS n, needed, done AS applied, CASE WHEN needed AND NOT done THEN 'cold_start_cap' END AS reason FROM i""")
def translated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "lang", "text")
    out = reports.with_translations(items, items.filter("source_id % 3 = 0").select("source_id", F.lit("translated").alias("text")))
    return out.select(F.col("source_id").alias("doc_id"), F.length("text").alias("n"), "needed", "applied", "reason")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 4 > 0 AND doc_id % 6 = 1")
def protected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").selectExpr("doc_id source_id", "if(doc_id % 6 = 1, 1, 2) lane")
    return reports.with_protected(items.filter("source_id % 4 = 0"), items).selectExpr("source_id doc_id")


@query("""WITH e AS (SELECT CASE WHEN user_id % 50 > 0 THEN 'x' || user_id ELSE '' END AS source_id, event_id, event_id % 3 > 0 AS live FROM events)
SELECT source_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY live, event_id) AS r FROM e) WHERE r = 1 OR source_id = ''""")
def merged_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr("if(user_id % 50 > 0, 'x' || user_id, '') source_id", "event_id")
    return reports.merged_social(rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 > 0"), [F.col("event_id")])


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR GROUP BY user_id")
def servable_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    latest = rows.agg(F.max("ts").alias("as_of"))  # one row
    fresh = reports.servable(rows.withColumnRenamed("ts", "refreshed_at").crossJoin(F.broadcast(latest)), F.col("as_of"), hours=12)
    return fresh.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS feed, s_suppkey % 7 > 0 AS active, n_name AS name, s_suppkey % 4 = 0 AS tracked FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 6 > 0")
def mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "supplier").selectExpr("s_suppkey feed", "s_suppkey % 7 > 0 active", "s_nationkey entity")
    entities = table(spark, sf_dir, "nation").filter("n_nationkey % 6 > 0").selectExpr("n_nationkey entity", "n_name name")
    return reports.mapping_report(mapping, entities, mapping.filter("feed % 4 = 0").select("feed"))


@query("""SELECT c_custkey AS feed, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN c_custkey % 2 = 0 AND s_suppkey % 7 = 0 THEN 'restore' ELSE 'leave' END AS action FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = table(spark, sf_dir, "supplier").selectExpr("s_suppkey feed", "s_suppkey % 7 > 0 active")
    return reports.restore_plan(table(spark, sf_dir, "customer").selectExpr("c_custkey feed", "c_custkey % 2 = 0 prev_active"), mapping)


@query("""WITH r AS (SELECT 'u' || user_id AS name, event_type AS kind, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL)
SELECT kind, '• ' || name || ' — seen ' || n || '× (last: ' || strftime(last, '%Y-%m-%dT%H:%MZ') || ')' AS line FROM r""")
def delta_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = events(spark, sf_dir).groupBy(F.expr("'u' || user_id").alias("name"), F.col("event_type").alias("kind"))
    return reports.delta_digest(seen.agg(F.count("*").alias("times_seen"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")))


_STATUS = "CASE o_orderkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'mapped' WHEN 2 THEN 'pending' WHEN 3 THEN 'rejected' WHEN 4 THEN 'odd' END"


@query(f"WITH r AS (SELECT {_STATUS} AS s, o_custkey % 100 AS w FROM orders) SELECT CASE WHEN s IS NULL OR s = 'odd' THEN 'pending' ELSE s END AS bucket, count(*) AS n, CAST(sum(w) AS BIGINT) AS weight FROM r GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.status_counts(table(spark, sf_dir, "orders").selectExpr(f"{_STATUS} status", "o_custkey % 100 weight"), "status")


@query(f"""WITH r AS (SELECT o_custkey AS owner, o_orderkey AS feed, {_STATUS} AS s, o_custkey % 3 AS w, o_orderpriority AS name FROM orders)
SELECT owner, feed FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY CASE s WHEN 'verified' THEN 1 WHEN 'mapped' THEN 2 WHEN 'pending' THEN 3 WHEN 'rejected' THEN 4 ELSE 5 END, w DESC, name, feed) AS r FROM r) WHERE r = 1""")
def first_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey owner", "o_orderkey feed", f"{_STATUS} status", "o_custkey % 3 weight", "o_orderpriority name")
    return ranking.top_per_key(rows, ["owner"], [*reports.status_order(F.col("status"), F.col("weight"), F.col("name")), F.col("feed")], 1).select("owner", "feed")


_LIST = "p_name || ',' || upper(p_name) || ', @x,--,' || replace(p_type, ' ', ',') || ',,' || lower(p_type) || ',' || repeat(p_brand, 1 + p_size % 12)"


@query(rf"""WITH w AS (SELECT p_partkey, list_transform(string_split({_LIST}, ','), lambda x: trim(x)) AS w FROM part),
g AS (SELECT p_partkey, list_filter(w, lambda x: length(x) <= 64 AND regexp_matches(x, '[\p{{L}}\p{{N}}]') AND NOT starts_with(x, '@')) AS g FROM w), l AS (SELECT p_partkey, g, list_transform(g, lambda x: lower(x)) AS l FROM g),
k AS (SELECT p_partkey, list_filter(g, lambda x, i: list_position(l, lower(x)) = i) AS k FROM l)
SELECT p_partkey, len(k) AS n, array_to_string(list_transform(list_sort(list_transform(k, lambda x: {{'k': lower(x), 'v': x}}))[1:3], lambda s: s.v), ' ') AS first FROM k""")
def list_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", reports.hygiene(F.split(F.expr(_LIST), ",", -1)).alias("k"))
    return rows.select("p_partkey", F.size("k").cast("long").alias("n"), F.array_join(reports.finalized(F.col("k"), 3), " ").alias("first"))


@query(r"""WITH r AS (SELECT c_custkey, ' @' || c_name || ',@@' || lower(c_name) || ' , ,' || c_mktsegment || ',@' AS raw FROM customer),
n AS (SELECT c_custkey, list_transform(string_split(raw, ','), lambda x: lower(trim(regexp_replace(trim(x), '^@+', '')))) AS n FROM r), k AS (SELECT c_custkey, list_filter(n, lambda x, i: x <> '' AND list_position(n, x) = i) AS k FROM n)
SELECT c_custkey, array_to_string(k, ',') AS names, 'x:' || k[1] || ':' || substr(sha256('x:' || k[1] || '::' || c_custkey), 1, 16) AS post FROM k""")
def user_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("' @' || c_name || ',@@' || lower(c_name) || ' , ,' || c_mktsegment || ',@'")
    rows = table(spark, sf_dir, "customer").select("c_custkey", reports.usernames(raw).alias("k"))
    return rows.select("c_custkey", F.array_join("k", ",").alias("names"), reports.post_id(F.col("k")[0], F.col("c_custkey").cast("string")).alias("post"))


@query("SELECT event_type, round(sum(round((event_id % 900 * 3.0 + user_id % 70 * 15.0) / 1000000, 6)), 4) AS usd FROM events GROUP BY event_type")
def run_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = reports.cost_usd(F.col("event_id") % 900, F.col("user_id") % 70, 3.0, 15.0)
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum(cost), 4).alias("usd"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(events(spark, sf_dir).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def stream_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, path = [F.col("ts").desc(), F.col("event_id").desc()], feeds.shared_folder(spark, "newest")
    feeds.run_once(_event_stream(spark, sf_dir), "append", feeds.newest_into(path, ["user_id"], order), feeds.shared_folder(spark, "progress"))
    return feeds.newest(spark, path, ["user_id"], order).select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = feeds.shared_folder(spark, "sightings")
    seen = feeds.first_sightings(_event_stream(spark, sf_dir), ["user_id", "event_type"], "ts", "400 days").select("user_id", "event_type")
    feeds.run_once(seen, "append", feeds.appended_into(path), feeds.shared_folder(spark, "progress"))
    return spark.read.parquet(path).drop("batch")


@query("""WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT CAST(start AS TIMESTAMP) AS start, event_type, n FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = feeds.shared_folder(spark, "windows")
    counts = feeds.windowed_counts(_event_stream(spark, sf_dir), ["event_type"], "ts", "1 day", "2 hours")
    feeds.run_once(counts, "append", feeds.appended_into(path), feeds.shared_folder(spark, "progress"))
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
