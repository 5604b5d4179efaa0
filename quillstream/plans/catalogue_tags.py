"""Registered queries of tags, written lines, registries and publishing, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, prose, tags, text
from ..operators import ranking, registry, tagging
from .catalogue import QUERIES, SETTINGS, SQL, events, query, rounded, table
from .catalogue_stories import QUERIES as _stories  # registers them


assert _stories is QUERIES
__all__ = ["QUERIES", "SQL"]  # of all three modules

_TAGS = """w AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+') AS w FROM documents),
s AS (SELECT doc_id, list_filter(w, lambda x, i: i % 4 = 1) AS topics, list_filter(w, lambda x, i: i % 4 = 2) AS keywords, list_filter(w, lambda x, i: i % 4 = 3) AS geographies,
 CASE WHEN doc_id % 3 > 0 THEN list_filter(w, lambda x, i: i % 4 = 0) ELSE [] END AS entities FROM w)"""
_T, _K, _G = (", ".join(f"'{x}'" for x in axis) for axis in (SETTINGS.topics, SETTINGS.keywords, SETTINGS.geographies))


def _words() -> Column:
    return text.words_of(F.coalesce("text", F.lit("")))


def _axes(w: Column) -> dict[str, Column]:
    """Words as the tags of a story, one in four on each axis."""
    # each word is looked at once, and not once for each axis
    every = lambda k: F.when(F.size(w) > k, F.transform(F.sequence(F.lit(k), F.size(w) - 1, F.lit(4)), lambda i: w[i])).otherwise(F.array())
    return {a: every(k) for k, a in enumerate(("topics", "keywords", "geographies", "entities"))}


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stories, tagged with their words."""
    own = _axes(F.col("w"))
    own["entities"] = F.when(F.col("doc_id") % 3 > 0, own["entities"]).otherwise(F.array())
    return table(spark, sf_dir, "documents").select("doc_id", _words().alias("w")).select("doc_id", *(c.alias(a) for a, c in own.items()))


@query(f"""WITH {_TAGS}, f AS (SELECT doc_id, topics, keywords, geographies, entities, CASE WHEN len(entities) > 0 THEN entities ELSE list_concat(topics, keywords, geographies) END AS ev,
 list_has_any(list_concat(topics, entities), [{_T}]) AS t, list_has_any(list_concat(keywords, entities), [{_K}]) AS k, list_has_any(list_concat(geographies, entities), [{_G}]) AS g FROM s)
SELECT doc_id, CAST(t AS DOUBLE) AS topic_fit, CAST(k AS DOUBLE) AS keyword_fit, CAST(g AS DOUBLE) AS geo_fit, t OR k AS on_beat, CAST(len(topics) > 0 AS INT) + CAST(len(keywords) > 0 AS INT) AS strength,
 round((CAST(list_has_any(ev, [{_T}]) AS INT) + CAST(list_has_any(ev, [{_K}]) AS INT) + CAST(list_has_any(ev, [{_G}]) AS INT)) / 3, 6) AS entity_fit FROM f""")
def tag_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagging.tag_fits(_tagged(spark, sf_dir), SETTINGS).withColumn("entity_fit", rounded(F.col("entity_fit")))
    return rows.select("doc_id", "topic_fit", "keyword_fit", "geo_fit", "on_beat", "strength", "entity_fit")


@query(f"WITH {_TAGS} SELECT doc_id FROM s WHERE list_has_any(topics, ['que', 'de', 'der', 'para', 'les']) AND list_has_any(geographies, ['la', 'de', 'die', 'los', 'elle', 'thes', 'que'])")
def tag_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"topics": ["que", "de", "der", "para", "les"], "keywords": [], "geographies": ["la", "de", "die", "los", "elle", "thes", "que"]}
    # a filter on columns of tags would be moved below them, and there split the text again for each of its words
    return table(spark, sf_dir, "documents").filter(text.bound(_words(), lambda w: tags.selected(_axes(w), wanted))).select("doc_id")


@query(f"""WITH {_TAGS}, l AS (SELECT doc_id, list_sort(list_distinct(topics)) AS t, list_sort(list_distinct(keywords)) AS k FROM s) SELECT doc_id, array_to_string(CASE WHEN len(t) >= 2 THEN t[1:2] ELSE list_concat(t, k)[1:2] END, ',') AS labels FROM l""")
def scan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("doc_id", F.array_join(tags.scan_labels(F.col("topics"), F.col("keywords")), ",").alias("labels"))


@query(f"""WITH {_TAGS}, a AS (SELECT 'topics' AS axis, unnest(topics) AS tag FROM s UNION SELECT 'keywords', unnest(keywords) FROM s UNION SELECT 'geographies', unnest(geographies) FROM s)
SELECT axis, tag, row_number() OVER (PARTITION BY axis ORDER BY tag) AS place FROM a""")
def tag_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.tag_sections(_tagged(spark, sf_dir), ["topics", "keywords", "geographies"]).withColumn("place", F.col("place").cast("long"))


_LINES = r"""l AS (SELECT doc_id, trim(coalesce(text, '')) AS a FROM documents),
p AS (SELECT doc_id, a, CASE doc_id % 4 WHEN 0 THEN upper(a) WHEN 1 THEN substr(a, 1, length(a) // 2) WHEN 2 THEN replace(a, ' ', '  ') || ' and more' ELSE substr(a, 60) END AS b FROM l)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text and a second one made from it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.trim(F.coalesce("text", F.lit(""))).alias("a"))
    others = F.expr("case doc_id % 4 when 1 then substr(a, 1, cast(length(a) div 2 as int)) when 2 then replace(a, ' ', '  ') || ' and more' else substr(a, 60) end")
    return rows.withColumn("b", F.when(F.col("doc_id") % 4 == 0, text.upper_letters(F.col("a"))).otherwise(others))


@query(rf"""WITH {_LINES}, n AS (SELECT doc_id, trim(regexp_replace(lower(a), '\s+', ' ', 'g')) AS x, trim(regexp_replace(lower(b), '\s+', ' ', 'g')) AS y FROM p),
t AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(x, '[^a-z0-9]+'), lambda t: length(t) > 2)) AS xs, list_distinct(list_filter(regexp_split_to_array(y, '[^a-z0-9]+'), lambda t: length(t) > 2)) AS ys FROM n),
c AS (SELECT *, len(xs) AS n, len(ys) AS m, len(list_intersect(xs, ys)) AS i FROM t)
SELECT doc_id, x <> '' AND y <> '' AND (x = y OR (length(x) >= 30 AND contains(y, x)) OR (length(y) >= 30 AND contains(x, y)) OR CASE WHEN least(n, m) < 4 THEN false ELSE i / (n + m - i) >= 0.7 OR (n <= m AND i / n >= 0.85) END) AS repeats FROM c""")
def line_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", prose.repeats(F.col("a"), F.col("b")).alias("repeats"))


@query(r"""WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(list_transform(ls, lambda x: trim(x))) AS a, generate_subscripts(ls, 1) - 1 AS line FROM w),
p AS (SELECT doc_id, line, a, CASE WHEN doc_id % 5 = 0 THEN 'UPDATE : ' || a ELSE a END AS raw FROM l),
k AS (SELECT doc_id, line, a, raw, regexp_replace(raw, '^(update|latest)\s*:\s*', '', 'i') AS t FROM p),
s AS (SELECT doc_id, line, a, raw, t, regexp_replace(array_to_string(regexp_extract_all(t, '[^.!?]+[.!?]+(?:\s+|$)')[1:2], ''), '^\s+|\s+$', '', 'g') AS kept FROM k),
v AS (SELECT *, CASE WHEN kept <> '' THEN kept ELSE t END AS prose FROM s),
r AS (SELECT *, CASE WHEN raw = '' THEN 'empty_prose' WHEN t = '' THEN 'empty_after_prefix_strip' WHEN length(prose) > 300 THEN 'length_overflow' END AS reason FROM v)
SELECT doc_id, line, reason, CASE WHEN reason IS NULL THEN prose ELSE '' END AS prose,
 a <> '' AND length(a) <= 300 AND len(regexp_extract_all(a, '[^.!?]+[.!?]+')) + CAST(trim(regexp_extract(a, '([^.!?]*)$', 1)) <> '' AS INT) BETWEEN 1 AND 2 AS fits FROM r""")
def prose_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "a")).select("doc_id", F.col("line").cast("long").alias("line"), F.trim("a").alias("a"))
    out = prose.changed_prose(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("UPDATE : "), "a")).otherwise(F.col("a")))
    return rows.withColumn("out", out).select("doc_id", "line", "out.reason", "out.prose", prose.length_fits(F.col("a")).alias("fits"))


@query(r"""WITH l AS (SELECT p_partkey, list_transform(string_split(CASE WHEN p_partkey % 3 = 0 THEN p_type || ' OFAC us 7' ELSE lower(p_type) || '  ' || p_name END, ' '), lambda x: x) AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(list_filter(w, lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[A-Za-z]') AND x = upper(x) THEN x ELSE upper(substr(lower(x), 1, 1)) || substr(lower(x), 2) END), ' ') AS label FROM l""")
def keyword_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("if(p_partkey % 3 = 0, p_type || ' OFAC us 7', lower(p_type) || '  ' || p_name)")
    return table(spark, sf_dir, "part").select("p_partkey", prose.keyword_label(raw).alias("label"))


@query(r"""SELECT doc_id, substr(sha256(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: (length(s) + length(regexp_replace(s, '[^\x{10000}-\x{10FFFF}]', '', 'g'))) || ':' || s), '')), 1, 16) AS hash FROM documents""")
def segment_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", prose.segments_hash(F.split(F.coalesce("text", F.lit("")), "\n")).alias("hash"))


@query("SELECT DISTINCT l_orderkey AS user_id, l_returnflag AS kind, l_suppkey AS raw FROM lineitem n WHERE l_linenumber >= 3 AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_linenumber < 3 AND o.l_orderkey = n.l_orderkey AND o.l_returnflag = n.l_returnflag AND o.l_suppkey = n.l_suppkey)")
def settings_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey user_id", "l_returnflag kind", "l_suppkey raw", "l_linenumber")
    return registry.added(rows.filter("l_linenumber >= 3"), rows.filter("l_linenumber < 3"), ["user_id", "kind", "raw"])


@query("""WITH a AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE ' ' || c_mktsegment || c_custkey % 20 END AS raw, c_mktsegment || c_custkey % 10 AS normalized, c_nationkey AS entity FROM customer),
k AS (SELECT seq, CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE n_name END AS canonical, raw, normalized FROM a JOIN nation ON n_nationkey = entity),
r AS (SELECT seq, 0 AS i, lower(trim(normalized)) AS alias, canonical FROM k UNION ALL SELECT seq, 1, lower(trim(raw)), canonical FROM k)
SELECT alias, arg_max(canonical, seq * 2 + i) AS canonical FROM r WHERE alias <> '' AND canonical <> '' GROUP BY alias""")
def alias_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "customer").selectExpr("c_custkey seq", "if(c_custkey % 7 = 0, ' ', ' ' || c_mktsegment || c_custkey % 20) raw", "c_mktsegment || c_custkey % 10 normalized", "c_nationkey entity")
    return registry.alias_names(aliases, table(spark, sf_dir, "nation").selectExpr("n_nationkey entity", "if(n_nationkey % 6 = 0, ' ', n_name) canonical"))


@query("""WITH e AS (SELECT user_id % 20 AS u, user_id || event_type || event_id % 3 AS key, epoch_us(ts) AS t, event_id FROM events), log AS (SELECT DISTINCT u, key, min(t) AS t FROM e WHERE event_id % 4 = 0 GROUP BY u, key),
fresh AS (SELECT u, key, min(t) AS t FROM e WHERE event_id % 4 > 0 AND NOT EXISTS (SELECT 1 FROM log l WHERE l.u = e.u AND l.key = e.key) GROUP BY u, key), b AS (SELECT * FROM log UNION ALL SELECT * FROM fresh)
SELECT u AS user, key FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY t DESC, key DESC) AS r FROM b) WHERE r <= 200""")
def rejection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr("user_id % 20 user", "user_id || event_type || event_id % 3 key", "ts at", "event_id")
    log = rows.filter("event_id % 4 = 0").groupBy("user", "key").agg(F.min("at").alias("at"))
    return registry.with_rejections(log, rows.filter("event_id % 4 > 0")).select("user", "key")


@query("""WITH st AS (SELECT c_custkey AS story, r_name AS topic, n_name AS geo, 'k' || c_custkey % 4 AS keyword, c_custkey % 3 AS state FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
sn AS (SELECT 's' || n_nationkey AS id, r_name AS topic, n_name AS geo, 'k' || n_nationkey % 4 AS keyword, n_nationkey % 3 AS state FROM nation JOIN region ON r_regionkey = n_regionkey),
j AS (SELECT story, id, CAST(st.keyword = sn.keyword AS INT) AS k, CAST(st.geo = sn.geo AS INT) AS g, CAST(st.state = sn.state AS INT) AS s FROM st JOIN sn ON st.topic = sn.topic OR st.geo = sn.geo)
SELECT story, id, place FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY k DESC, g DESC, s DESC, id) AS place FROM j) WHERE place <= 3""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    stories = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    stories = stories.selectExpr("c_custkey story", "array(r_name) topics", "array(n_name) geographies", "array('K' || c_custkey % 4) keywords", "cast(c_custkey % 3 as string) state")
    texts = nations.selectExpr("'s' || n_nationkey id", "array(r_name) topics", "array(n_name) geographies", "array('k' || n_nationkey % 4) keywords", "cast(n_nationkey % 3 as string) state")
    return registry.snippets_for(stories, texts).withColumn("place", F.col("place").cast("long"))


_FALL = """f AS (SELECT event_id, value, CASE WHEN value < 20 THEN 'not_beat_fit_included' WHEN event_id % 11 = 0 THEN 'missing_source_id' WHEN event_id % 3 = 0 THEN 'no_topic_fit' WHEN event_id % 4 = 0 THEN 'no_keyword_fit' END AS reason FROM events)"""


def _fallback(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf_dir).selectExpr("event_id", "value", "value >= 20 included", "if(event_id % 11 = 0, ' ', cast(event_id as string)) source_id", "event_id % 3 topic_fit", "event_id % 4 keyword_fit")
    return registry.fallback_stories(rows, [F.col("value").desc(), F.col("event_id").asc()])


@query(f"WITH {_FALL} SELECT event_id FROM f WHERE reason IS NULL ORDER BY value DESC, event_id LIMIT 5")
def fallback_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fallback(spark, sf_dir)[0].select("event_id")


@query(f"""WITH {_FALL} SELECT r AS reason, (SELECT count(*) FROM f WHERE reason = r) AS n FROM (SELECT unnest(['not_beat_fit_included', 'missing_source_id', 'no_topic_fit', 'no_keyword_fit']) AS r)
UNION ALL SELECT 'over_cap', greatest(count(*) - 5, 0) FROM f WHERE reason IS NULL""")
def fallback_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fallback(spark, sf_dir)[1]


@query("""WITH e AS (SELECT event_id, user_id, event_type = 'purchase' AS s, event_id % 2 = 0 AS c, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 5 END AS m, CAST(event_id AS VARCHAR) AS id FROM events)
SELECT event_id, CASE WHEN s AND c THEN 1 ELSE 2 END AS lane, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, c DESC, m NULLS LAST, id) AS place FROM e""")
def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr("event_id", "user_id", "event_type = 'purchase' s", "event_id % 2 = 0 c", "if(event_id % 7 = 0, null, event_id % 5) minutes_ago", "cast(event_id as string) source_id")
    rows = rows.withColumn("lane", registry.lane(F.col("s"), F.col("c")))
    out = ranking.top_per_key(rows, ["user_id"], registry.lane_order(F.col("s"), F.col("c")), 2**31 - 1, "place")
    return out.select("event_id", "lane", F.col("place").cast("long").alias("place"))


_FAILS = ", ".join(f"'{r}'" for r in fixed.WRITER_FAILURES)


@query(f"""WITH e AS (SELECT user_id, event_id % 9 = 0 AS c, event_id % 2 = 0 AND ['write_failed', 'disabled', 'resolver_threw', 'mock_only'][event_id % 4 + 1] IN ({_FAILS}) AND value > 50 AS w FROM events)
SELECT user_id, count(*) AS eligible, count(*) FILTER (c OR w) AS dropped, count(*) FILTER (c) AS changed, count(*) FILTER (w) AS why, count(*) FILTER (NOT (c OR w)) AS survived, round(count(*) FILTER (NOT (c OR w)) / count(*), 6) AS retention_rate FROM e GROUP BY user_id""")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.element_at(F.array(*map(F.lit, ("write_failed", "disabled", "resolver_threw", "mock_only"))), (F.col("event_id") % 4 + 1).cast("int"))
    failed = {"changed": F.col("event_id") % 9 == 0, "why": registry.writer_failed((F.col("event_id") % 2 == 0) & (F.col("value") > 50), reason)}
    return registry.stability(events(spark, sf_dir), ["user_id"], failed).withColumn("retention_rate", rounded(F.col("retention_rate")))


@query("""WITH n AS (SELECT o_custkey AS u, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderkey END AS story, o_orderkey % 5 = 0 AS failed FROM orders), s AS (SELECT u FROM n GROUP BY u HAVING bool_or(failed) AND count(story) = 0)
SELECT u AS user, story, false AS from_prior FROM n WHERE story IS NOT NULL UNION ALL SELECT c_custkey, -c_custkey, true FROM customer WHERE c_custkey IN (SELECT u FROM s)""")
def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "orders").selectExpr("o_custkey user", "if(o_orderstatus = 'O', null, o_orderkey) story", "o_orderkey % 5 = 0 failed")
    return registry.published(new, table(spark, sf_dir, "customer").selectExpr("c_custkey user", "-c_custkey story"))


@query("SELECT o_orderkey AS user, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL 3 HOUR ELSE o_orderdate END AS anchor FROM orders")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = "case o_orderkey % 3 when 0 then to_json(named_struct('_lastCheckedAt', date_format(o_orderdate + interval 3 hours, \"yyyy-MM-dd HH:mm:ss\"))) when 1 then '{\"stories\":[]}' else '{\"_lastCheckedAt\":\"?\"}' end"
    return registry.anchors(table(spark, sf_dir, "orders").selectExpr("o_orderkey user", f"{payload} payload", "o_orderdate refreshed_at"))


@query("""SELECT 'weight' AS rule, count(*) FILTER (NOT p_size BETWEEN 3 AND 45) AS n FROM part UNION ALL SELECT 'brand', count(*) FILTER (p_brand NOT IN ('Brand#11', 'Brand#12')) FROM part
UNION ALL SELECT 'name', count(*) FROM (SELECT p_name FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1) UNION ALL SELECT 'key', count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)""")
def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"weight": F.col("p_size").between(3, 45), "brand": F.col("p_brand").isin("Brand#11", "Brand#12")}
    return registry.broken_rules(table(spark, sf_dir, "part"), {"name": ["p_name"], "key": ["p_partkey"]}, tests)
