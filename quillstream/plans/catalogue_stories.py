"""Registered queries of source selection, story changes, clusters and roll-ups, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..operators import changes, clusters, metrics, ranking, selection, stories
from . import profile
from .catalogue import _SCORED, _word_sql, ITEMS, QUERIES, SETTINGS, SQL, _GEO, _geo_items, doc_items, events, query, rounded, table


__all__ = ["QUERIES", "SQL"]  # of this module and of the catalogue


def _sql_map(column: str, pairs: dict[str, str]) -> str:
    quoted = {k.replace("'", "''"): v.replace("'", "''") for k, v in pairs.items()}
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quoted.items()) + " END"


def _bare(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '^the\s+', ''), '[—–_/-]', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


_PICK = "CASE n_nationkey % 3 WHEN 0 THEN 'The ' || n_name WHEN 1 THEN n_name || ' Zed' ELSE '  ' || lower(n_name) || '-' END"


@query(f"""WITH s AS (SELECT trim({_PICK}) AS name FROM nation), n AS (SELECT name, {_bare("name")} AS needle FROM s),
f AS (SELECT CAST(s_suppkey AS VARCHAR) AS feed_id, {_bare("s_name")} AS a, {_bare("n_name")} AS b, s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS open FROM supplier JOIN nation ON n_nationkey = s_nationkey),
m AS (SELECT n.name, count(f.feed_id) AS k, bool_or(f.open) AS any_open, list_sort(list(f.feed_id) FILTER (f.open)) AS ids FROM n LEFT JOIN f ON contains(f.a, needle) OR contains(f.b, needle) GROUP BY n.name)
SELECT name, CASE WHEN k = 0 THEN 'unmatched' WHEN any_open THEN 'matched' ELSE 'unavailable' END AS status, coalesce(array_to_string(ids, ','), '') AS feed_ids FROM m""")
def resolve_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    feeds = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    feeds = feeds.selectExpr("cast(s_suppkey as string) feed_id", "s_name name", "n_name publisher", "if(s_suppkey % 7 = 0, 'newsletter', 'rss') kind", "s_suppkey % 5 != 0 active")
    out = selection.resolve_sources(nations.selectExpr(f"{_PICK} name"), feeds)
    return out.select("name", "status", F.array_join("feed_ids", ",").alias("feed_ids"))


@query(f"WITH {ITEMS} SELECT source_id FROM items WHERE feed_id = 'src8' OR contains(lower(outlet), 'src1') OR contains('src1', lower(outlet)) OR (kind = 'social' AND '@' || lower(outlet) = '@src3')")
def selected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.selected_items(doc_items(spark, sf_dir), ["src8"], ["SRC1"], ["@src3"]).select("source_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'invalid_row' WHEN c_custkey % 3 = 0 THEN 'non_rss' WHEN c_custkey % 5 = 0 THEN 'inactive' WHEN c_custkey % 7 = 0 THEN 'invalid_url'
 WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'publisher_filter' WHEN NOT contains(lower(c_name), '1') THEN 'not_allowed' END AS reason FROM customer""")
def feed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "if(c_custkey % 11 = 0, ' ', cast(c_custkey as string)) feed_id", "c_name name", "if(c_custkey % 7 = 0, 'ftp:x', 'HTTPS://h/f') url",
        "if(c_custkey % 3 = 0, 'social', 'rss') kind", "if(c_custkey % 5 = 0, false, null) active", "c_mktsegment publisher",
    )
    return selection.feed_verdicts(rows, ["Building", " machinery"], ["1"]).select("c_custkey", "reason")


@query("""WITH x AS (SELECT event_id, value / 400 AS score, event_id % 2 AS t, event_id % 3 AS k, event_id % 5 AS g, event_type = 'error' AS pen, (event_id % 10) / 10 AS sem FROM events), b AS (SELECT *, score >= CAST(0.2 AS DOUBLE) - CAST(0.05 AS DOUBLE) AND score < 0.2 AS band, CAST(t > 0 AS INT) + CAST(k > 0 AS INT) + CAST(g > 0 AS INT) AS strong FROM x)
SELECT event_id, band AND NOT pen AND strong >= 3 AS rescued, CASE WHEN band AND pen THEN 'major_penalty' WHEN band AND strong < 3 THEN 'insufficient_signals' END AS blocked_by,
 CASE WHEN score >= 0.2 THEN 'above_threshold' WHEN pen THEN 'major_penalty' WHEN sem < 0.6 THEN 'weak_semantic' WHEN g = 0 THEN 'geo_gate' END AS semantic_blocked_by FROM b""")
def rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, geo, penalty = F.col("value") / 400, F.col("event_id") % 5, F.col("event_type") == "error"
    near = scoring.rescue(score, F.col("event_id") % 2, F.col("event_id") % 3, geo, penalty)
    far = scoring.semantic_rescue(score, (F.col("event_id") % 10) / 10, geo, penalty)
    return events(spark, sf_dir).select("event_id", near["rescued"].alias("rescued"), near["blocked_by"].alias("blocked_by"), far["blocked_by"].alias("semantic_blocked_by"))


_GATE = """lines AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2),
now AS (SELECT l_orderkey AS story, l_linenumber AS id, 'o' || l_suppkey % 10 AS outlet, lower(l_returnflag) AS head FROM lines WHERE l_linenumber % 3 <> 0),
was AS (SELECT l_orderkey AS story, l_linenumber AS id, 'o' || l_suppkey % 10 AS outlet, CASE WHEN l_partkey % 5 = 0 THEN 'before' ELSE lower(l_returnflag) END AS head FROM lines WHERE l_linenumber % 3 <> 1 AND l_orderkey % 4 <> 0),
texts AS (SELECT o_orderkey AS story FROM orders), was_texts AS (SELECT o_orderkey AS story FROM orders WHERE o_orderkey % 4 <> 0),
a AS (SELECT now.* FROM now JOIN was_texts USING (story) WHERE NOT EXISTS (SELECT 1 FROM was w WHERE w.story = now.story AND w.id = now.id) AND NOT EXISTS (SELECT 1 FROM was w WHERE w.story = now.story AND w.outlet = now.outlet AND w.head = now.head)),
o AS (SELECT story, outlet, min(id) AS id FROM a WHERE NOT EXISTS (SELECT 1 FROM was w WHERE w.story = a.story AND w.outlet = a.outlet) GROUP BY 1, 2),
r AS (SELECT story, 0 AS p, id AS s, 0 AS u, 'added_source:' || id AS reason, true AS strong FROM a UNION ALL SELECT story, 0, id, 1, 'new_outlet:' || outlet, true FROM o
 UNION ALL SELECT now.story, 0, now.id, 0, 'headline_change:' || now.id, true FROM now JOIN was USING (story, id) WHERE now.head <> was.head
 UNION ALL SELECT was.story, 1, id, 0, 'removed_source:' || id, false FROM was WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.story = was.story AND n.id = was.id)
 UNION ALL SELECT story, 2, 1, 0, 'subtitle_change', false FROM was_texts WHERE story % 7 = 0),
g AS (SELECT story, CASE WHEN bool_or(strong) THEN 'strong' WHEN count(reason) > 0 THEN 'weak' ELSE 'none' END AS signal, coalesce(string_agg(reason, ',' ORDER BY p, s, u), '') AS reasons FROM was_texts LEFT JOIN r USING (story) GROUP BY story)"""


def _gate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_suppkey", "l_returnflag", "l_partkey")))
    lines = lines.selectExpr("l_orderkey story", "cast(l_linenumber as string) id", "l_linenumber seq", "concat('O', l_suppkey % 10) outlet", "l_returnflag headline", "l_partkey")
    prior = lines.filter("seq % 3 != 1 and story % 4 != 0").withColumn("headline", F.expr("if(l_partkey % 5 = 0, ' Before', headline)"))
    texts = table(spark, sf_dir, "orders").selectExpr("o_orderkey story", "o_orderpriority title", "o_orderstatus subtitle", "cast(o_custkey as string) summary")
    was = texts.filter("story % 4 != 0").withColumn("subtitle", F.expr("if(story % 7 = 0, 'x', lower(subtitle))"))
    return changes.structural_gate(lines.filter("seq % 3 != 0"), prior, texts, was), texts


@query(f"WITH {_GATE} SELECT story, signal, reasons FROM g")
def structural_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir)[0].select("story", "signal", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_GATE} SELECT t.story, CASE WHEN t.story % 9 <> 0 THEN 'unchanged' ELSE 'first-seen' END AS state, CASE WHEN t.story % 9 <> 0 THEN coalesce(signal, 'none') ELSE 'none' END AS signal FROM texts t LEFT JOIN g USING (story)")
def change_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate, texts = _gate(spark, sf_dir)
    return changes.change_state(texts, texts.filter("story % 9 != 0").select("story"), gate)


@query("SELECT o_orderkey AS story, CASE WHEN o_orderkey % 3 = 0 THEN 'first' ELSE o_orderpriority END AS title FROM orders")
def title_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey story", "o_orderpriority title")
    locks = rows.filter("story % 3 = 0").withColumn("title", F.lit("first"))
    return changes.with_locked_titles(rows, locks)[1]


@query("SELECT user_id AS story FROM events WHERE event_type = 'view' UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def ever_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.ever_seen(events(spark, sf_dir).filter("event_type = 'view'").selectExpr("user_id story"), table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").selectExpr("c_custkey story"))


_STOPS = ", ".join(f"'{w}'" for w in fixed.EVIDENCE_STOPWORDS)
#: The words of elections, spelt out, so that the SQL does not rest on the library's lists.
_VOTES = """'election', 'elections', 'electoral', 'elección', 'elecciones', 'electorales', 'vote', 'votes', 'voting', 'voter', 'voters', 'voto', 'votos', 'votación', 'votante', 'votantes',
 'ballot', 'ballots', 'papeleta', 'papeletas', 'tarjetón', 'presidential', 'president', 'presidencial', 'presidenciales', 'presidente', 'candidate', 'candidates', 'candidacy',
 'candidato', 'candidatos', 'candidata', 'candidatas', 'candidatura', 'campaign', 'campaigns', 'campaigning', 'campaña', 'campañas', 'runoff', 'runoffs', 'segunda', 'vuelta', 'balotaje',
 'debate', 'debates', 'electorate', 'incumbent', 'comicios', 'sondeo', 'sondeos', 'encuesta', 'encuestas'"""
#: Five documents make a cluster; two documents of every third cluster hold the word "vuelta". Evidence is the first line and the next two that are not blank.
_PLACES = "'us', 'u', 's', 'usa', 'a', 'united', 'states', 'washington', 'dc', 'd', 'c', 'new', 'york', 'city', 'los', 'angeles'"
_HEADS = f"""texts AS (SELECT doc_id, lang, list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l)) AS lines FROM documents),
heads AS (SELECT doc_id // 5 AS story, doc_id AS id, coalesce(lang, 'en') = 'en' OR doc_id // 5 % 2 = 0 AS english,
 list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(list_concat([lines[1]], list_filter(lines[2:], lambda l: l <> '')[1:2]), ' ') || CASE WHEN doc_id // 5 % 3 = 0 AND doc_id % 5 < 2 THEN ' vuelta' ELSE '' END), '[^\\p{{L}}\\p{{N}}]+'),
  lambda t: length(t) >= 3 AND t NOT IN ({_STOPS}) AND t NOT IN ({_PLACES}))) AS tokens FROM texts)"""


@query(f"""WITH RECURSIVE {_HEADS}, t AS (SELECT story, id, unnest(tokens) AS token FROM heads), c AS (SELECT x.story, x.id AS a, y.id AS b, count(*) AS c FROM t x JOIN t y ON x.story = y.story AND x.token = y.token AND x.id < y.id GROUP BY ALL),
alike AS (SELECT c.story, a, b FROM c JOIN heads x ON x.id = a JOIN heads y ON y.id = b WHERE c.c / (len(x.tokens) + len(y.tokens) - c.c) >= 0.15),
claims AS (SELECT doc_id // 5 AS story, CASE WHEN doc_id // 5 % 4 = 0 THEN 0 ELSE doc_id % 5 END AS claim, doc_id AS s FROM documents WHERE doc_id // 5 % 5 <> 4),
k AS (SELECT story, max(n) AS most, count(*) AS claims FROM (SELECT story, claim, count(*) AS n FROM claims GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT h.story, count(*) AS n, bool_and(english) AS english, list_sort(list(id)) AS ids, any_value(coalesce(most >= 2, false)) AS corr, any_value(coalesce(claims >= 2 AND most = 1, false)) AS disj, any_value(h.story IN (SELECT story FROM alike)) AS linked FROM heads h LEFT JOIN k USING (story) GROUP BY h.story),
v AS (SELECT story, ids, CASE WHEN n >= 2 AND NOT corr AND NOT linked AND english THEN 'low_token_overlap' WHEN n >= 2 AND disj THEN 'disjoint_claim_evidence' WHEN n >= 2 AND NOT corr AND NOT linked THEN 'ambiguous_unnormalized_overlap' END AS reason FROM f),
e AS (SELECT a, b FROM alike UNION SELECT b, a FROM alike UNION SELECT x.id, y.id FROM t x JOIN t y ON x.story = y.story AND x.token = y.token AND x.id <> y.id WHERE x.token IN ({_VOTES})),
reach AS (SELECT id, id AS r FROM heads UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
root AS (SELECT id, min(r) AS root FROM reach GROUP BY id), parts AS (SELECT h.story, root, list_sort(list(h.id)) AS ids FROM heads h JOIN root USING (id) GROUP BY 1, 2),
s AS (SELECT v.story, v.reason, count(*) AS n FROM v JOIN parts USING (story) WHERE v.reason IN ('low_token_overlap', 'disjoint_claim_evidence') GROUP BY 1, 2)
SELECT p.story, p.root AS part, array_to_string(p.ids, ',') AS ids, 'split' AS action, s.reason FROM parts p JOIN s USING (story) WHERE s.n > 1
UNION ALL SELECT v.story, NULL, array_to_string(v.ids, ','), CASE WHEN reason IS NULL THEN 'kept' ELSE 'deferred' END, CASE WHEN reason IN ('low_token_overlap', 'disjoint_claim_evidence') THEN 'ambiguous_overlap_conflict' ELSE reason END FROM v WHERE story NOT IN (SELECT story FROM s WHERE n > 1)""")
def split_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("story", F.expr("doc_id div 5"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x))
    body = F.slice(F.filter(lines, lambda x, i: (i > 0) & (x != "")), 1, 2)
    evidence = F.concat(F.concat_ws(" ", lines[0], body), F.when((F.col("story") % 3 == 0) & (F.col("doc_id") % 5 < 2), " vuelta").otherwise(""))
    tokens = text.evidence_tokens(evidence, text.geography_words(["us"]))
    items = rows.select("story", F.col("doc_id").alias("id"), ((F.coalesce("lang", F.lit("en")) == "en") | (F.col("story") % 2 == 0)).alias("english"), tokens.alias("tokens"))
    claims = rows.filter("story % 5 != 4").selectExpr("story", "if(story % 4 = 0, 0, doc_id % 5) claim", "cast(doc_id as string) source_id")
    out = clusters.split_clusters(items, claims)
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query("""WITH s AS (SELECT user_id, event_type AS story, floor(max(value) / 25) AS rel, count(DISTINCT event_id % 3) AS n, CASE WHEN min(value) < 1 THEN NULL ELSE floor(min(value)) END AS fit, max(event_id % 7) AS m FROM events GROUP BY 1, 2)
SELECT user_id, story, row_number() OVER (PARTITION BY user_id ORDER BY rel DESC, n DESC, coalesce(fit, 0) DESC, m, story) AS place FROM s""")
def story_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("story")).agg(
        F.floor(F.max("value") / 25).cast("double").alias("relevance"), F.countDistinct(F.col("event_id") % 3).cast("double").alias("n_sources"),
        F.expr("if(min(value) < 1, null, cast(floor(min(value)) as double))").alias("max_fit"), F.max(F.col("event_id") % 7).cast("double").alias("min_minutes"),
    )
    return ranking.top_per_key(rows, ["user_id"], clusters.story_order(), 100, "place").select("user_id", "story", F.col("place").cast("long").alias("place"))


@query(f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, minutes_ago, source_id) AS k FROM items) SELECT lang, source_id FROM r WHERE k <= 5")
def key_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_per_key(doc_items(spark, sf_dir), ["lang"], clusters.source_order(), 5).select("lang", "source_id")


@query("""WITH s AS (SELECT o_custkey, o_orderkey AS story, 100 + CASE o_orderkey % 4 WHEN 1 THEN 30 WHEN 2 THEN 20 ELSE 0 END + 2 * least(5, o_orderkey % 8) AS suspicion FROM orders WHERE o_orderkey % 4 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY suspicion DESC, story) AS k FROM s)
SELECT o_custkey, story, suspicion FROM r WHERE k <= 2""")
def recluster_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = "element_at(array('ambiguous_unnormalized_overlap', 'ambiguous_overlap_conflict', 'other'), cast(o_orderkey % 4 as int))"
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey story", f"if(o_orderkey % 4 = 0, null, {reason.replace('element_at', 'try_element_at')}) reason", "o_orderkey % 8 n_sources")
    return clusters.recluster_queue(rows, ["o_custkey"]).select("o_custkey", "story", F.col("suspicion").cast("long").alias("suspicion"))


@query("""WITH s AS (SELECT l_orderkey AS story, array_to_string(list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))), ',') AS ids FROM lineitem GROUP BY 1)
SELECT story, CASE WHEN story % 2 = 0 THEN CAST(story AS VARCHAR) ELSE 'src:' || substr(sha256(ids), 1, 16) END || '|low|' AS key FROM s""")
def rejection_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("ids"))
    meta = F.expr("if(story % 2 = 0, concat(' ', cast(story as string)), if(story % 3 = 0, ' ', null))")
    return rows.select("story", clusters.rejection_key(meta, F.col("ids"), F.lit("low"), F.lit(None).cast("string")).alias("key"))


@query("SELECT count(*) AS runs, round(avg(CAST(event_type <> 'error' AS DOUBLE)), 6) AS success_rate, median(event_id % 6) AS median_stories, quantile_disc(value, 0.95) AS p95_pipeline_ms, avg(CAST(event_type <> 'error' AS DOUBLE)) >= 0.95 AND median(event_id % 6) >= 2 AS passed FROM events")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.run_summary(events(spark, sf_dir).selectExpr("event_type = 'error' fallback", "event_id % 6 stories", "value pipeline_ms"))
    return out.withColumn("success_rate", rounded(F.col("success_rate")))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1")
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counted_by(table(spark, sf_dir, "orders").selectExpr("if(o_orderkey % 3 > 0, o_orderpriority, null) o_orderpriority"), "o_orderpriority")


@query("WITH t AS (SELECT event_type, user_id % 10 AS threshold, avg(value) AS recall FROM events GROUP BY 1, 2), b AS (SELECT user_id % 10 AS threshold, avg(value) / 200 AS recall FROM events GROUP BY 1) SELECT max(threshold) AS recommended FROM b WHERE recall >= (SELECT max(recall) FROM b) - 0.05")
def recommended_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("threshold")).agg((F.avg("value") / 200).alias("recall"))
    return metrics.recommended_threshold(rows, "threshold", "recall")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, round(avg(k), 6) AS mean_rank, count(*) AS n FROM r WHERE event_type = 'purchase' GROUP BY 1")
def mean_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.mean_rank(events(spark, sf_dir), ["user_id"], [F.col("value").desc(), F.col("event_id").asc()], "event_type = 'purchase'")
    return out.select("user_id", rounded(F.col("mean_rank")).alias("mean_rank"), "n")


_LABELS = (*fixed.TOPIC_SYNONYMS, *fixed.KEYWORD_SYNONYMS)
_LABEL_SQL = ", ".join(f"'{x}'" for x in _LABELS)


@query(f"""WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type WHEN p_partkey % 3 = 1 THEN upper([{_LABEL_SQL}][p_partkey % {len(_LABELS)} + 1]) || ' ' ELSE [{_LABEL_SQL}][p_partkey % {len(_LABELS)} + 1] END AS raw FROM part)
SELECT p_partkey, coalesce({_sql_map("lower(trim(raw))", fixed.TOPIC_SYNONYMS)}, trim(raw)) AS topic, coalesce({_sql_map("lower(trim(raw))", fixed.KEYWORD_SYNONYMS)}, trim(raw)) AS keyword FROM l""")
def label_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts, and all labels that have a synonym, by their standard labels."""
    known = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % len(_LABELS) + 1).cast("int"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.upper(known), F.lit(" "))).otherwise(known)
    return table(spark, sf_dir, "part").select("p_partkey", selection.label(raw, fixed.TOPIC_SYNONYMS).alias("topic"), selection.label(raw, fixed.KEYWORD_SYNONYMS).alias("keyword"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS own, replace(p_type, ' ', ' , ') || ', ' || upper(string_split(p_name, ' ')[1]) || ',, New ,new,' || lower(p_type) AS draft FROM part),
n AS (SELECT *, list_filter(list_transform(string_split(draft, ','), lambda x: trim(x)), lambda x: x <> '' AND NOT list_contains(list_transform(own, lambda y: lower(y)), lower(x))) AS new FROM p)
SELECT p_partkey, array_to_string(list_concat(own, list_filter(new, lambda x, i: list_position(list_transform(new, lambda y: lower(y)), lower(x)) = i)), ',') AS added,
 array_to_string(list_filter(list_concat(own, CASE WHEN p_partkey % 2 = 0 THEN [' Beijing ', 'CHINA'] ELSE ['Hong Kong', 'Lima'] END), lambda x: trim(x) <> '' AND lower(trim(x)) NOT IN ('china', 'beijing', 'shanghai', 'shenzhen', 'guangzhou', 'hong kong')), ',') AS kept FROM n""")
def settings_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of parts' names as a list that drafts add to, and as keywords of which those that name a place in China go."""
    own = F.split("p_name", " ")
    draft = F.concat(F.replace("p_type", F.lit(" "), F.lit(" , ")), F.lit(", "), F.upper(own[0]), F.lit(",, New ,new,"), F.lower("p_type"))
    places = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(" Beijing "), F.lit("CHINA"))).otherwise(F.array(F.lit("Hong Kong"), F.lit("Lima")))
    kept = selection.without_geographies(F.concat(own, places), ["China"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(selection.added_labels(own, draft), ",").alias("added"), F.array_join(kept, ",").alias("kept"))


@query(f"{_GEO} SELECT source_id FROM geo WHERE lang NOT IN ('fr', 'es') OR geo_fit >= 0.9")
def geo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose own geographies do not conflict with the configured ones, or whose text names one."""
    score, category = scoring.text_ladder(F.col("geographies"), F.col("text"), SETTINGS.geographies)
    return _geo_items(spark, sf_dir).filter((category != "explicit_conflict") | (score >= fixed.GEO_CONFLICT)).select("source_id")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS story, l_suppkey AS src, l_orderkey % 7 AS topic FROM lineitem WHERE l_orderkey % 2 = 0), p AS (SELECT DISTINCT l_orderkey AS prior, l_suppkey AS src, l_orderkey % 7 AS topic FROM lineitem WHERE l_orderkey % 2 = 1),
ns AS (SELECT story, count(*) AS n FROM n GROUP BY 1), ps AS (SELECT prior, count(*) AS m FROM p GROUP BY 1), c AS (SELECT story, prior, count(*) AS c FROM n JOIN p USING (topic, src) GROUP BY 1, 2),
k AS MATERIALIZED (SELECT story, list(prior) AS priors, row_number() OVER (ORDER BY story) AS i FROM c JOIN ns USING (story) JOIN ps USING (prior) WHERE c / (n + m - c) >= 0.5 GROUP BY story),
turn AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS story, NULL::BIGINT AS prior
 UNION ALL SELECT k.i, CASE WHEN len(list_filter(priors, lambda x: NOT list_contains(taken, x))) = 1 THEN list_concat(taken, list_filter(priors, lambda x: NOT list_contains(taken, x))) ELSE taken END, k.story,
  CASE WHEN len(list_filter(priors, lambda x: NOT list_contains(taken, x))) = 1 THEN list_filter(priors, lambda x: NOT list_contains(taken, x))[1] END FROM turn JOIN k ON k.i = turn.i + 1)
SELECT story, prior FROM turn WHERE prior IS NOT NULL""")
def lineage_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which prior story each new one goes on with."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey story", "l_orderkey % 7 topic", "l_suppkey source_id")
    return stories.claim_lineage(stories.lineage_candidates(rows.filter("story % 2 = 0"), rows.filter("story % 2 = 1")))


@query(f"""{_SCORED}, z AS (SELECT *, {_word_sql(fixed.COMMODITY_TERMS)} AS goods, tf = 0 AND kf = 0 AND geo_fit < 0.7 AS nothing FROM y),
v AS (SELECT *, fit >= 0.35 AND fit < 0.45 AND NOT goods AND NOT nothing AND tf > 0 AND kf > 0 AND geo_fit >= 0.7 AS saved FROM z)
SELECT CASE WHEN fit >= 0.45 OR saved THEN NULL WHEN goods THEN 'commodity' WHEN nothing THEN 'no_signal' ELSE 'low_score' END AS exclude_reason, CASE WHEN saved THEN 'rescue_borderline_multisignal' END AS rescued_by, count(*) AS n FROM v GROUP BY ALL""")
def precision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the gate with its rescues."""
    return profile.included(profile.scored(_geo_items(spark, sf_dir), SETTINGS), threshold=0.45).groupBy("exclude_reason", "rescued_by").agg(F.count("*").alias("n"))
