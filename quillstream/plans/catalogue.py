"""Registered queries over the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..operators import dedupe, metrics, ranking, state, stories
from ..sources import items as src
from . import profile

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AS_OF = "timestamp'2024-01-31 00:00:00'"
SETTINGS = profile.Settings(topics=("tion", "que"), keywords=("thes", "elle", "heit", "para"), geographies=("der", "los"))

#: The items that the documents adapter gives, for SQL.
ITEMS = """items AS (SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS source_id, source AS feed_id, source AS outlet, lang,
 CASE WHEN doc_id % 5 = 0 THEN 'social' ELSE 'traditional' END AS kind, CAST(doc_id % 101 AS DOUBLE) AS weight, CAST(doc_id * 37 % 2000 AS DOUBLE) AS minutes_ago,
 string_split(text, chr(10))[1] AS headline, string_split(text, chr(10))[2:] AS body, text FROM documents)"""
HEAD = r"trim(regexp_replace(regexp_replace(lower(headline), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.documents_as_items(table(spark, sf_dir, "documents"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


@query(f"""WITH {ITEMS}, keyed AS (SELECT *, {HEAD} AS head FROM items WHERE minutes_ago <= 1440),
ranked AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN head = '' THEN source_id ELSE head END, head = ''
 ORDER BY 2 * coalesce(list_sum(list_transform(body, lambda x: length(x))), 0) + length(headline) DESC, minutes_ago, weight DESC, feed_id, source_id) AS r FROM keyed)
SELECT outlet, count(*) AS n_items, max(weight) AS max_weight, min(minutes_ago) AS min_minutes, CASE WHEN max(weight) >= 80 THEN 'top' ELSE 'standard' END AS priority
FROM ranked WHERE r = 1 GROUP BY outlet""")
def item_dedupe_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing window, cross-feed dedupe, then a roll-up by outlet."""
    unique = dedupe.dedupe_items(profile.recent(doc_items(spark, sf_dir)))
    out = stories.roll_up(unique, "outlet")
    return out.select("outlet", F.col("n_sources").alias("n_items"), "max_weight", "min_minutes", "priority")


_URL = r"""u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS rest FROM u),
q AS (SELECT page_id, scheme, lower(regexp_extract(rest, '^([^/?]*)', 1)) AS host, regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path,
 list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(string_split(x, '=')[1]), '^(utm_|wt_|mc_)')
 AND lower(string_split(x, '=')[1]) NOT IN ('fbclid','gclid','mc_cid','mc_eid','_ga','_gl','cmpid','ref','referer','referrer','spm','yclid')) AS params FROM p),
canon AS (SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host || CASE WHEN length(path) <= 1 OR regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END
 || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(list_transform(params, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&') ELSE '' END END AS url FROM q)"""


@query(f"WITH {_URL} SELECT page_id, url AS canonical FROM canon")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query(f"WITH {_URL} SELECT url AS canonical, count(*) AS n_pages, min(page_id) AS first_page FROM canon WHERE url IS NOT NULL GROUP BY url")
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"))
    return rows.filter("canonical is not null").groupBy("canonical").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


_ENTITY_SQL = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _n, _c in fixed.ENTITIES.items():
    if _n != "amp":
        _c_sql = _c.replace("'", "''")
        _ENTITY_SQL = f"regexp_replace({_ENTITY_SQL}, '&{_n};', '{_c_sql}', 'gi')"


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace({_ENTITY_SQL}, '&amp;', '&', 'gi'), '\s+', ' ', 'g')) AS plain FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html"), numeric=False).alias("plain"))


@query(f"WITH {ITEMS} SELECT source_id, {HEAD} AS head FROM items")
def headline_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_items(spark, sf_dir).select("source_id", text.normalized_headline(F.col("headline")).alias("head"))


_STOP = ", ".join(f"'{w}'" for w in fixed.FAMILY_STOPWORDS)
_FAMILY = rf"""fam AS (SELECT *, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(translate(lower(headline), '{text.ACCENTED}', '{text.PLAIN}'), '[^\p{{L}}\p{{N}}]+'),
 lambda t: (length(t) >= 3 OR t IN ('us','eu','uk','un','id','ai')) AND t NOT IN ({_STOP})))), ' ') AS family FROM items)"""


@query(f"""WITH {ITEMS}, {_FAMILY} SELECT source_id, family, CASE WHEN family = '' THEN 0.0 ELSE round((n - 1) / (n - 1 + 2.0), 6) END AS density
FROM (SELECT *, count(*) OVER (PARTITION BY family) AS n FROM fam)""")
def family_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_items(spark, sf_dir).select("source_id", text.family_key(F.col("headline")).alias("family"))
    sizes = rows.filter("family != ''").groupBy("family").agg(F.count("*").alias("n"))
    return rows.join(sizes, "family", "left").select("source_id", "family", rounded(scoring.density(F.coalesce("n", F.lit(1)))).alias("density"))


@query("SELECT page_id, substr(sha256('feed1::' || url), 1, 16) AS source_id, substr(sha256(array_to_string(list_sort([CAST(page_id AS VARCHAR), CAST(page_id + 1 AS VARCHAR)]), ',') || '::' || 'news'), 1, 16) AS story_id FROM pages")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.col("page_id").cast("string"), (F.col("page_id") + 1).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", src.entry_id(F.lit("feed1"), F.col("url")).alias("source_id"), text.story_id(ids, F.lit(" News ")).alias("story_id"))


@query(f"SELECT event_type, count(*) AS n FROM events WHERE date_diff('second', ts, {AS_OF}) // 60 <= 1440 GROUP BY event_type")
def window_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("minutes_ago", src.age_minutes(F.col("ts"), F.expr(AS_OF)))
    return profile.recent(rows).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_type, substr(sha256('{"ids":[' || array_to_string(list_transform(list_sort(list_distinct(list(CAST(user_id AS VARCHAR)))), lambda x: '"' || x || '"'), ',') || '],"count":' || CAST(count(DISTINCT user_id) AS VARCHAR)
 || ',"min":' || CAST(min(epoch_us(ts) // 3600000000) AS VARCHAR) || ',"max":' || CAST(max(epoch_us(ts) // 3600000000) AS VARCHAR) || ',"feedIds":["' || event_type || '"]}'), 1, 16) AS mark FROM events GROUP BY event_type""")
def set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    rows = events(spark, sf_dir).groupBy("event_type").agg(F.collect_set(F.col("user_id").cast("string")).alias("ids"), F.min(hour).alias("lo"), F.max(hour).alias("hi"))
    return rows.select("event_type", metrics.fingerprint(F.col("ids"), F.col("lo"), F.col("hi"), F.array("event_type"), F.size("ids").cast("long")).alias("mark"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_type, CAST(date_diff('second', ts, {AS_OF}) // 60 AS DOUBLE) AS m FROM events),
d AS (SELECT DISTINCT user_id, event_type, m FROM e), a AS (SELECT user_id, event_type, min(m) AS anchor FROM d GROUP BY ALL
 UNION ALL SELECT a.user_id, a.event_type, (SELECT min(d.m) FROM d WHERE d.user_id = a.user_id AND d.event_type = a.event_type AND d.m > a.anchor + 60) FROM a WHERE a.anchor IS NOT NULL)
SELECT e.user_id, e.event_type, x.anchor, count(*) AS n FROM e JOIN (SELECT *, lead(anchor) OVER (PARTITION BY user_id, event_type ORDER BY anchor) AS nxt FROM a WHERE anchor IS NOT NULL) x
 ON e.user_id = x.user_id AND e.event_type = x.event_type AND e.m >= x.anchor AND (x.nxt IS NULL OR e.m < x.nxt) GROUP BY ALL""")
def anchor_window_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("minutes_ago", src.age_minutes(F.col("ts"), F.expr(AS_OF)))
    split = dedupe.anchored_windows(rows, ["user_id", "event_type"], "minutes_ago", "event_id")
    return split.groupBy("user_id", "event_type", "anchor").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY minutes_ago, seq) AS k FROM items) SELECT source_id, feed_id, minutes_ago FROM r WHERE k <= 30 ORDER BY minutes_ago, seq LIMIT 200")
def feed_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.feed_caps(doc_items(spark, sf_dir)).select("source_id", "feed_id", "minutes_ago")


@query(f"""WITH {ITEMS}, s AS (SELECT * FROM items WHERE kind = 'social' ORDER BY weight DESC, minutes_ago, seq LIMIT 3),
f AS (SELECT * FROM items WHERE seq NOT IN (SELECT seq FROM s) ORDER BY weight DESC, minutes_ago, seq LIMIT 15 - (SELECT count(*) FROM s)),
u AS (SELECT * FROM s UNION ALL SELECT * FROM f) SELECT source_id, kind, row_number() OVER (ORDER BY weight DESC, minutes_ago, seq) AS rank FROM u""")
def quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("weight").desc(), F.col("minutes_ago").asc(), F.col("seq").asc()]
    return ranking.quota_top(doc_items(spark, sf_dir), order).select("source_id", "kind", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n, max(value) AS best, event_type <> 'view' AS beat FROM events GROUP BY ALL),
f AS (SELECT *, count(*) OVER w AS c, bool_or(beat) OVER w AS any_beat FROM s WINDOW w AS (PARTITION BY user_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY best DESC, event_type) AS k FROM f WHERE c <= 3 OR NOT any_beat OR beat)
SELECT user_id, event_type, n FROM r WHERE c <= 3 OR k <= 3""")
def overflow_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("best"))
    return ranking.overflow_cap(rows, ["user_id"], [F.col("best").desc(), F.col("event_type").asc()], F.col("event_type") != "view", cap=3).select("user_id", "event_type", "n")


def _word_sql(terms: tuple[str, ...]) -> str:
    return f"regexp_matches(text, '(?i)\\b(?:{'|'.join(terms)})\\b')"


_RECALL = f"WITH {ITEMS}, f AS (SELECT *, {_word_sql(SETTINGS.topics)} AS t, {_word_sql(SETTINGS.keywords)} AS k, {_word_sql(SETTINGS.geographies)} AS g FROM items)"


@query(f"{_RECALL} SELECT source_id FROM f WHERE t OR k OR g")
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_items(spark, sf_dir).filter(profile.recalled(F.col("text"), SETTINGS)).select("source_id")


@query(f"{_RECALL} SELECT CASE WHEN t AND k THEN 'both' WHEN t THEN 'topic_only' WHEN k THEN 'keyword_only' WHEN g THEN 'geo_only' ELSE 'neither' END AS class, count(*) AS n FROM f GROUP BY 1")
def recall_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = doc_items(spark, sf_dir).select(*(c.alias(n) for n, c in profile.recall_flags(F.col("text"), SETTINGS).items()))
    t, k, g = F.col("by_topic"), F.col("by_keyword"), F.col("by_geo")
    kind = F.when(t & k, "both").when(t, "topic_only").when(k, "keyword_only").when(g, "geo_only").otherwise("neither")
    return f.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


_GEO = f"{_RECALL}, geo AS (SELECT *, CASE WHEN lang = 'de' THEN 1.0 WHEN g THEN 0.9 WHEN lang IN ('fr', 'es') THEN 0.0 ELSE 0.5 END AS geo_fit FROM f)"


def _geo_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German items lie in a configured geography, French and Spanish ones elsewhere, English ones nowhere."""
    own = F.when(F.col("lang") == "de", F.array(F.lit("der"))).when(F.col("lang").isin("fr", "es"), F.array(F.lit("elsewhere"))).otherwise(F.array().cast("array<string>"))
    return doc_items(spark, sf_dir).withColumn("geographies", own)


@query(f"{_GEO} SELECT source_id, geo_fit FROM geo")
def geo_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, _ = scoring.text_ladder(F.col("geographies"), F.col("text"), SETTINGS.geographies)
    return _geo_items(spark, sf_dir).select("source_id", score.alias("geo_fit"))


_TERMS = ", ".join(f"'{t}'" for t in fixed.COMMODITY_TERMS)
_ELECTION = sorted({w for c in fixed.ELECTION_CONCEPTS for forms in fixed.LEXICON[c] for w in forms})
_SCORED = f"""{_GEO}, fam AS (SELECT *, count(*) OVER (PARTITION BY family) AS fn FROM (SELECT *, {_FAMILY[len("fam AS (SELECT *, "):-len(" FROM items)")]} FROM geo)),
x AS (SELECT *, CAST({_word_sql(("tion",))} AS DOUBLE) / 2 + CAST({_word_sql(("que",))} AS DOUBLE) / 2 AS tf,
 (CAST({_word_sql(("thes",))} AS DOUBLE) + CAST({_word_sql(("elle",))} AS DOUBLE) + CAST({_word_sql(("heit",))} AS DOUBLE) + CAST({_word_sql(("para",))} AS DOUBLE)) / 4 AS kf,
 CASE WHEN family = '' OR fn <= 1 THEN 0.0 ELSE (fn - 1) / (fn + 1.0) END AS dens FROM fam),
y AS (SELECT *, least(1.0, greatest(0.0, 0.3 * CAST(tf > 0 AS INT) + 0.25 * CAST(kf > 0 AS INT) + 0.2 * CAST(geo_fit >= 0.7 AS INT) + 0.1 * least(1.0, greatest(0.0, 1 - minutes_ago / 1440))
 - 0.15 * CAST({_word_sql(fixed.COMMODITY_TERMS)} AS INT) - CASE WHEN tf = 0 AND kf = 0 AND geo_fit < 0.7 THEN 0.2 ELSE 0 END)) AS fit FROM x)"""


@query(f"{_SCORED} SELECT source_id, round(fit, 6) AS beat_fit, CASE WHEN fit >= 0.2 THEN 'included' WHEN {_word_sql(fixed.COMMODITY_TERMS)} THEN 'commodity' WHEN tf = 0 AND kf = 0 AND geo_fit < 0.7 THEN 'no_signal' ELSE 'low_score' END AS verdict FROM y")
def beat_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.included(profile.scored(_geo_items(spark, sf_dir), SETTINGS))
    return rows.select("source_id", rounded(F.col("beat_fit")).alias("beat_fit"), F.coalesce("exclude_reason", F.lit("included")).alias("verdict"))


@query(f"{_SCORED} SELECT source_id, round(3 * tf + 3 * kf + geo_fit + 1.5 * dens + fit + 0.25 / (1 + minutes_ago / 720) + CASE WHEN {_word_sql(tuple(_ELECTION))} THEN CASE WHEN geo_fit >= 0.7 THEN 1.5 ELSE -0.75 END ELSE 0 END, 6) AS score FROM y")
def precluster_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.scored(_geo_items(spark, sf_dir), SETTINGS).select("source_id", rounded(F.col("score")).alias("score"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, avg(value) AS v, max(ts) AS last FROM events GROUP BY user_id), r AS (SELECT user_id, round(3 * least(1.0, v / 100) + 1.5 * least(n, 5) / 5.0 + 0.25 / (1 + (date_diff('second', last, timestamp'2024-01-31 00:00:00') // 60) / 720.0), 6) AS score FROM s)
SELECT user_id, score, row_number() OVER (ORDER BY score DESC, user_id) AS rank FROM r ORDER BY score DESC, user_id LIMIT 20""")
def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.max("ts").alias("last"))
    none = F.lit(0.0)
    score = scoring.relevance(F.col("v") / 100, none, none, none, scoring.corroboration(F.col("n")), none, scoring.freshness(src.age_minutes(F.col("last"), F.expr(AS_OF))))
    rows = s.select("user_id", rounded(score).alias("score"))
    return ranking.global_rank(rows, [F.col("score").desc(), F.col("user_id").asc()], 20).select("user_id", "score", F.col("rank").cast("long").alias("rank"))


_COS = "WITH p AS (SELECT embedding AS e0 FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e0 AS DOUBLE[])), 6) AS score FROM embeddings, p)"


def _cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    first = rows.filter("vec_id = 0").select(F.col("embedding").alias("profile"))  # one row
    return rows.crossJoin(F.broadcast(first)).select("vec_id", "label", rounded(scoring.cosine(F.col("embedding"), F.col("profile"))).alias("score"))


@query(f"{_COS} SELECT vec_id, score FROM c ORDER BY score DESC, vec_id LIMIT 80")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosines(spark, sf_dir).orderBy(F.col("score").desc(), "vec_id").limit(fixed.RECALL_TOP).select("vec_id", "score")


@query(f"{_COS}, pool AS (SELECT * FROM c ORDER BY vec_id LIMIT 250), t AS (SELECT * FROM pool ORDER BY score DESC, vec_id LIMIT 80) SELECT vec_id, 'keyword' AS via FROM c WHERE label = 3 UNION ALL SELECT vec_id, 'semantic' FROM t WHERE score >= 0.35 AND label <> 3")
def hybrid_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label 3 stands for keyword hits; near vectors join them from a floor on."""
    rows = _cosines(spark, sf_dir)
    pool = rows.orderBy("vec_id").limit(fixed.RECALL_POOL).orderBy(F.col("score").desc(), "vec_id").limit(fixed.RECALL_TOP)
    hits = rows.filter("label = 3").select("vec_id", F.lit("keyword").alias("via"))
    near = pool.filter(F.col("score") >= fixed.RECALL_FLOOR).join(hits.select("vec_id"), "vec_id", "left_anti")
    return hits.unionByName(near.select("vec_id", F.lit("semantic").alias("via")))


@query(r"""WITH t AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 3))) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS c FROM t a JOIN t b ON a.w = b.w AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT c.a, c.b, round(c.c / (x.n + y.n - c.c), 6) AS jaccard FROM c JOIN n x ON x.item_id = c.a JOIN n y ON y.item_id = c.b WHERE c.c / (x.n + y.n - c.c) >= 0.05""")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.filter(text.tokens(F.col("text")), lambda t: F.length(t) >= 3))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), words.alias("tokens"))
    return stories.token_pairs(rows, "tokens", 0.05).select("a", "b", rounded(F.col("jaccard")).alias("jaccard"))


_LINE = """n AS (SELECT DISTINCT l_orderkey AS story, l_suppkey AS src, l_orderkey % 7 AS topic FROM lineitem WHERE l_orderkey % 2 = 0), p AS (SELECT DISTINCT l_orderkey AS prior, l_suppkey AS src, l_orderkey % 7 AS topic FROM lineitem WHERE l_orderkey % 2 = 1)"""


@query(f"""WITH {_LINE}, ns AS (SELECT story, count(*) AS n FROM n GROUP BY 1), ps AS (SELECT prior, count(*) AS m FROM p GROUP BY 1), c AS (SELECT story, prior, count(*) AS c FROM n JOIN p USING (topic, src) GROUP BY 1, 2)
SELECT story, prior, round(c / (n + m - c), 6) AS jaccard FROM c JOIN ns USING (story) JOIN ps USING (prior) WHERE c / (n + m - c) >= 0.5""")
def lineage_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey story", "l_orderkey % 7 topic", "l_suppkey source_id")
    out = stories.lineage_candidates(rows.filter("story % 2 = 0"), rows.filter("story % 2 = 1"))
    return out.select("story", "prior", rounded(F.col("jaccard")).alias("jaccard"))


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority AS now FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'old' ELSE o_orderpriority END AS was FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added_source' WHEN a.o_orderkey IS NULL THEN 'removed_source' ELSE 'headline_change' END AS reason,
 CASE WHEN a.o_orderkey IS NULL THEN 'weak' ELSE 'strong' END AS strength FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR now <> was""")
def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority headline")
    prior = rows.filter("o_orderkey % 3 != 1").withColumn("headline", F.when(F.col("o_orderkey") % 10 == 1, "old").otherwise(F.col("headline")))
    return stories.structural_diff(rows.filter("o_orderkey % 3 != 0"), prior, ["o_orderkey"], "headline")


@query("""SELECT CAST(user_id AS VARCHAR) AS raw, event_type AS kind, CAST(min(ts) AS VARCHAR) AS first_seen, count(*) AS times_seen, array_to_string(list_sort(list_distinct(list(CAST(event_id % 20 AS VARCHAR))))[1:3], ',') AS users FROM events
WHERE ts >= timestamp'2024-01-20 00:00:00' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY user_id, event_type""")
def net_new_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr("user_id raw", "event_type kind", "event_id % 20 user", "ts")
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").selectExpr("c_custkey raw")
    out = state.net_new(rows, known, "raw", "kind", "user", "ts", F.expr("timestamp'2024-01-20 00:00:00'"))
    return out.select(F.col("raw").cast("string").alias("raw"), "kind", F.col("first_seen").cast("string").alias("first_seen"), "times_seen", "users")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_current FROM events")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_per_key(events(spark, sf_dir), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "is_current")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type")
    return state.upsert(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["user_id"], "event_id")


@query("SELECT event_id, 'now' AS via FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'held' FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0")
def hold_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = events(spark, sf_dir).select("event_id")
    now = ids.filter("event_id % 3 = 0").withColumn("via", F.lit("now"))
    return state.carried_over(now, ids.filter("event_id % 2 = 0").withColumn("via", F.lit("held")), "event_id")


@query("SELECT n_name, count(*) AS n_suppliers FROM supplier JOIN nation ON contains(lower(s_name) || ' ' || s_nationkey, CAST(n_nationkey AS VARCHAR)) GROUP BY 1")
def theta_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substring join against a fixed table of 25 rows."""
    nations = F.broadcast(table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("string").alias("needle")))
    rows = table(spark, sf_dir, "supplier").select(F.concat_ws(" ", F.lower("s_name"), "s_nationkey").alias("name"))
    return rows.join(nations, F.contains("name", "needle")).groupBy("n_name").agg(F.count("*").alias("n_suppliers"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS story, l_linenumber AS claim, l_partkey AS source_id FROM lineitem), s AS (SELECT c.*, p.p_partkey IS NOT NULL AS ok FROM c LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0) p ON p.p_partkey = c.source_id),
k AS (SELECT story, claim, count(*) AS n, sum(CAST(ok AS INT)) AS ok FROM s GROUP BY 1, 2), t AS (SELECT story, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ok) AS BIGINT) AS ok, min(ok) AS least FROM k GROUP BY 1)
SELECT story, n AS n_evidence, ok AS n_known, CASE WHEN ok = 0 THEN 'no_valid_source_ids' WHEN least = 0 THEN 'ungrounded_claims' WHEN ok < n THEN 'partial_source_ids' ELSE 'grounded' END AS verdict FROM t""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey story", "l_linenumber claim", "l_partkey source_id")
    parts = rows.count() // stories.TASK_ROWS + 1
    claims = rows.repartition(parts, "story").distinct()
    return stories.grounding(claims, table(spark, sf_dir, "part").filter("p_partkey % 4 != 0").selectExpr("p_partkey source_id"), parts)


@query(f"""WITH {ITEMS}, f AS (SELECT lang, min(seq) AS first_seq, count(*) AS n_items FROM items GROUP BY lang ORDER BY first_seq, lang LIMIT 5), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY seq) AS k FROM items)
SELECT f.lang, f.first_seq, f.n_items, array_to_string(list(r.source_id ORDER BY r.seq), ',') AS source_ids FROM f JOIN r ON r.lang = f.lang AND r.k <= 5 GROUP BY 1, 2, 3""")
def topic_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories.topic_clusters(doc_items(spark, sf_dir), "lang")


@query(f"""WITH {ITEMS} SELECT source_id, array_to_string(list_sort(list_filter(['thes', 'elle', 'heit', 'para'], lambda x: regexp_matches(text, '(?i)\\b' || x || '\\b'))), ',') AS tags FROM items""")
def tag_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(text.mentions(F.col("text"), [k], F.col("words")), F.lit(k)) for k in SETTINGS.keywords)))
    return doc_items(spark, sf_dir).select("source_id", "text", text.words_of(F.col("text")).alias("words")).select("source_id", F.array_join(F.array_sort(found), ",").alias("tags"))


@query("""WITH c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn FROM (SELECT toxic = 1 AS p, quality = 0 AS a FROM labels)),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS r FROM c) SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""")
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.confusion(table(spark, sf_dir, "labels").selectExpr("toxic = 1 p", "quality = 0 a"), "p", "a")
    return out.select("tp", "fp", "fn", *(rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(median(value), 6) AS median FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "percentile_disc({}) within group (order by value)"
    return events(spark, sf_dir).groupBy("event_type").agg(F.expr(p.format(0.5)).alias("p50"), F.expr(p.format(0.95)).alias("p95"), rounded(F.median("value")).alias("median"))


@query("SELECT event_id, user_id, round(avg(CAST(event_type = 'error' AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS error_rate FROM events")
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = metrics.rolling_rate(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return events(spark, sf_dir).select("event_id", "user_id", rounded(rate).alias("error_rate"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('click', 'view')),
m AS (SELECT median(value) FILTER (event_type = 'click') AS c, median(value) FILTER (event_type = 'view') AS l FROM r WHERE k <= 5) SELECT round(c, 6) AS cache_median, round(l, 6) AS live_median, round((l - c) / l, 6) AS gain, (l - c) / l >= 0.2 AS met FROM m""")
def cache_benefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = ranking.top_per_key(events(spark, sf_dir).filter("event_type in ('click', 'view')"), ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 5)
    m = last.agg(F.median(F.when(F.col("event_type") == "click", F.col("value"))).alias("c"), F.median(F.when(F.col("event_type") == "view", F.col("value"))).alias("l"))
    gain = (F.col("l") - F.col("c")) / F.col("l")
    return m.select(rounded(F.col("c")).alias("cache_median"), rounded(F.col("l")).alias("live_median"), rounded(gain).alias("gain"), (gain >= 0.2).alias("met"))


@query("""WITH s AS (SELECT 1 AS i, 'view' AS stage, count(*) FILTER (event_type = 'view') AS n FROM events UNION ALL SELECT 2, 'click', count(*) FILTER (event_type = 'click') FROM events UNION ALL SELECT 3, 'signup', count(*) FILTER (event_type = 'signup') FROM events UNION ALL SELECT 4, 'purchase', count(*) FILTER (event_type = 'purchase') FROM events),
d AS (SELECT *, lag(n) OVER (ORDER BY i) - n AS dropped FROM s) SELECT stage, dropped FROM d WHERE dropped IS NOT NULL ORDER BY dropped DESC, i LIMIT 1""")
def funnel_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("view", "click", "signup", "purchase")
    counts = events(spark, sf_dir).agg(*(F.count_if(F.col("event_type") == s).alias(s) for s in names))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("stage"), F.col(s).alias("n")) for i, s in enumerate(names)))).alias("r")).select("r.*")
    return metrics.greatest_drop(rows, "stage", "i", "n")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, least(1.0, greatest(0.0, CAST(json_extract(props, '$.k') AS DOUBLE) / 10)) AS confidence FROM events")
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k double")["k"]
    return events(spark, sf_dir).select("event_id", k.cast("long").alias("k"), scoring.clamped(k / 10).alias("confidence"))


@query("SELECT source, round(avg(CAST(lang = 'en' AS DOUBLE)), 6) AS coverage, avg(CAST(lang = 'en' AS DOUBLE)) < 0.6 AS degraded FROM documents GROUP BY source")
def translation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg((F.col("lang") == "en").cast("double"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(rounded(share).alias("coverage"), (share < 0.6).alias("degraded"))


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1 AND ts + INTERVAL 708 HOUR > {AS_OF}")
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter("_n = 1")
    return state.unexpired(rows.withColumn("expires_at", F.expr("ts + interval 708 hours")), F.expr(AS_OF)).select("user_id", "event_id")


@query("SELECT p_partkey, p_brand, p_type IN (SELECT p_type FROM part WHERE p_partkey % 5 = 0) AS active FROM part")
def deactivation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return state.deactivated(rows.withColumn("active", F.lit(True)), rows.filter("p_partkey % 5 = 0").select("p_type"), "p_type").select("p_partkey", "p_brand", "active")


@query("SELECT c_custkey, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(m AS VARCHAR) || 'm ago' WHEN m < 1440 THEN CAST(m // 60 AS VARCHAR) || 'h' || CASE WHEN m % 60 > 0 THEN ' ' || CAST(m % 60 AS VARCHAR) || 'm' ELSE '' END || ' ago' ELSE CAST(m // 1440 AS VARCHAR) || 'd ago' END AS ago FROM (SELECT c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) AS m FROM customer)")
def time_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.time_ago(F.abs("c_acctbal")).alias("ago"))


@query("SELECT n_nationkey, regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM nation")
def slug_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", text.slug(F.col("n_name")).alias("slug"))


@query("SELECT user_id, max(ts) IS NULL OR date_diff('second', max(ts), timestamp'2024-01-30 12:00:00') >= 3600 AS due FROM events GROUP BY user_id")
def due_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("anchor"))
    age = F.unix_timestamp(F.expr("timestamp'2024-01-30 12:00:00'")) - F.unix_timestamp("anchor")
    return last.select("user_id", (F.col("anchor").isNull() | (age >= 3600)).alias("due"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'error') WHERE k <= 20")
def rejection_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).filter("event_type = 'error'")
    return ranking.top_per_key(rows, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 20).select("user_id", "event_id", "event_type")


@query("SELECT least(4, greatest(0, CAST(floor(value / 40) AS INT))) AS bin, count(*) AS n FROM events GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bin_ = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.col("value") / 40).cast("int")))
    return events(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT source_id, len(regexp_extract_all(text, '[^.!?]+[.!?]+')) + CAST(trim(regexp_extract(text, '([^.!?]*)$', 1)) <> '' AS INT) AS sentences FROM items")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_items(spark, sf_dir).select("source_id", text.sentence_count(F.col("text")).alias("sentences"))


@query("""WITH s AS (SELECT user_id, (quantile_disc(m, 0.5) FILTER (k = n // 2 + 1)) AS mid, min(m) AS lo, any_value(n) AS n, count(DISTINCT event_type) AS outlets FROM (SELECT user_id, event_type, m, row_number() OVER (PARTITION BY user_id ORDER BY m) AS k, count(*) OVER (PARTITION BY user_id) AS n
 FROM (SELECT user_id, event_type, floor(value * 10) AS m FROM events)) GROUP BY user_id), a AS (SELECT *, floor(floor(greatest(0, 100 * (1 - least(1, lo / 360))) + 0.5) * 0.55 + least(100, n * 7) * 0.45 + 0.5) AS activity, least(100, outlets * 18 + n * 6) AS score FROM s)
SELECT user_id, CAST(mid AS BIGINT) AS median_minutes, CAST(lo AS BIGINT) AS freshest_minutes, CAST(activity AS BIGINT) AS activity, CASE WHEN activity >= 70 THEN 'rising' WHEN activity >= 45 THEN 'steady' ELSE 'falling' END AS trend, outlets,
 CASE WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'early' END AS confidence FROM a""")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr("user_id story", "event_type outlet", "floor(value * 10) minutes_ago")
    return stories.signals(rows).withColumnRenamed("story", "user_id")


@query("SELECT item_id, array_to_string(list_transform(range(32), lambda i: CAST(CAST('0x' || substr(sha256(text), CAST(2 * i + 1 AS BIGINT), 2) AS INT) - 128 AS VARCHAR)), ',') AS vector FROM benchmark")
def mock_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(scoring.mock_embedding(F.col("text")), lambda x: (x * 128).cast("int").cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(whole, ",").alias("vector"))


_JUDGED = _SCORED.replace(" FROM geo)),", " FROM geo WHERE minutes_ago <= 1440 AND (t OR k OR g))),")
_NONE = "(tf = 0 AND kf = 0 AND geo_fit < 0.7)"


@query(f"""{_JUDGED}, j AS (SELECT *, fit >= 0.2 OR (fit >= 0.15 AND NOT {_word_sql(fixed.COMMODITY_TERMS)} AND NOT {_NONE} AND tf > 0 AND kf > 0 AND geo_fit >= 0.7) AS ok,
 3 * tf + 3 * kf + geo_fit + 1.5 * dens + fit + 0.25 / (1 + minutes_ago / 720) + CASE WHEN {_word_sql(tuple(_ELECTION))} THEN CASE WHEN geo_fit >= 0.7 THEN 1.5 ELSE -0.75 END ELSE 0 END AS score FROM y),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN {HEAD} = '' THEN 'alone ' || source_id ELSE 'head ' || {HEAD} END
  ORDER BY 2 * list_sum(list_transform(body, lambda x: length(x))) + length(headline) DESC, minutes_ago, weight DESC, feed_id, source_id) AS place FROM j WHERE ok) WHERE place = 1),
s AS (SELECT * FROM u WHERE kind = 'social' ORDER BY score DESC, dens DESC, fit DESC, minutes_ago, source_id LIMIT 3),
r AS (SELECT * FROM u WHERE seq NOT IN (SELECT seq FROM s) ORDER BY score DESC, dens DESC, fit DESC, minutes_ago, source_id LIMIT 15 - (SELECT count(*) FROM s)),
top AS (SELECT * FROM s UNION ALL SELECT * FROM r)
SELECT 0 AS place, 'window' AS stage, count(*) AS n FROM items WHERE minutes_ago <= 1440 UNION ALL SELECT 1, 'recall', count(*) FROM y UNION ALL SELECT 2, 'gate', count(*) FROM j WHERE ok UNION ALL SELECT 3, 'unique', count(*) FROM u
UNION ALL SELECT 4, 'top', count(*) FROM top UNION ALL SELECT 5, 'clusters', least(5, count(DISTINCT outlet)) FROM top""")
def refresh_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each stage of a refresh leaves."""
    return profile.funnel(_geo_items(spark, sf_dir), SETTINGS)
