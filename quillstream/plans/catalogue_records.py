"""Registered queries of semantic scores, grounded stories and what changed in them, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import upper_letters
from ..operators import changes, records, semantic, translation
from ..sources.store import VersionedTables
from ..streaming.feeds import shared_folder
from .catalogue import QUERIES, SQL, query, rounded, table

__all__ = ["QUERIES", "SQL"]

_VECTORS = r"""d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
it AS (SELECT doc_id, substr(array_to_string(list_filter([trim(l[1]), CASE WHEN doc_id % 2 = 0 THEN 'sub ' || doc_id % 9 END, trim(array_to_string(l[2:], ' '))], lambda x: x IS NOT NULL AND x <> ''), '. '), 1, 2000) AS t FROM d),
pr AS (SELECT 'r' || n_nationkey AS reader, CASE WHEN n_nationkey % 3 = 0 THEN 'Beat narrative: all of ' || n_name || ' ' ELSE '' END || 'I monitor news about ' || n_name || ', ' || lower(n_name) || '.' || CASE WHEN n_nationkey % 2 = 0 THEN ' Geographic focus: ' || n_name || '.' ELSE '' END AS t FROM nation),
h AS (SELECT doc_id, list_transform(range(32), lambda i: (CAST('0x' || substr(sha256(t), CAST(2 * i + 1 AS BIGINT), 2) AS INT) - 128) / 128.0) AS v FROM it WHERE t <> ''),
q AS (SELECT reader, list_transform(range(32), lambda i: (CAST('0x' || substr(sha256(t), CAST(2 * i + 1 AS BIGINT), 2) AS INT) - 128) / 128.0) AS v FROM pr),
s AS (SELECT reader, doc_id AS item, round((list_cosine_similarity(CAST(h.v AS DOUBLE[]), CAST(q.v AS DOUBLE[])) + 1) / 2, 9) AS score FROM h, q)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Documents and readers with vectors, and how many texts a second call had to embed."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), semantic.item_text(lines[0], F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("sub "), F.col("doc_id") % 9)), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).alias("t"))
    n = F.col("n_nationkey")
    own = semantic.intent_text(F.array(F.concat(F.lit(" "), "n_name"), F.lower("n_name"), F.lit("")), F.array().cast("array<string>"), F.when(n % 2 == 0, F.array("n_name")), F.when(n % 3 == 0, F.concat(F.lit("all of "), "n_name")))
    readers = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), n).alias("reader"), own.alias("t"))
    cache = VersionedTables(spark, shared_folder(spark, "vectors"), {semantic.VECTORS: ["key"]})
    rows, _ = semantic.embedded(cache, items, "t", scoring.mock_embedding, "mock")
    profiles, _ = semantic.embedded(cache, readers, "t", scoring.mock_embedding, "mock")
    _, again = semantic.embedded(cache, items, "t", scoring.mock_embedding, "mock")
    return rows, profiles, again


@query(f"WITH {_VECTORS}, k AS (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY score DESC, item) AS rank FROM s) SELECT reader, item, round(score, 6) AS score, rank, 0 AS embedded_again FROM k WHERE rank <= 10")
def semantic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each reader, by vectors of whole items kept by content."""
    rows, profiles, again = _vectors(spark, sf_dir)
    out = semantic.nearest(rows, profiles, 10)
    return out.select("reader", "item", rounded(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"), F.lit(again).alias("embedded_again"))


_CLAIMED = r"""d AS (SELECT doc_id AS id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS l FROM documents),
s AS (SELECT id, l, CASE id % 6 WHEN 1 THEN 'no_valid_source_ids' WHEN 2 THEN 'ungrounded_claims' WHEN 3 THEN 'partial_source_ids' END AS failure FROM d),
c AS (SELECT *, list_transform(list_filter(l, lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END) AS closed FROM s),
j AS (SELECT *, array_to_string(closed, ' ') AS t FROM c), h AS (SELECT *, regexp_replace(substr(t, 1, 500), '\s+$', '') AS head FROM j),
p AS (SELECT *, length(head) - length(regexp_extract(head, '(?s)\. ((?:[^.]|\.[^ ]|\.$)*)$', 1)) - 2 AS stop, length(head) - length(regexp_extract(head, '([^ ]*)$', 1)) - 1 AS blank FROM h)"""


@query(rf"""WITH {_CLAIMED} SELECT 's' || id AS story_id, failure, CASE WHEN failure = 'partial_source_ids' THEN '' || id WHEN failure = 'no_valid_source_ids' THEN 'x' || id ELSE id || CASE WHEN failure IS NULL THEN '' ELSE '' END END AS ids,
 CASE WHEN failure IS NULL THEN l[1] ELSE 'sub' END AS subtitle,
 CASE WHEN failure IS NOT NULL THEN 'old' WHEN len(closed) = 0 THEN 'old' WHEN length(t) <= 500 THEN t WHEN contains(head, '. ') AND stop >= 300 THEN substr(head, 1, stop + 1) WHEN blank > 0 THEN substr(head, 1, blank) || '…' ELSE head || '…' END AS summary FROM p""")
def grounded_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stories whose claims are their lines: sound ones, and such with unknown sources or claims without one."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "string(doc_id) id", "split(coalesce(text, ''), '\n') claims")
    kind = F.col("doc_id") % 6
    ghost = F.concat(F.lit("x"), "id")
    ids = F.when(kind == 1, F.array(ghost)).when(kind == 3, F.array("id", ghost)).otherwise(F.array("id"))
    last = F.size("claims") - 1
    evidence = F.map_from_entries(F.transform("claims", lambda _, i: F.struct(i.cast("string").alias("k"), F.when((kind == 2) & (i == last), F.array(ghost)).otherwise(F.array(ghost, F.col("id"))).alias("v"))))
    stories = rows.select(F.concat(F.lit("s"), "id").alias("story_id"), ids.alias("source_ids"), "claims", evidence.alias("evidence"), F.lit("sub").alias("subtitle"), F.lit("old").alias("summary"))
    out = records.grounded(stories, rows.selectExpr("id source_id"))
    return out.select("story_id", "failure", F.array_join("source_ids", ",").alias("ids"), "subtitle", "summary")


@query(r"""WITH d AS (SELECT doc_id AS id, trim(string_split(coalesce(text, ''), chr(10))[1]) AS h, CASE WHEN doc_id % 9 = 0 THEN '' ELSE source END AS o, lang FROM documents)
SELECT substr(sha256(id || '::' || lang), 1, 16) AS story_id, CASE WHEN h <> '' THEN h WHEN o <> '' THEN o || ' report' ELSE 'Source report' END AS title, CASE WHEN o <> '' THEN 'Reported by ' || o || '.' ELSE 'Single-source report.' END AS subtitle,
 CASE WHEN h <> '' AND o <> '' THEN o || ' reports: ' || h || '.' WHEN h <> '' THEN h || '.' WHEN o <> '' THEN o || ' report.' ELSE 'Source report.' END AS summary, CASE WHEN o = '' THEN lang ELSE lang || ',' || o END AS entities, id::VARCHAR AS ids FROM d""")
def single_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("string(doc_id) id", "split(coalesce(text, ''), '\n')[0] h", "if(doc_id % 9 = 0, '', source) o", "lang")
    none = F.array().cast("array<string>")
    s = records.single_story(F.col("id"), F.col("o"), F.col("h"), F.array("lang", F.lit(" ")), F.array("o"), none)
    return rows.select(s.alias("s")).select("s.story_id", "s.title", "s.subtitle", "s.summary", F.array_join("s.entities", ",").alias("entities"), F.array_join("s.source_ids", ",").alias("ids"))


@query(r"""WITH d AS (SELECT doc_id % 12 AS reader, doc_id, coalesce(string_split(text, chr(10))[1], '') AS h, source AS o, CASE WHEN doc_id % 8 = 0 THEN 'General' ELSE lang END AS topic FROM documents),
f AS (SELECT reader, topic, min(doc_id) AS first, row_number() OVER (PARTITION BY reader ORDER BY min(doc_id)) AS k FROM d GROUP BY reader, topic), r AS (SELECT d.*, first, row_number() OVER (PARTITION BY d.reader, d.topic ORDER BY doc_id) AS n FROM d JOIN f ON f.reader = d.reader AND f.topic = d.topic AND k <= 3)
SELECT reader, topic || ' Updates' AS title, substr(sha256(array_to_string(list_sort(ids), ',') || '::' || lower(topic)), 1, 16) AS story_id, topic || ' Updates. ' || array_to_string(hs[1:3], '; ') || '.' AS summary, array_to_string(cs, '|') AS claims
FROM (SELECT reader, topic, list(doc_id::VARCHAR) AS ids, list(h ORDER BY doc_id) AS hs, list(o || ' reports: ' || h ORDER BY doc_id) AS cs FROM r WHERE n <= 5 GROUP BY reader, topic)""")
def topic_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain stories of twelve readers, three topics each."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id % 12 reader", "doc_id seq", "string(doc_id) source_id", "source outlet", "coalesce(split(text, '\n')[0], '') headline", "if(doc_id % 8 = 0, if(doc_id % 16 = 0, '', null), lang) topic", "array(lang) geographies")
    out = records.topic_stories(rows, "reader", 5, 3)
    return out.select("reader", "title", "story_id", "summary", F.array_join("claims", "|").alias("claims"))


_DELTA = r"""d AS (SELECT doc_id // 4 AS story, doc_id, doc_id::VARCHAR AS id, coalesce(string_split(text, chr(10))[1], '') AS h, source AS o, coalesce(string_split(text, chr(10))[2:], []) AS b FROM documents),
n AS (SELECT * FROM d WHERE doc_id % 5 <> 1), w AS (SELECT story, doc_id, id, CASE WHEN doc_id % 7 = 0 THEN 'was ' || h ELSE h END AS h, o FROM d WHERE doc_id % 5 <> 2),
st AS (SELECT DISTINCT story FROM n WHERE story IN (SELECT story FROM w)),
a AS (SELECT n.story, n.doc_id, n.id, n.b FROM n JOIN st USING (story) WHERE NOT EXISTS (FROM w WHERE w.story = n.story AND w.id = n.id) AND NOT EXISTS (FROM w WHERE w.story = n.story AND w.o = n.o AND lower(trim(regexp_replace(w.h, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(n.h, '\s+', ' ', 'g'))) AND trim(n.h) <> '')),
x AS (SELECT w.story, w.doc_id, w.id FROM w JOIN st USING (story) WHERE NOT EXISTS (FROM n WHERE n.story = w.story AND n.id = w.id)),
c AS (SELECT n.story, n.doc_id, n.id, w.h AS was, n.h AS now FROM n JOIN w ON w.story = n.story AND w.id = n.id WHERE w.h <> n.h)
SELECT st.story, coalesce((SELECT array_to_string(list(id ORDER BY doc_id), ',') FROM a WHERE a.story = st.story), '') AS added, coalesce((SELECT array_to_string(list(id ORDER BY doc_id), ',') FROM x WHERE x.story = st.story), '') AS removed,
 coalesce((SELECT array_to_string(list(id || ': ' || was || ' > ' || now ORDER BY doc_id), '|') FROM c WHERE c.story = st.story), '') AS changed,
 coalesce((SELECT array_to_string(list(id || '=' || substr(trim(array_to_string(b, ' ')), 1, 400) ORDER BY id), '|') FROM a WHERE a.story = st.story AND trim(array_to_string(b, ' ')) <> ''), '') AS excerpts FROM st"""


@query("WITH " + _DELTA)
def delta_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came, went and was renamed in stories of four documents."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id div 4 story", "string(doc_id) id", "doc_id seq", "source outlet", "coalesce(split(text, '\n')[0], '') headline", "slice(split(coalesce(text, ''), '\n'), 2, 100000) body")
    current = rows.filter("seq % 5 != 1")
    prior = rows.filter("seq % 5 != 2").withColumn("headline", F.when(F.col("seq") % 7 == 0, F.concat(F.lit("was "), "headline")).otherwise(F.col("headline")))
    texts = [x.select("story").distinct().withColumns({c: F.lit("") for c in ("title", "subtitle", "summary")}) for x in (current, prior)]
    out = changes.delta_payload(changes.structural_gate(current, prior, *texts), current, prior, excerpts=True)
    pairs = F.array_sort(F.transform(F.map_entries("excerpts"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select(
        "story", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"),
        F.array_join(F.transform("headline_changes", lambda c: F.concat(c["id"], F.lit(": "), c["prior"], F.lit(" > "), c["current"])), "|").alias("changed"), F.array_join(pairs, "|").alias("excerpts"),
    )


@query(r"""WITH p AS (SELECT doc_id, lower(coalesce(text, '') || [' Reuters says so.', ' As the New York Times wrote', ' scaffolding, says AFP', ' (El País)', ''][doc_id % 5 + 1]) AS t, doc_id % 3 = 0 AS own FROM documents),
n(i, x) AS (VALUES (1, 'reuters'), (2, 'bloomberg'), (3, 'associated press'), (4, 'the associated press'), (5, 'afp'), (6, 'bbc'), (7, 'cnn'), (8, 'the new york times'), (9, 'new york times'), (10, 'nyt'), (11, 'the wall street journal'), (12, 'wall street journal'), (13, 'wsj'),
 (14, 'the washington post'), (15, 'washington post'), (16, 'the guardian'), (17, 'the financial times'), (18, 'financial times'), (19, 'ft'), (20, 'axios'), (21, 'politico'), (22, 'semafor'), (23, 'el tiempo'), (24, 'el espectador'), (25, 'el pais'), (26, 'el país'),
 (27, 'semana'), (28, 'infobae'), (29, 'noticias caracol'), (30, 'rcn')),
f AS (SELECT doc_id, i, x FROM p, n WHERE regexp_matches(t, '(^|[^a-z0-9_])' || x || '($|[^a-z0-9_])') AND NOT (own AND (contains('new york times', x) OR contains(x, 'new york times') OR x = 'reuters')))
SELECT doc_id, (SELECT arg_min(x, i) FROM f WHERE f.doc_id = p.doc_id) AS offending FROM p""")
def outlet_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first outlet that a text names without having it."""
    ends = F.array(*map(F.lit, (" Reuters says so.", " As the New York Times wrote", " scaffolding, says AFP", " (El País)", "")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.get(ends, (F.col("doc_id") % 5).cast("int"))).alias("t"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(" New  York Times"), F.lit("REUTERS"), F.lit(""))).alias("own"))
    return changes.named_outlets(rows, "t", "own").select("doc_id", "offending")


_TRANSLATED = r"""d AS (SELECT doc_id, trim(string_split(coalesce(text, ''), chr(10))[1]) AS h, list_filter(list_transform(string_split(coalesce(text, ''), chr(10))[2:], lambda x: trim(x)), lambda x: x <> '') AS b, lang FROM documents),
n AS (SELECT *, lang NOT LIKE 'en%' AS needed, length(h) AS a, length(coalesce(b[1], '')) AS c FROM d),
s AS (SELECT *, substr(h, 1, 700) AS s1, CASE WHEN len(b) >= 1 AND a < 700 THEN substr(b[1], 1, 700 - a) END AS s2, CASE WHEN len(b) >= 2 AND a + c < 700 THEN substr(b[2], 1, 700 - a - c) END AS s3 FROM n)"""


@query(rf"""WITH {_TRANSLATED} SELECT doc_id // 4 AS story, count(*) AS sources, count(*) FILTER (NOT needed OR lang <> 'de') AS covered, count(*) FILTER (needed) AS needed, count(*) FILTER (needed AND lang <> 'de') AS translated,
 round(count(*) FILTER (NOT needed OR lang <> 'de') / count(*), 6) AS coverage, count(*) FILTER (NOT needed OR lang <> 'de') / count(*) < 0.6 AS degraded, count(*) FILTER (needed AND lang <> 'de' AND doc_id % 2 = 0) AS cached,
 sha256(array_to_string(list(CASE WHEN needed AND lang <> 'de' THEN trim(upper(s1)) || '/' || array_to_string(CASE WHEN coalesce(trim(s2), '') || coalesce(trim(s3), '') <> '' THEN list_filter([trim(upper(s2)), trim(upper(s3))], lambda x: x <> '') ELSE b END, '/') ELSE h || '/' || array_to_string(b, '/') END ORDER BY doc_id), '|')) AS told FROM s GROUP BY 1""")
def translated_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in other languages, translated by a stand-in that cannot do German; those of even ids were done by an earlier run."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id div 4 story", "string(doc_id) source_id", "lang", "trim(split(coalesce(text, ''), '\n')[0]) headline", "filter(transform(slice(split(coalesce(text, ''), '\n'), 2, 100000), x -> trim(x)), x -> x != '') body")
    cache = VersionedTables(spark, shared_folder(spark, "translations"), {translation.TRANSLATIONS: ["key"]})
    shout = lambda segments, lang: F.when(lang != "de", F.transform(segments, upper_letters))
    translation.translated_items(cache, rows.filter("doc_id % 2 = 0"), shout)
    out = translation.translated_items(cache, rows, shout)
    said = F.concat(translation.english_headline(F.col("normalized_headline"), F.col("headline")), F.lit("/"), F.array_join(translation.english_body(F.col("normalized_body"), F.col("body")), "/"))
    told = out.groupBy("story").agg(F.array_sort(F.collect_list(F.struct("doc_id", said.alias("s")))).alias("s"), F.count_if("translation.from_cache").alias("cached"))
    told = told.select("story", "cached", F.sha2(F.array_join(F.transform("s", lambda x: x["s"]), "|"), 256).alias("told"))
    return translation.story_coverage(out).withColumn("coverage", rounded(F.col("coverage"))).join(told, "story")
