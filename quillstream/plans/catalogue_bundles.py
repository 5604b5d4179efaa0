"""Registered queries of stories that belong to one event, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import bundles
from .catalogue import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

#: What the invented texts have in place of themes and configured places.
THEME, PLACES = ("thea", "inea", "tion", "que", "der", "les", "ing", "los"), ("the", "la", "die")

_STOPS = ", ".join(f"'{w}'" for w in fixed.EVIDENCE_STOPWORDS)
_STORIES = r"""d AS (SELECT doc_id AS id, lang, source, list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l)) AS lines FROM documents),
s AS (SELECT id % 3 AS reader, id AS place, 's' || id AS story_id, id % 11 = 0 AS deferred, CASE WHEN id % 5 = 0 THEN ' ' ELSE lines[1] END AS title, lines[2] AS subtitle,
 CASE WHEN id % 2 = 0 THEN coalesce(lines[3], '') ELSE '' END AS summary, CASE WHEN id % 4 = 0 THEN [id::VARCHAR, (id + 1)::VARCHAR] ELSE [id::VARCHAR] END AS ids,
 [lines[1], coalesce(lines[2], '-')] AS claims, [[id::VARCHAR], [(id + 1)::VARCHAR]] AS evidence, [lang] AS topics, [source] AS keywords, CASE WHEN id % 2 = 0 THEN [] ELSE [lang] END AS geographies, [source, lang] AS entities FROM d)"""


def _stories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as stories of three readers, and as the items that the stories stand on."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id id", "lang", "source", "transform(split(coalesce(text, ''), '\n'), l -> trim(l)) lines")
    stories = rows.selectExpr(
        "id % 3 reader", "id place", "concat('s', id) story_id", "id % 11 = 0 deferred", "if(id % 5 = 0, ' ', lines[0]) title", "get(lines, 1) subtitle", "if(id % 2 = 0, coalesce(get(lines, 2), ''), '') summary",
        "if(id % 4 = 0, array(string(id), string(id + 1)), array(string(id))) source_ids", "array(lines[0], coalesce(get(lines, 1), '-')) claims", "map('0', array(string(id)), '1', array(string(id + 1))) evidence",
        "array(lang) topics", "array(source) keywords", "if(id % 2 = 0, array(), array(lang)) geographies", "array(source, lang) entities",
    )
    return stories, rows.selectExpr("string(id) source_id", "lines[0] headline", "slice(lines, 2, greatest(size(lines) - 1, 0)) body")


@query(rf"""WITH RECURSIVE {_STORIES},
tok AS (SELECT id, regexp_split_to_array(lower(lines[1]), '[^\p{{L}}\p{{N}}]+') AS head,
  regexp_split_to_array(lower(array_to_string(list_concat([lines[1]], list_filter(lines[2:], lambda l: l <> '')[1:2]), ' ')), '[^\p{{L}}\p{{N}}]+') AS words FROM d),
i AS (SELECT id::VARCHAR AS sid, list_has_any(words, ['thea', 'inea', 'tion', 'que', 'der', 'les', 'ing', 'los']) AS themed, list_has_any(words, ['the', 'la', 'die']) AS placed,
  list_distinct(list_filter(head, lambda t: length(t) >= 3 AND t NOT IN ({_STOPS}, 'the', 'la', 'die', 'thea', 'inea', 'tion', 'que', 'der', 'les', 'ing', 'los'))) AS own FROM tok),
f AS (SELECT reader, place, themed, placed, own FROM (SELECT reader, place, unnest(ids) AS sid FROM s WHERE NOT deferred) JOIN i USING (sid)),
w AS (SELECT DISTINCT reader, place, unnest(own) AS t FROM f JOIN (SELECT reader, place FROM f GROUP BY ALL HAVING bool_or(themed) AND bool_or(placed)) USING (reader, place)),
n AS (SELECT reader, place, count(*) AS n FROM w GROUP BY ALL),
e AS (SELECT c.reader, a, b FROM (SELECT x.reader, x.place AS a, y.place AS b, count(*) AS c FROM w x JOIN w y ON x.reader = y.reader AND x.t = y.t AND x.place < y.place GROUP BY ALL) c
  JOIN n p ON p.reader = c.reader AND p.place = a JOIN n q ON q.reader = c.reader AND q.place = b WHERE c >= 2 AND c >= 0.34 * (p.n + q.n - c) - 1e-9),
u AS (SELECT reader, a, b FROM e UNION SELECT reader, b, a FROM e),
reach AS (SELECT DISTINCT reader, a AS id, a AS r FROM u UNION SELECT reach.reader, reach.id, u.b FROM reach JOIN u ON u.reader = reach.reader AND u.a = reach.r),
root AS (SELECT reader, id AS place, min(r) AS root FROM reach GROUP BY ALL),
k AS (SELECT s.*, root, coalesce(root, s.place) AS grp FROM s LEFT JOIN root USING (reader, place)),
g AS (SELECT reader, grp, count(*) AS n_merged, list_distinct(flatten(list(ids ORDER BY place))) AS any_ids, flatten(list(ids ORDER BY place)) AS all_ids, arg_min(struct_pack(t := title, s := subtitle, y := summary), struct_pack(n := -len(ids), i := story_id)) AS p,
  array_to_string(list_sort(list_distinct(flatten(list(topics)))), ',') AS topics, array_to_string(list_sort(list_distinct(flatten(list(keywords)))), ',') AS keywords, array_to_string(list_sort(list_distinct(flatten(list(geographies)))), ',') AS geographies,
  array_to_string(list_sort(list_distinct(flatten(list(entities)))), ',') AS entities, first(lang_first) AS lang_first, any_value(root) AS root, any_value(story_id) AS own_id
  FROM (SELECT *, first_value(topics[1]) OVER (PARTITION BY reader, grp ORDER BY place) AS lang_first FROM k) GROUP BY ALL),
o AS (SELECT reader, grp, list_filter(all_ids, lambda x, j: list_position(all_ids, x) = j) AS ids FROM g),
c AS (SELECT k.reader, k.grp, k.root, place, j, k.claims[j] AS text, CASE WHEN k.root IS NULL THEN k.evidence[j] ELSE list_filter(k.evidence[j], lambda x: list_contains(o.ids, x)) END AS ev FROM k JOIN o ON o.reader = k.reader AND o.grp = k.grp, range(1, 3) r(j)),
m AS (SELECT reader, grp, list(text ORDER BY place, j) AS texts, array_to_string(list(j0 || '=' || array_to_string(ev, ',') ORDER BY place, j), ';') AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY reader, grp ORDER BY place, j) - 1 AS j0 FROM c WHERE len(ev) > 0) GROUP BY ALL)
SELECT g.reader, g.grp AS place, n_merged, CASE WHEN root IS NULL THEN own_id ELSE substr(sha256(array_to_string(list_sort(o.ids), ',') || '::' || lower(lang_first)), 1, 16) END AS story_id,
 CASE WHEN root IS NULL OR trim(p.t) <> '' THEN p.t ELSE o.ids[1] END AS title, CASE WHEN root IS NULL THEN p.s ELSE coalesce(p.s, '') END AS subtitle, CASE WHEN root IS NULL OR trim(p.y) <> '' THEN p.y ELSE array_to_string(texts, '. ') END AS summary,
 array_to_string(o.ids, ',') AS ids, len(texts) AS n_claims, evidence, topics, keywords, geographies, entities
FROM g JOIN o ON o.reader = g.reader AND o.grp = g.grp JOIN m ON m.reader = g.reader AND m.grp = g.grp""")
def event_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bundles.merge_bundles(*_stories(spark, sf_dir), "reader", PLACES, THEME)
    # The order of each merged list shows in the sources; tags are compared as sets.
    sets = [F.array_join(F.array_sort(F.array_distinct(a)), ",").alias(a) for a in (*bundles.AXES, "entities")]
    keys = F.array_sort(F.transform(F.map_keys("evidence"), lambda k: k.cast("int")))
    evidence = F.array_join(F.transform(keys, lambda k: F.concat(k.cast("string"), F.lit("="), F.array_join(F.try_element_at("evidence", k.cast("string")), ","))), ";")
    return out.select("reader", "place", "n_merged", "story_id", "title", "subtitle", "summary", F.array_join("source_ids", ",").alias("ids"), F.size("claims").cast("long").alias("n_claims"), evidence.alias("evidence"), *sets)
