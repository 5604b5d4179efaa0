"""Registered queries of tags and of lists drawn from texts, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tagging
from ..streaming.feeds import written
from .catalogue import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

_STORIES = r"""d AS (SELECT doc_id AS story, doc_id % 40 AS reader, coalesce(text, '') AS t, source, upper(lang) AS lang FROM documents),
sets AS (SELECT reader, 'topics' AS axis, regexp_extract(t, '[A-Za-z0-9_]+') AS label FROM d WHERE story % 3 = 0 UNION SELECT reader, 'keywords', regexp_extract(t, '[A-Za-z0-9_]+ [A-Za-z0-9_]+') FROM d WHERE story % 3 = 1
 UNION SELECT reader, 'geographies', regexp_extract(t, '[A-Za-z0-9_]+') FROM d WHERE story % 3 = 2 UNION SELECT reader, 'topics', source FROM d WHERE story % 9 = 0 UNION SELECT reader, 'geographies', lower(lang) FROM d WHERE story % 33 = 2)"""


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id story", "doc_id % 40 reader", "coalesce(text, '') evidence", "array(source) item_topics", "array(upper(lang)) item_geographies")


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, pairs of words, sources and languages of a reader's documents, as what the reader follows: they grow with the documents."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 40 reader", "coalesce(text, '') t", "source", "lang")
    one, two = (f"regexp_extract(t, '{p}', 0)" for p in ("[A-Za-z0-9_]+", "[A-Za-z0-9_]+ [A-Za-z0-9_]+"))
    parts = (("topics", one, "doc_id % 3 = 0"), ("keywords", two, "doc_id % 3 = 1"), ("geographies", one, "doc_id % 3 = 2"), ("topics", "source", "doc_id % 9 = 0"), ("geographies", "lang", "doc_id % 33 = 2"))
    own = (f"if({where}, named_struct('axis', '{axis}', 'label', {what}), null)" for axis, what, where in parts)
    return rows.selectExpr("reader", f"inline(array_compact(array({', '.join(own)})))")


_TAGS = rf"""{_STORIES}, n AS (SELECT story, reader, source, lang, ' ' || regexp_replace(lower(t), '[^a-z0-9_ ]', ' | ', 'g') || ' ' AS t FROM d),
hit AS (SELECT DISTINCT n.reader, story, axis, label FROM n JOIN sets ON sets.reader = n.reader
 WHERE label <> '' AND (contains(t, ' ' || lower(label) || ' ') OR axis = 'topics' AND lower(label) = lower(source) OR axis = 'geographies' AND lower(label) = lower(lang))),
g AS (SELECT reader, story, axis, array_to_string(list(label ORDER BY lower(label), label), '|') AS tags FROM hit GROUP BY ALL)"""


@query(rf"""WITH {_TAGS} SELECT reader, story, coalesce(max(tags) FILTER (axis = 'topics'), '') AS topics, coalesce(max(tags) FILTER (axis = 'keywords'), '') AS keywords,
 coalesce(max(tags) FILTER (axis = 'geographies'), '') AS geographies FROM d LEFT JOIN g USING (reader, story) GROUP BY ALL""")
def story_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tagging.story_tags(_stories(spark, sf_dir), _settings(spark, sf_dir))
    return out.select("reader", "story", *(F.array_join(a, "|").alias(a) for a in tagging.AXES))


@query(r"""WITH v AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w, doc_id % 2 = 0 AS own FROM documents),
s AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, own FROM v), k AS (SELECT * FROM (VALUES ('The', 1), ('QUE', 2), ('der', 3), ('la', 4), ('Tion', 5), ('And', 6)) k(label, p)),
f AS (SELECT doc_id, label, min(i) AS first FROM s JOIN k ON lower(x) = lower(label) GROUP BY ALL)
SELECT v.doc_id, coalesce((SELECT array_to_string(list(label ORDER BY first), ',') FROM f WHERE f.doc_id = v.doc_id), '') AS tags FROM v""")
def constrained_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))
    settings = F.array(*map(F.lit, ("The", "QUE", "der", "la", "Tion", "And")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tagging.constrained_axis(words, settings), ",").alias("tags"))


@query(rf"""WITH {_TAGS}, more AS (SELECT reader, story, 'topics' AS axis, 'lang ' || lower(lang) AS label FROM d WHERE len(t) % 100 >= 75 UNION SELECT reader, story, 'keywords', label FROM hit WHERE axis = 'topics' AND story % 5 > 0),
u AS (SELECT reader, story, axis, label FROM hit UNION SELECT * FROM more), a AS (SELECT reader, story, axis, array_to_string(list(label ORDER BY lower(label), label), '|') AS tags FROM u GROUP BY ALL)
SELECT reader, story, coalesce(max(tags) FILTER (axis = 'topics'), '') AS topics, coalesce(max(tags) FILTER (axis = 'keywords'), '') AS keywords FROM d LEFT JOIN a USING (reader, story) GROUP BY ALL""")
def semantic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with what scores add: a language where the text's length says so, and topics as keywords in four of five stories."""
    stories = _stories(spark, sf_dir)
    tags = written(tagging.story_tags(stories, _settings(spark, sf_dir)), "tags")  # read twice
    scores = stories.selectExpr("reader", "story", "'topics' axis", "concat('lang ', lower(item_geographies[0])) label", "(length(evidence) % 100) / 100 score")
    scores = scores.unionByName(tags.select("reader", "story", F.lit("keywords").alias("axis"), F.explode("topics").alias("label"), F.expr("if(story % 5 > 0, 0.9D, 0.7D)").alias("score")))
    out = tagging.with_semantic_tags(tags, scores)
    return out.select("reader", "story", *(F.array_join(a, "|").alias(a) for a in ("topics", "keywords")))


#: What readers may write about themselves, one sentence to every conversation's text.
_SAID = (
    "I follow sanctions and energy with OFAC, from Reuters and @icegov.", "La migración y las elecciones en Colombia; Semana, infobae colombia, @cbp", "Public health policy, vaccine rollout, the WHO bulletins",
    "customs policy via @DianColombia and trade across borders", "Only @WHO, nobody else who matters. Bilateral diplomacy, tariffs", "asylum and deportation, humanitarian aid, a health NGO in Bogotá; u.s. visas", "", "the outbreak: seguridad, organized crime; El Tiempo; @dash-handle and @",
)
_HINTS = r"""kw(o, v, p) AS (VALUES (1, 'OFAC', '\bofac\b'), (2, 'migration', '\bmigration\b'), (3, 'sanctions', '\bsanctions?\b'), (4, 'energy', '\benergy\b'), (5, 'border', '\bborder\b'), (6, 'security', '\bsecurity\b'), (7, 'health', '\bhealth\b'),
 (8, 'outbreak', '\boutbreaks?\b'), (9, 'vaccine', '\bvaccines?\b'), (10, 'customs', '\bcustoms?\b'), (11, 'DIAN', '\bdian\b'), (12, 'trade', '\btrade\b'), (13, 'asylum', '\basylum\b'), (14, 'deportation', '\bdeportation\b'), (15, 'ICE', '\bice\b'),
 (16, 'DHS', '\bdhs\b'), (17, 'diplomacy', '\bdiploma\w*\b'), (18, 'labor', '\blabor\b'), (19, 'manufacturing', '\bmanufacturing\b'), (20, 'tariffs', '\btariffs?\b'), (21, 'visa', '\bvisa\b'), (22, 'United Nations', '\b(united nations|unhcr)\b'),
 (23, 'organized crime', '\borganized crime\b'), (24, 'elections', '\belections?\b'), (25, 'public health', '\bpublic health\b'), (26, 'WHO', '\bwho\b'), (27, 'migration', '\bmigraci[oó]n\b|\bmigratori[oa]s?\b'), (28, 'ICE', '@icegov\b'), (30, 'border', '@cbp\b')),
tp(o, v, p, never, beside) AS (VALUES (1, 'Migration policy', '\bmigration\b', NULL, NULL), (2, 'Deportation policy', '\bdeportation\b', '\bhumanitarian\b', NULL), (3, 'Border policy', '\bborder\b|\b(cbp|dhs|ice)\b', NULL, NULL), (4, 'Border policy', '\basylum\b', NULL, NULL),
 (5, 'Security policy', '\bsecurity\b', NULL, NULL), (6, 'Public health', '\bpublic health\b', NULL, NULL), (7, 'Public health policy', '\bpublic health policy\b', NULL, NULL), (8, 'Public health policy', '\brollout\b', NULL, NULL), (9, 'Trade policy', '\btariffs?\b|\btrade\b', NULL, NULL),
 (10, 'Customs policy', '\bcustoms\b', NULL, NULL), (11, 'Energy policy', '\benergy\b', NULL, NULL), (12, 'Sanctions enforcement', '\bsanctions?\b', NULL, NULL), (13, 'Humanitarian aid', '\bhumanitarian\b', NULL, NULL), (14, 'Health policy', '\bhealth ngo\b', NULL, NULL),
 (15, 'Public health', '\bhealth ngo\b', NULL, NULL), (16, 'International health', '\boutbreak\b|\bvaccine\b', NULL, NULL), (17, 'International trade', '\btrade\b', NULL, '\bacross\b'), (18, 'Elections', '\belections?\b', NULL, NULL),
 (19, 'Migration policy', '\bmigraci[oó]n\b|\bmigratori[oa]s?\b', NULL, NULL), (20, 'Elections', '\belecciones\b', NULL, NULL), (21, 'Security', '\bseguridad\b', NULL, NULL))"""
_SAID_SQL = ", ".join(f"'{x}'" for x in _SAID)


@query(rf"""WITH {_HINTS}, c AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || [{_SAID_SQL}][(conv_id + turn) % 8 + 1] AS t FROM conversations),
dt AS (SELECT conv_id, turn, 0 AS o, unnest(list_filter([CASE WHEN contains(lower(t), 'diplomat') OR contains(lower(t), 'bilateral') THEN 'Diplomatic relations' END, CASE WHEN contains(lower(t), 'migrat') OR contains(lower(t), 'deportat') THEN 'Migration policy' END], lambda x: x IS NOT NULL)) AS v FROM c
 UNION ALL SELECT conv_id, turn, o, v FROM c JOIN tp ON regexp_matches(t, '(?i)' || p) AND (never IS NULL OR NOT regexp_matches(t, '(?i)' || never)) AND (beside IS NULL OR regexp_matches(t, '(?i)' || beside))),
tt AS (SELECT DISTINCT conv_id, turn, v FROM dt),
topics AS (SELECT conv_id, turn, array_to_string(list(v ORDER BY lower(v)), ',') AS v FROM tt x WHERE NOT (v = 'Sanctions enforcement' AND EXISTS (FROM tt y WHERE y.conv_id = x.conv_id AND y.turn = x.turn AND y.v IN ('Energy policy', 'Migration policy')))
 AND NOT (v = 'Public health' AND EXISTS (FROM tt y WHERE y.conv_id = x.conv_id AND y.turn = x.turn AND y.v = 'Public health policy')) GROUP BY ALL),
geo AS (SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN contains(lower(t), 'colombia') THEN 'Colombia' END, CASE WHEN contains(lower(t), 'united states') OR contains(lower(t), ' us ') OR contains(lower(t), ' u.s.') THEN 'US' END], lambda x: x IS NOT NULL), ',') AS v FROM c),
kk AS (SELECT DISTINCT conv_id, turn, v FROM (SELECT conv_id, turn, v FROM c JOIN kw ON regexp_matches(t, '(?i)' || p) UNION ALL SELECT conv_id, turn, v FROM c, unnest(['OFAC', 'sanctions', 'deportation']) u(v) WHERE contains(t, v)
  UNION ALL SELECT conv_id, turn, 'DIAN' FROM c WHERE regexp_matches(t, '(?i)@diancolombia\b') AND regexp_matches(t, '(?i)\bcustoms policy\b')) JOIN c USING (conv_id, turn) WHERE v <> 'WHO' OR regexp_matches(t, '(?i)(?:^|[^@])\bwho\b')),
keywords AS (SELECT conv_id, turn, array_to_string(list(v ORDER BY lower(v)), ',') AS v FROM kk GROUP BY ALL),
oo AS (SELECT DISTINCT conv_id, turn, v FROM (SELECT conv_id, turn, v FROM c, unnest(['Reuters', 'Washington Post', 'El Tiempo', 'El País', 'Semana', 'La Silla Vacía', 'Infobae']) u(v) WHERE contains(t, v)
  UNION ALL SELECT conv_id, turn, 'Infobae' FROM c WHERE contains(lower(t), 'infobae colombia') UNION ALL SELECT conv_id, turn, 'New York Times' FROM c WHERE contains(t, 'NYT') UNION ALL SELECT conv_id, turn, 'Semana' FROM c WHERE contains(lower(t), 'revista semana'))),
outlets AS (SELECT conv_id, turn, array_to_string(list(v ORDER BY lower(v)), ',') AS v FROM oo GROUP BY ALL),
hh AS (SELECT conv_id, turn, arg_min(h, i) AS h FROM (SELECT conv_id, turn, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(t, '@[A-Za-z0-9_]+') AS hs FROM c)) WHERE regexp_matches(h, '[A-Za-z0-9]') GROUP BY conv_id, turn, lower(h)),
social AS (SELECT conv_id, turn, array_to_string(list(h ORDER BY lower(h))[1:24], ',') AS v FROM hh GROUP BY ALL)
SELECT conv_id, turn, coalesce(topics.v, '') AS topics, coalesce(keywords.v, '') AS keywords, geo.v AS geographies, coalesce(outlets.v, '') AS traditional, coalesce(social.v, '') AS social
FROM c LEFT JOIN topics USING (conv_id, turn) LEFT JOIN keywords USING (conv_id, turn) LEFT JOIN geo USING (conv_id, turn) LEFT JOIN outlets USING (conv_id, turn) LEFT JOIN social USING (conv_id, turn)""")
def extracted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What conversations say of a reader's interests: drafts from the whole text, then their hygiene."""
    said = F.element_at(F.array(*map(F.lit, _SAID)), ((F.col("conv_id") + F.col("turn")) % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.coalesce("text", F.lit("")), said).alias("t"))
    rows = rows.select("*", *(c.alias(a) for a, c in tagging.drafted(F.col("t")).items()))
    return tagging.extraction(rows, "t").select("conv_id", "turn", *(F.array_join(a, ",").alias(a) for a in ("topics", "keywords", "geographies", "traditional", "social")))
