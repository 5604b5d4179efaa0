"""Tags of stories on all three axes, from what their evidence names; lists drawn from a reader's own words, and their hygiene."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, phrases, tags
from ..functions.phrases import named_phrases
from .reports import finalized, hygiene
from .selection import label

AXES = ("topics", "keywords", "geographies")


def evidence_text(title: Column, subtitle: Column, summary: Column, items: Column) -> Column:
    """What a story's evidence says: its lines, and headline, body and url of each item (structs), a line each."""
    own = F.transform(items, lambda x: F.concat_ws("\n", x["headline"], F.array_join(x["body"], " "), F.when(x["url"] != "", x["url"])))
    return F.concat_ws("\n", title, subtitle, summary, F.array_join(own, "\n"))


def _named(axis: str, value: Column) -> Column:
    """How a value of an axis is compared: topics by their standard label."""
    return F.lower(label(value, fixed.TOPIC_SYNONYMS)) if axis == "topics" else F.lower(F.trim(value))


def setting_terms(settings: DataFrame) -> DataFrame:
    """(reader, axis, label, phrase, kind) of settings (reader, axis, label): what names a label in a text, or as a value of an item.

    kind: ``text`` for the label itself and, of geographies, places in it by name or
    another spelling; ``value`` for what an item's own topic or geography may say.
    """
    rows = settings.select("reader", "axis", F.trim("label").alias("label")).filter("label != ''").distinct()
    low = F.lower("label")
    # country -> the spellings under which readers may have configured it
    spelt: dict[str, set[str]] = {}
    for own, others in fixed.GEO_SYNONYMS.items():
        for x in others:
            spelt.setdefault(x.strip().lower(), set()).add(own.lower())
    inside: dict[str, list[str]] = {}
    for place, country in fixed.GEO_ALIASES.items():
        for name in {country.lower(), *spelt.get(country.lower(), ())}:
            inside.setdefault(name, []).append(place)
    places = F.create_map(*(x for k, v in sorted(inside.items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))))
    none = F.array().cast("array<string>")
    text = F.concat(F.array(low), F.when(F.col("axis") == "geographies", F.coalesce(F.try_element_at(places, low), none)).otherwise(none))
    value = F.when(F.col("axis") == "topics", F.array_distinct(F.array(low, _named("topics", F.col("label"))))).when(F.col("axis") == "geographies", F.array(low)).otherwise(none)
    named = [F.transform(F.array_distinct(c), lambda p: F.struct(p.alias("phrase"), F.lit(k).alias("kind"))) for k, c in (("text", text), ("value", value))]  # noqa: B023
    return rows.select("reader", "axis", "label", F.inline(F.concat(*named)))


#: Bytes of one reader's evidence that are looked through at a time.
CHUNK_BYTES = 8 << 20


def story_tags(stories: DataFrame, settings: DataFrame) -> DataFrame:
    """(reader, story, topics, keywords, geographies): labels of the reader's settings that each of their stories bears out, one row a story.

    stories: reader, story, evidence (text), item_topics, item_geographies (arrays);
    settings: reader, axis, label. A label counts if the evidence names it as whole
    words, a geography also if it names a place in it, a topic or geography also if
    an item has it. Stories of a reader meet that reader's phrases only, in chunks of
    CHUNK_BYTES of evidence, so a text is read once however many readers there are;
    only of a reader with more than BLOCK_CHARS of phrases once for each such part.
    Tags are sorted, whatever their case.
    """
    terms = setting_terms(settings).filter("reader is not null")
    texts = stories.groupBy("reader").agg(F.sum(F.octet_length(F.coalesce("evidence", F.lit("")))).alias("_bytes"))
    sizes = terms.groupBy("reader").agg(F.sum(F.length("phrase")).alias("_chars")).join(texts, "reader", "right").select(
        "reader", F.greatest(F.ceil(F.col("_bytes") / CHUNK_BYTES), F.lit(1)).cast("int").alias("_chunks"), F.greatest(F.ceil(1.5 * F.coalesce("_chars", F.lit(0)) / phrases.BLOCK_CHARS), F.lit(1)).cast("int").alias("_parts")
    )
    given = {"topics": "item_topics", "geographies": "item_geographies"}
    has = [F.coalesce(F.flatten(F.transform(c, lambda x: F.array(F.lower(F.trim(x)), _named(a, x)))), F.array().cast("array<string>")).alias(c) for a, c in given.items()]  # noqa: B023
    # rows without a reader or story have no tags
    left = stories.select("reader", "story", F.when(F.col("reader").isNotNull() & F.col("story").isNotNull(), F.col("evidence")).alias("evidence"), *has).join(sizes, "reader", "left")
    left = left.select("reader", "story", "evidence", *given.values(), F.pmod(F.xxhash64("story"), F.coalesce("_chunks", F.lit(64))).cast("int").alias("_chunk"), F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
    right = terms.join(sizes, "reader").select("reader", "axis", "label", "phrase", "kind", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), F.pmod(F.xxhash64("phrase"), F.col("_parts")).cast("int").alias("_part"))
    out = T.StructType([stories.schema["reader"], stories.schema["story"], *(T.StructField(a, T.ArrayType(T.StringType())) for a in AXES)])
    by = ["reader", "_chunk", "_part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_borne_out, out)
    sets = [F.array_distinct(F.flatten(F.collect_list(a))).alias(a) for a in AXES]
    return found.groupBy("reader", "story").agg(*sets).select("reader", "story", *(_sorted(F.col(a)).alias(a) for a in AXES))


def _sorted(labels: Column) -> Column:
    """Labels by their lower-cased form, then as they are."""
    return F.transform(F.array_sort(F.transform(labels, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda x: x["v"])


def _borne_out(stories: pa.Table, terms: pa.Table) -> pa.Table:
    """Labels of the terms (of one reader) that the stories name or whose items have them, an array an axis."""
    said: dict[str, list] = {}
    valued: dict[tuple, list] = {}
    for axis, label_, phrase, kind in zip(*(terms[c].to_pylist() for c in ("axis", "label", "phrase", "kind")), strict=True):
        if kind == "text":
            said.setdefault(phrase, []).append((axis, label_))
        else:
            valued.setdefault((axis, phrase), []).append((axis, label_))
    find = phrases.phrase_finder(said)
    lists: dict[str, list] = {a: [] for a in AXES}
    for batch in stories.select(["story", "evidence", "item_topics", "item_geographies"]).to_batches(max_chunksize=1024):
        for story, text, topics, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own: dict[str, set] = {a: set() for a in AXES}
            hits = [h for p in (find(text.lower()) if text else ()) for h in said[p]]
            if story is not None:
                hits += [h for a, values in (("topics", topics), ("geographies", places)) for v in values for h in valued.get((a, v), ())]
            for axis, label_ in hits:
                if axis in own:
                    own[axis].add(label_)
            for a in AXES:
                lists[a].append(list(own[a]))
    kind = pa.list_(pa.string())
    return pa.table({"reader": stories["reader"], "story": stories["story"], **{a: pa.array(lists[a], kind) for a in AXES}})


def tag_fits(stories: DataFrame, settings) -> DataFrame:
    """The stories' other columns, and how well their tags and entities (arrays topics, keywords, geographies, entities) fit the settings: topic_fit, keyword_fit, geo_fit, on_beat, strength, entity_fit.

    Every axis is looked through once, for the words among its tags that the settings name; all fits go by these.
    """
    t, k, g, e = own = tuple(map(F.col, (*AXES, "entities")))
    others = [c for c in stories.columns if c not in {*AXES, "entities"}]
    bare = F.coalesce(F.size(e), F.lit(0)) <= 0
    terms = F.array(*map(F.lit, tags.terms_of(settings))).cast("array<string>")
    # columns of their own: items of an array would be worked out again wherever they are used
    tw, kw, gw, ew = map(F.col, names := [f"_{x}" for x in (*AXES, "entities")])
    # topics are looked through as words only where they stand in for entities
    named = [F.array_intersect(tags.words(F.when(bare, x) if x is t else x), terms) for x in own]
    rows = stories.select(*others, *own, *(x.alias(n) for n, x in zip(names, named, strict=True)))
    rows = rows.select(
        *others, tags.topic_fit(t, e, settings.topics, ew).alias("topic_fit"), tags.keyword_fit(k, e, settings.keywords, F.concat(kw, ew)).alias("keyword_fit"), tags.geo_fit(g, e, settings.geographies, F.concat(gw, ew)).alias("geo_fit"),
        tags.strength(t, k).alias("strength"), tags.entity_fit(t, k, g, e, settings, F.when(bare, F.concat(tw, kw, gw)).otherwise(ew)).alias("entity_fit"),
    )
    return rows.withColumn("on_beat", tags.beat_of(F.col("topic_fit"), F.col("keyword_fit"), settings))


def with_semantic_tags(tags: DataFrame, scores: DataFrame, threshold: float = fixed.SEMANTIC_TAG) -> DataFrame:
    """Tags with the topics and keywords that a scorer adds: scores (reader, story, axis, label, score) of ``threshold`` or more, of labels that are not there yet."""
    good = scores.filter((F.col("score") >= threshold) & F.col("axis").isin("topics", "keywords")).groupBy("reader", "story").agg(*(F.collect_set(F.when(F.col("axis") == a, F.col("label"))).alias(f"_{a}") for a in AXES[:2]))
    rows = tags.join(good, ["reader", "story"], "left")
    none = F.array().cast("array<string>")
    for a in AXES[:2]:
        both = F.array_union(a, F.coalesce(f"_{a}", none))
        rows = rows.withColumn(a, _sorted(both))
    return rows.select(*tags.columns)


def constrained_axis(values: Column, settings: Column, topics: bool = False) -> Column:
    """Values that the settings hold, once each in their own order, spelt as there; topics are compared by their standard label."""
    named = (lambda x: F.lower(label(x, fixed.TOPIC_SYNONYMS))) if topics else (lambda x: F.lower(F.trim(x)))
    known = F.transform(settings, named)
    at = F.filter(F.transform(values, lambda v: F.array_position(known, named(v))), lambda i: i > 0)
    return F.transform(F.array_distinct(at), lambda i: F.element_at(settings, i.cast("int")))


def backed_keywords(spark: SparkSession, text: Column, keywords: Sequence[str]) -> Column:
    """The configured keywords that a text names, in their order."""
    own = list(dict.fromkeys(k.strip() for k in keywords if k and k.strip()))
    named = named_phrases(spark, text, own)
    return F.array_compact(F.array(*(F.when(F.array_contains(named, k.lower()), F.lit(k)) for k in own)).cast("array<string>"))


def canonical_topic(c: Column) -> Column:
    """A topic by its standard label, three bare words by a fuller one."""
    own = label(c, fixed.TOPIC_SYNONYMS)
    table = F.create_map(*(F.lit(x) for pair in fixed.TOPIC_PROMOTIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(own)), own)


def _hinted(named: Column, rules: Sequence[tuple]) -> Column:
    """Values of the rules (value, any of these, none of these, and any of these) that the named phrases fulfil, in order."""

    def any_of(phrases: Sequence[str]) -> Column:
        return F.arrays_overlap(named, F.array(*map(F.lit, phrases)))

    out = []
    for value, some, *more in rules:
        holds = any_of(some)
        if more and more[0]:
            holds = holds & ~any_of(more[0])
        if len(more) > 1 and more[1]:
            holds = holds & any_of(more[1])
        out.append(F.when(holds, F.lit(value)))
    return F.array_compact(F.array(*out))


def _rule_phrases(*rules: Sequence[tuple]) -> list[str]:
    return sorted({p for group in rules for _, *lists in group for own in lists for p in own or ()})


def quiet_topics(topics: Column) -> Column:
    """Topics without known noise, and without a vague one beside the one that says more."""
    low = F.transform(topics, F.lower)
    noise = [F.lit(x) for x in fixed.NOISE_TOPICS]

    def stays(t: Column) -> Column:
        out = ~F.array_contains(F.array(*noise), F.lower(t))
        for vague, fuller in fixed.VAGUE_TOPICS.items():
            out = out & ~((F.lower(t) == vague) & F.arrays_overlap(low, F.array(*map(F.lit, fuller))))
        return out

    return F.filter(topics, stays)


def quiet_keywords(keywords: Column) -> Column:
    """Keywords without known noise and without several words of which one only qualifies."""
    qualifiers = F.array(*map(F.lit, fixed.QUALIFIERS))

    def stays(k: Column) -> Column:
        words = F.filter(F.split(F.lower(k), r"\s+"), lambda w: w != "")
        return ~F.lower(k).isin(*fixed.NOISE_KEYWORDS) & ~((F.size(words) > 1) & F.arrays_overlap(words, qualifiers))

    return F.filter(keywords, stays)


def extraction(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with clean lists topics, keywords, geographies, traditional, social in place of the drafts of these names.

    Each axis: usable values once each, by their standard names; topics and
    keywords also those that the text itself names; noise and qualified keywords,
    keywords that name a geography of the list, bulletins and WHO as outlets go;
    sorted, 24 at most. A null text names nothing.
    """
    spark = rows.sparkSession
    none = F.array().cast("array<string>")
    c = {a: F.coalesce(a, none) for a in ("topics", "keywords", "geographies", "traditional", "social")}
    phrases = [*_rule_phrases(fixed.KEYWORD_HINTS, fixed.TOPIC_HINTS), fixed.DIAN_HANDLE[1]]
    said = rows.withColumn("_named", F.coalesce(named_phrases(spark, F.col(text), phrases), none))
    handle = lambda h: F.col(text).rlike(f"(?i){h}(?![A-Za-z0-9_])")  # noqa: E731  whatever stands before the @
    handles = [F.when(handle(h), F.lit(v)) for h, v in fixed.HANDLE_HINTS.items()]
    handles.insert(1, F.when(handle(fixed.DIAN_HANDLE[0]) & F.array_contains("_named", fixed.DIAN_HANDLE[1]), F.lit(fixed.DIAN_HANDLE[2])))
    who = F.coalesce(F.col(text).rlike(r"(?i)(?:^|[^@])(?<![A-Za-z0-9_])who(?![A-Za-z0-9_])"), F.lit(False))
    # each step is a column of its own: the expressions of the next stay small
    said = said.withColumn("_geo", finalized(hygiene(c["geographies"])))
    said = said.withColumn("_topics", hygiene(F.concat(F.transform(hygiene(c["topics"]), canonical_topic), _hinted(F.col("_named"), fixed.TOPIC_HINTS))))
    keywords = F.concat(F.transform(hygiene(c["keywords"]), lambda k: label(k, fixed.KEYWORD_SYNONYMS)), _hinted(F.col("_named"), fixed.KEYWORD_HINTS), F.array_compact(F.array(*handles)))
    said = said.withColumn("_keywords", hygiene(keywords)).withColumn("_who", who)
    said = said.withColumn("_keywords", finalized(quiet_keywords(F.filter("_keywords", lambda k: F.col("_who") | (F.lower(k) != "who")))))
    outlets = hygiene(F.transform(hygiene(c["traditional"]), lambda x: label(x, fixed.OUTLET_ALIASES)))
    outlets = F.filter(outlets, lambda x: ~x.rlike(r"(?i)(?<![A-Za-z0-9_])bulletins?(?![A-Za-z0-9_])") & (F.lower(x) != "who"))
    new = {
        "topics": finalized(quiet_topics(F.col("_topics"))), "keywords": _without_places(F.col("_keywords"), F.col("_geo")), "geographies": F.col("_geo"),
        "traditional": finalized(outlets), "social": finalized(hygiene(c["social"], handles=True)),
    }
    return said.select(*(new.get(n, F.col(f"`{n}`")).alias(n) for n in rows.columns))


def _without_places(keywords: Column, geographies: Column) -> Column:
    """Keywords that name no geography of the list, no other spelling of it and no place in it."""
    low = F.transform(geographies, lambda g: F.lower(F.trim(g)))
    spelt = F.create_map(*(x for k, v in fixed.GEO_SYNONYMS.items() for x in (F.lit(k.lower()), F.array(*(F.lit(s.lower()) for s in v)))))
    none = F.array().cast("array<string>")
    wide = F.array_union(low, F.flatten(F.transform(low, lambda g: F.coalesce(F.try_element_at(spelt, g), none))))
    places = F.create_map(*(x for p, country in fixed.GEO_ALIASES.items() for x in (F.lit(p), F.lit(country.lower()))))
    return F.filter(keywords, lambda k: ~F.array_contains(wide, F.lower(F.trim(k))) & ~F.coalesce(F.array_contains(wide, F.try_element_at(places, F.lower(F.trim(k)))), F.lit(False)))


def drafted(text: Column) -> dict[str, Column]:
    """The draft of each list that a text gives by itself, without a model."""
    low = F.lower(text)
    have = lambda *words: F.reduce(F.array(*map(F.lit, words)), F.lit(False), lambda a, w: a | F.contains(low, w))
    listed = lambda pairs: F.array_compact(F.array(*(F.when(have(*w), F.lit(v)) for v, *w in pairs)))
    exact = lambda words: F.array_compact(F.array(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words)))
    return {
        "topics": listed(fixed.DRAFT_TOPICS), "keywords": exact(fixed.DRAFT_KEYWORDS), "geographies": listed(fixed.DRAFT_GEOGRAPHIES),
        "traditional": F.concat(exact(fixed.DRAFT_OUTLETS), listed(fixed.DRAFT_OUTLET_SPELLINGS)), "social": F.regexp_extract_all(text, F.lit(r"(@[A-Za-z0-9_]+)"), F.lit(1)),
    }
