"""A reader's settings and the refresh pipeline over items."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.phrases import named_phrases
from ..functions.scoring import beat_fit, density, fraction_mentioned, freshness, geo_ladder, mentioned_geo, relevance, rescue, semantic_rescue
from ..functions.text import all_forms, english_forms, family_key, mentions
from ..operators.dedupe import dedupe_items, richness
from ..operators.ranking import quota_top
from ..operators.stories import topic_clusters
from ..streaming.feeds import written


@dataclass(frozen=True)
class Settings:
    """What a reader follows."""

    topics: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    geographies: tuple[str, ...] = ()
    sources: tuple[str, ...] = field(default=())


def recent(items: DataFrame, minutes: int = fixed.TRAILING_MINUTES) -> DataFrame:
    """Items at most that old; unknown and non-numeric ages fail."""
    return items.filter((F.col("minutes_ago") <= minutes) & ~F.isnan("minutes_ago"))


def recall_flags(text: Column, settings: Settings) -> dict[str, Column]:
    """Which of topic, keyword and geography a text mentions; with nothing configured, all pass."""
    keyword = mentions(text, [f for k in settings.keywords for f in english_forms(k)])
    return {"by_topic": fraction_mentioned(text, settings.topics) > 0, "by_keyword": keyword, "by_geo": mentioned_geo(text, settings.geographies).isNotNull()}


def recalled(text: Column, settings: Settings) -> Column:
    """Does any recall flag hold? All terms in one look at the words."""
    if settings == Settings():
        return F.lit(True)
    wide = {x.lower() for g in settings.geographies for x in (g, *fixed.GEO_SYNONYMS.get(g, ()))}
    places = [p for p, country in fixed.GEO_ALIASES.items() if country.lower() in wide]
    forms = [f for t in settings.topics for f in all_forms(t)] + [f for k in settings.keywords for f in english_forms(k)]
    named = mentions(text, [*forms, *settings.geographies, *places])
    synonyms = [x for g in settings.geographies for x in fixed.GEO_SYNONYMS.get(g, ())]
    return named | mentioned_geo(text, settings.geographies).isNotNull() if synonyms else named


def _phrases(settings: Settings) -> dict[str, list[str]]:
    """All that texts are looked through for, lower-cased: forms of each topic and keyword, names of each geography, people, framing, theme."""

    def low(terms) -> list[str]:
        return list(dict.fromkeys(t.strip().lower() for t in terms if t and t.strip()))

    out = {f"topic {t}": low(all_forms(t)) for t in settings.topics if t.strip()} | {f"keyword {k}": low(all_forms(k)) for k in settings.keywords if k.strip()}
    out |= {f"english {k}": low(english_forms(k)) for k in settings.keywords if k.strip()}
    for g in settings.geographies:
        inside = [p for p, country in fixed.GEO_ALIASES.items() if country.lower() in {g.lower(), *(s.lower() for s in fixed.GEO_SYNONYMS.get(g, ()))}]
        # other spellings may go on: some end in a mark
        out[f"geo {g}"] = low([g, *inside, *(f"{s}*" for s in fixed.GEO_SYNONYMS.get(g, ()))])
    out["people"] = low(w for g in settings.geographies for w in fixed.DEMONYMS.get(g.strip().lower(), ()))
    out["commodity"] = low(fixed.COMMODITY_TERMS)
    out["election"] = low(w for c in fixed.ELECTION_CONCEPTS for forms in fixed.LEXICON[c] for w in forms)
    return out


def with_signals(items: DataFrame, settings: Settings) -> DataFrame:
    """Items (with ``text``) and what their texts say by themselves: recalled, family, fits, framing, theme.

    One automaton looks each text through for all phrases at once.
    """
    phrases = _phrases(settings)
    named = F.coalesce(named_phrases(items.sparkSession, F.col("text"), [p for own in phrases.values() for p in own]), F.array().cast("array<string>"))

    def has(*kinds: str) -> Column:
        own = [p for k in kinds for p in phrases[k]]
        return F.arrays_overlap("_named", F.array(*map(F.lit, own))) if own else F.lit(False)

    def share(kind: str) -> Column:
        own = [k for k in phrases if k.startswith(f"{kind} ")]
        return sum((has(k).cast("double") for k in own), F.lit(0.0)) / len(own) if own else F.lit(0.0)

    own = F.col("geographies") if "geographies" in items.columns else F.array().cast("array<string>")
    geos = [k for k in phrases if k.startswith("geo ")]
    placed = has(*geos)
    geo, category = geo_ladder(own, settings.geographies, placed, has("people"))
    wanted = has(*(k for k in phrases if k.startswith(("topic ", "english ", "geo ")))) if settings != Settings() else F.lit(True)
    return items.withColumn("_named", named).select(
        "*", wanted.alias("recalled"), family_key(F.col("headline")).alias("family"), share("topic").alias("topic_fit"), share("keyword").alias("keyword_fit"),
        geo.alias("geo_fit"), category.alias("geo_category"), has("commodity").alias("commodity"), has("election").alias("election"),
    ).drop("_named")


def with_scores(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows of ``with_signals`` and their family's size among them, precision score and pre-cluster score."""
    sizes = rows.filter("family != ''").groupBy("family").agg(F.count("*").alias("family_size"))
    rows = rows.join(sizes, "family", "left").withColumn("family_size", F.coalesce("family_size", F.lit(1)))
    fit = beat_fit(F.col("topic_fit") > 0, F.col("keyword_fit") > 0, F.col("geo_fit") >= fixed.ELECTION_GEO, F.col("commodity"), F.col("minutes_ago"))
    rows = rows.withColumn("beat_fit", fit).withColumn("corroboration", density(F.col("family_size")))
    boost = F.when(F.col("election") & F.lit(bool(settings.geographies)), F.when(F.col("geo_fit") >= fixed.ELECTION_GEO, fixed.ELECTION_BOOST).otherwise(-fixed.ELECTION_PENALTY)).otherwise(0.0)
    score = relevance(F.col("topic_fit"), F.col("keyword_fit"), F.col("geo_fit"), F.lit(0.0), F.col("corroboration"), F.col("beat_fit"), freshness(F.col("minutes_ago"))) + boost
    return rows.withColumn("score", score)


def scored(items: DataFrame, settings: Settings) -> DataFrame:
    """Items (with ``text``) and their family, fits and pre-cluster score."""
    return with_scores(with_signals(items, settings), settings)


def rank_order() -> list[Column]:
    return [F.col("score").desc(), F.col("corroboration").desc(), F.col("beat_fit").desc(), F.col("minutes_ago").asc(), F.col("source_id").asc()]


def included(rows: DataFrame, threshold: float = fixed.BEAT_THRESHOLD, semantic: str | None = None) -> DataFrame:
    """Scored rows with the verdict of the precision gate: exclude_reason, or null, and rescued_by, if a rescue let it pass.

    semantic: the column of a semantic score, where there is one.
    """
    signal = {"topic": F.col("topic_fit"), "keyword": F.col("keyword_fit"), "geo": F.when(F.col("geo_fit") >= fixed.ELECTION_GEO, F.col("geo_fit")).otherwise(0.0)}
    none = (F.col("topic_fit") == 0) & (F.col("keyword_fit") == 0) & (F.col("geo_fit") < fixed.ELECTION_GEO)
    penalty = F.col("commodity") | none
    by = F.when(rescue(F.col("beat_fit"), penalty=penalty, threshold=threshold, **signal)["rescued"], "rescue_borderline_multisignal")
    if semantic is not None:
        by = by.when(semantic_rescue(F.col("beat_fit"), F.col(semantic), signal["geo"], penalty, threshold)["rescued"], "rescue_semantic_geo")
    reason = F.when((F.col("beat_fit") >= threshold) | F.col("rescued_by").isNotNull(), None).when(F.col("commodity"), "commodity").when(none, "no_signal").otherwise("low_score")
    return rows.withColumn("rescued_by", by).withColumn("exclude_reason", reason)


def refresh(items: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    """The stages of one refresh, each a DataFrame: window, recall, gate (all that was recalled, judged), unique, top, clusters.

    Texts are read once: what they say is written in narrow rows (without text and
    body), and so are the verdicts and the winners of the dedupe, so that no stage
    works out an earlier one again.
    """
    age = (F.col("minutes_ago") <= fixed.TRAILING_MINUTES) & ~F.isnan("minutes_ago")
    flagged = items.withColumn("evidence", richness(F.col("body"), F.col("headline"), F.col("byline") if "byline" in items.columns else None))
    window = written(with_signals(flagged.filter(age), settings).drop("text", "body"), "signals")
    recall = window.filter("recalled")
    gated = written(included(with_scores(recall, settings)), "verdicts")
    unique = written(dedupe_items(gated.filter("exclude_reason is null")), "unique")
    top = quota_top(unique, rank_order())
    return {"window": window, "recall": recall, "gate": gated.filter("exclude_reason is null"), "unique": unique, "top": top, "clusters": topic_clusters(top, "outlet")}


def funnel(items: DataFrame, settings: Settings) -> DataFrame:
    """(place, stage, n): how many rows each stage of one refresh leaves."""
    stages = refresh(items, settings)
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(i).cast("long").alias("place"), F.lit(name).alias("stage"), "n") for i, (name, df) in enumerate(stages.items())]
    return reduce(DataFrame.unionByName, rows)
