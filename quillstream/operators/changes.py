"""What changed between two states of a story, and which state that is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.phrases import named_phrases as named_outlet_phrases
from ..functions.text import source_identity


def _sources(rows: DataFrame) -> DataFrame:
    """(story, id, seq, outlet, headline), normalised; sources without an id take no part."""
    norm = {c: source_identity(F.coalesce(c, F.lit(""))) for c in ("outlet", "headline")}
    return rows.filter("id is not null and id != ''").select("story", "id", "seq", *(c.alias(n) for n, c in norm.items()))


def structural_gate(current: DataFrame, prior: DataFrame, texts: DataFrame, prior_texts: DataFrame) -> DataFrame:
    """(story, signal, reasons) of the stories that both states have: none, weak or strong.

    Sources: story, id, seq, outlet, headline; texts: story, title, subtitle,
    summary. An added source, a new outlet and a changed headline are strong; a
    removed source and a changed text are weak. A new id whose outlet had the same
    headline before is a duplicate and counts for nothing.
    """
    now, was = _sources(current), _sources(prior)
    known = prior_texts.select("story").distinct()
    now = now.join(known, "story", "left_semi")
    was = was.join(texts.select("story").distinct(), "story", "left_semi")
    both = now.join(was.selectExpr("story", "id", "headline was", "seq was_seq", "true old"), ["story", "id"], "full_outer")
    heads = was.filter("outlet != '' and headline != ''").select("story", "outlet", "headline").distinct().withColumn("copy", F.lit(True))
    outlets = was.filter("outlet != ''").select("story", "outlet").distinct().withColumn("seen", F.lit(True))
    both = both.join(heads, ["story", "outlet", "headline"], "left").join(outlets, ["story", "outlet"], "left")
    added = both.filter("old is null and copy is null")
    first = F.row_number().over(Window.partitionBy("story", "outlet").orderBy("seq", "id"))
    fresh = added.filter("outlet != '' and seen is null").withColumn("_n", first).filter("_n = 1")

    def reason(rows: DataFrame, phase: int, seq: str, sub: int, name: Column, strong: bool) -> DataFrame:
        return rows.select("story", F.struct(F.lit(phase).alias("phase"), F.col(seq).cast("long").alias("seq"), F.lit(sub).alias("sub"), name.alias("reason")).alias("r"), F.lit(strong).alias("strong"))

    found = [
        reason(added, 0, "seq", 0, F.concat(F.lit("added_source:"), "id"), True), reason(fresh, 0, "seq", 1, F.concat(F.lit("new_outlet:"), "outlet"), True),
        reason(both.filter("old and seq is not null and headline != was"), 0, "seq", 0, F.concat(F.lit("headline_change:"), "id"), True),
        reason(both.filter("seq is null"), 1, "was_seq", 0, F.concat(F.lit("removed_source:"), "id"), False),
    ]
    parts = ("summary", "subtitle", "title")
    old = prior_texts.select("story", *(F.col(c).alias(f"was_{c}") for c in parts))
    diff = F.array_compact(F.array(*(F.when(source_identity(F.coalesce(c, F.lit(""))) != source_identity(F.coalesce(f"was_{c}", F.lit(""))), F.struct(F.lit(i).alias("i"), F.lit(f"{c}_change").alias("n"))) for i, c in enumerate(parts))))
    texts = texts.join(old, "story")
    changed = texts.select("story", F.explode(diff).alias("d")).select("story", F.col("d.i").alias("i"), F.col("d.n").alias("n"))
    found.append(reason(changed, 2, "i", 0, F.col("n"), False))
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    per_story = rows.groupBy("story").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["reason"]).alias("reasons"), F.bool_or("strong").alias("strong"))
    signal = F.when(F.col("strong").isNull(), "none").when(F.col("strong"), "strong").otherwise("weak")
    return texts.select("story").join(per_story, "story", "left").select("story", signal.alias("signal"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def delta_payload(gate: DataFrame, current: DataFrame, prior: DataFrame, excerpts: bool = False) -> DataFrame:
    """(story, signal, added, removed, headline_changes, prior_headlines, current_headlines, excerpts): what a writer is told of each story.

    gate: the result of ``structural_gate``; current, prior: story, id, seq, outlet,
    headline, body (lines). Ids come in the order of the gate's reasons; an excerpt
    of each added source's body, if asked for and if it has one.
    """
    def of(kind: str) -> Column:
        return F.transform(F.filter("reasons", lambda r: F.startswith(r, F.lit(kind))), lambda r: F.substr(r, F.lit(len(kind) + 1)))

    def told(rows: DataFrame, name: str, more: bool) -> DataFrame:
        head = F.coalesce("headline", F.lit(""))
        body = F.substring(F.trim(F.array_join(F.coalesce("body", F.array().cast("array<string>")), " ")), 1, fixed.EXCERPT_CHARS)
        own = F.struct("seq", "id", head.alias("head"), (body if more else F.lit("")).alias("body"))
        return rows.filter("id is not null and id != ''").groupBy("story").agg(F.array_sort(F.collect_list(own)).alias(name))

    rows = gate.join(told(current, "_now", excerpts), "story", "left").join(told(prior, "_was", False), "story", "left")
    none = F.array().cast("array<struct<seq: long, id: string, head: string, body: string>>")
    rows = rows.withColumns({n: F.coalesce(F.col(n).cast("array<struct<seq: long, id: string, head: string, body: string>>"), none) for n in ("_now", "_was")})
    heads = lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["id"], x["head"])))
    at = lambda c, i: F.coalesce(F.try_element_at(heads(c), i), F.lit(""))
    added = of("added_source:")
    shown = F.map_filter(F.map_from_entries(F.transform(F.filter("_now", lambda x: F.array_contains(added, x["id"])), lambda x: F.struct(x["id"], x["body"]))), lambda _, v: v != "")
    return rows.select(
        "story", "signal", added.alias("added"), of("removed_source:").alias("removed"),
        F.transform(of("headline_change:"), lambda i: F.struct(i.alias("id"), at("_was", i).alias("prior"), at("_now", i).alias("current"))).alias("headline_changes"),
        *(F.filter(F.transform(c, lambda x: x["head"]), lambda h: F.trim(h) != "").alias(n) for c, n in (("_was", "prior_headlines"), ("_now", "current_headlines"))), shown.alias("excerpts"),
    )


def named_outlets(rows: DataFrame, prose: str, outlets: str, known: Sequence[str] = fixed.KNOWN_OUTLETS) -> DataFrame:
    """Rows with ``offending``: the first known outlet that a written line names though none of the story's outlets (an array) is it, contains it or is contained in it; null where the line is sound."""
    said = rows.withColumn("_named", named_outlet_phrases(rows.sparkSession, F.col(prose), known)).withColumn("_own", F.filter(F.transform(F.coalesce(outlets, F.array().cast("array<string>")), source_identity), lambda o: o != ""))
    foreign = F.filter("_named", lambda t: ~F.exists("_own", lambda o: F.contains(o, t) | F.contains(t, o)))
    return said.withColumn("offending", F.get(foreign, F.lit(0))).drop("_named", "_own")


def change_state(stories: DataFrame, ever_seen: DataFrame, gate: DataFrame) -> DataFrame:
    """(story, state, signal): first-seen if never seen before, else unchanged; the gate's signal where there was a prior state."""
    seen = ever_seen.select("story").distinct().withColumn("_seen", F.lit(True))
    rows = stories.select("story").join(seen, "story", "left").join(gate.select("story", F.col("signal").alias("_signal")), "story", "left")
    return rows.select("story", F.when(F.col("_seen"), "unchanged").otherwise("first-seen").alias("state"), F.when(F.col("_seen"), F.coalesce("_signal", F.lit("none"))).otherwise("none").alias("signal"))


def ever_seen(prior: DataFrame, stories: DataFrame) -> DataFrame:
    """The stories seen so far and those of now, once each."""
    return prior.select("story").union(stories.select("story")).filter("story is not null").distinct()


def with_locked_titles(stories: DataFrame, locks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stories with the title first given to each, and the locks with those of new stories."""
    out = stories.join(locks.selectExpr("story", "title _locked"), "story", "left").withColumn("title", F.coalesce("_locked", "title")).drop("_locked")
    return out, locks.select("story", "title").unionByName(stories.join(locks, "story", "left_anti").select("story", "title"))
