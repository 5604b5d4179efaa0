"""Roll-ups of runs, evaluations and funnels; joins of items with what is known of them; registry reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# The states of a tag scorer from best to worst, the order of a source's statuses, the bounds of a release.
RUNTIME_STATES = ("disabled", "enabled_no_scorer", "enabled_scorer_ready", "scorer_error_fallback", "scorer_timeout_fallback")
STATUS_ORDER = ("verified", "mapped", "pending", "rejected")
GROUP_A_PASS, OVERALL_PASS, HARD_FAIL, FALLBACK, DUPLICATION = 1.0, 0.9, 0.02, 0.1, 0.05
ITEM_LENGTH, LIST_SIZE = 64, 24


def _n(condition: str) -> Column:
    return F.count_if(F.coalesce(F.expr(condition), F.lit(False)))


def _sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def change_totals(results: DataFrame, by: list[str]) -> DataFrame:
    """Per key: stories by state (unknown: unchanged) and signal (unknown: none), calls, verdicts, failures and time of the change writer."""
    return results.groupBy(*by).agg(
        _n("state = 'first-seen'").alias("first_seen"), _n("state = 'changed'").alias("changed"), (F.count("*") - _n("state in ('first-seen', 'changed')")).alias("unchanged"),
        _n("signal = 'strong'").alias("strong"), _n("signal = 'weak'").alias("weak"), (F.count("*") - _n("signal in ('strong', 'weak')")).alias("no_signal"),
        _n("called").alias("called"), _n("called and material").alias("material"), _n("called and not material").alias("immaterial"),
        _n("failed").alias("failed"), _sum("latency_ms").alias("latency_ms"),
    )


def reason_totals(results: DataFrame, by: list[str]) -> DataFrame:
    """Per key: stories tried, those that fell back, else were rewritten, else passed at once, and those of low confidence."""
    f, r, w = ("coalesce(fallback, false)", "coalesce(rewrite_ok, false)", "coalesce(writer_ok, false)")
    return results.groupBy(*by).agg(
        F.count("*").alias("attempted"), _n(f).alias("fallback"), _n(f"not {f} and {r}").alias("rewritten"),
        _n(f"not {f} and ({r} or {w})").alias("passed"), _n("confidence = 'low'").alias("low_confidence"),
    )


def axis_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per axis: sums over stories, the first threshold by ``seq``, the worst state, the slowest call, and the rates of acceptance, of what lies below, of time-outs."""
    ranks = F.array(*map(F.lit, RUNTIME_STATES))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("runs"), F.coalesce(F.bool_or("enabled"), F.lit(False)).alias("enabled"), F.expr("min_by(threshold, seq) filter (where threshold is not null)").alias("threshold"),
        *(_sum(c).alias(c) for c in ("candidates", "accepted", "below", "timeouts", "calls")), F.coalesce(F.max("latency_ms"), F.lit(0)).alias("slowest_ms"),
        F.max(F.coalesce(F.array_position(ranks, F.col("state")), F.lit(0))).alias("_worst"),
    )
    rates = {n: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)) for n, a, b in (("accept_rate", "accepted", "candidates"), ("below_rate", "below", "candidates"), ("timeout_rate", "timeouts", "calls"))}
    return out.withColumns({**rates, "worst_state": F.element_at(ranks, F.greatest("_worst", F.lit(1)).cast("int"))}).drop("_worst")


def eval_rollup(cases: DataFrame) -> DataFrame:
    """(group, total, passed, hard_fail, fallback, duplicated, mislabelled and their rates) of each group of cases, and of all under a null group."""
    dup, tax = "exists(fail_reasons, x -> contains(x, 'non_duplication'))", "exists(fail_reasons, x -> startswith(x, 'taxonomy_mismatch') or startswith(x, 'confidence_mismatch'))"
    tests = {"passed": "pass", "hard_fail": "hard_fail", "fallback": "fallback", "duplicated": dup, "mislabelled": f"coalesce({tax}, false) or coalesce(size(label_mismatches) > 0, false)"}
    groups = cases.groupBy(F.coalesce("group", F.lit("?")).alias("group")).agg(F.count("*").alias("total"), *(_n(t).alias(c) for c, t in tests.items()))
    of_all = groups.agg(F.lit(None).cast("string").alias("group"), *(_sum(c).alias(c) for c in ("total", *tests)))
    return groups.unionByName(of_all).withColumns({f"{c}_rate": F.coalesce(F.try_divide(c, "total"), F.lit(0.0)) for c in tests})


def eval_gate(rollup: DataFrame) -> DataFrame:
    """(blockers, warnings): the names of the bounds that a roll-up breaks; only blockers stop a release."""

    def broken(tests: dict[str, str]) -> Column:
        return F.array_compact(F.array(*(F.max(F.when(F.expr(t), F.lit(n))) for n, t in tests.items())))

    total, a = "`group` is null", "`group` = 'A' and total > 0"
    blockers = {"group_A_pass_rate": f"{a} and passed_rate < {GROUP_A_PASS}", "overall_pass_rate": f"{total} and passed_rate < {OVERALL_PASS}", "hard_fail_rate": f"{total} and hard_fail_rate > {HARD_FAIL}"}
    warnings = {"fallback_rate": f"{total} and fallback_rate > {FALLBACK}", "duplication_failure_rate": f"{total} and duplicated_rate > {DUPLICATION}", "label_mismatch_rate": f"{total} and mislabelled > 0"}
    return rollup.agg(broken(blockers).alias("blockers"), broken(warnings).alias("warnings"))


def social_funnel(items: DataFrame, stages: Sequence[str], not_run: Sequence[str] = ()) -> DataFrame:
    """(stage, n, dropped, primary) of the social items (kind, reached: place of the last stage they came through).

    A stage that did not run has no count, and no drop on either side of it. One
    aggregation whatever the number of stages; the first of the largest drops is primary.
    """
    counts = [F.lit(None).cast("long") if s in not_run else _n(f"kind = 'social' and reached >= {i}") for i, s in enumerate(stages)]
    row = items.agg(F.array(*counts).alias("n"))
    drops = F.transform("n", lambda x, i: F.when(i > 0, F.when(x.isNotNull() & F.get("n", i - 1).isNotNull(), F.greatest(F.lit(0), F.get("n", i - 1) - x))))
    out = row.withColumn("d", drops).select(F.array_max("d").alias("_most"), "d", F.posexplode("n").alias("i", "n"))
    primary = (F.col("_most") > 0) & (F.col("i") == F.array_position("d", F.col("_most")) - 1)
    return out.select(F.get(F.array(*map(F.lit, stages)), F.col("i")).alias("stage"), "n", F.get("d", F.col("i")).alias("dropped"), F.coalesce(primary, F.lit(False)).alias("primary"))


def social_in_stories(sources: DataFrame, by: list[str]) -> DataFrame:
    """Per key: stories, those with a social source, and social sources in all, from (story, kind, *by)."""
    each = sources.groupBy(*by, "story").agg(_n("kind = 'social'").alias("_s"))
    return each.groupBy(*by).agg(F.count("*").alias("stories"), _n("_s > 0").alias("social_stories"), F.sum("_s").alias("social_sources"))


def evidence_refs(sources: DataFrame) -> DataFrame:
    """(story, sources, outlets, divergence, cadence) from (story, outlet, state): low, medium (4 sources, 4 outlets) or high (6, 5) divergence."""
    name = text.source_identity(F.col("outlet"))
    out = sources.groupBy("story").agg(F.count("*").alias("sources"), F.count_distinct(F.when(name != "", name)).alias("outlets"), F.max("state").alias("_state"))
    tier = F.when((F.col("sources") >= 6) & (F.col("outlets") >= 5), "high").when((F.col("sources") >= 4) & (F.col("outlets") >= 4), "medium").otherwise("low")
    return out.select("story", "sources", "outlets", tier.alias("divergence"), F.when(F.col("_state") == "changed", "accelerating").otherwise("stable").alias("cadence"))


def not_english(lang: Column) -> Column:
    """Is a language named, and another than English?"""
    return F.coalesce((F.trim(lang) != "") & ~F.startswith(F.lower(F.trim(lang)), F.lit("en")), F.lit(False))


def with_translations(items: DataFrame, translated: DataFrame) -> DataFrame:
    """Items with the translation of their text where there is one; ``reason`` of those that need one and were left for a later run."""
    new = translated.select("source_id", F.col("text").alias("_text"), F.lit(True).alias("_done"))
    out = items.join(new, "source_id", "left").withColumns({"text": F.when(F.col("_done"), F.col("_text")).otherwise(F.col("text")), "needed": not_english(F.col("lang")), "applied": F.coalesce("_done", F.lit(False))})
    return out.withColumn("reason", F.when(F.col("needed") & ~F.col("applied"), "cold_start_cap")).drop("_text", "_done")


def with_protected(recalled: DataFrame, items: DataFrame, lane: str = "lane", degraded: bool = False) -> DataFrame:
    """The recalled items and the lane-1 ones that recall missed; none of these where recall was degraded."""
    if degraded:
        return recalled
    return recalled.unionByName(items.filter(F.col(lane) == 1).join(recalled.select("source_id"), "source_id", "left_anti").select(*recalled.columns))


def merged_social(cached: DataFrame, live: DataFrame, order: list[Column]) -> DataFrame:
    """Cached rows, then live ones, each source id once (its first row by ``order``, cached before live); rows without an id all stay."""
    rows = cached.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)))
    named = F.coalesce(F.col("source_id") != "", F.lit(False))
    first = rows.filter(named).withColumn("_r", F.row_number().over(Window.partitionBy("source_id").orderBy("_live", *order))).filter("_r = 1").drop("_r")
    return first.unionByName(rows.filter(~named)).drop("_live")


def servable(snapshots: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Snapshots (user, refreshed_at) fresh enough to be served; without a time, none is."""
    return snapshots.filter(F.col("refreshed_at") >= as_of - F.expr(f"interval {int(hours)} hours"))


def mapping_report(mapping: DataFrame, entities: DataFrame, tracker: DataFrame) -> DataFrame:
    """(feed, active, name, tracked) of every mapped feed, with or without an entity."""
    names = entities.select("entity", "name")
    return mapping.join(names, "entity", "left").join(tracker.select("feed", F.lit(True).alias("tracked")).distinct(), "feed", "left").select("feed", "active", "name", F.coalesce("tracked", F.lit(False)).alias("tracked"))


def restore_plan(tracker: DataFrame, mapping: DataFrame) -> DataFrame:
    """(feed, action) for each feed switched off before: restore, leave (as it was or already on) or missing."""
    known = mapping.select("feed", F.col("active").alias("_now"), F.lit(True).alias("_there"))
    action = F.when(F.col("_there").isNull(), "missing").when(F.col("prev_active") & ~F.col("_now"), "restore").otherwise("leave")
    return tracker.join(known, "feed", "left").select("feed", action.alias("action"))


def delta_digest(rows: DataFrame) -> DataFrame:
    """(kind, line) of unmapped names, the most seen first, then those seen first: name, times and last time."""
    last = F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm'Z'")
    line = F.concat(F.lit("• "), "name", F.lit(" — seen "), F.col("times_seen").cast("string"), F.lit("× (last: "), last, F.lit(")"))
    return rows.orderBy(F.col("times_seen").desc(), "first_seen", "name").select("kind", line.alias("line"))


def status_order(status: Column, weight: Column, name: Column) -> list[Column]:
    """By status (unknown ones last), heavier first, by name."""
    place = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), status)
    return [F.when(place > 0, place).otherwise(len(STATUS_ORDER) + 1), F.coalesce(weight, F.lit(0)).desc(), F.coalesce(name, F.lit(""))]


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """(bucket, n, weight) per status; unknown ones count as pending."""
    bucket = F.when(F.col(status).isin(*STATUS_ORDER), F.col(status)).otherwise("pending")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def hygiene(values: Column, handles: bool = False) -> Column:
    """The usable values of a settings list, each once whatever its case, first spelling kept.

    Blank values, those without a letter or digit and those over 64 characters go;
    a list of handles keeps only @names, the others none of them. Each value is
    looked for in its own list: for lists as people keep them, not for texts.
    """
    good = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: (F.char_length(x) <= ITEM_LENGTH) & x.rlike(r"[\p{L}\p{N}]") & (x.rlike(r"^@(?=.*[\p{L}\p{N}])[\p{L}\p{N}_.-]+$") if handles else ~x.startswith("@")))
    low = F.transform(good, F.lower)
    return F.filter(good, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def finalized(values: Column, most: int = LIST_SIZE) -> Column:
    """A list in the order of lower-cased values, the first ``most``."""
    return F.slice(F.transform(F.array_sort(F.transform(values, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))), lambda s: s["v"]), 1, most)


def usernames(raw: Column) -> Column:
    """Distinct lower-case names of a comma-separated list, without the @."""
    names = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.lower(F.trim(F.regexp_replace(F.trim(x), "^@+", ""))))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def post_id(username: Column, post: Column) -> Column:
    """The id of a social post: x:name and 16 hex digits over name and post."""
    digest = F.substring(F.sha2(F.concat(F.lit("x:"), username, F.lit("::"), post), 256), 1, 16)
    return F.concat(F.lit("x:"), username, F.lit(":"), digest)


def cost_usd(prompt: Column, output: Column, prompt_rate: float, output_rate: float) -> Column:
    """Cost of tokens at rates for a million of each."""
    return F.round((prompt * prompt_rate + output * output_rate) / 1_000_000, 6)
