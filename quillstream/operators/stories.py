"""Stories: roll-up, grounding, similarity components, lineage and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import LINEAGE_JACCARD, SIGNAL_MINUTES, STORY_CAP
from .blocks import block_links, numbered, weight


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def roll_up(items: DataFrame, by: str) -> DataFrame:
    """One row a story: sources, outlets, greatest weight, priority, freshest age."""
    out = items.groupBy(by).agg(
        F.count("*").alias("n_sources"), F.countDistinct("outlet").alias("n_outlets"), F.max("weight").alias("max_weight"), F.min("minutes_ago").alias("min_minutes"),
    )
    return out.withColumn("priority", F.when(F.col("max_weight") >= 80, "top").otherwise("standard"))


def topic_clusters(items: DataFrame, topic: str, per_cluster: int = 5, clusters: int = STORY_CAP) -> DataFrame:
    """Deterministic clusters: a topic each, in order of first appearance, with its first items."""
    items = items.select(topic, "seq", "source_id")
    first = items.groupBy(topic).agg(F.min("seq").alias("first_seq"), F.count("*").alias("n_items"))
    kept = first.orderBy("first_seq", topic).limit(clusters)
    ranked = items.join(F.broadcast(kept), topic).withColumn("_r", F.row_number().over(Window.partitionBy(topic).orderBy("seq"))).filter(F.col("_r") <= per_cluster)
    return ranked.groupBy(topic, "first_seq", "n_items").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "source_id"))), lambda s: s["source_id"]), ",").alias("source_ids"))


#: Rows that one task of a table of claims holds, about.
TASK_ROWS = 500_000


def grounding(claims: DataFrame, known: DataFrame, parts: int | None = None) -> DataFrame:
    """Verdict of each story from its (story, claim, source_id) rows: no_valid_source_ids, ungrounded_claims, partial_source_ids, or grounded.

    parts: into how many tasks the rows are dealt, so that a task's share does not
    grow with the table; a story's rows stay in one.
    """
    known = known.select("source_id").distinct().withColumn("_ok", F.lit(1))
    if parts:
        claims, known = claims.repartition(parts, "source_id"), known.repartition(parts, "source_id")
    seen = claims.join(known, "source_id", "left")
    if parts:
        seen = seen.repartition(parts, "story")
    per_claim = seen.groupBy("story", "claim").agg(F.count("_ok").alias("ok"), F.count("*").alias("n"))
    per_story = per_claim.groupBy("story").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"), F.min("ok").alias("least"))
    verdict = F.when(F.col("ok") == 0, "no_valid_source_ids").when(F.col("least") == 0, "ungrounded_claims").when(F.col("ok") < F.col("n"), "partial_source_ids").otherwise("grounded")
    return per_story.select("story", F.col("n").alias("n_evidence"), F.col("ok").alias("n_known"), verdict.alias("verdict"))


#: Groups of so few pairs of sets are paired outright.
FEW_PAIRS = 2500
_SKETCH = 4


def _needed(n: Column, m: Column, least: float, shared: int) -> Column:
    """How many tokens sets of these sizes have in common at least, if their Jaccard is ``least``."""
    return F.greatest((n + m) * (least / (1 + least)) - 1e-9, F.lit(float(shared)))


def _scored(pairs: DataFrame, kept: list[str], least: float, shared: int) -> DataFrame:
    """Pairs of sets (s, t) whose Jaccard is ``least`` or more, with it."""
    n, m = F.size("s"), F.size("t")
    rows = pairs.filter(F.least(n, m) >= least * F.greatest(n, m) - 1e-9).select(*kept, F.size(F.array_intersect("s", "t")).alias("_c"), (n + m).alias("_n"))
    return rows.filter(F.col("_c") >= shared).withColumn("jaccard", F.col("_c") / (F.col("_n") - F.col("_c"))).filter(F.col("jaccard") >= least).drop("_c", "_n")


def _prefixes(sets: DataFrame, often: DataFrame, within: list[str], least: float, shared: int) -> DataFrame:
    """(id, *within, token, n, k, reach, b0..b3) of the first tokens of each set, rarest first; reach: is the token among those that a larger set has to meet?"""
    at = F.xxhash64("token")
    bits = [F.coalesce(F.bit_or(F.when(F.pmod(at, F.lit(_SKETCH)) == j, F.expr("shiftleft(1L, cast(pmod(shiftright(xxhash64(token), 8), 64) as int))"))), F.lit(0).cast("long")).alias(f"b{j}") for j in range(_SKETCH)]
    rows = sets.select("id", *within, F.explode("s").alias("token")).join(often, [*within, "token"])
    rows = rows.groupBy("id", *within).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "token"))), lambda x: x["token"]).alias("s"), *bits)
    n = F.size("s")
    first, half = (n - F.greatest(F.ceil(n * c - 1e-9), F.lit(shared)).cast("int") + 1 for c in (least, 2 * least / (1 + least)))
    sketch = [f"b{j}" for j in range(_SKETCH)]
    rows = rows.select("id", *within, n.alias("n"), half.alias("_half"), *sketch, F.posexplode(F.slice("s", F.lit(1), F.greatest(first, F.lit(0)))).alias("k", "token"))
    return rows.select("id", *within, "token", "n", "k", (F.col("k") < F.col("_half")).alias("reach"), *sketch)


def _met(left: DataFrame, right: DataFrame | None, within: list[str], least: float, shared: int) -> DataFrame:
    """Pairs of sets by their rarest tokens; without ``right`` of one table, each pair once (a < b).

    Tokens are ordered by how many sets hold them, rarest first; two sets that
    reach the threshold share one of their first n - ceil(least * n) + 1 tokens,
    and of sets of one table the smaller one's first n - ceil(2 * least / (1 + least) * n) + 1
    do. Only these are joined, by id, with the token's place and a sketch of 256 bits:
    what follows the place bounds the overlap, and so does the number of bits in which
    sketches differ. Whole sets are joined for the pairs that are left.
    """
    both = left if right is None else left.unionByName(right)
    often = both.select(*within, F.explode("s").alias("token")).groupBy(*within, "token").agg(F.count("*").alias("_n"))
    x = _prefixes(left, often, within, least, shared).alias("x")
    y = (x if right is None else _prefixes(right, often, within, least, shared)).alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    differ = sum((F.bit_count(F.col(f"x.b{j}").bitwiseXOR(F.col(f"y.b{j}"))) for j in range(_SKETCH)), F.lit(0))
    needed = _needed(n, m, least, shared)
    fits = (F.least(n, m) >= least * F.greatest(n, m) - 1e-9) & (F.least(n - F.col("x.k"), m - F.col("y.k")) >= needed) & (n + m - differ >= 2 * needed - 1e-9)
    if right is None:
        fits = fits & F.col("x.reach") & ((n < m) | ((n == m) & (F.col("x.id") < F.col("y.id"))))
    pairs = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*within, "token")] + [fits]).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), *(F.col(f"x.{c}").alias(c) for c in within)).distinct()
    own = lambda sets, name, s: sets.select(F.col("id").alias(name), *within, F.col("s").alias(s))
    full = pairs.join(own(left, "a", "s"), ["a", *within]).join(own(left if right is None else right, "b", "t"), ["b", *within])
    if right is None:
        full = full.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    return _scored(full, [*within, "a", "b"], least, shared)


def _as_sets(rows: DataFrame, within: list[str]) -> DataFrame:
    return rows.groupBy("id", *within).agg(F.array_sort(F.collect_set("token")).alias("s"))


def similar_sets(left: DataFrame, right: DataFrame, within: list[str], least: float, shared: int = 1) -> DataFrame:
    """Pairs (a, b, jaccard) of sets of one ``within`` whose Jaccard is ``least`` or more, with ``shared`` tokens in common or more; both sides hold (id, *within, token)."""
    return _met(_as_sets(left, within), _as_sets(right, within), within, least, shared).select("a", "b", "jaccard")


def similar_pairs(rows: DataFrame, within: list[str], least: float, shared: int = 1) -> DataFrame:
    """``similar_sets`` of one table, each pair once: a < b."""
    return _met(_as_sets(rows, within), None, within, least, shared).select("a", "b", "jaccard")


def similar_links(sets: DataFrame, within: str, least: float, shared: int = 1) -> DataFrame:
    """Links (within, a, b), a < b, that hold together what the similar pairs of sets (id, within, s: distinct tokens) do.

    In small groups all pairs are looked at. In others sets that are equal are linked
    with the first of them, and only that one with sets that differ, block by block.
    """
    given = sets
    sets = sets.groupBy(within, "id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s")).filter(F.size("s") >= shared)
    counts = sets.groupBy(within).agg(F.count("*").alias("_sets"), F.sum(weight()).alias("_weight")).checkpoint()
    few = F.col("_sets") * F.col("_sets") <= FEW_PAIRS
    some = not counts.filter(~few).isEmpty()
    if some:
        sets = numbered(sets, given)
    sets = sets.join(counts, within)
    if some:
        sets = sets.checkpoint()
    small = sets.filter(few)
    x, y = (small.select(within, F.col("id").alias(i), F.col("s").alias(v)) for i, v in (("a", "s"), ("b", "t")))
    out = _scored(x.join(y, within).filter("a < b"), [within, "a", "b"], least, shared).select(within, "a", "b")
    if not some:
        return out
    large = sets.filter(~few)
    first = large.groupBy(within, "s").agg(F.min("id").alias("id"), F.first("_weight").alias("_weight")).checkpoint()
    copies = large.join(first.select(within, "s", F.col("id").alias("a")), [within, "s"]).filter("id != a").select(within, "a", F.col("id").alias("b"))
    return out.unionByName(block_links(first, within, least, shared)).unionByName(copies)


def lineage_candidates(new: DataFrame, prior: DataFrame, least: float = LINEAGE_JACCARD) -> DataFrame:
    """Prior stories of the same topic whose sources overlap by ``least`` or more: (story, prior, jaccard).

    Both sides hold one row a source (story, topic, source_id).
    """
    sides = (x.selectExpr("story id", "topic", "source_id token") for x in (new, prior))
    return similar_sets(*sides, ["topic"], least).selectExpr("a story", "b prior", "jaccard")


#: Candidate rows of which the order of claims is followed on the driver; more go in rounds.
TAIL_ROWS = 50_000


def _claimed_in_order(rows: list) -> list[tuple]:
    """(story, prior) of the stories, in order of id, whose candidates no earlier one took leave exactly one."""
    of: dict = {}
    for r in rows:
        of.setdefault(r["story"], set()).add(r["prior"])
    taken: set = set()
    out = []
    for story in sorted(of):
        free = of[story] - taken
        if len(free) == 1:
            taken |= free
            out.append((story, next(iter(free))))
    return out


def claim_lineage(candidates: DataFrame) -> DataFrame:
    """(story, prior): stories in order of id take their only prior that no earlier story took.

    In each round all stories are settled whose candidates no earlier unsettled
    story shares. Every round settles one story of each connected part at least, so
    the longest chain gives the number of rounds; once few rows are left, their
    chains are followed on the driver (TAIL_ROWS rows, ids only). Each round is
    written to the checkpoint folder.
    """
    open_ = candidates.select("story", "prior").distinct().checkpoint()
    claims = open_.limit(0)
    while (left := open_.limit(TAIL_ROWS + 1).count()) > 0:
        if left <= TAIL_ROWS:
            return claims.unionAll(candidates.sparkSession.createDataFrame(_claimed_in_order(open_.collect()), open_.schema))
        first = open_.groupBy("prior").agg(F.min("story").alias("_first"))
        turn = open_.join(first, "prior").groupBy("story").agg(F.bool_and(F.col("_first") == F.col("story")).alias("_ready"), F.count("*").alias("_n"), F.min("prior").alias("prior"))
        turn = turn.filter("_ready").checkpoint()
        taken = turn.filter("_n = 1").select("story", "prior")
        claims = claims.unionAll(taken)
        open_ = open_.join(turn, "story", "left_anti").join(taken, "prior", "left_anti").select("story", "prior").checkpoint()
    return claims


def structural_diff(current: DataFrame, prior: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, reason, strength) of what differs: added_source and headline_change are strong, removed_source is weak."""
    both = current.select(*key, F.col(value).alias("_now"), F.lit(True).alias("_new")).join(prior.select(*key, F.col(value).alias("_was"), F.lit(True).alias("_old")), key, "full_outer")
    reason = F.when(F.col("_old").isNull(), "added_source").when(F.col("_new").isNull(), "removed_source").when(~F.col("_now").eqNullSafe(F.col("_was")), "headline_change")
    strength = F.when(reason.isin("added_source", "headline_change"), "strong").otherwise("weak")
    return both.withColumn("reason", reason).filter("reason is not null").select(*key, "reason", strength.alias("strength"))


def token_pairs(items: DataFrame, tokens: str, least: float) -> DataFrame:
    """Pairs (a, b, jaccard), a < b, of items (id) whose token sets overlap by ``least`` or more."""
    rows = items.select("id", F.explode(tokens).alias("token"))
    return similar_pairs(rows, [], least)


def signals(sources: DataFrame) -> DataFrame:
    """Per story, from its (story, outlet, minutes_ago): upper median and least age, activity and its trend, outlets, confidence."""
    order = Window.partitionBy("story").orderBy("minutes_ago")
    placed = sources.withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy("story")))
    middle = F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col("minutes_ago")))
    rows = placed.groupBy("story").agg(middle.alias("median_minutes"), F.min("minutes_ago").alias("freshest_minutes"), F.count("*").alias("n"), F.countDistinct("outlet").alias("outlets"))
    fresh = F.floor(F.greatest(F.lit(0.0), 100 * (1 - F.least(F.lit(1.0), F.col("freshest_minutes") / SIGNAL_MINUTES))) + 0.5)
    activity = F.floor(fresh * 0.55 + F.least(F.lit(100), F.col("n") * 7) * 0.45 + 0.5)
    score = F.least(F.lit(100), F.col("outlets") * 18 + F.col("n") * 6)
    trend = F.when(activity >= 70, "rising").when(activity >= 45, "steady").otherwise("falling")
    confidence = F.when(score >= 70, "high").when(score >= 45, "medium").otherwise("early")
    return rows.select("story", "median_minutes", "freshest_minutes", activity.alias("activity"), trend.alias("trend"), "outlets", confidence.alias("confidence"))
