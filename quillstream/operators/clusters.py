"""Over-merged clusters: which ones to split, and into which components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import theme_words
from .stories import similar_links


def components(edges: DataFrame, within: str, most_rounds: int = 50) -> DataFrame:
    """(within, id, root): the least id that each end of an edge (within, a, b) reaches; edges stay within one ``within``.

    Every round takes the least label of the neighbours and of the neighbours'
    labels; it is written to the checkpoint folder.
    """
    # the edges are worked out once, and not once for each direction
    both = edges.select(within, F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e")).select(within, "e.id", "e.to").distinct().checkpoint()
    labels = both.groupBy(within, "id").agg(F.least(F.min("to"), F.min("id")).alias("root"))
    for _ in range(most_rounds):
        labels = labels.checkpoint()
        near = both.join(labels.withColumnRenamed("id", "to"), [within, "to"]).groupBy(within, "id").agg(F.min("root").alias("_near"))
        far = labels.toDF(within, "_at", "_far")
        new = labels.join(near, [within, "id"]).select(within, "id", "root", F.least("root", "_near").alias("_best"))
        new = new.join(far, (new[within] == far[within]) & (new["_best"] == far["_at"])).select(new[within], "id", "root", F.least("_best", "_far").alias("_best")).checkpoint()
        if new.filter("_best != root").isEmpty():
            return labels
        labels = new.select(within, "id", F.col("_best").alias("root"))
    raise RuntimeError("components did not converge")


def claim_support(claims: DataFrame) -> DataFrame:
    """(story, corroborated, disjoint) from (story, claim, source_id): a claim of two sources; claims of one source each, all different."""
    rows = claims.filter("source_id is not null and source_id != ''")
    per_claim = rows.groupBy("story", "claim").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("k"))
    sources = rows.groupBy("story").agg(F.countDistinct("source_id").alias("sources"))
    out = per_claim.groupBy("story").agg(F.count("*").alias("claims"), F.max("n").alias("most"), F.max("k").alias("k")).join(sources, "story")
    return out.select("story", (F.col("k") >= 2).alias("corroborated"), ((F.col("claims") >= 2) & (F.col("most") == 1) & (F.col("sources") == F.col("claims"))).alias("disjoint"))


def split_clusters(items: DataFrame, claims: DataFrame, threshold: float = fixed.SPLIT_JACCARD, theme: Sequence[str] = theme_words()) -> DataFrame:
    """(story, part, ids, action, reason) of each cluster, kept, deferred or split.

    items: story, id, english, tokens (of the evidence: headline and two lines of
    body, without words of configured geographies). A cluster of unlike
    sources that no claim holds together is split (low_token_overlap), and one
    whose claims each stand on a source of their own (disjoint_claim_evidence);
    what is not all in English, or hangs together after all, is deferred. Parts are
    the components of sources alike or with a word of ``theme`` in common.
    """
    facts = items.groupBy("story").agg(F.count("*").alias("n"), F.bool_and("english").alias("english"), F.array_sort(F.collect_list("id")).alias("all_ids"))
    rows = items.select("story", "id", F.explode("tokens").alias("token"))
    alike = similar_links(items.select("story", "id", F.col("tokens").alias("s")), "story", threshold).checkpoint()
    facts = facts.join(alike.select("story").distinct().withColumn("linked", F.lit(True)), "story", "left").join(claim_support(claims), "story", "left")
    free = ~F.coalesce("corroborated", F.lit(False)) & F.col("linked").isNull() & (F.col("n") >= 2)
    reason = F.when(free & F.col("english"), "low_token_overlap").when((F.col("n") >= 2) & F.coalesce("disjoint", F.lit(False)), "disjoint_claim_evidence").when(free, "ambiguous_unnormalized_overlap")
    facts = facts.withColumn("reason", reason).select("story", "all_ids", "reason").checkpoint()
    wanted = facts.filter("reason in ('low_token_overlap', 'disjoint_claim_evidence')")
    voted = rows.filter(F.col("token").isin(*theme))
    first = voted.groupBy("story", "token").agg(F.min("id").alias("b"))  # a star joins all that share a word
    themed = voted.join(first, ["story", "token"]).filter("id != b").selectExpr("story", "id a", "b")
    edges = alike.unionByName(themed).join(wanted.select("story"), "story", "left_semi")
    roots = components(edges, "story")
    parts = items.select("story", "id").join(wanted.select("story", "reason"), "story").join(roots, ["story", "id"], "left").withColumn("root", F.coalesce("root", "id"))
    parts = parts.groupBy("story", "reason", "root").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    several = parts.groupBy("story").agg((F.count("*") > 1).alias("several"))
    whole = F.lit(None).cast(items.schema["id"].dataType)
    split = parts.join(several.filter("several"), "story").select("story", F.col("root").alias("part"), "ids", F.lit("split").alias("action"), "reason")
    kept = facts.join(several.filter("several"), "story", "left_anti")
    action = F.when(F.col("reason").isNull(), "kept").otherwise("deferred")
    why = F.when(F.col("reason").isin("low_token_overlap", "disjoint_claim_evidence"), "ambiguous_overlap_conflict").otherwise(F.col("reason"))
    return split.unionByName(kept.select("story", whole.alias("part"), F.col("all_ids").alias("ids"), action.alias("action"), why.alias("reason")))


def recluster_queue(clusters: DataFrame, by: list[str], most: int = fixed.QUEUE_CAP) -> DataFrame:
    """The deferred clusters (story, reason, n_sources) to look at again, the most suspect first, ``most`` of each ``by``."""
    from .ranking import top_per_key

    weight = F.when(F.col("reason") == "ambiguous_unnormalized_overlap", 30).when(F.col("reason") == "ambiguous_overlap_conflict", 20).otherwise(0)
    scored = clusters.filter("reason is not null").withColumn("suspicion", 100 + weight + 2 * F.least("n_sources", F.lit(5)))
    return top_per_key(scored.dropDuplicates(["story", *by]), by, [F.col("suspicion").desc(), F.col("story").asc()], most)


def story_identity(meta_id: Column, source_ids: Column) -> Column:
    """A story's id, or a hash of its sorted sources; "" without either."""
    ids = F.array_sort(F.array_distinct(F.filter(source_ids, lambda x: x.isNotNull() & (x != ""))))
    hashed = F.when(F.size(ids) > 0, F.concat(F.lit("src:"), F.substring(F.sha2(F.array_join(ids, ","), 256), 1, 16))).otherwise("")
    return F.coalesce(F.when(F.trim(meta_id) != "", F.trim(meta_id)), hashed)


def rejection_key(meta_id: Column, source_ids: Column, reason: Column, watermark: Column) -> Column:
    return F.concat_ws("|", story_identity(meta_id, source_ids), F.coalesce(reason, F.lit("")), F.coalesce(watermark, F.lit("")))


def story_order() -> list[Column]:
    """Most relevant first, then of more sources, better fit, fresher, by id; what is unknown counts least."""
    least = [F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)).desc() for c in ("relevance", "n_sources", "max_fit")]
    return [*least, F.coalesce("min_minutes", F.lit(float("inf"))).asc(), F.col("story").asc()]


def source_order(weight: str = "weight", minutes: str = "minutes_ago", source: str = "source_id") -> list[Column]:
    """Heavier first, then fresher, by id."""
    return [F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).desc(), F.coalesce(F.col(minutes).cast("double"), F.lit(float("inf"))).asc(), F.coalesce(F.col(source), F.lit("")).asc()]


def match_strength(topics: Column, keywords: Column) -> Column:
    return (F.coalesce(F.size(topics), F.lit(0)) > 0).cast("int") + (F.coalesce(F.size(keywords), F.lit(0)) > 0).cast("int")
