"""Ranking, gating and combining tidy signals: signals(plan_id, file, source, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WEIGHTS = {"structural": 0.50, "comod": 0.35, "semantic": 0.15}
#: Sources that count as evidence of a relation in the code, rather than of closeness.
STRONG = ("verified-caller", "verified-callee", "verified-cascade", "structural", "import-chain", "cascade", "callee", "comod", "shared-pkg", "sibling-cmd")


def rounded(x: Column, digits: int) -> Column:
    """Multiply, round, divide."""
    return F.round(x * 10**digits) / 10**digits


def novelty_weights(n: Column) -> dict[str, Column]:
    """Weights by novelty: structural and co-change fall, analogy and semantic rise."""
    return {"structural": 0.5 * (1 - 0.8 * n), "comod": 0.35 * (1 - 0.7 * n), "analogy": 0.05 + 0.35 * n, "semantic": 0.1 + 0.3 * n}


def contribution(source: Column, score: Column, n: Column, hub: Column, refs: Column | None = None) -> Column:
    """What one signal adds to its file; null where hubs are skipped."""
    # The weight of each source, and how much less a hub's file gets.
    w = novelty_weights(n)
    s, skip = w["structural"], lambda x: F.when(~hub, x)
    coupling = 0.15 + 0.45 * F.least((refs if refs is not None else F.lit(0)) / 5, F.lit(1.0))
    return (
        F.when(F.startswith(source, F.lit("verified-")), score)
        .when(source == "structural", s * 0.5 * F.when(hub, 0.4).otherwise(1.0))
        .when(source == "callee", s * 0.4 * F.when(hub, 0.4).otherwise(1.0))
        .when(source == "pattern", 0.3 + 0.2 * (1 - n))
        .when(source == "dir-sibling", skip(F.when(score > 0, 0.55).otherwise(0.35)))
        .when(source == "parent", skip(F.lit(0.25)))
        .when(source == "peer-dir", skip(F.when(score > 0, 0.3).otherwise(0.2)))
        .when(source == "import", 0.6 * s).when(source == "import-chain", skip(s * coupling))
        .when(source == "shared-pkg", 0.6).when(source == "sibling-cmd", skip(F.lit(0.55))).when(source == "cmdutil", 0.45).when(source == "convention", skip(F.lit(0.5)))
        .when(source == "sibling", skip(F.lit(0.15)))
        .when(source == "comod", score * w["comod"] * F.when(hub, 0.5).otherwise(1.0))
        .when(source == "dir-comod", skip(score * w["comod"] * 0.8))
        .when(source == "cascade", skip(0.8 * s))
        .when(source == "analogy", score * w["analogy"])
        .when(source.isin("keyword-dir", "entity-dir"), skip(score))
        .when(source == "semantic", score * w["semantic"])
        .otherwise(score)
    )


def not_planned(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows (plan_id, file, ..) whose file is no planned path and no planned path's base name."""
    names = planned.select("plan_id", F.explode(F.array_distinct(F.array(F.col("file"), F.regexp_replace("file", "^.*/", "")))).alias("file")).distinct()
    return rows.join(names, ["plan_id", "file"], "left_anti")


def rank(signals: DataFrame, planned: DataFrame, novelty: float = 0.0, hubs: DataFrame | None = None) -> DataFrame:
    """plan_id, file, score (two decimals), sources: contributions summed over sources, planned files left out by path and by base name.

    Contributions are added in millionths, so the sum does not depend on their order.
    """
    marked = signals.withColumn("hub", F.lit(False)) if hubs is None else signals.join(hubs.select("file", F.lit(True).alias("h")), "file", "left").withColumn("hub", F.coalesce("h", F.lit(False)))
    added = marked.withColumn("added", contribution(F.col("source"), F.col("score"), F.lit(novelty), F.col("hub"))).filter("added IS NOT NULL")
    summed = added.groupBy("plan_id", "file").agg((F.sum(F.round(F.col("added") * 1_000_000).cast("long")) / 1_000_000).alias("total"), F.array_sort(F.collect_set("source")).alias("sources"))
    return not_planned(summed, planned).select("plan_id", "file", rounded(F.col("total"), 2).alias("score"), "sources")


def merge_by_base(ranked: DataFrame, files: DataFrame) -> DataFrame:
    """ranked(plan_id, file, score) with base names replaced by the path where there is just one, and scores added up."""
    only = files.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1")
    joined = ranked.join(only.select(F.col("base").alias("file"), "path"), "file", "left").withColumn("file", F.coalesce("path", "file"))
    return joined.groupBy("plan_id", "file").agg(rounded(F.sum("score"), 2).alias("score"))


def top_k(ranked: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("plan_id").orderBy(F.desc("score"), "file")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def confidence_gate(ranked: DataFrame, verified: int = 3, alone: int = 2, discount: float = 0.6) -> DataFrame:
    """plan_id, file, score, tier: build-check without limit, then spike with strong evidence, then spike alone at a discount.

    Spike alone counts only where the plan has a file of one of the better tiers. A plan without
    any spike file is not gated: all its files stay, without a tier.
    """
    spike = F.array_contains("sources", "verified-spike")
    strong = F.arrays_overlap("sources", F.array(*map(F.lit, STRONG)))
    tier = F.when(F.array_contains("sources", "build-check"), 0).when(spike & strong, 1).when(spike, 2)
    plan = Window.partitionBy("plan_id")
    tiers = ranked.withColumn("tier", tier).withColumn("spiked", F.max(spike).over(plan)).withColumn("found", F.max(F.coalesce(F.col("tier") < 2, F.lit(False))).over(plan))
    order = Window.partitionBy("plan_id", "tier").orderBy(F.desc("score"), "file")
    kept = tiers.withColumn("r", F.row_number().over(order)).filter(f"NOT spiked OR tier = 0 OR tier = 1 AND r <= {verified} OR tier = 2 AND found AND r <= {alone}")
    score = F.when(F.col("spiked") & (F.col("tier") == 2), F.col("score") * discount).otherwise(F.col("score"))
    return kept.select("plan_id", "file", score.alias("score"), F.when(F.col("spiked"), F.col("tier")).alias("tier"))


def source_count_gate(signals: DataFrame, least: int = 2, k: int = 10) -> DataFrame:
    """plan_id, file, best, reason, n_sources, label: files of ``least`` sources or a build check, the ``k`` best of a plan."""
    found = signals.groupBy("plan_id", "file").agg(
        F.countDistinct("source").alias("n_sources"), F.max(F.struct("score", "source")).alias("b"), F.bool_or(F.col("source") == "build-check").alias("built")
    ).filter((F.col("n_sources") >= least) | F.col("built"))
    return best_of_plans(found, k)


def best_of_plans(found: DataFrame, k: int) -> DataFrame:
    """Of found(plan_id, file, b (score, source), n_sources) the ``k`` best of a plan, labelled."""
    w = Window.partitionBy("plan_id").orderBy(F.desc("b.score"), "file")
    label = F.when(F.col("b.score") >= 0.9, "must").when(F.col("b.score") >= 0.5, "likely").when(F.col("b.score") >= 0.3, "consider").otherwise("unlikely")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("plan_id", "file", F.col("b.score").alias("best"), F.col("b.source").alias("reason"), "n_sources", label.alias("label"))


def extremize(p: Column, factor: float) -> Column:
    """Odds to the power of ``factor``, back as a probability; 0 and 1 stay."""
    odds = F.pow(p / (1 - p), F.lit(factor))
    return F.when((p <= 0) | (p >= 1), p).otherwise(odds / (1 + odds))


def combine(signals: DataFrame, planned: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """plan_id, file, combined, structural, comod, semantic, confidence: the weighted mean of three sources, extremized where two agree."""
    w = weights or DEFAULT_WEIGHTS
    wide = not_planned(signals, planned).groupBy("plan_id", "file").pivot("source", list(w)).agg(F.max("score")).na.fill(0.0, list(w))
    mean = sum((w[s] * F.col(s) for s in list(w)[1:]), w[list(w)[0]] * F.col(list(w)[0])) / sum(w.values())
    agree = sum(((F.col(s) > at).cast("int") for s, at in (("comod", 0.3), ("semantic", 0.3))), (F.col("structural") > 0.5).cast("int")) >= 2
    wide = wide.withColumn("mean", mean).withColumn("value", F.when(agree, extremize(F.col("mean"), 1.3)).otherwise(F.col("mean")))
    level = F.when(F.col("structural") >= 0.8, "must").when(F.col("value") >= 0.5, "likely").when(F.col("value") >= 0.2, "consider").otherwise("unlikely")
    return wide.select("plan_id", "file", rounded(F.col("value"), 3).alias("combined"), *[rounded(F.col(s), 3).alias(s) for s in w], level.alias("confidence"))


def calibrate(predictions: DataFrame, actual: DataFrame, weights: dict[str, float] | None = None, rate: float = 0.1) -> DataFrame:
    """plan_id and the weights after one round: each moves with its signal's accuracy, is clamped to [.05, .9], and all are scaled to 1."""
    w = weights or DEFAULT_WEIGHTS
    hit = predictions.join(actual.select("plan_id", "file", F.lit(True).alias("a")), ["plan_id", "file"], "left").withColumn("a", F.coalesce("a", F.lit(False)))
    at = {"structural": 0.5}
    right = {s: F.avg(F.when(F.col(s) > 0, ((F.col(s) > at.get(s, 0.3)) == F.col("a")).cast("int"))).alias(s) for s in w}
    moved = hit.groupBy("plan_id").agg(*right.values())
    for s, x in w.items():
        moved = moved.withColumn(s, F.greatest(F.lit(0.05), F.least(F.lit(0.9), x + F.coalesce(rate * (F.col(s) - 0.5), F.lit(0.0)))))
    total = sum((F.col(s) for s in list(w)[1:]), F.col(list(w)[0]))
    return moved.withColumn("total", total).select("plan_id", *[rounded(F.col(s) / F.col("total"), 6).alias(s) for s in w])


def verified_scores(ranked: DataFrame, sites: DataFrame) -> DataFrame:
    """ranked with a boost of min(.25, half the score) where sites(file, and plan_id if it has one) has a call site, else, with no structural source, 0.7 of the score."""
    key = [c for c in ("plan_id", "file") if c in sites.columns]
    joined = ranked.join(sites.select(*key, F.lit(True).alias("seen")).distinct(), key, "left")
    weak = F.exists("sources", lambda s: s.isin("sibling", "structural", "callee"))
    score = F.when(F.col("seen"), F.least(F.lit(1.0), F.col("score") + F.least(F.lit(0.25), 0.5 * F.col("score")))).when(weak, F.col("score") * 0.7).otherwise(F.col("score"))
    return joined.withColumn("score", rounded(score, 3)).drop("seen")
