"""Outcome forecasts, maturity and novelty."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.operators.graph import blast_bucket, density_bucket
from rippleframe.operators.rank import rounded
from rippleframe.sources.scratch import discard, written


#: Cells of the grid: complexity and blast radius by logarithm, so that a ratio spans few of them, density by its reach.
COMPLEXITY_BASE = 2.0
BLAST_BASE = 3.0
DENSITY_REACH = 0.2
#: Cascades of this depth and more share a cell.
DEEPEST = 4


def _log_cell(x: Column, base: float, shift: float) -> Column:
    return F.floor(F.log(base, F.greatest(x, F.lit(0.0)) + shift)).cast("int")


def _complexity_cell(x: Column) -> Column:
    return _log_cell(x, COMPLEXITY_BASE, 4.0)


def _blast_cell(x: Column) -> Column:
    return _log_cell(x, BLAST_BASE, 1.0)


def _density_cell(x: Column) -> Column:
    return F.floor(x / DENSITY_REACH).cast("int")


def _depth_cell(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)), F.lit(DEEPEST)).cast("int")


def _meetings(plans: DataFrame, outcomes: DataFrame, dealt: tuple[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Plans (columns p_..) with outcomes of equal cells: in the grid of densities and in that of blast radii.

    ``dealt`` names a column of both sides that has to be equal too, and the number of tasks that cells are dealt to by it.
    """
    by, tasks = dealt or (None, None)
    p = plans.select(*[F.col(c).alias(f"p_{c}") for c in ("plan_id", "complexity", "density", "blast", "depth")], *([by] if by else []))
    reach = F.greatest(F.lit(3.0), F.col("p_complexity") / 2)
    from_to = lambda cell, low, high: F.explode(F.sequence(cell(low), cell(high)))
    depths = F.when(F.coalesce(F.col("p_depth"), F.lit(0)) <= 0, F.sequence(F.lit(0), F.lit(DEEPEST))).otherwise(
        F.array_distinct(F.array(F.lit(0), *[_depth_cell(F.col("p_depth") + d) for d in (-1, 0, 1)]))
    )
    spread = p.withColumn("c_cell", from_to(_complexity_cell, F.col("p_complexity") - reach, F.col("p_complexity") + reach)).withColumn("k_cell", F.explode(depths))
    placed = outcomes.withColumn("c_cell", _complexity_cell(F.col("complexity"))).withColumn("k_cell", _depth_cell(F.col("depth")))
    by_density = spread.filter("p_density IS NOT NULL").withColumn("x_cell", from_to(_density_cell, F.col("p_density") - DENSITY_REACH, F.col("p_density") + DENSITY_REACH))
    small = F.col("p_blast") <= 5
    low, high = F.when(small, 0.0).otherwise(0.3 * F.col("p_blast")), F.when(small, F.greatest(F.lit(10.0), 3.0 * F.col("p_blast"))).otherwise(3.0 * F.col("p_blast"))
    by_blast = spread.filter("p_blast IS NOT NULL").withColumn("x_cell", from_to(_blast_cell, low, high))
    cells = ["c_cell", "k_cell", "x_cell", *([by] if by else [])]
    spaced = lambda df: df.repartition(tasks, *cells) if tasks else df
    meet = lambda x, near: spaced(placed.withColumn("x_cell", x)).join(spaced(near), cells)
    return meet(_density_cell(F.col("density")), by_density), meet(_blast_cell(F.col("blast")), by_blast)


def _likeness(of: Callable[[str], Column]) -> tuple[Column, Column, Column]:
    """Whether an outcome's columns, by ``of``, are like a plan's (p_..) in complexity and depth, in density, and in blast radius."""
    gap = F.abs(of("complexity") - F.col("p_complexity"))
    like = (gap <= 3) | ((F.col("p_complexity") > 0) & (gap / F.nullif("p_complexity", F.lit(0)) < 0.5))
    dense = F.abs(of("density") - F.col("p_density")) < DENSITY_REACH
    ratio = of("blast") / F.nullif("p_blast", F.lit(0))
    blast = ((F.col("p_blast") <= 5) & (of("blast") <= 10)) | F.coalesce((F.col("p_blast") > 0) & (ratio > 0.3) & (ratio < 3.0), F.lit(False))
    deep = F.coalesce(~((F.col("p_depth") > 0) & (of("depth") > 0)) | (F.abs(of("depth") - F.col("p_depth")) <= 1), F.lit(True))
    return like & deep, dense, blast


def similar(plans: DataFrame, outcomes: DataFrame, dealt: tuple[str, int] | None = None) -> DataFrame:
    """plans(plan_id, complexity, density, blast, depth) with each outcome that resembles it.

    Complexity within 3 or half, and density within .2 or blast radius within a factor of 3
    (or both small), and cascades of much the same depth.

    Both sides lie on a grid of complexity, depth and density, and on one of complexity, depth
    and blast radius. An outcome has one cell in each, a plan all that its ranges touch; the
    joins are on equal cells, and the second leaves out what the first has, so a pair comes once
    and outcomes out of range are not compared. Null densities and blast radii are like none.
    ``dealt`` is that of ``_meetings``.
    """
    like, dense, blast = _likeness(F.col)
    by_density, by_blast = _meetings(plans, outcomes, dealt)
    both = by_density.filter(like & dense).unionByName(by_blast.filter(like & blast & ~F.coalesce(dense, F.lit(False))))
    return both.drop("c_cell", "k_cell", "x_cell").withColumnRenamed("p_plan_id", "plan_id")


_FEATURES = ("complexity", "density", "blast", "depth")


def similar_classes(plans: DataFrame, outcomes: DataFrame) -> DataFrame:
    """kind, id, class_id: every pair of ``similar``, by classes of plans and of outcomes with equal features.

    Rows of kind plan and outcome give each one's class, named after its least id; rows of kind
    alike give a class of plans (id) and a class of outcomes (class_id) whose members resemble each
    other. So rows grow with plans and outcomes, not with their product.
    """
    classes = lambda df, c: df.groupBy(*_FEATURES).agg(F.min(c).alias(c))
    p, o = classes(plans, "plan_id"), classes(outcomes, "id")

    def members(kind: str, df: DataFrame, of: DataFrame, c: str) -> DataFrame:
        named = of.select(F.col(c).alias("class_id"), *[F.col(x).alias(f"of_{x}") for x in _FEATURES])
        same = reduce(Column.__and__, (F.col(x).eqNullSafe(F.col(f"of_{x}")) for x in _FEATURES))
        return df.join(named, same).select(F.lit(kind).alias("kind"), F.col(c).alias("id"), "class_id")

    alike = similar(p, o).select(F.lit("alike").alias("kind"), F.col("plan_id").alias("id"), F.col("id").alias("class_id"))
    return members("plan", plans, p, "plan_id").unionByName(members("outcome", outcomes, o, "id")).unionByName(alike)


#: About as many plans, or outcomes, are dealt together by their ids.
HAND = 65_536
#: Tasks for each hand of outcomes.
HAND_TASKS = 16


def _hands(df: DataFrame, c: str, hands: int) -> DataFrame:
    """One row, with ids as an array, null ones too, for equal features in each hand; so a task gathers a part of a hand."""
    keys = [*_FEATURES, "hand"]
    dealt = df.withColumn("hand", F.pmod(F.xxhash64(c), F.lit(hands)).cast("int")).repartition(hands * HAND_TASKS, *keys)
    return dealt.groupBy(*keys).agg(F.transform(F.collect_list(F.struct(c)), lambda x: x[c]).alias(c))


def similar_pairs(plans: DataFrame, outcomes: DataFrame) -> DataFrame:
    """plan_id, id: the rows of ``similar``, where most plans and outcomes share their features with others.

    Rows of equal features in a hand are compared as one and their ids paired in the task where they
    meet, so what is shuffled is ids, never pairs. Each hand of outcomes is dealt to its own tasks;
    plans go to all hands.
    """
    hands = outcomes.count() // HAND + 1
    p = _hands(plans, "plan_id", plans.count() // HAND + 1).withColumn("hand", F.explode(F.sequence(F.lit(0), F.lit(hands - 1))))
    met = similar(p, _hands(outcomes, "id", hands), ("hand", hands * HAND_TASKS))
    return met.select(F.explode("plan_id").alias("plan_id"), "id").select("plan_id", F.explode("id").alias("id"))


def penalty(depth: Column, files: Column) -> Column:
    """What deep cascades over many files cost in recall."""
    return F.when((depth >= 3) & (files >= 20), 0.15).when((depth >= 2) & (files >= 10), 0.08).when((depth >= 1) & (files >= 5), 0.03).otherwise(0.0)


def percentile_at(values: Column, p: float) -> Column:
    """Element floor(p * (n - 1)) of an array, ascending."""
    return F.get(F.array_sort(values), F.floor(p * (F.size(values) - 1)).cast("int"))


_PERCENTILES = {"p50": 0.5, "p85": 0.85, "p95": 0.95}


def _class(recall: Column) -> Column:
    return F.when(recall >= 0.8, "clean").when(recall >= 0.4, "rework").otherwise("failed")


def _recalls(pool: DataFrame, key: str) -> DataFrame:
    """key, mean and percentiles of pool(key, drawn, weight): places are counted by weight, one row a distinct value."""
    values = pool.groupBy(key, "drawn").agg(F.sum("weight").alias("weight"))
    w = Window.partitionBy(key)
    ranked = values.withColumn("upto", F.sum("weight").over(w.orderBy("drawn"))).withColumn("m", F.sum("weight").over(w))
    held = lambda p: (F.floor(p * (F.col("m") - 1)) >= F.col("upto") - F.col("weight")) & (F.floor(p * (F.col("m") - 1)) < F.col("upto"))
    # Recalls are added in billionths, so the mean does not depend on their order.
    mean = F.sum(F.round(F.col("drawn") * 1e9).cast("long") * F.col("weight")) / F.sum("weight") / 1e9
    return ranked.groupBy(key).agg(rounded(mean, 2).alias("mean"), *[rounded(F.max(F.when(held(p), F.col("drawn"))), 2).alias(c) for c, p in _PERCENTILES.items()])


def _chances(pool: DataFrame, key: str) -> DataFrame:
    """key and the shares of clean, rework and failed of pool(key, outcome, recall, drawn, weight).

    Where a key has any labelled outcome, labels count and unlabelled ones go by their recall;
    otherwise all go by the recall drawn.
    """
    labelled = F.coalesce(F.col("outcome") != "", F.lit(False))
    told = pool.withColumn("told", F.max(labelled).over(Window.partitionBy(key)))
    by_label = F.when(F.col("outcome").isin("clean", "rework", "failed"), F.col("outcome")).otherwise(_class(F.col("recall")))
    classed = told.withColumn("class", F.when(F.col("told"), by_label).otherwise(_class(F.col("drawn"))))
    share = lambda c: rounded(F.sum(F.when(F.col("class") == c, F.col("weight")).otherwise(0)) / F.sum("weight"), 2).alias(f"p_{c}")
    return classed.groupBy(key).agg(*map(share, ("clean", "rework", "failed")))


def _report(found: DataFrame) -> DataFrame:
    out = found.select("plan_id", "n", "p_clean", "p_rework", "p_failed", "mean", *_PERCENTILES)
    confidence = F.when(F.col("n") >= 20, "high").when(F.col("n") >= 5, "moderate").otherwise("low")
    risk = F.when(F.col("p_failed") > 0.3, "high").when(F.col("p_rework") > 0.5, "moderate").otherwise("low")
    return out.withColumn("confidence", confidence).withColumn("risk", risk)


#: Similar outcomes without which all of history stands in.
LEAST_SIMILAR = 3


def _alike(outcomes: DataFrame) -> DataFrame:
    """Outcomes that no forecast tells apart, with their number as ``weight``."""
    return _labelled(outcomes).groupBy("complexity", "density", "blast", "depth", "recall", "outcome").agg(F.count(F.lit(1)).alias("weight"))


def _costs(plans: DataFrame) -> DataFrame:
    """plan_id, cost: the penalty of each plan; plans without cascade_files have none."""
    files = F.col("cascade_files") if "cascade_files" in plans.columns else F.lit(0)
    return plans.select("plan_id", penalty(F.col("depth"), files).alias("cost"))


def _labelled(outcomes: DataFrame) -> DataFrame:
    """Outcomes with a label, empty where there is none."""
    return outcomes.withColumn("outcome", F.coalesce("outcome", F.lit("")) if "outcome" in outcomes.columns else F.lit(""))


def _drawn(pool: DataFrame, cost: str) -> DataFrame:
    return pool.withColumn("drawn", F.greatest(F.lit(0.0), F.col("recall") - F.col(cost)))


def forecast_exact(plans: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What endless draws from a plan's similar outcomes tend to: shares of clean, rework and failed, mean and percentiles of recall.

    plans(plan_id, complexity, density, blast, depth, cascade_files). ``n`` is the number of
    similar outcomes; with fewer than three, all of history stands in, once for each penalty;
    plans get no row if that has fewer than three too.
    """
    costs = _costs(plans)
    bag = _alike(outcomes)
    pool = similar(plans, bag).select("plan_id", "recall", "outcome", "weight").groupBy("plan_id", "recall", "outcome").agg(F.sum("weight").alias("weight"))
    sizes = costs.join(pool.groupBy("plan_id").agg(F.sum("weight").alias("n")), "plan_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    own = _drawn(pool.join(sizes.filter(F.col("n") >= LEAST_SIMILAR), "plan_id"), "cost")
    mine = sizes.join(_chances(own, "plan_id"), "plan_id").join(_recalls(own, "plan_id"), "plan_id")
    every = bag.groupBy("recall", "outcome").agg(F.sum("weight").alias("weight"))
    every = _drawn(every.withColumn("cost", F.explode(F.array(*map(F.lit, (0.15, 0.08, 0.03, 0.0))))), "cost")
    enough = every.groupBy("cost").agg(F.sum("weight").alias("all")).filter(F.col("all") >= LEAST_SIMILAR).select("cost")
    whole = enough.join(_chances(every, "cost"), "cost").join(_recalls(every, "cost"), "cost")
    rest = sizes.filter(F.col("n") < LEAST_SIMILAR).join(whole, "cost")
    return _report(mine.unionByName(rest))


#: Outcomes in a run of neighbours by id, in which a draw is looked up.
RUN = 256


def _runs(outcomes: DataFrame) -> DataFrame:
    """run, rows: outcomes in the order of their ids, ``RUN`` to an array (fewer at the end of a range)."""
    kept = _labelled(outcomes).select("id", *_FEATURES, "recall", "outcome")
    # Ids of rows go up through the ranges, so runs do too.
    placed = kept.repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id())
    row = F.struct("at", *_FEATURES, "recall", "outcome")
    return placed.groupBy(F.floor(F.col("at") / RUN).alias("run")).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _in_runs(counts: DataFrame, picks: DataFrame) -> DataFrame:
    """picks(plan_id, i, ..) with the run that holds a plan's i-th outcome, and its place among the run's similar ones.

    Runs and picks are sorted together, so each pick follows the run that it lies in.
    """
    before = F.sum("n").over(Window.partitionBy("plan_id").orderBy("run")) - F.col("n")
    starts = counts.select("plan_id", before.alias("at"), F.lit(0).alias("pick"), F.struct("run", before.alias("start")).alias("in"))
    both = starts.unionByName(picks.withColumns({"at": F.col("i"), "pick": F.lit(1)}), allowMissingColumns=True)
    upto = Window.partitionBy("plan_id").orderBy("at", "pick").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("in", F.last("in", ignorenulls=True).over(upto)).filter("pick = 1")
    return held.select(*picks.columns, "in.run", (F.col("i") - F.col("in.start")).alias("place"))


def forecast_draws(plans: DataFrame, outcomes: DataFrame, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """The same from ``draws`` draws of recalls and as many of labels a plan; each is a digest of plan, draw and seed, so reruns agree.

    Outcomes of a plan are numbered by id. Plans with fewer than three similar outcomes get no row.

    A plan's similar outcomes are counted by run of ids, and only runs that a draw falls in are
    opened, so they are neither moved nor sorted for each plan.
    """
    own = written(plans.select("plan_id", *_FEATURES), "draw-plans")
    runs = written(_runs(outcomes), "draw-runs")
    counts = written(similar(own, runs.select("run", F.inline("rows"))).groupBy("plan_id", "run").agg(F.count(F.lit(1)).alias("n")), "draw-counts")
    sizes = written(counts.groupBy("plan_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_SIMILAR), "draw-sizes")
    each = sizes.select("plan_id", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("d"), "n", F.explode(F.array(F.lit("recall"), F.lit("label"))).alias("of"))
    digest = F.md5(F.concat_ws(":", "of", "plan_id", "d", F.lit(seed)))
    picks = each.select("plan_id", "of", F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.col("n")).alias("i"))
    # Draws of the same outcome are one row with a weight.
    times = lambda kind: F.count_if(F.col("of") == kind).alias(kind)
    placed = _in_runs(counts, picks.groupBy("plan_id", "i").agg(times("recall"), times("label")))
    wanted = placed.groupBy("plan_id", "run").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("recall", "label")))).alias("wanted"))
    features = own.select("plan_id", *[F.col(c).alias(f"p_{c}") for c in _FEATURES])

    def alike(o: Column) -> Column:
        like, dense, blast = _likeness(lambda c: o[c])
        return like & (F.coalesce(dense, F.lit(False)) | blast)

    met = F.transform(F.filter("rows", alike), lambda o, i: F.struct(o["recall"].alias("recall"), o["outcome"].alias("outcome"), F.element_at("wanted", i.cast("long")).alias("w")))
    opened = wanted.join(features, "plan_id").join(runs, "run").select("plan_id", F.inline(F.filter(met, lambda x: x["w"].isNotNull())))
    drawn = opened.groupBy("plan_id", "recall", "outcome").agg(F.sum("w.recall").alias("of_recall"), F.sum("w.label").alias("of_label"))
    drawn = written(_drawn(drawn.join(_costs(plans), "plan_id"), "cost"), "draw-drawn")
    discard(runs, counts, own)
    of = lambda kind: drawn.withColumn("weight", F.col(f"of_{kind}")).filter("weight > 0")
    return _report(sizes.join(_chances(of("label"), "plan_id"), "plan_id").join(_recalls(of("recall"), "plan_id"), "plan_id"))


def replicated(own: DataFrame, traces: DataFrame, seeds: DataFrame) -> DataFrame:
    """A bag of outcomes: own ones three times, traces twice, seeds once."""
    times = lambda df, n: df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return times(own, 3).unionByName(times(traces, 2)).unionByName(times(seeds, 1))


def base_rates(outcomes: DataFrame) -> DataFrame:
    """dimension, bucket, n, recall, hit_rate by kind, blast radius and test density, in one pass."""
    b = outcomes.select("recall", "kind", blast_bucket(F.col("blast")).alias("blast_b"), density_bucket(F.col("density")).alias("density_b"))
    dims = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("bucket")) for d, c in (("kind", "kind"), ("blast", "blast_b"), ("density", "density_b"))])).alias("d")
    found = b.select("recall", dims).groupBy("d.dimension", "d.bucket").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("recall"), 4).alias("recall"), rounded(F.avg((F.col("recall") > 0).cast("int")), 4).alias("hit_rate"))
    return found


def base_rate_lookup(plans: DataFrame, rates: DataFrame, kind: str = "method", least: int = 20) -> DataFrame:
    """plan_id, recall, hit_rate: by kind, overridden by blast radius, averaged with density where that has ``least`` rows."""
    r = lambda d: F.broadcast(rates.filter(F.col("dimension") == d).select(F.col("bucket").alias(f"{d}_b"), *[F.col(c).alias(f"{d}_{c}") for c in ("n", "recall", "hit_rate")]))
    keyed = plans.select("plan_id", F.lit(kind).alias("kind_b"), blast_bucket(F.col("blast")).alias("blast_b"), density_bucket(F.col("density")).alias("density_b"))
    joined = keyed.join(r("kind"), "kind_b", "left").join(r("blast"), "blast_b", "left").join(r("density"), "density_b", "left")

    def of(c: str) -> Column:
        base = F.coalesce(F.col(f"blast_{c}"), F.col(f"kind_{c}"), F.lit(0.0))
        return rounded(F.when(F.col("density_n") >= least, (base + F.col(f"density_{c}")) / 2).otherwise(base), 4).alias(c)

    return joined.select("plan_id", of("recall"), of("hit_rate"))


def maturity(projects: DataFrame) -> DataFrame:
    """projects(commits, age_days, density, files, graph) -> score, label and how far each signal can be relied on."""
    share = lambda c, cap: F.least(F.col(c) / cap, F.lit(1.0))
    score = rounded(share("commits", 200) * 0.3 + share("age_days", 365) * 0.2 + share("density", 0.60) * 0.3 + share("files", 50) * 0.1 + F.when(F.col("graph"), 0.1).otherwise(0.0), 2)
    s = F.col("score")
    label = F.when(s < 0.2, "nascent").when(s < 0.4, "growing").when(s < 0.7, "established").otherwise("mature")
    verify = F.when(s < 0.2, "backward-scout").when(s < 0.4, "bidirectional").when(s < 0.7, "combined-model").otherwise("full-forecast")
    structural = F.when(~F.col("graph"), "unavailable").when(F.col("files") < 5, "weak").when(F.col("density") < 0.2, "moderate").otherwise("strong")
    comod = F.when(F.col("commits") < 10, "unavailable").when(F.col("commits") < 50, "weak").when(F.col("commits") < 200, "moderate").otherwise("strong")
    return projects.withColumn("score", score).withColumns({"label": label, "structural": structural, "comod": comod, "verification": verify})


def novelty(plans: DataFrame) -> DataFrame:
    """plans(modify array, create array) -> score, label, uncertainty; new directories lift the score to .3 at least."""
    n, m = F.size("create"), F.size("modify")
    dirs = F.size(F.array_distinct(F.filter(F.transform("create", lambda f: F.regexp_replace(f, "/?[^/]*$", "")), lambda d: d != "")))
    score = F.when(n + m == 0, F.lit(0.5)).otherwise(n / F.nullif(n + m, F.lit(0)))
    s = F.col("score")
    step = lambda a, b, c, d: F.when(s < 0.15, a).when(s < 0.4, b).when(s < 0.7, c).otherwise(d)
    return plans.withColumn("score", F.when(dirs > 0, score * 0.7 + 0.3).otherwise(score)).withColumns(
        {"label": step("routine", "extension", "novel", "exploratory"), "uncertainty": step("narrow", "moderate", "wide", "very wide")}
    )


def complexity(steps: Column, files: Column) -> Column:
    return F.greatest(F.size(steps), F.size(files))
