"""Back-test statistics: set metrics, resampling, strata and grid search. predicted and actual are (task_id, file)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.operators.quantile import numbered
from rippleframe.operators.rank import rounded


def compared(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """task_id, file, verdict: hit, extra (predicted alone) or miss (actual alone)."""
    p, a = predicted.select("task_id", "file", F.lit(True).alias("p")).distinct(), actual.select("task_id", "file", F.lit(True).alias("a")).distinct()
    both = p.join(a, ["task_id", "file"], "full_outer")
    return both.select("task_id", "file", F.when(F.col("p") & F.col("a"), "hit").when(F.col("p"), "extra").otherwise("miss").alias("verdict"))


def set_metrics(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """task_id, hits, extras, misses, precision, recall, f1, brier (over the union, predictions taken as 1)."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    counts = compared(predicted, actual).groupBy("task_id").agg(n("hit").alias("hits"), n("extra").alias("extras"), n("miss").alias("misses"))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    h, e, m = F.col("hits"), F.col("extras"), F.col("misses")
    out = counts.withColumns({"precision": over(h, h + e), "recall": over(h, h + m), "brier": over(e + m, h + e + m)})
    return out.withColumn("f1", over(2 * h, 2 * h + e + m))


def summary(metrics: DataFrame) -> DataFrame:
    """One row: tasks, mean precision, recall and F1, and the share of tasks with a hit."""
    return metrics.agg(
        F.count(F.lit(1)).alias("tasks"), *[rounded(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")], rounded(F.avg((F.col("hits") > 0).cast("int")), 4).alias("hit_rate")
    )


def lift(base: DataFrame, model: DataFrame) -> DataFrame:
    """improved, worsened, lift: of task recalls (task_id, recall) from one model to another."""
    d = base.select("task_id", F.col("recall").alias("r0")).join(model.select("task_id", "recall"), "task_id").withColumn("d", F.col("recall") - F.col("r0"))
    return d.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") < 0).alias("worsened"), rounded(F.avg("d"), 4).alias("lift"))


def difficulty(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 10, "4-10").when(n <= 50, "11-50").otherwise(">50")


def file_count(n: Column) -> Column:
    return F.when(n >= 6, "6+").otherwise(n.cast("string"))


def stratified(metrics: DataFrame, bucket: Column, least: int = 5) -> DataFrame:
    """bucket, tasks, recall, for buckets of ``least`` tasks or more."""
    return metrics.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("tasks"), rounded(F.avg("recall"), 4).alias("recall")).filter(F.col("tasks") >= least)


def alternating(metrics: DataFrame) -> DataFrame:
    """half, tasks, recall: tasks in order of id dealt in turn, without one sort of all."""
    placed = numbered(metrics.select("task_id", "recall"), ["task_id"])
    return placed.withColumn("half", F.when(F.col("row_no") % 2 == 1, "first").otherwise("second")).groupBy("half").agg(F.count(F.lit(1)).alias("tasks"), rounded(F.avg("recall"), 4).alias("recall"))


#: Chances that a Poisson variable of mean 1 is at most 0, 1, 2, ..; beyond them it is taken as the next.
_AT_MOST = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]


def bootstrap(values: DataFrame, column: str, resamples: int = 1000, seed: int = 42, key: str = "task_id") -> DataFrame:
    """mean, lo, hi: the mean of a column and the 95 % interval of it over resamples of the rows.

    A Poisson bootstrap: in each resample a row counts as often as a Poisson variable of mean 1
    says, which a digest of seed, resample and the row's key decides; so one pass with sums a
    resample does, rows need no numbers, and reruns agree. A digest serves four resamples. Values
    are added in billionths, so the order of rows does not matter. Nulls are left out.
    """
    v = values.filter(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.round(F.col(column) * 1e9).cast("long").alias("x"))
    blocks = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // 4) - 1)))).withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "block", "k")))
    each = blocks.select("x", "h", F.posexplode(F.array(*[F.substring("h", 8 * j + 1, 8) for j in range(4)])).alias("j", "part"), "block").withColumn("b", 4 * F.col("block") + F.col("j")).filter(F.col("b") < resamples)
    u = F.conv("part", 16, 10).cast("long") / (1 << 32)
    times = F.lit(0)
    for p in _AT_MOST:
        times = times + (u >= p).cast("int")
    means = each.withColumn("times", times).groupBy("b").agg((F.sum(F.col("x") * F.col("times")) / F.nullif(F.sum("times"), F.lit(0)) / 1e9).alias("m"))
    # One value a resample.
    sorted_means = means.agg(F.array_sort(F.array_compact(F.collect_list("m"))).alias("ms"))
    at = lambda p: F.get("ms", F.floor(F.lit(p) * F.size("ms")).cast("int"))
    return v.agg((F.avg("x") / 1e9).alias("mean")).join(sorted_means.select(at(0.025).alias("lo"), at(0.975).alias("hi")), F.lit(True))


def paired_difference(base: DataFrame, model: DataFrame, resamples: int = 1000) -> DataFrame:
    """mean, lo, hi of the difference of task recalls, and whether the interval leaves 0 out."""
    d = base.select("task_id", F.col("recall").alias("r0")).join(model.select("task_id", "recall"), "task_id").select("task_id", (F.col("recall") - F.col("r0")).alias("d"))
    return bootstrap(d, "d", resamples).withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def grid_search(scored: DataFrame, actual: DataFrame, grid: list[float], at: float = 0.5) -> DataFrame:
    """scored(task_id, file, a, b): for each weight w the mean recall of files with w * a + (1 - w) * b of ``at`` or more, and which is best."""
    # The grid is a handful of weights: one count each in the row of a task, so no row is repeated for them.
    held = scored.join(actual.select("task_id", "file").distinct(), ["task_id", "file"], "left_semi")
    best = held.groupBy("task_id", "file").agg(*[F.max(w * F.col("a") + (1 - w) * F.col("b") >= at).alias(f"h{i}") for i, w in enumerate(grid)])
    hits = best.groupBy("task_id").agg(*[F.count_if(f"h{i}").alias(f"h{i}") for i in range(len(grid))])
    truth = actual.groupBy("task_id").agg(F.countDistinct("file").alias("n")).join(hits, "task_id", "left")
    share = lambda i: F.avg(F.coalesce(F.col(f"h{i}") / F.col("n"), F.lit(0.0)))
    means = truth.agg(F.count(F.lit(1)).alias("n"), *[rounded(share(i), 4).alias(f"h{i}") for i in range(len(grid))]).filter("n > 0")
    by = means.select(F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"h{i}").alias("recall")) for i, w in enumerate(grid)])).alias("g")).select("g.w", "g.recall")
    first = F.row_number().over(Window.orderBy(F.desc("recall"), "w")) == 1
    return by.withColumn("best", first)


def by_repo(metrics: DataFrame) -> DataFrame:
    """repo (null: all), tasks, graph, combined and the lift of the second over the first."""
    found = metrics.rollup("repo").agg(F.count(F.lit(1)).alias("tasks"), rounded(F.avg("graph"), 4).alias("graph"), rounded(F.avg("combined"), 4).alias("combined"))
    return found.withColumn("lift", rounded(F.col("combined") / F.nullif("graph", F.lit(0.0)) - 1, 4))


def exploration_waste(steps: DataFrame) -> DataFrame:
    """steps(session, pos, action, file) -> files opened and never edited, as a share, and steps spent on them.

    A step without a file belongs to the file opened last.
    """
    w = Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = steps.withColumn("open", F.last(F.when(F.col("action") == "open", F.col("file")), ignorenulls=True).over(w)).filter("open IS NOT NULL")
    files = held.groupBy("session", "open").agg(F.count(F.lit(1)).alias("steps"), F.max((F.col("action") == "edit").cast("int")).alias("edited"))
    return files.groupBy("session").agg(
        F.count(F.lit(1)).alias("opened"), F.count_if(F.col("edited") == 0).alias("wasted"), F.sum(F.when(F.col("edited") == 0, F.col("steps")).otherwise(0)).alias("wasted_steps"),
        rounded(F.avg(1 - F.col("edited")), 4).alias("waste"),
    )


def diff_magnitude(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, changed: lines of either text that the other lacks, as a multiset, over the longer's lines; (id, line) rows."""
    n = lambda df, c: df.groupBy("id", "line").agg(F.count(F.lit(1)).alias(c))
    both = n(before, "x").join(n(after, "y"), ["id", "line"], "full_outer").na.fill(0, ["x", "y"])
    sums = both.groupBy("id").agg(F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("gone"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("new"), F.greatest(F.sum("x"), F.sum("y")).alias("most"))
    return sums.select("id", rounded(F.greatest("gone", "new") / F.col("most"), 4).alias("changed"))


def union_of(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, (s.select("task_id", "file") for s in sets)).distinct()


def gold_matches(gold: DataFrame, plans: DataFrame, tasks: int | None = None) -> DataFrame:
    """gold(task_id, path), plans(task_id, path) -> task_id, path, matched, how: for each gold file the planned file it is met by, null without one.

    The whole path comes first, then one path that ends in the other, then a base name that one
    planned file alone has; among several the least path. Ends of paths are keys of equal
    joins, so a task's files are not compared pair by pair. Slashes at either end do not count;
    a planned file may meet several gold files.
    """
    side = lambda df, gold: df.select("task_id", F.trim(F.col("path"), F.lit("/")).alias("path"), F.lit(gold).alias("gold"))
    # Both sides are dealt by task once and meet where they lie.
    both = side(gold, True).unionByName(side(plans, False)).repartition(*([tasks] if tasks else []), "task_id").distinct()
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.lit("end").alias("kind"), F.array_join(F.slice(parts, n, F.size(parts)), "/").alias("key")))
    base = F.array(F.struct(F.lit("base").alias("kind"), F.regexp_replace("path", "^.*/", "").alias("key")))
    keyed = both.select("task_id", "path", "gold", F.inline_outer(F.concat(ends, base)))
    same, planned, whole = Window.partitionBy("task_id", "kind", "key"), ~F.col("gold") & F.col("task_id").isNotNull(), F.col("path") == F.col("key")
    least = lambda when, how: F.min(F.when(planned & when, F.struct(how.alias("how"), F.col("path").alias("matched")))).over(same)
    met = keyed.withColumns({"any": least(F.lit(True), F.when(whole, 0).otherwise(1)), "exact": F.max(planned & whole).over(same), "n": F.count_if(planned).over(same)}).filter("gold")
    longer = F.when(whole, F.col("any"))
    shorter = F.when(F.col("exact") & ~whole, F.struct(F.lit(1).alias("how"), F.col("key").alias("matched")))
    named = F.when(F.col("n") == 1, F.struct(F.lit(2).alias("how"), F.col("any.matched").alias("matched")))
    best = met.groupBy("task_id", "path").agg(F.min(F.when(F.col("kind") == "base", named).otherwise(F.coalesce(longer, shorter))).alias("b"))
    said = F.when(F.col("b.how") == 0, "exact").when(F.col("b.how") == 1, "suffix").when(F.col("b.how") == 2, "basename")
    return best.select("task_id", "path", F.col("b.matched").alias("matched"), said.alias("how"))


def gold_scores(gold: DataFrame, plans: DataFrame, tasks: int | None = None) -> DataFrame:
    """task_id, gold, hits, recall, precision, f1 of ``gold_matches``, for tasks with gold files."""
    found = gold_matches(gold, plans, tasks).groupBy("task_id").agg(F.count(F.lit(1)).alias("gold"), F.count("matched").alias("hits"))
    sizes = plans.select("task_id", F.trim(F.col("path"), F.lit("/")).alias("path")).distinct().groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    both = found.join(sizes, "task_id", "left")
    share = lambda x: F.coalesce(F.col("hits") / F.nullif(x, F.lit(0)), F.lit(0.0))
    r, p = share(F.col("gold")), share(F.col("n"))
    return both.select("task_id", "gold", "hits", r.alias("recall"), p.alias("precision"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))
