"""Recency, churn, patterns and calibration over event logs; windows are partitioned by a key, never global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.operators.rank import rounded


def tail_n(events: DataFrame, key: str, n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def recency_weight(key: str, *order: str) -> Column:
    """``1 + (ordinal - 1) / count`` within each key."""
    w = Window.partitionBy(key)
    return 1 + (F.row_number().over(w.orderBy(*order)) - 1) / F.count(F.lit(1)).over(w)


def recency_mean(events: DataFrame, key: str) -> DataFrame:
    """Mean of ``value`` by linear recency weight."""
    found = events.filter("value IS NOT NULL").withColumn("w", recency_weight(key, "ts", "event_id")).groupBy(key)
    return found.agg(rounded(F.sum(F.col("value") * F.col("w")) / F.sum("w"), 3).alias("weighted"))


def calibration_summary(entries: DataFrame, key: str = "project", keep: int = 100) -> DataFrame:
    """entries(key, id, recall, precision_, brier, confidence): of the newest ``keep`` the weighted means, the hit rate and the recall by confidence."""
    newest = entries.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("id")))).filter(F.col("r") <= keep)
    weighted = newest.withColumn("w", recency_weight(key, "id"))
    mean = lambda c: rounded(F.sum(F.col(c) * F.col("w")) / F.sum("w"), 3)
    by = [rounded(F.coalesce(F.avg(F.when(F.col("confidence") == c, F.col("recall"))), F.lit(0.0)), 3).alias(f"{c}_recall") for c in ("high", "moderate", "low")]
    return weighted.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), mean("recall").alias("avg_recall"), mean("precision_").alias("avg_precision"), mean("brier").alias("avg_brier"),
        rounded(F.avg((F.col("recall") > 0).cast("int")), 3).alias("hit_rate"), *by,
    )


def churn(events: DataFrame, key: str, days: int, least: int) -> DataFrame:
    """Keys with ``least`` or more rows in the last ``days`` before the newest row."""
    newest = events.agg(F.max("ts").alias("newest"))
    recent = events.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("changes")).filter(F.col("changes") >= least)


def carry_forward(turns: DataFrame) -> DataFrame:
    """conv_id, turn, opened: the turn of the user's latest message so far."""
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    return turns.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("opened"))


def recurring_misses(checks: DataFrame, last: int = 10, days: int = 7, least: int = 2) -> DataFrame:
    """checks(project, event_id, ts, misses array) -> project, file, times: files missed by ``least`` of the last checks.

    A check counts a file once; names that start with "<" are placeholders.
    """
    newest = Window.partitionBy("project")
    fresh = checks.withColumn("newest", F.max("ts").over(newest)).filter(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {days} DAYS"))
    fresh = fresh.withColumn("r", F.row_number().over(newest.orderBy(F.desc("ts"), F.desc("event_id")))).filter(F.col("r") <= last)
    each = fresh.select("project", "event_id", F.explode(F.array_distinct("misses")).alias("file")).filter("NOT startswith(file, '<')")
    return each.groupBy("project", "file").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= least)


def layer_effectiveness(reflections: DataFrame, last: int = 5, least: int = 3) -> DataFrame:
    """reflections(project, event_id, ts, probe, persona, outcome) -> sums over the last of each project that has ``least``, and advice."""
    w = Window.partitionBy("project")
    kept = reflections.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))))
    found = kept.filter((F.col("n") >= least) & (F.col("r") <= last)).groupBy("project").agg(
        F.count(F.lit(1)).alias("reflections"), F.sum("probe").alias("probe"), F.sum("persona").alias("persona"), F.count_if(F.col("outcome").isin("rework", "failed")).alias("reworks")
    ).filter("probe + persona > 0")
    return found.withColumn("advice", F.when(F.col("persona") == 0, "personas found nothing").when(F.col("probe") == 0, "probes found nothing").otherwise("both"))


def enriched(checks: DataFrame, outcomes: DataFrame, reflections: DataFrame) -> DataFrame:
    """Each check with its latest outcome and reflection: (project, k) is the id; the last one by event wins."""
    last = lambda df, c: df.groupBy("project", "k").agg(F.max_by(c, "event_id").alias(c))
    return checks.join(last(outcomes, "outcome"), ["project", "k"], "left").join(last(reflections, "passes"), ["project", "k"], "left")


def stats(outcomes: DataFrame, key: str = "project") -> DataFrame:
    """Outcome counts, whole percentages and a verdict for each project."""
    n = F.count(F.lit(1))
    counts = outcomes.groupBy(key).agg(n.alias("n"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("clean", "rework", "failed")])
    pct = lambda c: F.floor(F.col(c) * 100 / F.col("n")).cast("long").alias(f"{c}_pct")
    out = counts.select(key, "n", "clean", "rework", "failed", pct("clean"), pct("rework"), pct("failed"))
    return out.withColumn("verdict", F.when(F.col("n") < 5, "too few").when(F.col("clean_pct") >= 50, "working").when(F.col("failed_pct") > 30, "failing").otherwise("mixed"))


def session_index(calls: DataFrame) -> DataFrame:
    """calls(session, tool, file) -> distinct files read, edited and created, calls, and the share of reads that led to no change."""
    files = lambda tool: F.collect_set(F.when(F.col("tool") == tool, F.col("file")))
    found = calls.groupBy("session").agg(F.count(F.lit(1)).alias("calls"), files("Read").alias("r"), files("Edit").alias("e"), files("Write").alias("c"))
    idle = F.size(F.array_except("r", F.array_union("e", "c")))
    return found.select("session", "calls", *[F.size(x).cast("long").alias(n) for x, n in (("r", "files_read"), ("e", "files_edited"), ("c", "files_created"))], F.coalesce(idle / F.nullif(F.size("r"), F.lit(0)), F.lit(0.0)).alias("exploration"))


def first_of(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("r_ = 1").drop("r_")
