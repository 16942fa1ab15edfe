"""The product's questions, for many plans at once: suggest, review, check, validate. plans are (plan_id, file) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.functions.text import suggest_confidence
from rippleframe.operators import rank


def _ends(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """from_file, to_file and from_test, once a pair of definitions, between different files."""
    a = defs.select(F.col("id").alias("from_def"), F.col("source_file").alias("from_file"), F.col("is_test").alias("from_test"))
    b = defs.select(F.col("id").alias("to_def"), F.col("source_file").alias("to_file"), F.col("is_test").alias("to_test"))
    return refs.join(a, "from_def").join(b, "to_def").filter("from_file <> to_file")


def file_links(refs: DataFrame, defs: DataFrame, confidences: DataFrame, least: float = 0.3) -> DataFrame:
    """own, file, callers (references from file), callees (references to it), confidence (from ``least`` on): what ties other files to a file.

    One row a pair of files, whatever the number of plans.
    """
    between = _ends(refs, defs).filter("NOT from_test").groupBy("from_file", "to_file").agg(F.count(F.lit(1)).alias("n"))
    sides = F.inline(F.array(
        F.struct(F.col("to_file").alias("own"), F.col("from_file").alias("file"), F.col("n").alias("callers"), F.lit(None).cast("long").alias("callees")),
        F.struct(F.col("from_file").alias("own"), F.col("to_file").alias("file"), F.lit(None).cast("long").alias("callers"), F.col("n").alias("callees")),
    ))
    near = confidences.filter(F.col("confidence") >= least).select(F.col("file_a").alias("own"), F.col("file_b").alias("file"), "confidence")
    return between.select(sides).unionByName(near, allowMissingColumns=True).groupBy("own", "file").agg(F.sum("callers").alias("callers"), F.sum("callees").alias("callees"), F.max("confidence").alias("confidence"))


def suggest_linked(plans: DataFrame, links: DataFrame, split: bool = True, most: float = 0.8, k: int = 10, tasks: int | None = None) -> DataFrame:
    """Files of two sources that the plan lacks, by ``file_links``: plan_id, file, best, reason, n_sources, label.

    Callers score .4 + .1 each (.8 at most), with ``split`` callees with three references .3, co-change
    the highest confidence (``most`` at most). A plan is one row with its files, so what is linked to
    them is counted where the plan lies and only plans are shuffled; ``tasks`` bounds those of a task.
    """
    dealt = plans.repartition(tasks, "plan_id") if tasks else plans
    own = dealt.groupBy("plan_id").agg(F.collect_set("file").alias("files"))
    met = own.select("plan_id", "files", F.explode("files").alias("own")).join(links, "own").filter(~F.array_contains("files", F.col("file")))
    sums = met.groupBy("plan_id", "file").agg(F.sum("callers").alias("callers"), F.sum("callees").alias("callees"), F.max("confidence").alias("c"))
    source = lambda when, score, name: F.when(when, F.struct(score.cast("double").alias("score"), F.lit(name).alias("source")))
    told = [source(F.col("callers").isNotNull(), suggest_confidence(F.col("callers")), "graph-caller" if split else "graph"), source(F.col("c").isNotNull(), F.least("c", F.lit(most)), "comod")]
    if split:
        told.append(source(F.col("callees") >= 3, F.lit(0.3), "graph-callee"))
    found = sums.select("plan_id", "file", F.array_compact(F.array(*told)).alias("told"))
    return rank.best_of_plans(found.select("plan_id", "file", F.array_max("told").alias("b"), F.size("told").cast("long").alias("n_sources")).filter("n_sources >= 2"), k)


def build_signals(errors: DataFrame) -> DataFrame:
    """errors(plan_id, file) of a compiler probe, at .95."""
    return errors.select("plan_id", "file", F.lit("build-check").alias("source"), F.lit(0.95).alias("score")).distinct()


def suggest(plans: DataFrame, signals: DataFrame, k: int = 10) -> DataFrame:
    """Files of two sources or a failed build that the plan lacks: plan_id, file, best, reason, n_sources, label."""
    return rank.source_count_gate(signals.join(plans, ["plan_id", "file"], "left_anti"), 2, k)


def list_findings(lists: DataFrame, files: DataFrame) -> DataFrame:
    """lists(plan_id, kind, path): kind is read, modify or create -> plan_id, path, finding.

    missing: to be read or changed, but neither there nor to be created; directory: a directory,
    not a file; exists: to be created, but there; overlap: both changed and created. Empty paths are ignored.
    """
    asked = lists.filter("path <> ''").distinct()
    there = asked.join(files.select("path", F.lit(True).alias("file")).distinct(), "path", "left").join(files.select(F.col("dir").alias("path"), F.lit(True).alias("is_dir")).distinct(), "path", "left")
    per = there.groupBy("plan_id", "path").agg(F.collect_set("kind").alias("kinds"), F.max("file").alias("file"), F.max("is_dir").alias("is_dir"))
    has = lambda k: F.array_contains("kinds", k)
    found = F.array_compact(F.array(
        F.when(F.coalesce("is_dir", F.lit(False)), "directory"), F.when(has("create") & F.coalesce("file", F.lit(False)), "exists"), F.when(has("create") & has("modify"), "overlap"),
        F.when((has("read") | has("modify")) & ~has("create") & F.col("file").isNull() & F.col("is_dir").isNull(), "missing"),
    ))
    return per.select("plan_id", "path", F.explode(found).alias("finding"))


def semantic_levels(suggestions: DataFrame, links: DataFrame) -> DataFrame:
    """suggestions(plan_id, file, confidence) with links(plan_id, file, n) -> level: must with links, likely from .7, else consider."""
    joined = suggestions.join(links, ["plan_id", "file"], "left")
    return joined.select("plan_id", "file", F.when(F.coalesce("n", F.lit(0)) > 0, "must").when(F.col("confidence") >= 0.7, "likely").otherwise("consider").alias("level"))


def collapsed(signals: DataFrame, most: int = 5) -> DataFrame:
    """plan_id, kind, n, files: signals of a kind about one target listed while there are few, else the first three named."""
    w = Window.partitionBy("plan_id", "kind").orderBy("file")
    ranked = signals.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("plan_id", "kind"))).withColumn("r", F.row_number().over(w))
    kept = ranked.filter((F.col("n") <= most) | (F.col("r") <= 3))
    return kept.groupBy("plan_id", "kind").agg(F.max("n").alias("n"), F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))


def greenfield(plans: DataFrame, files: DataFrame, least: int = 3) -> DataFrame:
    """plan_id, greenfield: whether the directories of a plan hold fewer than ``least`` files."""
    dirs = files.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    own = plans.select("plan_id", F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).distinct().join(dirs, "dir", "left")
    return own.groupBy("plan_id").agg((F.coalesce(F.sum("n"), F.lit(0)) < least).alias("greenfield"))


def execution_report(plans: DataFrame, actual: DataFrame) -> DataFrame:
    """plan_id, planned, changed, untouched, unplanned, precision, recall, verdict."""
    p, a = plans.select("plan_id", "file", F.lit(1).alias("p")).distinct(), actual.select("plan_id", "file", F.lit(1).alias("a")).distinct()
    n = F.count_if
    both = p.join(a, ["plan_id", "file"], "full_outer").groupBy("plan_id").agg(
        n(F.col("p").isNotNull()).alias("planned"), n(F.col("a").isNotNull()).alias("changed"), n(F.col("p").isNotNull() & F.col("a").isNull()).alias("untouched"), n(F.col("p").isNull()).alias("unplanned")
    )
    hits = F.col("planned") - F.col("untouched")
    share = lambda x, y: rank.rounded(F.coalesce(x / F.nullif(F.col(y), F.lit(0)), F.lit(0.0)), 3)
    out = both.withColumn("precision", share(hits, "planned")).withColumn("recall", share(hits, "changed"))
    return out.withColumn("verdict", F.when(F.col("recall") >= 0.8, "clean").when(F.col("recall") >= 0.4, "rework").otherwise("failed"))


def check(plans: DataFrame, signals: DataFrame, files: DataFrame, forecasts: DataFrame, novelty: float = 0.0, k: int = 5) -> DataFrame:
    """plan_id, n_findings, ranked (array of file:score, ``k`` at most), p_failed: one row a plan."""
    planned = plans.select("plan_id", "file").distinct()
    best = rank.top_k(rank.rank(signals, planned, novelty), k)
    listed = best.groupBy("plan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file", "score"))), lambda x: F.concat_ws(":", x["file"], x["score"])).alias("ranked"))
    found = list_findings(plans.select("plan_id", F.lit("modify").alias("kind"), F.col("file").alias("path")), files).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_findings"))
    out = planned.select("plan_id").distinct().join(found, "plan_id", "left").join(listed, "plan_id", "left").join(forecasts.select("plan_id", "p_failed"), "plan_id", "left")
    return out.select("plan_id", F.coalesce("n_findings", F.lit(0).cast("long")).alias("n_findings"), F.array_join(F.coalesce("ranked", F.array().cast("array<string>")), ",").alias("ranked"), "p_failed")


def envelope(items: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """Of each key the first ``k`` items, with how many there are and how many are shown."""
    w = Window.partitionBy(key)
    ranked = items.withColumn("total", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(order))).filter(F.col("r") <= k)
    return ranked.withColumn("showing", F.least("total", F.lit(k))).drop("r")
