"""What plans leave out by co-change and by the graph, as one list; and what an agent's searches point to. planned is (plan_id, file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.functions.text import basename, confidence_level, is_cross_stack, is_test_file
from rippleframe.sources.scratch import written

# Ranks of an agent's tools, and the scores that go with them.
TOOL_RANK = {"code": 3, "constructors": 3, "read": 2, "find": 1}
RANK_SCORE = {3: 0.50, 2: 0.45, 1: 0.30}


def blast_links(refs: DataFrame, defs: DataFrame, least: float = 0.1) -> DataFrame:
    """plan_file, file, b (frequency, callers): the highest share of callers of an exported definition of one file that another holds."""
    to = defs.filter("exported AND NOT is_test").select(F.col("id").alias("to_def"), F.col("source_file").alias("plan_file"))
    edges = refs.join(to, "to_def").join(defs.select(F.col("id").alias("from_def"), F.col("source_file").alias("file"), F.col("is_test").alias("from_test")), "from_def")
    # Callers are counted by definition and file first, so a definition that very many call is folded before the shuffle.
    each = edges.groupBy("to_def", "plan_file", "file").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("from_test")).alias("callers"))
    total = each.groupBy("to_def").agg(F.sum("n").alias("total"))
    share = each.filter("callers > 0").join(total, "to_def").withColumn("frequency", F.col("callers") / F.col("total")).filter(F.col("frequency") >= least)
    return share.groupBy("plan_file", "file").agg(F.max(F.struct("frequency", "callers")).alias("b"))


def _level(frequency: Column, callers: Column) -> Column:
    return F.when((frequency > 0.5) | (callers >= 5), "high").otherwise("moderate")


def _met(plans: DataFrame, links: DataFrame) -> DataFrame:
    """plans(plan_id, files ..) with links(plan_file, file ..) of their files to files that they lack.

    A plan is one row, so it is not moved for what it meets if ``links`` are few.
    """
    return plans.withColumn("plan_file", F.explode("files")).join(links, "plan_file").filter(~F.array_contains("files", F.col("file"))).drop("files")


def _by_plan(planned: DataFrame, tasks: int | None = None) -> DataFrame:
    dealt = planned.repartition(tasks, "plan_id") if tasks else planned
    return dealt.groupBy("plan_id").agg(F.collect_set("file").alias("files"))


def blast_gaps(refs: DataFrame, defs: DataFrame, planned: DataFrame, least: float = 0.1) -> DataFrame:
    """plan_id, plan_file, file, callers, frequency, confidence: for each plan the files outside it that hold enough callers of its exported definitions.

    A file's share of a definition's callers is counted once for all plans; of a plan and file the highest counts.
    """
    found = _met(_by_plan(planned), written(blast_links(refs, defs, least), "blast-links"))
    top = found.groupBy("plan_id", "file").agg(F.max(F.struct("b.frequency", "b.callers", "plan_file")).alias("b"))
    return top.select("plan_id", "b.plan_file", "file", "b.callers", "b.frequency").withColumn("confidence", _level(F.col("frequency"), F.col("callers")))


def _comod_links(confidences: DataFrame, threshold: float) -> DataFrame:
    """plan_file, file, often, cross_stack: partners at the threshold or more that are no tests."""
    pairs = confidences.filter(F.col("confidence") >= threshold).select(F.col("file_a").alias("plan_file"), F.col("file_b").alias("file"), F.col("confidence").alias("often"))
    return pairs.filter(~is_test_file(F.col("file"))).withColumn("cross_stack", is_cross_stack(F.col("plan_file"), F.col("file")))


def _acknowledging(planned: DataFrame, acks: DataFrame, tasks: int | None = None) -> DataFrame:
    """plan_id, files, said: each plan's files and its reasons by path."""
    own = acks.filter("reason <> '' AND file IS NOT NULL").groupBy("plan_id", "file").agg(F.min("reason").alias("reason"))
    said = own.groupBy("plan_id").agg(F.map_from_entries(F.collect_list(F.struct("file", "reason"))).alias("said"))
    return _by_plan(planned, tasks).join(said, "plan_id", "left")


def _told(met: DataFrame) -> DataFrame:
    """Partners with the reason by path, else by base name."""
    reason = F.coalesce(F.element_at("said", F.col("file")), F.element_at("said", basename(F.col("file"))))
    return met.withColumn("reason", F.when(F.col("often").isNotNull(), reason)).drop("said")


def _merged(rows: DataFrame, least_hub: int, hub_share: float) -> DataFrame:
    """rows(plan_id, plan_file, file, often, cross_stack, reason, b): co-change where often is given, the graph where b (frequency, callers, plan_file, confidence) is."""
    each, plan, near = Window.partitionBy("plan_id", "file"), Window.partitionBy("plan_id"), F.col("often").isNotNull()
    counted = rows.withColumn("n", F.count("often").over(each)).withColumn("top", F.max("b").over(each))
    kept = counted.withColumn("pointing", F.size(F.collect_set(F.when(near, F.col("plan_file"))).over(plan))).filter("often IS NOT NULL OR n = 0 AND b = top")
    hub = (F.col("n") >= least_hub) | (F.col("n") / F.nullif("pointing", F.lit(0)) >= hub_share)
    out = kept.select(
        "plan_id", "plan_file", "file", F.coalesce("often", "b.frequency").alias("frequency"), F.when(near, confidence_level(F.col("often"))).otherwise(F.col("b.confidence")).alias("confidence"),
        F.when(near, F.col("cross_stack")).otherwise(F.lit(False)).alias("cross_stack"), F.when(near, hub).otherwise(F.lit(False)).alias("hub"), "reason", F.when(near, "comod").otherwise("refgraph").alias("source"),
    )
    order = Window.partitionBy("plan_id").orderBy(F.when(F.col("confidence") == "high", 0).otherwise(1), F.desc("frequency"), "file", "plan_file")
    return out.withColumn("place", F.row_number().over(order))


def merged_gaps(confidences: DataFrame, blast: DataFrame, planned: DataFrame, acks: DataFrame, threshold: float, least_hub: int = 3, hub_share: float = 0.6) -> DataFrame:
    """plan_id, plan_file, file, frequency, confidence, cross_stack, hub, reason, source, place.

    Co-change partners of planned files at the threshold or more come first: those that the plan
    lacks and that are no tests, marked as hubs where ``least_hub`` planned files point to them
    or ``hub_share`` of those that point anywhere, and with the reason of acks(plan_id, file,
    reason) by path, else by base name. Gaps of the graph, ``blast``, follow only for files without one.
    Places go by high confidence first, then by frequency.
    """
    near = _told(_met(_acknowledging(planned, acks), _comod_links(confidences, threshold)))
    far = blast.select("plan_id", "plan_file", "file", F.struct("frequency", "callers", "plan_file", "confidence").alias("b"))
    return _merged(near.unionByName(far, allowMissingColumns=True), least_hub, hub_share)


def plan_gaps(confidences: DataFrame, links: DataFrame, planned: DataFrame, acks: DataFrame, threshold: float, least_hub: int = 3, hub_share: float = 0.6, tasks: int | None = None) -> DataFrame:
    """``merged_gaps`` with those of the graph by ``blast_links``: plans meet both in one table, a row a pair of files.

    ``tasks`` bounds the plans, and so the gaps, that one of them sorts.
    """
    both = _comod_links(confidences, threshold).join(links, ["plan_file", "file"], "full_outer")
    b = F.struct("b.frequency", "b.callers", "plan_file", _level(F.col("b.frequency"), F.col("b.callers")).alias("confidence"))
    met = _met(_acknowledging(planned, acks, tasks), written(both.withColumn("b", F.when(F.col("b").isNotNull(), b)), "gap-links"))
    return _merged(_told(met), least_hub, hub_share)


def hub_explosions(gaps: DataFrame, least: int = 5, named: int = 3) -> DataFrame:
    """plan_id, hubs, files: plans with ``least`` hub files or more, and the first ``named`` of them by name."""
    hubs = gaps.filter("hub").select("plan_id", "file").distinct()
    w = Window.partitionBy("plan_id")
    ranked = hubs.withColumn("hubs", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("file"))).filter((F.col("hubs") >= least) & (F.col("r") <= named))
    return ranked.groupBy("plan_id").agg(F.max("hubs").alias("hubs"), F.array_sort(F.collect_list(basename(F.col("file")))).alias("files"))


def compact_counts(gaps: DataFrame) -> DataFrame:
    """plan_id, comod_gaps, refgraph_gaps, high_confidence (neither acknowledged nor hubs)."""
    high = (F.col("confidence") == "high") & F.col("reason").isNull() & ~F.col("hub")
    return gaps.groupBy("plan_id").agg(F.count_if(F.col("source") == "comod").alias("comod_gaps"), F.count_if(F.col("source") == "refgraph").alias("refgraph_gaps"), F.count_if(high).alias("high_confidence"))


def without_acknowledged(rows: DataFrame, acks: DataFrame, column: str = "dir") -> DataFrame:
    """Rows (plan_id, dir ..) whose directory acks(plan_id, dir) does not name, with or without a slash at the end."""
    names = acks.select("plan_id", F.regexp_replace("dir", "/$", "").alias("acked")).distinct()
    marked = rows.withColumn("acked", F.regexp_replace(column, "/$", ""))
    return marked.join(names, ["plan_id", "acked"], "left_anti").drop("acked")


def find_hits(outputs: DataFrame, k: int = 3) -> DataFrame:
    """id, file, hits: of each text of file:line:match rows the ``k`` Go files with most matches, tests left out."""
    lines = outputs.select("id", F.explode(F.split("text", "\n")).alias("line"))
    file = F.regexp_extract("line", "^([^:]+):", 1)
    counts = lines.select("id", file.alias("file")).filter(F.endswith("file", F.lit(".go")) & ~F.endswith("file", F.lit("_test.go"))).groupBy("id", "file").agg(F.count(F.lit(1)).alias("hits"))
    w = Window.partitionBy("id").orderBy(F.desc("hits"), "file")
    return counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def exploration_scores(calls: DataFrame, left_out: DataFrame, files: DataFrame) -> DataFrame:
    """calls(session, turn, tool, path) -> session, path, tool_rank, hits, turn, score of what an agent looked at.

    .50 for code and constructors, .45 for read, .30 for find, by the best tool; .10 more from two
    calls on, .60 at most. Files found once by find alone, tests, what left_out(session, path)
    names and what is not in files(path) do not count. The turn is that after the first call.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TOOL_RANK.items() for x in kv]), F.col("tool")), F.lit(0))
    real = calls.filter(~F.endswith("path", F.lit("_test.go"))).join(left_out.select("session", "path").distinct(), ["session", "path"], "left_anti").join(files.select("path").distinct(), "path", "left_semi")
    each = real.groupBy("session", "path").agg(F.max(rank).alias("tool_rank"), F.count(F.lit(1)).alias("hits"), (F.min("turn") + 1).alias("turn")).filter("NOT (tool_rank = 1 AND hits < 2)")
    base = F.when(F.col("tool_rank") == 3, RANK_SCORE[3]).when(F.col("tool_rank") == 2, RANK_SCORE[2]).otherwise(RANK_SCORE[1])
    return each.withColumn("score", F.least(F.lit(0.60), F.round((base + F.when(F.col("hits") >= 2, 0.10).otherwise(0.0)) * 100) / 100))
