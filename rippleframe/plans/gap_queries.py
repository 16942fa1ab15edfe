"""Queries of merged gaps and of an agent's searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.operators import comod, gaps
from rippleframe.plans.base import query
from rippleframe.sources.views import line_tasks, table, view

_BLAST = "e AS (SELECT t.source_file AS plan_file, s.source_file AS file, s.is_test AS s_test, to_def FROM {refs} JOIN {defs} s ON s.id = from_def JOIN {defs} t ON t.id = to_def WHERE t.exported AND NOT t.is_test), tt AS (SELECT to_def, count(*) AS total FROM e GROUP BY 1), sh AS (SELECT plan_file, file, e.to_def, count(*) AS callers, count(*) / any_value(total) AS frequency FROM e JOIN tt ON tt.to_def = e.to_def WHERE NOT s_test GROUP BY 1, 2, 3), bg AS (SELECT plan_id, plan_file, file, callers, frequency, CASE WHEN frequency > 0.5 OR callers >= 5 THEN 'high' ELSE 'moderate' END AS confidence FROM (SELECT p.plan_id, sh.*, row_number() OVER (PARTITION BY p.plan_id, sh.file ORDER BY frequency DESC, callers DESC, plan_file DESC) AS r FROM {planned} p JOIN sh ON sh.plan_file = p.file WHERE frequency >= 0.1 AND NOT EXISTS (SELECT 1 FROM {planned} q WHERE q.plan_id = p.plan_id AND q.file = sh.file)) WHERE r = 1)"
_GAPS = _BLAST + ", al AS (SELECT file, count(*) AS alone FROM {commits} GROUP BY 1), f AS (SELECT a.file AS file_a, b.file AS file_b, count(*) / any_value(alone) AS frequency FROM {commits} a JOIN {commits} b ON a.commit_id = b.commit_id AND a.file <> b.file JOIN al ON al.file = a.file GROUP BY 1, 2), cg AS (SELECT p.plan_id, p.file AS plan_file, file_b AS file, frequency FROM {planned} p JOIN f ON file_a = p.file WHERE frequency >= 0.16 AND NOT EXISTS (SELECT 1 FROM {planned} q WHERE q.plan_id = p.plan_id AND q.file = file_b)), po AS (SELECT plan_id, count(DISTINCT plan_file) AS pointing FROM cg GROUP BY 1), hb AS (SELECT cg.plan_id, file, count(DISTINCT plan_file) AS n, any_value(pointing) AS pointing FROM cg JOIN po ON po.plan_id = cg.plan_id GROUP BY 1, 2), ak AS (SELECT plan_id, min(file) AS file FROM {predicted_plans} GROUP BY 1), a AS (SELECT cg.*, CASE WHEN frequency > 0.75 THEN 'high' ELSE 'moderate' END AS confidence, false AS cross_stack, n >= 3 OR n / pointing >= 0.6 AS hub, CASE WHEN ak.file IS NOT NULL THEN 'known' END AS reason, 'comod' AS source FROM cg JOIN hb ON hb.plan_id = cg.plan_id AND hb.file = cg.file LEFT JOIN ak ON ak.plan_id = cg.plan_id AND ak.file = cg.file UNION ALL SELECT plan_id, plan_file, file, frequency, confidence, false, false, NULL, 'refgraph' FROM bg WHERE NOT EXISTS (SELECT 1 FROM cg WHERE cg.plan_id = bg.plan_id AND cg.file = bg.file)), g AS (SELECT *, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY CASE WHEN confidence = 'high' THEN 0 ELSE 1 END, frequency DESC, file, plan_file) AS INTEGER) AS place FROM a) "
_GAPS = _GAPS.replace("{predicted_plans}", "(SELECT task_id AS plan_id, file FROM {predicted})")


def _gaps(spark, sf):
    """Every customer's plan; the least predicted brand is acknowledged."""
    planned, commits = view(spark, sf, "planned"), view(spark, sf, "commits")
    links = gaps.blast_links(view(spark, sf, "refs"), view(spark, sf, "defs"))
    acks = view(spark, sf, "predicted").groupBy(F.col("task_id").alias("plan_id")).agg(F.min("file").alias("file")).withColumn("reason", F.lit("known"))
    return gaps.plan_gaps(comod.confidence(commits), links, planned, acks, 0.16, tasks=line_tasks(spark, sf, 200_000))


@query("AND_VIEWS " + _BLAST + " SELECT * FROM bg")
def plan_blast_gaps(spark, sf):
    return gaps.blast_gaps(view(spark, sf, "refs"), view(spark, sf, "defs"), view(spark, sf, "planned"))


@query("AND_VIEWS " + _GAPS + "SELECT * FROM g")
def merged_gaps(spark, sf):
    return _gaps(spark, sf)


@query("AND_VIEWS " + _GAPS + ", h AS (SELECT DISTINCT plan_id, file FROM g WHERE hub), r AS (SELECT *, count(*) OVER (PARTITION BY plan_id) AS hubs, row_number() OVER (PARTITION BY plan_id ORDER BY file) AS r FROM h) SELECT plan_id, max(hubs) AS hubs, string_agg(file, ',' ORDER BY file) AS files FROM r WHERE hubs >= 5 AND r <= 3 GROUP BY 1")
def hub_explosions(spark, sf):
    return gaps.hub_explosions(_gaps(spark, sf)).withColumn("files", F.array_join("files", ","))


@query("AND_VIEWS " + _GAPS + "SELECT plan_id, count(*) FILTER (source = 'comod') AS comod_gaps, count(*) FILTER (source = 'refgraph') AS refgraph_gaps, count(*) FILTER (confidence = 'high' AND reason IS NULL AND NOT hub) AS high_confidence FROM g GROUP BY 1")
def compact_counts(spark, sf):
    return gaps.compact_counts(_gaps(spark, sf))


_CALLS = "c AS (SELECT conv_id AS session, turn, CASE turn % 4 WHEN 0 THEN 'find' WHEN 1 THEN 'read' WHEN 2 THEN 'code' ELSE 'find' END AS tool, 'f' || length(text) % 7 || CASE WHEN turn % 5 = 4 THEN '_test.go' ELSE '.go' END AS path FROM {conversations})"


def _calls(spark, sf):
    turn = F.col("turn")
    tool = F.when(turn % 4 == 1, "read").when(turn % 4 == 2, "code").otherwise("find")
    path = F.concat(F.lit("f"), F.length("text") % 7, F.when(turn % 5 == 4, "_test.go").otherwise(".go"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), "turn", tool.alias("tool"), path.alias("path"))


@query("AND_VIEWS " + _CALLS + ", x AS (SELECT session, path, max(CASE tool WHEN 'code' THEN 3 WHEN 'read' THEN 2 ELSE 1 END) AS tool_rank, count(*) AS hits, min(turn) + 1 AS turn FROM c WHERE NOT ends_with(path, '_test.go') AND path <> 'f0.go' AND NOT (path = 'f1.go' AND session % 2 = 0) GROUP BY 1, 2) SELECT session, path, tool_rank, hits, turn, least(0.6, round((CASE tool_rank WHEN 3 THEN 0.5 WHEN 2 THEN 0.45 ELSE 0.3 END + CASE WHEN hits >= 2 THEN 0.1 ELSE 0 END)::DOUBLE * 100) / 100)::DOUBLE AS score FROM x WHERE NOT (tool_rank = 1 AND hits < 2)")
def exploration_scores(spark, sf):
    calls = _calls(spark, sf)
    left_out = calls.filter("path = 'f1.go' AND session % 2 = 0").select("session", "path")
    return gaps.exploration_scores(calls, left_out, calls.select("path").filter("path <> 'f0.go'"))


@query("AND_VIEWS " + _CALLS + ", n AS (SELECT session AS id, path AS file, count(*) AS hits FROM c WHERE NOT ends_with(path, '_test.go') GROUP BY 1, 2) SELECT id, file, hits FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, file) AS r FROM n) WHERE r <= 3")
def find_hits(spark, sf):
    """Each conversation's paths as the text that a search would print."""
    lines = F.concat("path", F.lit(":"), F.col("turn"), F.lit(":func F(x)"))
    # A conversation is one text here, as a search result is.
    printed = _calls(spark, sf).groupBy(F.col("session").alias("id")).agg(F.array_join(F.collect_list(lines), "\n").alias("text"))
    return gaps.find_hits(printed)
