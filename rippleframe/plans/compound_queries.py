"""The compound questions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.operators import comod, compound, forecast
from rippleframe.plans.base import query
from rippleframe.plans.history_queries import _EXACT
from rippleframe.plans.rank_queries import _ADDED
from rippleframe.sources.scratch import written
from rippleframe.sources.views import line_tasks, view

_BETWEEN = "b AS (SELECT s.source_file AS from_file, t.source_file AS to_file, count(*) AS n FROM {refs} JOIN {defs} s ON s.id = from_def JOIN {defs} t ON t.id = to_def WHERE NOT s.is_test AND s.source_file <> t.source_file GROUP BY 1, 2), n AS (SELECT file, count(*) AS alone FROM {commits} GROUP BY file), f AS (SELECT a.file AS file_a, b.file AS file_b, count(*) / any_value(n.alone) AS confidence FROM {commits} a JOIN {commits} b ON a.commit_id = b.commit_id AND a.file <> b.file JOIN n ON n.file = a.file GROUP BY 1, 2 HAVING confidence >= 0.16) "
_COMOD = " UNION ALL SELECT p.plan_id, file_b, 'comod', least(max(confidence), 0.8) FROM {planned} p JOIN f ON file_a = p.file GROUP BY 1, 2"
_TAIL = "), g AS (SELECT plan_id, file, max(score) AS best, arg_max(source, (score, source)) AS reason, count(DISTINCT source) AS n_sources FROM s WHERE NOT EXISTS (SELECT 1 FROM {planned} p WHERE p.plan_id = s.plan_id AND p.file = s.file) GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2) SELECT plan_id, file, best, reason, n_sources, CASE WHEN best >= 0.9 THEN 'must' WHEN best >= 0.5 THEN 'likely' WHEN best >= 0.3 THEN 'consider' ELSE 'unlikely' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY best DESC, file) AS r FROM g) WHERE r <= 10"
_CALLER = "SELECT p.plan_id, from_file AS file, '{}' AS source, least((4 + sum(n)) / 10, 0.8)::DOUBLE AS score FROM [planned] p JOIN b ON to_file = p.file GROUP BY 1, 2"


def _caller(name):
    return _CALLER.format(name).replace("[", "{").replace("]", "}")


def _suggested(spark, sf, split):
    links = compound.file_links(view(spark, sf, "refs"), view(spark, sf, "defs"), comod.confidence(view(spark, sf, "commits")), 0.16)
    # Written, so that their size is known before they are joined.
    return compound.suggest_linked(view(spark, sf, "planned"), written(links, "file-links"), split, tasks=line_tasks(spark, sf, 200_000))


@query("AND_VIEWS " + _BETWEEN + ", s AS (" + _caller("graph-caller") + " UNION ALL SELECT p.plan_id, to_file, 'graph-callee', 0.3 FROM {planned} p JOIN b ON from_file = p.file GROUP BY 1, 2 HAVING sum(n) >= 3" + _COMOD + _TAIL)
def suggest_files(spark, sf):
    return _suggested(spark, sf, True)


@query("AND_VIEWS " + _BETWEEN + ", s AS (" + _caller("graph") + _COMOD + _TAIL)
def review_files(spark, sf):
    return _suggested(spark, sf, False)


@query("AND_VIEWS a AS (SELECT DISTINCT task_id AS plan_id, file FROM {actual}), j AS (SELECT coalesce(p.plan_id, a.plan_id) AS plan_id, p.file IS NOT NULL AS p, a.file IS NOT NULL AS a FROM {planned} p FULL JOIN a ON a.plan_id = p.plan_id AND a.file = p.file), c AS (SELECT plan_id, count(*) FILTER (p) AS planned, count(*) FILTER (a) AS changed, count(*) FILTER (p AND NOT a) AS untouched, count(*) FILTER (NOT p) AS unplanned FROM j GROUP BY 1), m AS (SELECT *, round(coalesce((planned - untouched) / nullif(planned, 0), 0) * 1000) / 1000 AS precision, round(coalesce((planned - untouched) / nullif(changed, 0), 0) * 1000) / 1000 AS recall FROM c) SELECT *, CASE WHEN recall >= 0.8 THEN 'clean' WHEN recall >= 0.4 THEN 'rework' ELSE 'failed' END AS verdict FROM m")
def validate_execution(spark, sf):
    actual = view(spark, sf, "actual").select(F.col("task_id").alias("plan_id"), "file").distinct()
    return compound.execution_report(view(spark, sf, "planned"), actual)


@query("AND_VIEWS l AS (SELECT DISTINCT l_orderkey % 20 AS plan_id, CASE l_linenumber % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'modify' ELSE 'create' END AS kind, CASE WHEN l_orderkey % 5 = 0 THEN p_type || '/' || p_brand WHEN l_orderkey % 3 = 0 THEN p_type || '/' || p_brand || '/none.go' ELSE p_type || '/' || p_brand || '/' || replace(p_name, ' ', '_') || '.go' END AS path FROM {lineitem} JOIN {part} ON l_partkey = p_partkey), k AS (SELECT plan_id, path, list(kind) AS kinds, path IN (SELECT path FROM {manifest}) AS f, path IN (SELECT dir FROM {manifest}) AS d FROM l GROUP BY 1, 2) SELECT plan_id, path, 'directory' AS finding FROM k WHERE d UNION ALL SELECT plan_id, path, 'exists' FROM k WHERE f AND list_contains(kinds, 'create') UNION ALL SELECT plan_id, path, 'overlap' FROM k WHERE list_contains(kinds, 'create') AND list_contains(kinds, 'modify') UNION ALL SELECT plan_id, path, 'missing' FROM k WHERE NOT f AND NOT d AND NOT list_contains(kinds, 'create')")
def list_validation(spark, sf):
    kind = "CASE l_linenumber % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'modify' ELSE 'create' END AS kind"
    path = "CASE WHEN l_orderkey % 5 = 0 THEN p_type || '/' || p_brand WHEN l_orderkey % 3 = 0 THEN p_type || '/' || p_brand || '/none.go' ELSE p_type || '/' || p_brand || '/' || replace(p_name, ' ', '_') || '.go' END AS path"
    items = view(spark, sf, "lineitem").join(view(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return compound.list_findings(items.selectExpr("l_orderkey % 20 AS plan_id", kind, path), view(spark, sf, "manifest"))


@query("AND_VIEWS b AS (SELECT s.source_file AS file, t.source_file AS own, count(*) AS n FROM {refs} JOIN {defs} s ON s.id = from_def JOIN {defs} t ON t.id = to_def WHERE s.source_file <> t.source_file GROUP BY 1, 2), l AS (SELECT p.plan_id, b.file, CAST(sum(n) AS BIGINT) AS n FROM {planned} p JOIN b ON b.own = p.file GROUP BY 1, 2) SELECT s.plan_id, s.file, CASE WHEN coalesce(n, 0) > 0 THEN 'must' WHEN score >= 0.7 THEN 'likely' ELSE 'consider' END AS level FROM {signals} s LEFT JOIN l ON l.plan_id = s.plan_id AND l.file = s.file WHERE source = 'semantic'")
def semantic_validation(spark, sf):
    ends = compound._ends(view(spark, sf, "refs"), view(spark, sf, "defs")).groupBy("from_file", "to_file").agg(F.count(F.lit(1)).alias("n"))
    own = view(spark, sf, "planned").select("plan_id", F.col("file").alias("to_file"))
    links = own.join(ends, "to_file").groupBy("plan_id", F.col("from_file").alias("file")).agg(F.sum("n").alias("n"))
    said = view(spark, sf, "signals").filter("source = 'semantic'").select("plan_id", "file", F.col("score").alias("confidence"))
    return compound.semantic_levels(said, links)


@query("AND_VIEWS s AS (SELECT plan_id, source AS kind, file FROM {signals}), c AS (SELECT *, count(*) OVER (PARTITION BY plan_id, kind) AS n, row_number() OVER (PARTITION BY plan_id, kind ORDER BY file) AS r FROM s) SELECT plan_id, kind, max(n) AS n, string_agg(file, ',' ORDER BY file) AS files FROM c WHERE n <= 5 OR r <= 3 GROUP BY 1, 2")
def collapsed_signals(spark, sf):
    return compound.collapsed(view(spark, sf, "signals").withColumnRenamed("source", "kind"))


@query("AND_VIEWS s AS (SELECT plan_id, file, source, score FROM {signals}), c AS (SELECT *, count(*) OVER (PARTITION BY plan_id) AS total, row_number() OVER (PARTITION BY plan_id ORDER BY file || source) AS r FROM s) SELECT plan_id, file, source, total, CAST(least(total, 7) AS BIGINT) AS showing FROM c WHERE r <= 7")
def drill_down(spark, sf):
    items = view(spark, sf, "signals").select("plan_id", "file", "source", F.concat("file", "source").alias("at"))
    return compound.envelope(items, "plan_id", "at", 7).select("plan_id", "file", "source", "total", F.col("showing").cast("long").alias("showing"))


@query("AND_VIEWS " + _ADDED + ", t AS (SELECT plan_id, string_agg(file || ':' || score, ',' ORDER BY r) AS ranked FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, file) AS r FROM k) WHERE r <= 5 GROUP BY 1), mi AS (SELECT plan_id, count(*) AS n FROM {planned} WHERE file NOT IN (SELECT path FROM {manifest}) AND file NOT IN (SELECT dir FROM {manifest}) GROUP BY 1), fc AS (WITH " + _EXACT + " SELECT plan_id, p_failed FROM g) SELECT p.plan_id, coalesce(mi.n, 0) AS n_findings, coalesce(ranked, '') AS ranked, p_failed FROM (SELECT DISTINCT plan_id FROM {planned}) p LEFT JOIN mi ON mi.plan_id = p.plan_id LEFT JOIN t ON t.plan_id = p.plan_id LEFT JOIN {customer} c ON c.c_custkey = p.plan_id LEFT JOIN fc ON fc.plan_id = concat_ws('-', c_nationkey, c_mktsegment)")
def check_plans(spark, sf):
    """Every customer's plan, with the forecast of its nation and segment."""
    plans = view(spark, sf, "planned")
    shared = forecast.forecast_exact(view(spark, sf, "plans"), view(spark, sf, "outcomes")).withColumnRenamed("plan_id", "shared_id")
    of = view(spark, sf, "customer").select(F.col("c_custkey").alias("plan_id"), F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("shared_id"))
    return compound.check(plans, view(spark, sf, "signals"), view(spark, sf, "manifest"), of.join(shared, "shared_id"), 0.25)
