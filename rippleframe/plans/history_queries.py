"""Queries over event logs, outcomes and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.operators import forecast, history, quantile
from rippleframe.plans.base import query
from rippleframe.sources.views import table, view

_MISSES = "m AS (SELECT project, event_id, ts, unnest([ 'f' || (k % 7), 'f' || (event_id % 5), CASE WHEN event_id % 3 = 0 THEN '<ack>' ELSE 'g' || (k % 2) END ]) AS file FROM {log} WHERE event_type IN ('view', 'click')), c AS (SELECT project, event_id, ts, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT *, max(ts) OVER (PARTITION BY project) AS newest FROM {log} WHERE event_type IN ('view', 'click')) WHERE ts >= newest - INTERVAL 7 DAY) "
_OUT = "CASE k % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'rework' ELSE 'failed' END"
_SIM = "s AS (SELECT p.plan_id, CASE WHEN p.depth >= 3 AND p.cascade_files >= 20 THEN 0.15 WHEN p.depth >= 2 AND p.cascade_files >= 10 THEN 0.08 WHEN p.depth >= 1 AND p.cascade_files >= 5 THEN 0.03 ELSE 0 END::DOUBLE AS cost, o.id, o.recall, o.outcome FROM {plans} p JOIN {outcomes} o ON (abs(o.complexity - p.complexity) <= 3 OR p.complexity > 0 AND abs(o.complexity - p.complexity) / p.complexity < 0.5) AND NOT (p.depth > 0 AND o.depth > 0 AND abs(o.depth - p.depth) > 1) AND (abs(o.density - p.density) < 0.2 OR p.blast <= 5 AND o.blast <= 10 OR p.blast > 0 AND o.blast / p.blast > 0.3 AND o.blast / p.blast < 3.0)) "
_SHARES = "round(avg((class = 'clean')::INT) * 100) / 100 AS p_clean, round(avg((class = 'rework')::INT) * 100) / 100 AS p_rework, round(avg((class = 'failed')::INT) * 100) / 100 AS p_failed"
_PLACES = "round(sum(CAST(round(drawn * 1e9) AS BIGINT)) / count(*) / 1e9 * 100) / 100 AS mean, " + ", ".join(f"round(max(CASE WHEN i = floor({p} * (m - 1)) THEN drawn END) * 100) / 100 AS p{round(p * 100)}" for p in (0.5, 0.85, 0.95))
_SAID = "CASE WHEN n >= 20 THEN 'high' WHEN n >= 5 THEN 'moderate' ELSE 'low' END AS confidence, CASE WHEN p_failed > 0.3 THEN 'high' WHEN p_rework > 0.5 THEN 'moderate' ELSE 'low' END AS risk"
# Outcomes of the view are all labelled, so shares go by the labels.
_EXACT = _SIM + ", c AS (SELECT plan_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT plan_id, cost, recall, outcome FROM s UNION ALL SELECT p.plan_id, CASE WHEN p.depth >= 3 AND p.cascade_files >= 20 THEN 0.15 WHEN p.depth >= 2 AND p.cascade_files >= 10 THEN 0.08 WHEN p.depth >= 1 AND p.cascade_files >= 5 THEN 0.03 ELSE 0 END::DOUBLE, o.recall, o.outcome FROM {plans} p LEFT JOIN c ON c.plan_id = p.plan_id CROSS JOIN {outcomes} o WHERE coalesce(c.n, 0) < 3), e AS (SELECT f.* FROM f LEFT JOIN c ON c.plan_id = f.plan_id), d AS (SELECT plan_id, outcome AS class, greatest(0.0, recall - cost) AS drawn FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY drawn) - 1 AS i, count(*) OVER (PARTITION BY plan_id) AS m FROM d), g AS (SELECT k.plan_id, coalesce(any_value(c.n), 0) AS n, " + _SHARES + ", " + _PLACES + " FROM k LEFT JOIN c ON c.plan_id = k.plan_id GROUP BY 1) "
_BLAST = "CASE WHEN blast <= 2 THEN '0-2' WHEN blast <= 5 THEN '3-5' WHEN blast <= 10 THEN '6-10' WHEN blast <= 20 THEN '11-20' ELSE '>20' END"
_DENS = "CASE WHEN density < 0.20 THEN '<20%' WHEN density < 0.35 THEN '20-35%' ELSE '>35%' END"
_RATES = "b AS (SELECT recall, CASE WHEN project % 2 = 0 THEN 'method' ELSE 'function' END AS kind, " + _BLAST + " AS bb, " + _DENS + " AS db FROM {outcomes}), x AS (SELECT 'kind' AS dimension, kind AS bucket, recall FROM b UNION ALL SELECT 'blast', bb, recall FROM b UNION ALL SELECT 'density', db, recall FROM b), r AS (SELECT dimension, bucket, count(*) AS n, round(avg(recall) * 10000) / 10000 AS recall, round(avg((recall > 0)::INT) * 10000) / 10000 AS hit_rate FROM x GROUP BY 1, 2) "
_CALLS = "SELECT conv_id AS session, CASE role WHEN 'user' THEN 'Read' WHEN 'assistant' THEN 'Edit' ELSE 'Write' END AS tool, 'f' || (length(text) % 5) AS file FROM {conversations}"


def _of(spark, sf, *types):
    return view(spark, sf, "log").filter(F.col("event_type").isin(*types))


def _checks(spark, sf):
    third = F.when(F.col("event_id") % 3 == 0, F.lit("<ack>")).otherwise(F.concat(F.lit("g"), F.col("k") % 2))
    misses = F.array(F.concat(F.lit("f"), F.col("k") % 7), F.concat(F.lit("f"), F.col("event_id") % 5), third)
    return _of(spark, sf, "view", "click").withColumn("misses", misses)


def _outcome(k):
    return F.when(k % 3 == 0, "clean").when(k % 3 == 1, "rework").otherwise("failed")


@query("SELECT quality, toxic, count(*) AS n FROM {labels} GROUP BY 1, 2")
def outcome_base_rates(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rn FROM {events}) WHERE rn <= 10")
def tail_n(spark, sf):
    return history.tail_n(table(spark, sf, "events"), "user_id", 10).select("user_id", "event_id", "rn")


@query("SELECT user_id, round(sum(value * w) / sum(w) * 1000) / 1000 AS weighted FROM (SELECT user_id, value, 1 + (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / count(*) OVER (PARTITION BY user_id) AS w FROM {events} WHERE value IS NOT NULL) GROUP BY 1")
def recency_calibration(spark, sf):
    return history.recency_mean(table(spark, sf, "events"), "user_id")


@query("AND_VIEWS n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY id DESC) AS r FROM {outcomes}), w AS (SELECT *, abs(recall - precision_) AS brier, 1 + (row_number() OVER (PARTITION BY project ORDER BY id) - 1) / count(*) OVER (PARTITION BY project) AS w FROM n WHERE r <= 100) SELECT project, count(*) AS n, round(sum(recall * w) / sum(w) * 1000) / 1000 AS avg_recall, round(sum(precision_ * w) / sum(w) * 1000) / 1000 AS avg_precision, round(sum(brier * w) / sum(w) * 1000) / 1000 AS avg_brier, round(avg((recall > 0)::INT) * 1000) / 1000 AS hit_rate, round(coalesce(avg(recall) FILTER (confidence = 'high'), 0) * 1000) / 1000 AS high_recall, round(coalesce(avg(recall) FILTER (confidence = 'moderate'), 0) * 1000) / 1000 AS moderate_recall, round(coalesce(avg(recall) FILTER (confidence = 'low'), 0) * 1000) / 1000 AS low_recall FROM w GROUP BY 1")
def calibration_summary(spark, sf):
    entries = view(spark, sf, "outcomes").withColumn("brier", F.abs(F.col("recall") - F.col("precision_")))
    return history.calibration_summary(entries)


@query("SELECT user_id, count(*) AS changes FROM {events} WHERE ts >= (SELECT max(ts) FROM {events}) - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) >= 2")
def churn_hotspots(spark, sf):
    return history.churn(table(spark, sf, "events"), "user_id", 7, 2)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened FROM {conversations}")
def carry_forward(spark, sf):
    return history.carry_forward(table(spark, sf, "conversations"))


@query("AND_VIEWS " + _MISSES + "SELECT m.project, file, count(DISTINCT m.event_id) AS times FROM m JOIN c ON c.event_id = m.event_id WHERE r <= 10 AND NOT starts_with(file, '<') GROUP BY 1, 2 HAVING count(DISTINCT m.event_id) >= 2")
def recurring_misses(spark, sf):
    return history.recurring_misses(_checks(spark, sf))


@query("AND_VIEWS f AS (SELECT project, k % 4 AS probe, k % 3 AS persona, " + _OUT + " AS outcome, count(*) OVER (PARTITION BY project) AS n, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id DESC) AS r FROM {log} WHERE event_type = 'signup'), g AS (SELECT project, count(*) AS reflections, CAST(sum(probe) AS BIGINT) AS probe, CAST(sum(persona) AS BIGINT) AS persona, count(*) FILTER (outcome IN ('rework', 'failed')) AS reworks FROM f WHERE n >= 3 AND r <= 5 GROUP BY 1) SELECT *, CASE WHEN persona = 0 THEN 'personas found nothing' WHEN probe = 0 THEN 'probes found nothing' ELSE 'both' END AS advice FROM g WHERE probe + persona > 0")
def layer_effectiveness(spark, sf):
    k = F.col("k")
    return history.layer_effectiveness(_of(spark, sf, "signup").select("project", "event_id", "ts", (k % 4).alias("probe"), (k % 3).alias("persona"), _outcome(k).alias("outcome")))


@query("AND_VIEWS o AS (SELECT project, k, arg_max(" + _OUT.replace("k % 3", "event_id % 3") + ", event_id) AS outcome FROM {log} WHERE event_type = 'error' GROUP BY 1, 2), f AS (SELECT project, k, arg_max(event_id % 6, event_id) AS passes FROM {log} WHERE event_type = 'signup' GROUP BY 1, 2) SELECT l.event_id, outcome, passes FROM {log} l LEFT JOIN o ON o.project = l.project AND o.k = l.k LEFT JOIN f ON f.project = l.project AND f.k = l.k WHERE event_type = 'view'")
def history_enriched(spark, sf):
    outs = _of(spark, sf, "error").withColumn("outcome", _outcome(F.col("event_id")))
    refl = _of(spark, sf, "signup").withColumn("passes", F.col("event_id") % 6)
    return history.enriched(_of(spark, sf, "view").select("event_id", "project", "k"), outs, refl).select("event_id", "outcome", "passes")


@query("AND_VIEWS c AS (SELECT project, count(*) AS n, count(*) FILTER (outcome = 'clean') AS clean, count(*) FILTER (outcome = 'rework') AS rework, count(*) FILTER (outcome = 'failed') AS failed FROM {outcomes} GROUP BY 1), q AS (SELECT *, clean * 100 // n AS clean_pct, rework * 100 // n AS rework_pct, failed * 100 // n AS failed_pct FROM c) SELECT *, CASE WHEN n < 5 THEN 'too few' WHEN clean_pct >= 50 THEN 'working' WHEN failed_pct > 30 THEN 'failing' ELSE 'mixed' END AS verdict FROM q")
def stats_verdict(spark, sf):
    return history.stats(view(spark, sf, "outcomes"))


@query("AND_VIEWS k AS (" + _CALLS + "), f AS (SELECT session, file, max((tool = 'Read')::INT) AS r, max((tool = 'Edit')::INT) AS e, max((tool = 'Write')::INT) AS c, count(*) AS n FROM k GROUP BY 1, 2) SELECT session, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(r) AS BIGINT) AS files_read, CAST(sum(e) AS BIGINT) AS files_edited, CAST(sum(c) AS BIGINT) AS files_created, CASE WHEN sum(r) = 0 THEN 0 ELSE count(*) FILTER (r = 1 AND e = 0 AND c = 0) / sum(r) END AS exploration FROM f GROUP BY 1")
def session_index(spark, sf):
    tool = F.when(F.col("role") == "user", "Read").when(F.col("role") == "assistant", "Edit").otherwise("Write")
    calls = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), tool.alias("tool"), F.concat(F.lit("f"), F.length("text") % 5).alias("file"))
    return history.session_index(calls)


_SAME = " AND ".join(f"x.{c} IS NOT DISTINCT FROM c.{c}" for c in ("complexity", "density", "blast", "depth"))
_LIKE = _SIM[_SIM.index(" ON ") + 4:].rstrip().removesuffix(")")


@query("AND_VIEWS pc AS (SELECT complexity, density, blast, depth, min(plan_id) AS class_id FROM {customer_plans} GROUP BY 1, 2, 3, 4), oc AS (SELECT complexity, density, blast, depth, min(id) AS class_id FROM {outcomes} GROUP BY 1, 2, 3, 4) SELECT 'plan' AS kind, plan_id AS id, class_id FROM {customer_plans} x JOIN pc c ON " + _SAME + " UNION ALL SELECT 'outcome', id, class_id FROM {outcomes} x JOIN oc c ON " + _SAME + " UNION ALL SELECT 'alike', p.class_id, o.class_id FROM pc p JOIN oc o ON " + _LIKE + " UNION ALL SELECT 'pair', p.plan_id, o.id FROM {customer_plans} p JOIN {outcomes} o ON " + _LIKE)
def similar_history(spark, sf):
    """Every customer's plan with every outcome: by classes, and in rows of kind pair each plan (id) with each outcome like it (class_id)."""
    plans, outcomes = view(spark, sf, "customer_plans"), view(spark, sf, "outcomes")
    pairs = forecast.similar_pairs(plans, outcomes).select(F.lit("pair").alias("kind"), F.col("plan_id").alias("id"), F.col("id").alias("class_id"))
    return forecast.similar_classes(plans, outcomes).unionByName(pairs)


@query("AND_VIEWS " + _EXACT + "SELECT *, " + _SAID + " FROM g")
def forecast_exact(spark, sf):
    return forecast.forecast_exact(view(spark, sf, "plans"), view(spark, sf, "outcomes"))


def _draws(of):
    return f"SELECT s.plan_id, s.n, CAST('0x' || substr(md5(concat_ws(':', '{of}', s.plan_id, d, 42)), 1, 15) AS BIGINT) % s.n AS i FROM z s, t"


@query("AND_VIEWS " + _SIM + ", q AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY plan_id) AS n FROM s), z AS (SELECT DISTINCT plan_id, n FROM q WHERE n >= 3), t AS (SELECT unnest(range(1, 10001)) AS d), r AS (" + _draws("recall") + "), l AS (" + _draws("label") + "), d AS (SELECT r.plan_id, greatest(0.0, recall - cost) AS drawn FROM r JOIN q ON q.plan_id = r.plan_id AND q.i = r.i), k AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY drawn) - 1 AS i, count(*) OVER (PARTITION BY plan_id) AS m FROM d), g AS (SELECT plan_id, " + _PLACES + " FROM k GROUP BY 1), h AS (SELECT l.plan_id, any_value(l.n) AS n, " + _SHARES.replace("class", "outcome") + " FROM l JOIN q ON q.plan_id = l.plan_id AND q.i = l.i GROUP BY 1) SELECT h.*, g.* EXCLUDE (plan_id), " + _SAID + " FROM h JOIN g ON g.plan_id = h.plan_id")
def forecast_mc(spark, sf):
    return forecast.forecast_draws(view(spark, sf, "plans"), view(spark, sf, "outcomes"))


@query("AND_VIEWS " + _RATES + "SELECT * FROM r")
def base_rates(spark, sf):
    return forecast.base_rates(_kinds(spark, sf))


def _kinds(spark, sf):
    return view(spark, sf, "outcomes").withColumn("kind", F.when(F.col("project") % 2 == 0, "method").otherwise("function"))


@query("AND_VIEWS " + _RATES + ", p AS (SELECT plan_id, " + _BLAST + " AS bb, " + _DENS + " AS db FROM {plans}), j AS (SELECT plan_id, coalesce(b.recall, m.recall, 0) AS recall, coalesce(b.hit_rate, m.hit_rate, 0) AS hit_rate, d.n, d.recall AS d_recall, d.hit_rate AS d_hit FROM p LEFT JOIN r b ON b.dimension = 'blast' AND b.bucket = bb LEFT JOIN r m ON m.dimension = 'kind' AND m.bucket = 'method' LEFT JOIN r d ON d.dimension = 'density' AND d.bucket = db) SELECT plan_id, round(CASE WHEN n >= 20 THEN (recall + d_recall) / 2 ELSE recall END * 10000) / 10000 AS recall, round(CASE WHEN n >= 20 THEN (hit_rate + d_hit) / 2 ELSE hit_rate END * 10000) / 10000 AS hit_rate FROM j")
def base_rate_lookup(spark, sf):
    return forecast.base_rate_lookup(view(spark, sf, "plans"), forecast.base_rates(_kinds(spark, sf)))


@query("AND_VIEWS p AS (SELECT project, count(*) AS commits, count(*) % 400 AS age_days, avg(density) AS density, count(DISTINCT blast) AS files, project % 2 = 0 AS graph FROM {outcomes} GROUP BY 1), s AS (SELECT *, round((least(commits / 200, 1.0) * 0.3 + least(age_days / 365, 1.0) * 0.2 + least(density / 0.60, 1.0) * 0.3 + least(files / 50, 1.0) * 0.1 + CASE WHEN graph THEN 0.1 ELSE 0 END) * 100) / 100 AS score FROM p) SELECT project, score, CASE WHEN score < 0.2 THEN 'nascent' WHEN score < 0.4 THEN 'growing' WHEN score < 0.7 THEN 'established' ELSE 'mature' END AS label, CASE WHEN NOT graph THEN 'unavailable' WHEN files < 5 THEN 'weak' WHEN density < 0.2 THEN 'moderate' ELSE 'strong' END AS structural, CASE WHEN commits < 10 THEN 'unavailable' WHEN commits < 50 THEN 'weak' WHEN commits < 200 THEN 'moderate' ELSE 'strong' END AS comod FROM s")
def maturity(spark, sf):
    n = F.count(F.lit(1))
    p = view(spark, sf, "outcomes").groupBy("project").agg(n.alias("commits"), (n % 400).alias("age_days"), F.avg("density").alias("density"), F.countDistinct("blast").alias("files")).withColumn("graph", F.col("project") % 2 == 0)
    return forecast.maturity(p).select("project", "score", "label", "structural", "comod")


@query("AND_VIEWS p AS (SELECT c_custkey AS plan_id, CAST(c_custkey % 5 AS INTEGER) AS m, CAST(c_custkey % 4 AS INTEGER) AS n, c_custkey % 3 = 0 AS own FROM {customer}), s AS (SELECT plan_id, own AND n > 0 AS lifted, CASE WHEN n + m = 0 THEN 0.5 ELSE n / (n + m) END AS s FROM p), x AS (SELECT plan_id, CASE WHEN lifted THEN s * 0.7 + 0.3 ELSE s END AS score FROM s) SELECT plan_id, score, CASE WHEN score < 0.15 THEN 'routine' WHEN score < 0.4 THEN 'extension' WHEN score < 0.7 THEN 'novel' ELSE 'exploratory' END AS label, CASE WHEN score < 0.15 THEN 'narrow' WHEN score < 0.4 THEN 'moderate' WHEN score < 0.7 THEN 'wide' ELSE 'very wide' END AS uncertainty FROM x")
def novelty(spark, sf):
    key = F.col("c_custkey")
    made = F.when(key % 3 == 0, F.lit("new/f.go")).otherwise(F.lit("f.go"))
    p = table(spark, sf, "customer").select(key.alias("plan_id"), F.array_repeat(F.lit("a.go"), (key % 5).cast("int")).alias("modify"), F.array_repeat(made, (key % 4).cast("int")).alias("create"))
    return forecast.novelty(p).select("plan_id", "score", "label", "uncertainty")


@query("SELECT outcome, CAST(sum(CASE WHEN id % 3 = 0 THEN 3 WHEN id % 3 = 1 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM {outcomes} GROUP BY 1")
def outcome_replication(spark, sf):
    o = view(spark, sf, "outcomes")
    parts = (o.filter(F.col("id") % 3 == m) for m in range(3))
    return forecast.replicated(*parts).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("AND_VIEWS k AS (SELECT project, recall, row_number() OVER (PARTITION BY project ORDER BY recall) - 1 AS i, count(*) OVER (PARTITION BY project) AS m FROM {outcomes}) SELECT project, max(CASE WHEN i = floor(0.5 * (m - 1)) THEN recall END) AS p50, max(CASE WHEN i = floor(0.85 * (m - 1)) THEN recall END) AS p85 FROM k GROUP BY 1")
def percentile_index(spark, sf):
    return quantile.exact_percentiles(view(spark, sf, "outcomes"), "project", "recall", {"p50": 0.5, "p85": 0.85})
