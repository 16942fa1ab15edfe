"""Queries that rank, gate and combine signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.operators import rank
from rippleframe.plans.base import query
from rippleframe.sources.views import view

_NOT_PLANNED = "NOT EXISTS (SELECT 1 FROM {planned} p WHERE p.plan_id = s.plan_id AND p.file = s.file)"
_ADDED = "a AS (SELECT s.*, CASE source WHEN 'structural' THEN 0.5 * (1 - 0.8 * 0.25) * 0.5 WHEN 'comod' THEN score * 0.35 * (1 - 0.7 * 0.25) WHEN 'semantic' THEN score * (0.1 + 0.3 * 0.25) ELSE score END AS added FROM {signals} s WHERE " + _NOT_PLANNED + "), k AS (SELECT plan_id, file, round(sum(CAST(round(added * 1000000) AS BIGINT)) / 1000000 * 100) / 100 AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM a GROUP BY 1, 2) "
_WIDE = "w AS (SELECT plan_id, file, coalesce(max(score) FILTER (source = 'structural'), 0) AS structural, coalesce(max(score) FILTER (source = 'comod'), 0) AS comod, coalesce(max(score) FILTER (source = 'semantic'), 0) AS semantic FROM {signals} s WHERE " + _NOT_PLANNED + " GROUP BY 1, 2), m AS (SELECT *, (0.5 * structural + 0.35 * comod + 0.15 * semantic) / 1.0 AS mean, (structural > 0.5)::INT + (comod > 0.3)::INT + (semantic > 0.3)::INT >= 2 AS agree FROM w), v AS (SELECT *, CASE WHEN agree AND mean > 0 AND mean < 1 THEN pow(mean / (1 - mean), 1.3) / (1 + pow(mean / (1 - mean), 1.3)) ELSE mean END AS value FROM m), c AS (SELECT plan_id, file, round(value * 1000) / 1000 AS combined, round(structural * 1000) / 1000 AS structural, round(comod * 1000) / 1000 AS comod, round(semantic * 1000) / 1000 AS semantic, CASE WHEN structural >= 0.8 THEN 'must' WHEN value >= 0.5 THEN 'likely' WHEN value >= 0.2 THEN 'consider' ELSE 'unlikely' END AS confidence FROM v) "
_MOVED = "".join(f", greatest(0.05, least(0.9, {w} + coalesce(0.1 * (avg(CASE WHEN {s} > 0 THEN (({s} > {t}) = (p.file IS NOT NULL))::INT END) - 0.5), 0))) AS {s}" for s, w, t in (("structural", 0.5, 0.5), ("comod", 0.35, 0.3), ("semantic", 0.15, 0.3)))


def _ranked(spark, sf):
    return rank.rank(view(spark, sf, "signals"), view(spark, sf, "planned"), 0.25)


@query("AND_VIEWS " + _ADDED + "SELECT * FROM k")
def rank_signals(spark, sf):
    return _ranked(spark, sf).withColumn("sources", F.array_join("sources", ","))


@query("AND_VIEWS " + _ADDED + "SELECT plan_id, file, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, file) AS r FROM k) WHERE r <= 5")
def rank_top5(spark, sf):
    return rank.top_k(_ranked(spark, sf)).select("plan_id", "file", "score", "rank")


@query("AND_VIEWS " + _ADDED + ", t AS (SELECT *, max(sources LIKE '%verified-spike%') OVER (PARTITION BY plan_id) AS spiked, CASE WHEN sources LIKE '%verified-spike%' AND (sources LIKE '%structural%' OR sources LIKE '%comod%') THEN 1 WHEN sources LIKE '%verified-spike%' THEN 2 END AS tier FROM k), u AS (SELECT *, row_number() OVER (PARTITION BY plan_id, tier ORDER BY score DESC, file) AS r, max(coalesce(tier < 2, false)) OVER (PARTITION BY plan_id) AS found FROM t) SELECT plan_id, file, CASE WHEN spiked AND tier = 2 THEN score * 0.6::DOUBLE ELSE score END AS score, CASE WHEN spiked THEN tier END AS tier FROM u WHERE NOT spiked OR tier = 1 AND r <= 3 OR tier = 2 AND r <= 2 AND found")
def confidence_gate(spark, sf):
    return rank.confidence_gate(_ranked(spark, sf))


@query("AND_VIEWS g AS (SELECT plan_id, file, max(score) AS best, arg_max(source, (score, source)) AS reason, count(DISTINCT source) AS n_sources FROM {signals} GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2) SELECT plan_id, file, best, reason, n_sources, CASE WHEN best >= 0.9 THEN 'must' WHEN best >= 0.5 THEN 'likely' WHEN best >= 0.3 THEN 'consider' ELSE 'unlikely' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY best DESC, file) AS r FROM g) WHERE r <= 10")
def source_count_gate(spark, sf):
    return rank.source_count_gate(view(spark, sf, "signals"))


@query("AND_VIEWS " + _WIDE + "SELECT * FROM c")
def combine_pivot(spark, sf):
    return rank.combine(view(spark, sf, "signals"), view(spark, sf, "planned"))


@query("AND_VIEWS " + _WIDE + ", q AS (SELECT DISTINCT task_id AS plan_id, file FROM {actual}), x AS (SELECT c.plan_id" + _MOVED + " FROM c LEFT JOIN q p ON p.plan_id = c.plan_id AND p.file = c.file GROUP BY 1) SELECT plan_id, round(structural / (structural + comod + semantic) * 1000000) / 1000000 AS structural, round(comod / (structural + comod + semantic) * 1000000) / 1000000 AS comod, round(semantic / (structural + comod + semantic) * 1000000) / 1000000 AS semantic FROM x")
def calibrate_weights(spark, sf):
    actual = view(spark, sf, "actual").select(F.col("task_id").alias("plan_id"), "file").distinct()
    return rank.calibrate(combine_pivot(spark, sf), actual)


@query("AND_VIEWS p AS (SELECT plan_id, file, max(score) AS p FROM {signals} GROUP BY 1, 2) SELECT plan_id, file, round(CASE WHEN p <= 0 OR p >= 1 THEN p ELSE pow(p / (1 - p), 1.3) / (1 + pow(p / (1 - p), 1.3)) END * 1000) / 1000 AS p FROM p")
def extremize(spark, sf):
    best = view(spark, sf, "signals").groupBy("plan_id", "file").agg(F.max("score").alias("p"))
    return best.select("plan_id", "file", rank.rounded(rank.extremize(F.col("p"), 1.3), 3).alias("p"))


@query("AND_VIEWS " + _ADDED + ", s AS (SELECT task_id, file FROM {predicted}) SELECT plan_id, k.file, sources, round(CASE WHEN s.file IS NOT NULL THEN least(1.0, score + least(0.25, 0.5 * score)) WHEN sources LIKE '%structural%' THEN score * 0.7 ELSE score END * 1000) / 1000 AS score FROM k LEFT JOIN s ON s.file = k.file AND s.task_id = k.plan_id")
def verification_boost(spark, sf):
    sites = view(spark, sf, "predicted").withColumnRenamed("task_id", "plan_id")
    return rank.verified_scores(_ranked(spark, sf), sites).select("plan_id", "file", "score", F.array_join("sources", ",").alias("sources"))
