"""Back-test queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.operators import evaluate
from rippleframe.plans.base import query
from rippleframe.sources.views import table, view

_CMP = "k AS (SELECT coalesce(p.task_id, a.task_id) AS task_id, coalesce(p.file, a.file) AS file, CASE WHEN p.file IS NOT NULL AND a.file IS NOT NULL THEN 'hit' WHEN p.file IS NOT NULL THEN 'extra' ELSE 'miss' END AS verdict FROM {predicted} p FULL JOIN {actual} a ON a.task_id = p.task_id AND a.file = p.file)"
_MET = _CMP + ", c AS (SELECT task_id, count(*) FILTER (verdict = 'hit') AS hits, count(*) FILTER (verdict = 'extra') AS extras, count(*) FILTER (verdict = 'miss') AS misses FROM k GROUP BY 1), m AS (SELECT *, coalesce(hits / nullif(hits + extras, 0), 0) AS precision, coalesce(hits / nullif(hits + misses, 0), 0) AS recall, coalesce((extras + misses) / nullif(hits + extras + misses, 0), 0) AS brier, coalesce(2 * hits / nullif(2 * hits + extras + misses, 0), 0) AS f1 FROM c) "
_UNION = "u AS (SELECT * FROM {predicted} UNION SELECT task_id, 'Brand#7' FROM {predicted} UNION SELECT task_id, 'Brand#8' FROM {predicted}), ru AS (SELECT a.task_id, count(u.file) / count(*) AS recall FROM {actual} a LEFT JOIN u ON u.task_id = a.task_id AND u.file = a.file GROUP BY 1), rp AS (SELECT a.task_id, count(p.file) / count(*) AS recall FROM {actual} a LEFT JOIN {predicted} p ON p.task_id = a.task_id AND p.file = a.file GROUP BY 1) "
_GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
_STEPS = "SELECT conv_id AS session, turn AS pos, CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN 'edit' WHEN role = 'user' THEN 'open' ELSE 'run' END AS action, 'f' || (length(text) % 4) AS file FROM {conversations}"


def _sets(spark, sf):
    return view(spark, sf, "predicted"), view(spark, sf, "actual")


def _metrics(spark, sf):
    return evaluate.set_metrics(*_sets(spark, sf))


def _wider(spark, sf):
    p = view(spark, sf, "predicted")
    more = p.select("task_id", F.explode(F.array(F.lit("Brand#7"), F.lit("Brand#8"))).alias("file"))
    return evaluate.set_metrics(evaluate.union_of(p, more), view(spark, sf, "actual"))


@query("AND_VIEWS " + _CMP + " SELECT * FROM k")
def full_outer_validate(spark, sf):
    return evaluate.compared(*_sets(spark, sf))


@query("AND_VIEWS " + _MET + "SELECT * FROM m")
def set_metrics(spark, sf):
    return _metrics(spark, sf)


@query("AND_VIEWS " + _MET + "SELECT count(*) AS tasks, round(avg(precision) * 10000) / 10000 AS precision, round(avg(recall) * 10000) / 10000 AS recall, round(avg(f1) * 10000) / 10000 AS f1, round(avg((hits > 0)::INT) * 10000) / 10000 AS hit_rate FROM m")
def metrics_summary(spark, sf):
    return evaluate.summary(_metrics(spark, sf))


@query("AND_VIEWS " + _UNION + "SELECT count(*) AS tasks, count(*) FILTER (ru.recall > rp.recall) AS improved, count(*) FILTER (ru.recall < rp.recall) AS worsened, round(avg(ru.recall - rp.recall) * 10000) / 10000 AS lift FROM ru JOIN rp ON rp.task_id = ru.task_id")
def union_lift(spark, sf):
    return evaluate.lift(_metrics(spark, sf).filter("hits + misses > 0"), _wider(spark, sf))


@query("AND_VIEWS " + _MET + "SELECT CASE WHEN hits + misses <= 1 THEN '1' WHEN hits + misses <= 3 THEN '2-3' WHEN hits + misses <= 10 THEN '4-10' WHEN hits + misses <= 50 THEN '11-50' ELSE '>50' END AS bucket, count(*) AS tasks, round(avg(recall) * 10000) / 10000 AS recall FROM m GROUP BY 1 HAVING count(*) >= 5")
def stratify_difficulty(spark, sf):
    return evaluate.stratified(_metrics(spark, sf), evaluate.difficulty(F.col("hits") + F.col("misses")))


@query("AND_VIEWS " + _MET + "SELECT CASE WHEN hits + misses >= 6 THEN '6+' ELSE CAST(hits + misses AS VARCHAR) END AS bucket, count(*) AS tasks, round(avg(recall) * 10000) / 10000 AS recall FROM m GROUP BY 1")
def stratify_files(spark, sf):
    return evaluate.stratified(_metrics(spark, sf), evaluate.file_count(F.col("hits") + F.col("misses")), 1)


@query("AND_VIEWS " + _MET + ", n AS (SELECT *, row_number() OVER (ORDER BY task_id) AS r FROM m) SELECT CASE WHEN r % 2 = 1 THEN 'first' ELSE 'second' END AS half, count(*) AS tasks, round(avg(recall) * 10000) / 10000 AS recall FROM n GROUP BY 1")
def holdout_split(spark, sf):
    return evaluate.alternating(_metrics(spark, sf))


_TIMES = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in evaluate._AT_MOST)
_BOOT = "q AS (SELECT unnest(range(250)) AS block), hs AS (SELECT x, block, md5(concat_ws(':', 42, block, task_id)) AS h FROM v, q), us AS (SELECT x, 4 * block + j AS b, CAST('0x' || substr(h, 8 * j + 1, 8) AS BIGINT) / 4294967296 AS u FROM hs, (SELECT unnest(range(4)) AS j)), ms AS (SELECT b, sum(x * (" + _TIMES + ")) / sum(" + _TIMES + ") / 1e9 AS m FROM us GROUP BY 1), ls AS (SELECT list_sort(list(m)) AS l FROM ms) SELECT (SELECT avg(x) / 1e9 FROM v) AS mean, l[26] AS lo, l[976] AS hi"


@query("AND_VIEWS " + _MET + ", v AS (SELECT task_id, CAST(round(recall * 1e9) AS BIGINT) AS x FROM m), " + _BOOT + " FROM ls")
def bootstrap_ci(spark, sf):
    return evaluate.bootstrap(_metrics(spark, sf).select("task_id", "recall"), "recall")


@query("AND_VIEWS " + _MET + ", " + _UNION.strip() + ", nu AS (SELECT coalesce(u.task_id, a.task_id) AS task_id, count(a.file) AS n, count(CASE WHEN u.file IS NOT NULL AND a.file IS NOT NULL THEN 1 END) AS h FROM u FULL JOIN {actual} a ON a.task_id = u.task_id AND a.file = u.file GROUP BY 1), v AS (SELECT m.task_id, CAST(round((coalesce(h / nullif(n, 0), 0) - m.recall) * 1e9) AS BIGINT) AS x FROM m JOIN nu ON nu.task_id = m.task_id), " + _BOOT + ", l[26] > 0 OR l[976] < 0 AS significant FROM ls")
def paired_difference(spark, sf):
    return evaluate.paired_difference(_metrics(spark, sf), _wider(spark, sf))


@query("AND_VIEWS s AS (SELECT plan_id AS task_id, file, coalesce(max(score) FILTER (source = 'structural'), 0) AS a, coalesce(max(score) FILTER (source = 'comod'), 0) AS b FROM {signals} GROUP BY 1, 2), g AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS w), n AS (SELECT w, a.task_id, count(s.file) / count(*) AS recall FROM g CROSS JOIN {actual} a LEFT JOIN s ON s.task_id = a.task_id AND s.file = a.file AND w * s.a + (1 - w) * s.b >= 0.5 GROUP BY 1, 2), r AS (SELECT w, round(avg(recall) * 10000) / 10000 AS recall FROM n GROUP BY 1) SELECT *, row_number() OVER (ORDER BY recall DESC, w) = 1 AS best FROM r")
def grid_search(spark, sf):
    # Files of other sources alone score 0, below the mark at any weight.
    best = lambda s: F.coalesce(F.max(F.when(F.col("source") == s, F.col("score"))), F.lit(0.0))
    wide = view(spark, sf, "signals").filter("source IN ('structural', 'comod')").groupBy(F.col("plan_id").alias("task_id"), "file").agg(best("structural").alias("structural"), best("comod").alias("comod"))
    return evaluate.grid_search(wide.select("task_id", "file", F.col("structural").alias("a"), F.col("comod").alias("b")), view(spark, sf, "actual"), _GRID)


@query("AND_VIEWS " + _UNION + ", j AS (SELECT rp.task_id % 5 AS repo, rp.recall AS graph, ru.recall AS combined FROM rp JOIN ru ON ru.task_id = rp.task_id), t AS (SELECT repo, count(*) AS tasks, round(avg(graph) * 10000) / 10000 AS graph, round(avg(combined) * 10000) / 10000 AS combined FROM j GROUP BY ROLLUP (repo)) SELECT *, round((combined / nullif(graph, 0) - 1) * 10000) / 10000 AS lift FROM t")
def lift_by_repo(spark, sf):
    both = _metrics(spark, sf).filter("hits + misses > 0").select("task_id", F.col("recall").alias("graph")).join(_wider(spark, sf).select("task_id", F.col("recall").alias("combined")), "task_id")
    return evaluate.by_repo(both.withColumn("repo", F.col("task_id") % 5))


@query("AND_VIEWS s AS (" + _STEPS + "), h AS (SELECT *, last_value(CASE WHEN action = 'open' THEN file END IGNORE NULLS) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM s), f AS (SELECT session, open, count(*) AS steps, max((action = 'edit')::INT) AS edited FROM h WHERE open IS NOT NULL GROUP BY 1, 2) SELECT session, count(*) AS opened, count(*) FILTER (edited = 0) AS wasted, CAST(sum(CASE WHEN edited = 0 THEN steps ELSE 0 END) AS BIGINT) AS wasted_steps, round(avg(1 - edited) * 10000) / 10000 AS waste FROM f GROUP BY 1")
def exploration_waste(spark, sf):
    role, turn = F.col("role"), F.col("turn")
    action = F.when((role == "assistant") & (turn % 3 == 1), "edit").when(role == "user", "open").otherwise("run")
    steps = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), turn.alias("pos"), action.alias("action"), F.concat(F.lit("f"), F.length("text") % 4).alias("file"))
    return evaluate.exploration_waste(steps)


@query("AND_VIEWS x AS (SELECT conv_id AS id, unnest(string_split(text, ' ')) AS line FROM {conversations} WHERE turn = 0), y AS (SELECT conv_id AS id, unnest(string_split(text, ' ')) AS line FROM {conversations} WHERE turn = 1), j AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM (SELECT id, line, count(*) AS n FROM x GROUP BY 1, 2) a FULL JOIN (SELECT id, line, count(*) AS n FROM y GROUP BY 1, 2) b ON a.id = b.id AND a.line = b.line) SELECT id, round(greatest(sum(greatest(x - y, 0)), sum(greatest(y - x, 0))) / greatest(sum(x), sum(y)) * 10000) / 10000 AS changed FROM j GROUP BY 1")
def diff_magnitude(spark, sf):
    lines = lambda turn: table(spark, sf, "conversations").filter(F.col("turn") == turn).select(F.col("conv_id").alias("id"), F.explode(F.split("text", " ")).alias("line"))
    return evaluate.diff_magnitude(lines(0), lines(1))


@query("SELECT 'intersect' AS op, count(*) AS n FROM (SELECT * FROM {predicted} INTERSECT SELECT * FROM {actual}) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM {predicted} EXCEPT SELECT * FROM {actual}) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM {predicted} UNION SELECT * FROM {actual}) UNION ALL SELECT 'bag', count(*) FROM (SELECT * FROM {predicted} UNION ALL SELECT * FROM {actual})")
def set_ops(spark, sf):
    p, a = _sets(spark, sf)
    n = lambda op, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n("intersect", p.intersect(a)).union(n("except", p.subtract(a))).union(n("union", evaluate.union_of(p, a))).union(n("bag", p.union(a)))
