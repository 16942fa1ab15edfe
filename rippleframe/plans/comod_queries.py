"""Queries over change history and the file manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.operators import comod
from rippleframe.plans.base import query
from rippleframe.sources.views import line_tasks, view

PLANNED = ("Brand#11", "Brand#12", "Brand#13")
_PLAN = ", ".join(f"'{p}'" for p in PLANNED)
THRESHOLD = 0.16
_CONF = "n AS (SELECT file, count(*) AS alone FROM {commits} GROUP BY file), f AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS together, any_value(n.alone) AS alone, count(*) / any_value(n.alone) AS confidence FROM {commits} a JOIN {commits} b ON a.commit_id = b.commit_id AND a.file <> b.file JOIN n ON n.file = a.file GROUP BY 1, 2) "
_GAPS = "SELECT file_b AS file, max(confidence) AS best, count(*) AS sources FROM f WHERE confidence >= 0.16 AND file_a IN (" + _PLAN + ") AND file_b NOT IN (" + _PLAN + ") GROUP BY file_b"
_DIR_PLAN = "ECONOMY/Brand#2/blue_bolt.go", "SMALL/Brand#4/red_ring.go"


def _plan(spark):
    return spark.createDataFrame([(p,) for p in PLANNED], "file string")


@query("AND_VIEWS " + _CONF + "SELECT * FROM f")
def comod_confidence(spark, sf):
    return comod.confidence(view(spark, sf, "commits"))


@query("AND_VIEWS " + _CONF + _GAPS)
def comod_gaps(spark, sf):
    return comod.gaps(view(spark, sf, "commits"), _plan(spark), THRESHOLD)


@query("AND_VIEWS " + _CONF + _GAPS + " HAVING count(*) >= 2")
def comod_hubs(spark, sf):
    return comod.hubs(comod_gaps(spark, sf), planned=len(PLANNED))


@query("SELECT CASE WHEN count(*) = 0 THEN 1.0 ELSE greatest(0.4, least(1.0, 2 / sqrt(count(*)))) END AS threshold, count(*) AS files FROM (SELECT DISTINCT file FROM {commits})")
def adaptive_threshold(spark, sf):
    n = view(spark, sf, "commits").agg(F.countDistinct("file").alias("files"))
    return n.select(comod.adaptive_threshold(F.col("files")).alias("threshold"), "files")


@query("SELECT count(*) AS rows, count(DISTINCT commit_id) AS commits, min(commit_id) AS oldest FROM {commits} WHERE commit_id IN (SELECT commit_id FROM (SELECT DISTINCT commit_id FROM {commits}) ORDER BY commit_id DESC LIMIT 200)")
def newest_commits(spark, sf):
    return comod.newest_commits(view(spark, sf, "commits")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("commit_id").alias("commits"), F.min("commit_id").alias("oldest"))


@query("AND_VIEWS p AS (SELECT unnest(['ECONOMY/Brand#2', 'ECONOMY', 'SMALL/Brand#4', 'SMALL']) AS plan_dir), t AS (SELECT DISTINCT plan_dir, commit_id FROM p JOIN {commit_paths} c ON starts_with(c.file, plan_dir || '/')), n AS (SELECT plan_dir, count(*) AS touching FROM t GROUP BY 1 HAVING count(*) >= 3) SELECT t.plan_dir, c.file, count(*) AS together, any_value(touching) AS touching, count(*) / any_value(touching) AS frequency FROM t JOIN n ON n.plan_dir = t.plan_dir JOIN {commit_paths} c ON c.commit_id = t.commit_id WHERE NOT starts_with(c.file, t.plan_dir || '/') AND c.file NOT IN ('" + "', '".join(_DIR_PLAN) + "') GROUP BY 1, 2 HAVING frequency >= 0.003")
def dir_comod(spark, sf):
    return comod.dir_comod(view(spark, sf, "commit_lines"), spark.createDataFrame([(p,) for p in _DIR_PLAN], "file string"), 0.003, tasks=line_tasks(spark, sf, 500_000))


@query("SELECT a.base AS base_a, b.base AS base_b, count(*) AS dirs FROM {manifest} a JOIN {manifest} b ON a.dir = b.dir AND a.base < b.base GROUP BY 1, 2 HAVING count(*) >= 5")
def pair_conventions(spark, sf):
    return comod.convention_pairs(view(spark, sf, "manifest"))


@query("AND_VIEWS p AS (SELECT a.base AS base, b.base AS companion, count(*) AS score FROM {manifest} a JOIN {manifest} b ON a.dir = b.dir AND a.base <> b.base GROUP BY 1, 2 HAVING count(*) >= 5) SELECT base, companion, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY score DESC, companion) AS r FROM p) WHERE r <= 2")
def companion_score(spark, sf):
    return comod.companions(comod.convention_pairs(view(spark, sf, "manifest")))


@query("AND_VIEWS " + _CONF + ", g AS (" + _GAPS + ") SELECT g.*, CASE file WHEN 'Brand#1' THEN 'known' WHEN 'Brand#5' THEN 'later' END AS reason, file IN ('Brand#1', 'Brand#5') AS acknowledged FROM g")
def acknowledged_gaps(spark, sf):
    return comod.acknowledged(comod_gaps(spark, sf), spark.createDataFrame([("Brand#1", "known"), ("x/Brand#5", "later")], "file string, reason string"))


@query("AND_VIEWS " + _CONF + "SELECT DISTINCT file_b AS file FROM f WHERE file_a = 'Brand#11' AND file_b NOT IN ('Brand#1', 'Brand#2')")
def excluded_by_name(spark, sf):
    found = comod.confidence(view(spark, sf, "commits"), spark.createDataFrame([("Brand#11",)], "file string")).select(F.col("file_b").alias("file")).distinct()
    return comod.excluded(found, spark.createDataFrame([("Brand#1",), ("dir/Brand#2",)], "file string"))


@query("AND_VIEWS w AS (SELECT path FROM {manifest} WHERE dir = 'ECONOMY/Brand#2' UNION SELECT 'Brand#4/' || base FROM {manifest} WHERE dir LIKE '%/Brand#4' UNION SELECT 'else/where/' || base FROM {manifest} WHERE parent = 'SMALL'), h AS (SELECT w.path, count(*) AS n, max(CASE WHEN m.path = w.path THEN m.path END) AS exact, min(m.path) AS any_path FROM w JOIN {manifest} m ON m.path = w.path OR ends_with(m.path, '/' || w.path) GROUP BY 1), b AS (SELECT base, count(*) AS bases, min(path) AS one_path FROM {manifest} GROUP BY 1), k AS (SELECT w.path, exact, any_path, one_path, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'suffix' WHEN bases = 1 THEN 'base' ELSE 'none' END AS how FROM w LEFT JOIN h ON h.path = w.path LEFT JOIN b ON b.base = regexp_replace(w.path, '^.*/', '')) SELECT path, CASE how WHEN 'exact' THEN exact WHEN 'suffix' THEN any_path WHEN 'base' THEN one_path END AS resolved, how FROM k")
def resolve_paths(spark, sf):
    m = view(spark, sf, "manifest")
    wanted = m.filter("dir = 'ECONOMY/Brand#2'").select("path").union(m.filter("dir LIKE '%/Brand#4'").select(F.concat(F.lit("Brand#4/"), "base"))).union(m.filter("parent = 'SMALL'").select(F.concat(F.lit("else/where/"), "base")))
    return comod.resolve_paths(wanted, m)


@query("SELECT DISTINCT dir FROM (SELECT dir FROM {manifest} UNION SELECT parent FROM {manifest}) a WHERE NOT EXISTS (SELECT 1 FROM {manifest} b WHERE starts_with(b.dir, a.dir || '/'))")
def leaf_dirs(spark, sf):
    m = view(spark, sf, "manifest")
    return comod.leaf_dirs(m.select("dir").union(m.select("parent")))


@query("AND_VIEWS p AS (SELECT * FROM {manifest} WHERE base = 'red_ring.go'), s AS (SELECT p.path AS plan_file, m.path AS file, 'dir-sibling' AS kind FROM p JOIN {manifest} m ON m.dir = p.dir AND m.path <> p.path UNION ALL SELECT p.path, m.path, 'peer-dir' FROM p JOIN {manifest} m ON m.parent = p.parent AND m.base = p.base AND m.dir <> p.dir) SELECT plan_file, file, kind FROM (SELECT *, row_number() OVER (PARTITION BY plan_file, kind ORDER BY file) AS r FROM s) WHERE r <= 3")
def directory_siblings(spark, sf):
    m = view(spark, sf, "manifest")
    return comod.siblings(m.filter("base = 'red_ring.go'"), m)


@query("SELECT base, list_aggregate(list_sort(list(path)), 'string_agg', ',') AS paths, count(*) AS n FROM {manifest} GROUP BY 1")
def basename_index(spark, sf):
    found = view(spark, sf, "manifest").groupBy("base").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"), F.count(F.lit(1)).alias("n"))
    return found


@query("SELECT dir, count(*) AS files, count(*) FILTER (base LIKE 'red%') AS tests, count(*) FILTER (base LIKE 'red%') / count(*) AS ratio FROM {manifest} GROUP BY 1")
def directory_counts(spark, sf):
    red = F.startswith("base", F.lit("red"))
    return view(spark, sf, "manifest").groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.count_if(red).alias("tests"), (F.count_if(red) / F.count(F.lit(1))).alias("ratio"))


@query("SELECT parent, string_agg(dir, ',' ORDER BY dir) AS dirs, count(*) AS n FROM (SELECT DISTINCT parent, dir FROM {manifest}) GROUP BY 1")
def directory_tree(spark, sf):
    return view(spark, sf, "manifest").groupBy("parent").agg(F.array_sort(F.collect_set("dir")).alias("d")).select("parent", F.array_join("d", ",").alias("dirs"), F.size("d").cast("long").alias("n"))
