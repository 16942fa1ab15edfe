"""Queries over the reference graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rippleframe.operators import graph
from rippleframe.plans.base import query
from rippleframe.sources.views import view

PLANNED = ("Brand#11", "Brand#12", "Brand#13")
_PLAN = ", ".join(f"'{p}'" for p in PLANNED)
SEED_MODULO = 400
_DEPTHS = "t(id, depth) AS (SELECT from_def, 0 FROM {sparse_refs} r JOIN {defs} s ON s.id = r.to_def WHERE s.id % 400 = 1 UNION SELECT r.from_def, depth + 1 FROM t JOIN {sparse_refs} r ON r.to_def = t.id WHERE depth < 4)"


def _plan(spark):
    return spark.createDataFrame([(p,) for p in PLANNED], "file string")


def _graph(spark, sf, sparse=False):
    return view(spark, sf, "sparse_refs" if sparse else "refs"), view(spark, sf, "defs")


def _seeds(spark, sf):
    return view(spark, sf, "defs").filter(F.col("id") % SEED_MODULO == 1).select("id")


@query("SELECT to_def AS id, count(*) AS callers FROM {refs} GROUP BY 1")
def in_degree(spark, sf):
    return graph.in_degree(view(spark, sf, "refs"))


@query("SELECT id, (SELECT count(*) FROM {refs} r WHERE r.to_def = d.id) AS callers FROM {defs} d")
def in_degree_each(spark, sf):
    refs, defs = _graph(spark, sf)
    return graph.callers_each(refs, defs).select("id", "callers")


@query("SELECT to_def AS id, count(*) AS callers FROM {refs} GROUP BY 1 ORDER BY callers DESC, id LIMIT 15")
def in_degree_topk(spark, sf):
    return in_degree(spark, sf).orderBy(F.desc("callers"), "id").limit(15)


@query("SELECT t.id, count(DISTINCT s.id) AS external_callers FROM {refs} r JOIN {defs} s ON s.id = from_def JOIN {defs} t ON t.id = to_def WHERE t.exported AND NOT s.is_test AND s.source_file <> t.source_file GROUP BY 1")
def external_callers(spark, sf):
    return graph.external_callers(*_graph(spark, sf))


@query("SELECT d.id, count(DISTINCT t.id) AS tests FROM {defs} d LEFT JOIN {refs} r ON r.to_def = d.id LEFT JOIN {defs} t ON t.id = r.from_def AND t.is_test GROUP BY 1")
def test_coverage_count(spark, sf):
    return graph.test_coverage(*_graph(spark, sf))


@query("SELECT id FROM {defs} WHERE id NOT IN (SELECT to_def FROM {refs})")
def not_in_anti(spark, sf):
    return graph.not_referenced(*_graph(spark, sf))


@query("SELECT DISTINCT to_def AS id, s.source_file AS caller_file FROM {refs} JOIN {defs} s ON s.id = from_def JOIN {defs} t ON t.id = to_def WHERE NOT s.is_test AND s.source_file <> t.source_file")
def callers(spark, sf):
    return graph.callers(*_graph(spark, sf))


@query("SELECT DISTINCT from_def AS id, t.source_file AS callee_file FROM {refs} JOIN {defs} s ON s.id = from_def JOIN {defs} t ON t.id = to_def WHERE NOT t.is_test AND s.source_file <> t.source_file")
def callees(spark, sf):
    return graph.callees(*_graph(spark, sf))


@query("SELECT s.source_file, count(*) AS links FROM {refs} JOIN {defs} s ON s.id = from_def JOIN {defs} t ON t.id = to_def WHERE t.source_file IN (" + _PLAN + ") AND s.source_file NOT IN (" + _PLAN + ") GROUP BY 1")
def structural_links(spark, sf):
    return graph.structural_links(*_graph(spark, sf), _plan(spark))


@query("SELECT DISTINCT source_file FROM {defs} WHERE source_file <> 'Brand#11' AND module_id IN (SELECT module_id FROM {defs} WHERE source_file = 'Brand#11')")
def module_siblings_semi(spark, sf):
    return graph.module_siblings(view(spark, sf, "defs"), "Brand#11")


@query("SELECT t.module_id AS to_module, s.module_id AS from_module, count(*) AS refs FROM {refs} JOIN {defs} s ON s.id = from_def JOIN {defs} t ON t.id = to_def WHERE s.module_id <> t.module_id GROUP BY 1, 2")
def cross_module_callers(spark, sf):
    return graph.cross_module_callers(*_graph(spark, sf))


@query("SELECT name, receiver, count(r.from_def) AS callers FROM {defs} d LEFT JOIN {refs} r ON r.to_def = d.id GROUP BY 1, 2")
def left_join_callers(spark, sf):
    return graph.callers_by_name(*_graph(spark, sf))


@query("SELECT receiver, id, callers, CAST(r AS INTEGER) AS rank FROM (SELECT receiver, id, callers, row_number() OVER (PARTITION BY receiver ORDER BY callers DESC, id) AS r FROM (SELECT receiver, id, (SELECT count(*) FROM {refs} r WHERE r.to_def = d.id) AS callers FROM {defs} d WHERE exported AND NOT is_test)) WHERE r <= 5")
def top_siblings(spark, sf):
    return graph.top_siblings(*_graph(spark, sf), 5)


@query("SELECT a.from_def AS id, b.to_def AS second FROM {refs} a JOIN {refs} b ON a.to_def = b.from_def WHERE a.from_def <> b.to_def EXCEPT SELECT from_def, to_def FROM {refs}")
def two_hop(spark, sf):
    return graph.two_hop(view(spark, sf, "refs"))


@query("AND_VIEWS " + _DEPTHS + " SELECT DISTINCT t.id FROM t JOIN {defs} d ON d.id = t.id WHERE d.is_test", True)
def closure_depth4(spark, sf):
    refs, defs = _graph(spark, sf, True)
    return graph.reachable_callers(refs, _seeds(spark, sf), 5).join(defs.filter("is_test"), "id", "left_semi").select("id")


@query("AND_VIEWS " + _DEPTHS.replace("depth < 4", "depth < 3") + " SELECT count(DISTINCT CASE WHEN d.is_test THEN t.id END) AS tests, count(DISTINCT CASE WHEN NOT d.is_test THEN t.id END) AS production, count(DISTINCT CASE WHEN depth = 0 THEN t.id END) AS direct FROM t JOIN {defs} d ON d.id = t.id", True)
def impact_depth3(spark, sf):
    return graph.impact(*_graph(spark, sf, True), _seeds(spark, sf), 4)


@query("AND_VIEWS t(seed, id, depth) AS (SELECT r.to_def, r.from_def, 0 FROM {sparse_refs} r WHERE r.to_def % 400 = 1 UNION SELECT t.seed, r.from_def, depth + 1 FROM t JOIN {sparse_refs} r ON r.to_def = t.id WHERE depth < 4), f AS (SELECT seed, t.id, min(depth) AS hop, any_value(d.is_test) AS is_test FROM t JOIN {defs} d ON d.id = t.id GROUP BY 1, 2) SELECT m.id, count(CASE WHEN hop = 0 AND NOT f.is_test THEN 1 END) AS direct_callers, count(CASE WHEN hop = 0 AND f.is_test THEN 1 END) AS direct_tests, count(CASE WHEN NOT f.is_test THEN 1 END) AS all_callers, count(CASE WHEN f.is_test THEN 1 END) AS tests FROM {defs} m LEFT JOIN f ON f.seed = m.id WHERE m.id % 400 = 1 GROUP BY 1", True)
def forward_simulation(spark, sf):
    return graph.forward_simulation(*_graph(spark, sf, True), _seeds(spark, sf), 5)


@query("AND_VIEWS e AS (SELECT t.source_file AS plan_file, s.source_file AS file, s.is_test AS s_test, to_def FROM {refs} JOIN {defs} s ON s.id = from_def JOIN {defs} t ON t.id = to_def WHERE t.exported AND NOT t.is_test AND t.source_file IN (" + _PLAN + ")), n AS (SELECT to_def, count(*) AS total FROM e GROUP BY 1), g AS (SELECT file, plan_file, e.to_def, count(*) AS callers, count(*) / any_value(total) AS frequency FROM e JOIN n ON n.to_def = e.to_def WHERE NOT s_test AND file NOT IN (" + _PLAN + ") GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY frequency DESC, callers DESC, plan_file DESC, to_def) AS r FROM g WHERE frequency >= 0.1) SELECT file, plan_file, callers, frequency, CASE WHEN frequency > 0.5 OR callers >= 5 THEN 'high' ELSE 'moderate' END AS confidence FROM b WHERE r = 1")
def blast_radius_gaps(spark, sf):
    return graph.blast_gaps(*_graph(spark, sf), _plan(spark))


@query("AND_VIEWS c AS (SELECT d.*, (SELECT count(*) FROM {refs} r WHERE r.to_def = d.id) AS callers FROM {defs} d), w AS (SELECT 'own' || id AS key, name, receiver FROM {defs} UNION ALL SELECT 'other' || id, name, 'NONE' FROM {defs} UNION ALL SELECT 'end' || id, name, '*' || right(receiver, 2) FROM {defs}), j AS (SELECT w.key, c.id, CASE WHEN w.receiver = c.receiver THEN 0 WHEN count(*) OVER (PARTITION BY w.key) = 1 THEN 1 WHEN ends_with(c.receiver, ltrim(w.receiver, '*')) THEN 2 ELSE 3 END AS h, c.callers FROM w JOIN c ON c.name = w.name), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY h, CASE WHEN h = 3 THEN callers ELSE 0 END DESC, id) AS r FROM j) SELECT key, id, CASE h WHEN 0 THEN 'exact' WHEN 1 THEN 'unique' WHEN 2 THEN 'suffix' ELSE 'callers' END AS how FROM k WHERE r = 1")
def resolve_definition(spark, sf):
    refs, defs = _graph(spark, sf)
    known = defs.select(F.concat(F.lit("own"), "id").alias("key"), "name", "receiver")
    unknown = defs.select(F.concat(F.lit("other"), "id").alias("key"), "name", F.lit("NONE").alias("receiver"))
    ends = defs.select(F.concat(F.lit("end"), "id").alias("key"), "name", F.concat(F.lit("*"), F.right("receiver", F.lit(2))).alias("receiver"))
    return graph.resolve(known.union(unknown).union(ends), refs, defs)


def _broken(i):
    at = "SELECT id FROM {defs} WHERE id % 400 = 1" if i == 0 else f"SELECT min(from_def) AS id FROM h{i - 1} GROUP BY name, receiver"
    before = "".join(f" AND (s.name, s.receiver) NOT IN (SELECT (name, receiver) FROM h{j})" for j in range(i))
    return f"h{i} AS (SELECT DISTINCT s.name, s.receiver, from_def, s.source_file AS file FROM ({at}) m JOIN {{sparse_refs}} ON to_def = m.id JOIN {{defs}} s ON s.id = from_def WHERE NOT s.is_test{before})"


@query("AND_VIEWS " + ", ".join(map(_broken, range(4))) + ", a AS (" + " UNION ALL ".join(f"SELECT {i} AS depth, * FROM h{i}" for i in range(4)) + "), f AS (SELECT depth, file, count(DISTINCT (name, receiver)) AS breaks FROM a GROUP BY 1, 2), l AS (SELECT depth, count(DISTINCT (name, receiver)) AS new_breaks FROM a GROUP BY 1) SELECT f.depth, file, breaks, new_breaks, (SELECT CAST(sum(new_breaks) AS BIGINT) FROM l b WHERE b.depth <= f.depth) AS cumulative, (SELECT count(*) FROM h3) = 0 AS converged FROM f JOIN l ON l.depth = f.depth")
def cascade_by_depth(spark, sf):
    refs, defs = _graph(spark, sf, True)
    return graph.cascade(refs, defs, _seeds(spark, sf).withColumn("kind", F.lit("removal")), 4)


@query("AND_VIEWS c AS (SELECT d.*, (SELECT count(*) FROM {refs} r WHERE r.to_def = d.id) AS callers FROM {defs} d), b AS (SELECT name FROM c WHERE receiver = 'SMALL' AND exported AND NOT is_test ORDER BY callers DESC, id LIMIT 1), o AS (SELECT id FROM {defs} WHERE receiver = 'SMALL' AND name IN (SELECT name FROM b)) SELECT DISTINCT 'reference' AS kind, d.name FROM {refs} r JOIN {defs} d ON d.id = r.to_def WHERE NOT d.is_test AND r.from_def IN (SELECT id FROM o) UNION SELECT 'test', d.name FROM {refs} r JOIN {defs} d ON d.id = r.from_def WHERE d.is_test AND r.to_def IN (SELECT id FROM o)")
def backward_prereqs(spark, sf):
    return graph.backward_prerequisites(*_graph(spark, sf), "SMALL")


@query("SELECT name, receiver, max(callers) AS callers FROM (SELECT d.*, (SELECT count(*) FROM {refs} r WHERE r.to_def = d.id) AS callers FROM {defs} d) WHERE exported AND NOT is_test AND source_file IN (" + _PLAN + ") GROUP BY 1, 2 HAVING max(callers) >= 2 ORDER BY callers DESC, name, receiver LIMIT 5")
def mutation_selection(spark, sf):
    return graph.select_mutations(*_graph(spark, sf), _plan(spark))


@query("AND_VIEWS k AS (SELECT from_def, to_def, CASE WHEN regexp_matches(body, '\\b' || name || '\\s*\\(') THEN 'pass-through' WHEN regexp_matches(body, '\\.\\(\\s*\\*?' || name || '\\s*\\)') THEN 'indirect' WHEN regexp_matches(body, '\\.' || name || '\\b[^(]') THEN 'field' WHEN regexp_matches(body, '\\b' || name || '\\b') THEN 'type-ref' ELSE 'unknown' END AS kind FROM {bodies} JOIN {defs} ON id = to_def) SELECT *, CAST(CASE kind WHEN 'pass-through' THEN 1.0 WHEN 'field' THEN 0.8 WHEN 'indirect' THEN 0.2 ELSE 0.5 END AS DOUBLE) AS weight FROM k")
def coupling_class(spark, sf):
    named = view(spark, sf, "bodies").join(view(spark, sf, "defs").select(F.col("id").alias("to_def"), "name"), "to_def")
    found = named.select("from_def", "to_def", graph.coupling_kind(F.col("body"), F.col("name")).alias("kind"))
    return found.withColumn("weight", graph.coupling_weight(F.col("kind")))


@query("SELECT source_file AS key, count(CASE WHEN name LIKE '%ring%' THEN 1 END) + count(CASE WHEN name LIKE 'red%' THEN 1 END) AS hits FROM {defs} GROUP BY 1 HAVING hits > 0 ORDER BY hits DESC, key LIMIT 10")
def pattern_search(spark, sf):
    bodies = view(spark, sf, "defs").select(F.col("source_file").alias("key"), F.col("name").alias("body"))
    return graph.pattern_counts(bodies, ["%ring%", "red%"])


@query("SELECT s.module_id, count(*) AS \"references\", round((0.15 + 0.45 * least(count(*) / 5, 1.0)) * 1000) / 1000 AS coupling FROM {refs} JOIN {defs} s ON s.id = from_def JOIN {defs} t ON t.id = to_def WHERE t.source_file IN (" + _PLAN + ") AND s.source_file NOT IN (" + _PLAN + ") GROUP BY 1")
def importer_density(spark, sf):
    return graph.importer_density(*_graph(spark, sf), _plan(spark))


@query("SELECT source_file, count(*) FILTER (is_test) AS tests, count(*) AS definitions, count(*) FILTER (is_test) / count(*) AS density FROM {defs} GROUP BY 1")
def test_density(spark, sf):
    return graph.test_density(view(spark, sf, "defs"))


@query("AND_VIEWS g AS (SELECT d.id, d.is_test, (SELECT count(*) FROM {refs} r WHERE r.to_def = d.id) AS n FROM {defs} d) SELECT CASE WHEN n <= 2 THEN '0-2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '>20' END AS bucket, count(*) AS definitions, count(*) FILTER (is_test) AS tests FROM g GROUP BY 1")
def blast_buckets(spark, sf):
    each = graph.callers_each(*_graph(spark, sf))
    return each.groupBy(graph.blast_bucket(F.col("callers")).alias("bucket")).agg(F.count(F.lit(1)).alias("definitions"), F.count_if("is_test").alias("tests"))


@query("AND_VIEWS t(seed, id, depth) AS (SELECT r.to_def, r.from_def, 0 FROM {sparse_refs} r WHERE r.to_def % 100 = 1 UNION SELECT t.seed, r.from_def, depth + 1 FROM t JOIN {sparse_refs} r ON r.to_def = t.id WHERE depth < 4), f AS (SELECT seed, t.id, min(depth) AS hop, any_value(d.is_test) AS is_test FROM t JOIN {defs} d ON d.id = t.id GROUP BY 1, 2), m AS (SELECT m.id, count(CASE WHEN hop = 0 AND NOT f.is_test THEN 1 END) AS direct, count(CASE WHEN f.is_test THEN 1 END) AS tests FROM {defs} m LEFT JOIN f ON f.seed = m.id WHERE m.id % 100 = 1 GROUP BY 1), g AS (SELECT CAST(id % 4 AS INTEGER) AS segment, count(*) AS mutations, CAST(sum(direct) AS BIGINT) AS callers, CAST(sum(tests) AS BIGINT) AS tests FROM m GROUP BY 1) SELECT *, CASE WHEN callers >= 10 OR tests >= 30 THEN 'high' WHEN callers >= 3 OR tests >= 10 THEN 'moderate' ELSE 'low' END AS risk FROM g", True)
def subdivide_risk(spark, sf):
    refs, defs = _graph(spark, sf, True)
    return graph.subdivide(refs, defs, defs.filter("id % 100 = 1").select("id"), 4)


@query("AND_VIEWS c AS (SELECT d.source_file AS file, count(DISTINCT CASE WHEN s.is_test THEN (d.id, s.id) END) AS tests, count(DISTINCT CASE WHEN d.exported AND NOT s.is_test AND s.source_file <> d.source_file THEN (d.id, s.id) END) AS outside FROM {defs} d LEFT JOIN {refs} r ON r.to_def = d.id LEFT JOIN {defs} s ON s.id = r.from_def GROUP BY 1), k AS (SELECT DISTINCT source_file AS file, unnest(['tests', 'api-compat', 'no-new-deps']) AS kind FROM {defs}) SELECT k.file, kind, CASE kind WHEN 'tests' THEN tests > 0 WHEN 'api-compat' THEN outside = 0 ELSE false END AS verified, CASE kind WHEN 'tests' THEN tests WHEN 'api-compat' THEN outside END AS evidence FROM k JOIN c ON c.file = k.file")
def invariants(spark, sf):
    refs, defs = _graph(spark, sf)
    kinds = F.explode(F.array(*map(F.lit, ("tests", "api-compat", "no-new-deps"))))
    return graph.invariant_claims(refs, defs, defs.select(F.col("source_file").alias("file")).distinct().withColumn("kind", kinds))


_KIND = "CASE id % 4 WHEN 0 THEN 'signature-change' WHEN 1 THEN 'behavior-change' WHEN 2 THEN 'removal' ELSE 'other' END"
_SHOWN = "CASE WHEN {r}receiver = '' THEN {r}name ELSE '(' || {r}receiver || ').' || {r}name END"


def _shown(r=""):
    return _SHOWN.replace("{r}", r)


@query("AND_VIEWS h AS (SELECT to_def AS id, from_def, s.is_test, " + _shown("s.") + " AS who FROM {refs} JOIN {defs} s ON s.id = from_def), c AS (SELECT id, count(*) FILTER (NOT is_test) AS p, count(*) FILTER (is_test) AS t FROM h GROUP BY 1), f AS (SELECT id, string_agg(who, ',' ORDER BY from_def) AS l FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY from_def) AS r FROM h WHERE NOT is_test) WHERE r <= 10 GROUP BY 1), m AS (SELECT d.id, " + _KIND.replace("id", "d.id") + " AS kind, " + _shown("d.") + " AS who, coalesce(p, 0) AS p, coalesce(t, 0) AS t, coalesce(l, '') AS l FROM {defs} d LEFT JOIN c ON c.id = d.id LEFT JOIN f ON f.id = d.id), sh AS (SELECT avg(is_test::INT) AS share FROM {defs}) SELECT id, p AS production_callers, t AS test_callers, l AS top_callers, CASE kind WHEN 'signature-change' THEN who || ' signature change: ' || p || ' production callers will break, ' || t || ' tests cover this' WHEN 'behavior-change' THEN who || ' behavior change: ' || p || ' production callers unaffected syntactically, ' || t || ' tests may fail' WHEN 'removal' THEN who || ' removal: ' || p || ' production callers + ' || t || ' test callers will fail to compile' ELSE who || ': ' || p || ' production callers, ' || t || ' tests' END AS impact, CASE WHEN share > 0.35 THEN 'high' WHEN share > 0.20 THEN 'moderate' ELSE 'low' END AS confidence FROM m, sh")
def impact_report(spark, sf):
    """What each definition's change would do."""
    refs, defs = _graph(spark, sf)
    kinds = F.element_at(F.array(*map(F.lit, ("signature-change", "behavior-change", "removal", "other"))), (F.col("id") % 4 + 1).cast("int"))
    return graph.impact_report(refs, defs, defs.select("id", kinds.alias("kind"))).withColumn("top_callers", F.array_join("top_callers", ","))


@query("AND_VIEWS RECURSIVE_ m AS (SELECT d.module_id AS plan_id, row_number() OVER (PARTITION BY d.module_id ORDER BY d.id) AS pos, (SELECT count(*) FROM {refs} r JOIN {defs} s ON s.id = r.from_def WHERE r.to_def = d.id AND NOT s.is_test) AS callers, (SELECT count(*) FROM {refs} r JOIN {defs} s ON s.id = r.from_def WHERE r.to_def = d.id AND s.is_test) AS tests FROM {defs} d), u AS (SELECT plan_id, pos, CAST(sum(callers) OVER w AS BIGINT) AS c, CAST(sum(tests) OVER w AS BIGINT) AS t FROM m WINDOW w AS (PARTITION BY plan_id ORDER BY pos) UNION ALL SELECT DISTINCT plan_id, 0, 0, 0 FROM m), g(plan_id, first, last, callers, tests, goes_on) AS (SELECT plan_id, CAST(1 AS BIGINT), max(pos), CAST(0 AS BIGINT), CAST(0 AS BIGINT), true FROM m GROUP BY 1 UNION ALL SELECT x.plan_id, x.a, x.b, h.c - l.c, h.t - l.t, x.halved AND (h.c - l.c >= 10 OR h.t - l.t >= 30) AND x.b - x.a >= 2 FROM (SELECT plan_id, unnest(CASE WHEN last - first < 3 THEN range(first, last + 1) ELSE [first, first + (last - first + 1) // 2] END) AS a, unnest(CASE WHEN last - first < 3 THEN range(first, last + 1) ELSE [first + (last - first + 1) // 2 - 1, last] END) AS b, last - first >= 3 AS halved FROM g WHERE goes_on) x JOIN u l ON l.plan_id = x.plan_id AND l.pos = x.a - 1 JOIN u h ON h.plan_id = x.plan_id AND h.pos = x.b) SELECT plan_id, first, last, callers, tests, CASE WHEN callers >= 10 OR tests >= 30 THEN 'high' WHEN callers >= 3 OR tests >= 10 THEN 'moderate' ELSE 'low' END AS risk FROM g WHERE NOT goes_on".replace("RECURSIVE_ ", ""), True)
def subdivide_plans(spark, sf):
    """Each module's definitions as a plan's mutations, divided by risk until no half of high risk is left to halve."""
    refs, defs = _graph(spark, sf)
    kinds = refs.join(defs.select(F.col("id").alias("from_def"), "is_test"), "from_def").groupBy(F.col("to_def").alias("id")).agg(F.count_if(~F.col("is_test")).alias("callers"), F.count_if("is_test").alias("tests"))
    pos = F.row_number().over(Window.partitionBy("plan_id").orderBy("id"))
    each = defs.select("id", F.col("module_id").alias("plan_id")).join(kinds, "id", "left").na.fill(0, ["callers", "tests"]).withColumn("pos", pos)
    return graph.subdivide_plans(each)
