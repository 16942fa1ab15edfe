"""Queries that read sources, and those that follow names through graphs, directories and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleframe.operators import addition, evaluate, infer, keywords, verified
from rippleframe.plans.base import query
from rippleframe.sources import golang
from rippleframe.sources.scratch import written
from rippleframe.sources.views import line_tasks, view

# --- sources written from the graph: a file is a module's parts of one brand, a function a part ---

_GO = "d AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'f' END || p_partkey AS name, p_brand || '.go' AS base, 'm' || p_size || '/' || p_brand || '.go' AS path, p_size % 5 = 0 AS is_test, p_brand AS brand, p_size FROM {part}), calls AS (SELECT s.path, t.name AS callee, from_def, to_def FROM {refs} JOIN d s ON s.id = from_def JOIN d t ON t.id = to_def WHERE to_def % 3 = 0), ex AS (SELECT DISTINCT path, name FROM d WHERE p_size % 2 = 0), own AS (SELECT DISTINCT brand AS plan_id, path FROM d WHERE p_size = 2), taken AS (SELECT DISTINCT plan_id, plan_id || '.go' AS base FROM own)"
_NOT_OWN = "NOT EXISTS (SELECT 1 FROM own o WHERE o.plan_id = x.plan_id AND o.path = x.path)"
_NOT_TAKEN = "NOT EXISTS (SELECT 1 FROM taken k WHERE k.plan_id = x.plan_id AND k.base = x.base)"


def _go_defs(spark, sf):
    exported = F.col("p_size") % 2 == 0
    named = view(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.when(exported, "F").otherwise("f"), "p_partkey").alias("name"), F.lit("").alias("receiver"), F.concat("p_brand", F.lit(".go")).alias("source_file"),
        F.concat(F.lit("m"), "p_size", F.lit("/"), "p_brand", F.lit(".go")).alias("path"), (F.col("p_size") % 5 == 0).alias("is_test"), F.col("p_brand").alias("brand"), "p_size",
    )
    return named


def _go_texts(spark, sf):
    """id (path), text: functions with as many parameters as their id says, calls of a third of what they refer to, and comments and strings that look like calls of the rest."""
    defs = _go_defs(spark, sf)
    to = defs.select(F.col("id").alias("to_def"), F.col("name").alias("callee"))
    said = F.when(F.col("to_def") % 3 == 0, F.concat(F.lit("\tx."), "callee", F.lit("(1, g[0],\n\t\t2)"))).when(F.col("to_def") % 3 == 1, F.concat(F.lit("\t// "), "callee", F.lit("(1)"))).otherwise(F.concat(F.lit('\ts := "'), "callee", F.lit('(1)"')))
    # A function has as many lines as its definition has references, a file as many as its parts have.
    bodies = view(spark, sf, "refs").join(to, "to_def").groupBy(F.col("from_def").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(said)), "\n").alias("body"))
    params = F.element_at(F.array(*map(F.lit, ("", "a int", "a, b int", "a func(int, int) error, b map[string][]int, c ...string"))), (F.col("id") % 4 + 1).cast("int"))
    results = F.element_at(F.array(*map(F.lit, (" ", " error ", " (n int, err error) "))), (F.col("id") % 3 + 1).cast("int"))
    code = F.concat(F.lit("func "), "name", F.lit("("), params, F.lit(")"), results, F.lit("{\n"), F.coalesce("body", F.lit("")), F.lit("\n}\n"))
    whole = defs.join(bodies, "id", "left").select("path", code.alias("code"))
    return whole.groupBy(F.col("path").alias("id")).agg(F.concat(F.lit("package m\n\n"), F.array_join(F.array_sort(F.collect_list("code")), "\n")).alias("text"))


def _relations(spark, sf):
    """refs, defs, files, calls, exports and planned, the last three from the texts, which are read once however often these are joined."""
    defs = _go_defs(spark, sf)
    said = written(golang.names(_go_texts(spark, sf)).withColumnRenamed("id", "path"), "go-names")
    calls = said.filter("kind = 'call'").select("path", F.col("name").alias("callee"))
    exports = said.filter("kind = 'function'").filter(F.col("name").rlike("^[A-Z]") & ~F.col("name").rlike("^Test")).select("path", "name")
    planned = defs.filter("p_size = 2").select(F.col("brand").alias("plan_id"), "path").distinct()
    return view(spark, sf, "refs"), defs, defs.select("path", F.col("source_file").alias("base")).distinct(), calls, exports, planned


@query("AND_VIEWS " + _GO + " SELECT path AS id, name, CAST(id % 4 AS INTEGER) AS params, CAST(id % 3 AS INTEGER) AS results FROM d")
def go_arity(spark, sf):
    """Parameters and results of every function, counted in the sources."""
    return golang.functions(_go_texts(spark, sf)).select("id", "name", "params", "results")


@query("AND_VIEWS " + _GO + " SELECT path, callee, count(*) AS sites, 3 * count(*) AS args FROM calls GROUP BY 1, 2")
def go_call_sites(spark, sf):
    found = golang.calls(_go_texts(spark, sf))
    return found.groupBy(F.col("id").alias("path"), "callee").agg(F.count(F.lit(1)).alias("sites"), F.sum("args").alias("args"))


def _level(i):
    before = "".join(f" AND NOT EXISTS (SELECT 1 FROM v{j} w WHERE w.plan_id = x.plan_id AND w.path = x.path)" for j in range(i))
    return (
        f", b{i} AS (SELECT DISTINCT plan_id, base FROM n{i} JOIN cf ON cf.name = n{i}.name), c{i} AS (SELECT x.plan_id, f.path FROM b{i} x JOIN f ON f.base = x.base WHERE {_NOT_TAKEN}),"
        f" v{i} AS (SELECT x.plan_id, x.path, count(*) AS sites FROM c{i} x JOIN calls ON calls.path = x.path JOIN n{i} n ON n.plan_id = x.plan_id AND n.name = calls.callee WHERE {_NOT_OWN}{before} GROUP BY 1, 2),"
        f" n{i + 1} AS (SELECT DISTINCT plan_id, name FROM v{i} JOIN ex ON ex.path = v{i}.path)"
    )


_CASCADE = _GO + ", cf AS (SELECT DISTINCT t.name, s.base FROM {refs} JOIN d t ON t.id = to_def JOIN d s ON s.id = from_def WHERE NOT s.is_test), f AS (SELECT base, path FROM (SELECT base, path, row_number() OVER (PARTITION BY base ORDER BY path) AS r FROM (SELECT DISTINCT base, path FROM d)) WHERE r <= 3), n0 AS (SELECT DISTINCT plan_id, name FROM own JOIN ex ON ex.path = own.path)" + "".join(map(_level, range(3)))


@query("AND_VIEWS " + _CASCADE + ", a AS (SELECT *, 0 AS depth FROM v0 UNION ALL SELECT *, 1 FROM v1 UNION ALL SELECT *, 2 FROM v2), r AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY depth, path) AS r FROM a) SELECT plan_id, path, depth, CAST(CASE depth WHEN 0 THEN 0.7 WHEN 1 THEN 0.5 ELSE 0.35 END AS DOUBLE) AS score, sites FROM r WHERE r <= 10")
def verified_cascade(spark, sf):
    return verified.verified_cascade(*_relations(spark, sf), depth=3)


_BOTH = ", q AS (SELECT DISTINCT o.plan_id, ex.name FROM own o JOIN ex ON ex.path = o.path), fw AS (SELECT x.plan_id, x.path, count(*) AS n FROM cand x JOIN calls ON calls.path = x.path JOIN q ON q.plan_id = x.plan_id AND q.name = calls.callee GROUP BY 1, 2), pc AS (SELECT o.plan_id, callee AS name, count(*) AS n FROM own o JOIN calls ON calls.path = o.path GROUP BY 1, 2), bw AS (SELECT x.plan_id, x.path, CAST(sum(pc.n) AS BIGINT) AS n FROM cand x JOIN ex ON ex.path = x.path JOIN pc ON pc.plan_id = x.plan_id AND pc.name = ex.name GROUP BY 1, 2), vf AS (SELECT coalesce(fw.plan_id, bw.plan_id) AS plan_id, coalesce(fw.path, bw.path) AS path, coalesce(fw.n, 0) AS caller_sites, coalesce(bw.n, 0) AS callee_sites FROM fw FULL JOIN bw ON bw.plan_id = fw.plan_id AND bw.path = fw.path) "


@query("AND_VIEWS " + _GO + ", cand AS (SELECT DISTINCT own.plan_id, d.path FROM own, d)" + _BOTH + "SELECT * FROM vf")
def verify_files(spark, sf):
    """Every file of the sources against every plan, in both directions."""
    _, defs, files, calls, exports, planned = _relations(spark, sf)
    plans = F.array_sort(F.collect_set("plan_id")).alias("plans")
    # There is one plan a brand; each file is asked for all of them.
    asked = files.join(F.broadcast(planned.agg(plans)), F.lit(True)).select("path", F.explode("plans").alias("plan_id"))
    return verified.verify_files(asked, calls, exports, planned)


@query("AND_VIEWS " + _GO + ", q0 AS (SELECT DISTINCT o.plan_id, ex.name FROM own o JOIN ex ON ex.path = o.path), e AS (SELECT s.name AS from_name, s.base AS from_base, t.name AS to_name, t.base AS to_base FROM {refs} JOIN d s ON s.id = from_def JOIN d t ON t.id = to_def WHERE NOT s.is_test AND NOT t.is_test), bs AS (SELECT plan_id, from_base AS base FROM q0 JOIN e ON to_name = name UNION SELECT plan_id, to_base FROM q0 JOIN e ON from_name = name), pa AS (SELECT DISTINCT base, path, 'm' || p_size AS dir FROM d), fi AS (SELECT x.plan_id, pa.path, row_number() OVER (PARTITION BY x.plan_id, pa.base ORDER BY CASE WHEN pa.dir = 'm2' THEN 0 ELSE 1 END, pa.path) AS r FROM bs x JOIN pa ON pa.base = x.base WHERE " + _NOT_TAKEN + "), cand AS (SELECT plan_id, path FROM fi x WHERE r <= 5 AND " + _NOT_OWN + ")" + _BOTH + "SELECT plan_id, path, CASE WHEN caller_sites > 0 THEN 'caller' ELSE 'callee' END AS direction, CAST(CASE WHEN caller_sites + callee_sites >= 3 THEN 0.8 WHEN caller_sites + callee_sites = 2 THEN 0.7 ELSE 0.6 END AS DOUBLE) AS score, caller_sites + callee_sites AS sites FROM vf")
def verified_discovery(spark, sf):
    return verified.verified_discovery(*_relations(spark, sf))


# --- additions and analogies ---

_RING = "sib AS (SELECT receiver AS key, id FROM (SELECT receiver, id, row_number() OVER (PARTITION BY receiver ORDER BY id) AS r FROM {defs} WHERE exported AND NOT is_test) WHERE r <= 10), nm AS (SELECT key, d.name, min((from_def, to_def)) AS pos FROM sib JOIN {refs} ON from_def = sib.id JOIN {defs} d ON d.id = to_def WHERE NOT d.is_test GROUP BY 1, 2), nk AS (SELECT key, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS r FROM nm) WHERE r <= 10), dg AS (SELECT d.name, d.id, count(r.from_def) AS callers FROM {defs} d LEFT JOIN {refs} r ON r.to_def = d.id WHERE NOT d.is_test GROUP BY 1, 2), rs AS (SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY callers DESC, id) AS r FROM dg) WHERE r = 1), ring AS (SELECT DISTINCT key, rs.id FROM nk JOIN rs ON rs.name = nk.name), sec AS (SELECT DISTINCT key, to_def AS id FROM ring JOIN {refs} ON from_def = ring.id EXCEPT SELECT key, id FROM ring), far AS (SELECT sec.key, from_def FROM sec JOIN {refs} ON to_def = sec.id WHERE (sec.key, from_def) NOT IN (SELECT (key, id) FROM ring UNION ALL SELECT (key, id) FROM sec)), c1 AS (SELECT key, d.is_test, NULL AS file FROM ring JOIN {refs} ON to_def = ring.id JOIN {defs} d ON d.id = from_def UNION ALL SELECT key, d.is_test, CASE WHEN NOT d.is_test THEN source_file END FROM far JOIN {defs} d ON d.id = from_def UNION ALL SELECT key, NULL, source_file FROM ring JOIN {defs} d ON d.id = ring.id)"


@query("AND_VIEWS " + _RING + " SELECT k.receiver AS key, (SELECT count(*) FROM nk WHERE nk.key = k.receiver) AS n_references, CASE WHEN k.receiver IN (SELECT key FROM sec) THEN 2 WHEN k.receiver IN (SELECT key FROM ring) THEN 1 ELSE 0 END AS chain_depth, count(DISTINCT file) AS files, count(*) FILTER (NOT is_test) AS production_callers, count(*) FILTER (is_test) AS test_callers FROM (SELECT DISTINCT receiver FROM {defs}) k LEFT JOIN c1 ON c1.key = k.receiver GROUP BY 1")
def addition_impact(spark, sf):
    """What one more method of each receiver would set in motion."""
    defs = view(spark, sf, "defs")
    return addition.addition_impact(view(spark, sf, "refs"), defs, defs.select(F.col("receiver").alias("key"), "receiver").distinct())


_ANALOGY = "dr AS (SELECT receiver AS repo, * FROM {defs}), rr AS (SELECT s.repo, from_def, to_def FROM {refs} JOIN dr s ON s.id = from_def JOIN dr t ON t.id = to_def WHERE s.repo = t.repo), tm AS (SELECT DISTINCT unnest(string_split(name, '_')) AS term FROM {defs}), kn AS (SELECT d.*, (SELECT count(*) FROM rr WHERE rr.to_def = d.id) AS callers FROM dr d), us AS (SELECT DISTINCT rr.repo, s.name, t.name AS reference FROM rr JOIN dr s ON s.id = from_def JOIN dr t ON t.id = to_def WHERE NOT s.is_test AND NOT t.is_test), be AS (SELECT * FROM (SELECT tm.term, kn.*, row_number() OVER (PARTITION BY term, repo ORDER BY callers DESC, id) AS r FROM tm JOIN kn ON contains(kn.name, tm.term) WHERE exported AND NOT is_test) WHERE r <= 3 AND callers > 0), na AS (SELECT * FROM (SELECT be.term, be.repo, be.id, be.name, be.callers, us.reference, row_number() OVER (PARTITION BY be.term, be.repo, be.id ORDER BY us.reference) AS q FROM be JOIN us ON us.repo = be.repo AND us.name = be.name) WHERE q <= 10)"


def _analogies(spark, sf):
    defs = view(spark, sf, "defs").withColumn("repo", F.col("receiver"))
    end = lambda c: defs.select(F.col("id").alias(c), F.col("repo").alias(f"{c}_repo"))
    refs = view(spark, sf, "refs").join(end("from_def"), "from_def").join(end("to_def"), "to_def").filter("from_def_repo = to_def_repo").select(F.col("from_def_repo").alias("repo"), "from_def", "to_def")
    terms = defs.select(F.explode(F.split("name", "_")).alias("term")).distinct()
    return addition.analogies(refs, defs, terms)


@query("AND_VIEWS " + _ANALOGY + ", ls AS (SELECT term, repo, id, string_agg(reference, ',' ORDER BY reference) AS l FROM na GROUP BY 1, 2, 3) SELECT be.term, be.repo, be.id, be.name, be.callers, be.source_file, coalesce(l, '') AS refs FROM be LEFT JOIN ls ON ls.term = be.term AND ls.repo = be.repo AND ls.id = be.id")
def analogies(spark, sf):
    """What each repository (a receiver's definitions) has by each word of the names."""
    return _analogies(spark, sf)[0].select("term", "repo", "id", "name", "callers", "source_file", F.array_join("references", ",").alias("refs"))


@query("AND_VIEWS " + _ANALOGY + ", tp AS (SELECT repo, name, max(callers) AS fame FROM kn WHERE exported AND NOT is_test GROUP BY 1, 2), kn2 AS (SELECT term, repo, sibling FROM (SELECT na.term, na.repo, us.name AS sibling, row_number() OVER (PARTITION BY na.term, na.repo, na.id, na.reference ORDER BY tp.fame DESC, us.name) AS r FROM na JOIN us ON us.repo = na.repo AND us.reference = na.reference AND us.name <> na.name JOIN tp ON tp.repo = us.repo AND tp.name = us.name WHERE na.callers >= 3) WHERE r <= 5 GROUP BY ALL), th AS (SELECT term, reference FROM (SELECT k.term, us.reference, row_number() OVER (PARTITION BY k.term, k.repo, k.sibling ORDER BY us.reference) AS r FROM kn2 k JOIN us ON us.repo = k.repo AND us.name = k.sibling) WHERE r <= 5) SELECT term, reference AS name, count(*) AS hits FROM (SELECT term, reference FROM na UNION ALL SELECT term, reference FROM th) GROUP BY 1, 2 HAVING count(*) >= 2")
def analogy_patterns(spark, sf):
    return _analogies(spark, sf)[1].filter("hits >= 2")


# --- paths and directories ---

_LINES = "{lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {orders} ON l_orderkey = o_orderkey"
_FULL = "p_type || '/' || p_brand || '/' || replace(p_name, ' ', '_') || '.go'"
_GOLD = f"gd AS (SELECT DISTINCT o_custkey AS task_id, CASE l_linenumber % 3 WHEN 0 THEN '/' || {_FULL} WHEN 1 THEN p_brand || '/' || replace(p_name, ' ', '_') || '.go' ELSE replace(p_name, ' ', '_') || '.go' END AS path FROM {_LINES} WHERE l_linestatus = 'O'), pl AS (SELECT DISTINCT o_custkey AS task_id, CASE WHEN l_linenumber % 2 = 0 THEN 'src/' ELSE '' END || {_FULL} AS path FROM {_LINES} WHERE l_returnflag = 'R')"
_MATCH = _GOLD + ", g AS (SELECT DISTINCT task_id, trim(path, '/') AS path FROM gd), p AS (SELECT DISTINCT task_id, trim(path, '/') AS path FROM pl), al AS (SELECT task_id, regexp_replace(path, '^.*/', '') AS base, min(path) AS matched FROM p GROUP BY 1, 2 HAVING count(*) = 1), h AS (SELECT g.task_id, g.path, p.path AS matched, CASE WHEN p.path = g.path THEN 0 ELSE 1 END AS how FROM g JOIN p ON p.task_id = g.task_id AND (p.path = g.path OR ends_with(p.path, '/' || g.path) OR ends_with(g.path, '/' || p.path)) UNION ALL SELECT g.task_id, g.path, al.matched, 2 FROM g JOIN al ON al.task_id = g.task_id AND al.base = regexp_replace(g.path, '^.*/', '')), m AS (SELECT g.task_id, g.path, arg_min(matched, (how, matched)) AS matched, min(how) AS how FROM g LEFT JOIN h ON h.task_id = g.task_id AND h.path = g.path GROUP BY 1, 2) "


def _gold(spark, sf):
    lines = view(spark, sf, "lineitem").join(view(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(view(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".go"))
    brand, n = F.concat("p_brand", F.lit("/"), name), F.col("l_linenumber")
    whole = F.concat("p_type", F.lit("/"), brand)
    gold = lines.filter("l_linestatus = 'O'").select(F.col("o_custkey").alias("task_id"), F.when(n % 3 == 0, F.concat(F.lit("/"), whole)).when(n % 3 == 1, brand).otherwise(name).alias("path"))
    plans = lines.filter("l_returnflag = 'R'").select(F.col("o_custkey").alias("task_id"), F.concat(F.when(n % 2 == 0, "src/").otherwise(""), whole).alias("path"))
    return gold, plans


@query("AND_VIEWS " + _MATCH + "SELECT task_id, path, matched, CASE how WHEN 0 THEN 'exact' WHEN 1 THEN 'suffix' WHEN 2 THEN 'basename' END AS how FROM m")
def gold_matches(spark, sf):
    return evaluate.gold_matches(*_gold(spark, sf), line_tasks(spark, sf, 200_000))


@query("AND_VIEWS " + _MATCH + ", c AS (SELECT task_id, count(*) AS gold, count(matched) AS hits FROM m GROUP BY 1), s AS (SELECT task_id, count(*) AS n FROM p GROUP BY 1), x AS (SELECT c.*, coalesce(hits / nullif(gold, 0), 0) AS recall, coalesce(hits / nullif(n, 0), 0) AS precision FROM c LEFT JOIN s ON s.task_id = c.task_id) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM x")
def gold_scores(spark, sf):
    return evaluate.gold_scores(*_gold(spark, sf), line_tasks(spark, sf, 200_000))


_KFILE = "lower(p_type) || '/' || split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2) || '.go'"
_GAPS = f"fl AS (SELECT DISTINCT {_KFILE} AS path FROM {{part}}), ls AS (SELECT o_custkey AS plan_id, p_name, {_KFILE} AS path, l_returnflag FROM {_LINES}), dr AS (SELECT DISTINCT split_part(path, '/', 1) AS dir, '.' AS parent, 0 AS depth, split_part(path, '/', 1) AS base FROM fl UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), split_part(path, '/', 1), 1, split_part(path, '/', 2) FROM fl), wd AS (SELECT plan_id, w, w = min(noun) OVER (PARTITION BY plan_id) AS entity FROM (SELECT plan_id, unnest(string_split(p_name, ' ')) AS w, min(split_part(p_name, ' ', 1)) OVER (PARTITION BY plan_id) AS noun FROM ls) GROUP BY plan_id, w, noun), cv AS (SELECT DISTINCT plan_id, split_part(path, '/', 1) AS dir FROM ls WHERE l_returnflag = 'R' UNION SELECT plan_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM ls WHERE l_returnflag = 'R'), cd AS (SELECT cv.plan_id, dr.* FROM cv JOIN dr ON dr.dir = cv.dir JOIN wd ON wd.plan_id = cv.plan_id AND wd.w = dr.base), pe AS (SELECT plan_id, parent, depth, min(dir) AS peer FROM cd GROUP BY 1, 2, 3), an AS (SELECT plan_id, min(dir) AS any_peer FROM cd GROUP BY 1), nb AS (SELECT base, count(*) AS n FROM dr GROUP BY 1), gp AS (SELECT wd.plan_id, wd.w AS token, dr.dir, coalesce(peer, any_peer, '(none)') AS covered_dir, CASE WHEN entity THEN 'entity-dir' ELSE 'keyword-dir' END AS source FROM wd JOIN dr ON dr.base = wd.w JOIN nb ON nb.base = dr.base LEFT JOIN pe ON pe.plan_id = wd.plan_id AND pe.parent = dr.parent AND pe.depth = dr.depth LEFT JOIN an ON an.plan_id = wd.plan_id WHERE NOT EXISTS (SELECT 1 FROM cv WHERE cv.plan_id = wd.plan_id AND cv.dir = dr.dir) AND (entity AND n <= 12 OR NOT entity AND peer IS NOT NULL AND n <= 10))"


def _task_plans(spark, sf):
    """plans(plan_id, text), planned and files: a customer's text names its parts, and the least colour in quotes."""
    parts = view(spark, sf, "part")
    path = F.concat(F.lower("p_type"), F.lit("/"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("/"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(".go"))
    lines = view(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(view(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lines.select(F.col("o_custkey").alias("plan_id"), "p_name", path.alias("path"), "l_returnflag")
    quoted = F.concat(F.lit(" `"), F.min(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit("`"))
    # A text has one mention of a name, of which there are few, however many lines a customer has. Lines are grouped once for texts and paths.
    taken = F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("path"))).alias("paths")
    each = written(named.groupBy("plan_id").agg(F.concat(F.array_join(F.array_sort(F.collect_set("p_name")), " "), quoted).alias("text"), taken), "task-plans")
    return each.select("plan_id", "text"), each.select("plan_id", F.explode("paths").alias("path")), parts.select(path.alias("path")).distinct()


@query("AND_VIEWS " + _GAPS + " SELECT * FROM gp")
def keyword_gaps(spark, sf):
    return keywords.keyword_gaps(*_task_plans(spark, sf), most=10, most_entity=12)


@query("AND_VIEWS " + _GAPS + ", pl AS (SELECT DISTINCT plan_id, path FROM ls WHERE l_returnflag = 'R'), nr AS (SELECT path, unnest([regexp_replace(path, '/[^/]*$', ''), split_part(path, '/', 1)]) AS dir FROM fl), li AS (SELECT gp.*, nr.path, split_part(nr.path, '/', 2) || '/' || split_part(nr.path, '/', 3) AS sub, lower(replace(split_part(nr.path, '/', 3), '.go', '')) AS stem FROM gp JOIN nr ON nr.dir = gp.dir), sc AS (SELECT li.*, CASE WHEN EXISTS (SELECT 1 FROM pl WHERE pl.plan_id = li.plan_id AND pl.path = li.covered_dir || '/' || li.sub) THEN 0.9 WHEN EXISTS (SELECT 1 FROM wd WHERE wd.plan_id = li.plan_id AND wd.w = li.stem) THEN 0.8 WHEN stem IN ('common', 'shared', 'utils', 'helpers') THEN 0.7 ELSE 0.5 END::DOUBLE AS score FROM li), r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, dir, token ORDER BY score DESC, path) AS r FROM sc) SELECT plan_id, dir, path, CASE WHEN source = 'entity-dir' THEN least(1.0, round((score + 0.2) * 10) / 10) ELSE score END AS score, source FROM r WHERE r <= 3")
def keyword_files(spark, sf):
    plans, planned, files = _task_plans(spark, sf)
    gaps = keywords.keyword_gaps(plans, planned, files, most=10, most_entity=12)
    return keywords.keyword_files(gaps, plans, planned, files)


# --- what words say about code ---

_CONCEPTS = ", ".join(f"'{c}'" for c in infer.CONCEPTS)


@query("SELECT concept, count(*) AS documents FROM (SELECT doc_id, unnest([c FOR c IN [" + _CONCEPTS + "] IF contains(lower(text), c)]) AS concept FROM {documents}) GROUP BY 1")
def concept_counts(spark, sf):
    """How many documents name each concept."""
    named = view(spark, sf, "documents").select(F.explode(infer.concepts(F.col("text"))).alias("concept"))
    return named.groupBy("concept").agg(F.count(F.lit(1)).alias("documents"))


_FUNCS = "fn AS (SELECT DISTINCT p_brand AS file, split_part(p_name, ' ', 1) AS c, split_part(p_name, ' ', 2) AS n, p_size % 4 AS kind FROM {part}), fs AS (SELECT DISTINCT file, kind, CASE WHEN kind < 3 THEN c END AS c, CASE WHEN kind >= 2 THEN n END AS n, CASE kind WHEN 0 THEN 'NewCmd' || upper(c[1]) || c[2:] WHEN 1 THEN c || 'Run' WHEN 2 THEN upper(n[1]) || n[2:] || upper(c[1]) || c[2:] ELSE 'Get' || upper(n[1]) || n[2:] END AS name FROM fn)"


@query(f"AND_VIEWS {_FUNCS}, ls AS (SELECT o_custkey AS plan_id, p_name, p_brand AS file, l_returnflag FROM {_LINES}), wd AS (SELECT DISTINCT plan_id, unnest(string_split(p_name, ' ')) AS w FROM ls), pl AS (SELECT DISTINCT plan_id, file FROM ls WHERE l_returnflag = 'R'), sc AS (SELECT pl.plan_id, fs.file, fs.name, kind, (EXISTS (SELECT 1 FROM wd WHERE wd.plan_id = pl.plan_id AND wd.w = fs.c))::INT * (kind < 3)::INT + (EXISTS (SELECT 1 FROM wd WHERE wd.plan_id = pl.plan_id AND wd.w = fs.n))::INT * (kind >= 2)::INT + (EXISTS (SELECT 1 FROM wd WHERE wd.plan_id = pl.plan_id AND wd.w = 'new'))::INT * (kind = 0)::INT AS shared FROM pl JOIN fs ON fs.file = pl.file), ru AS (SELECT *, CASE WHEN kind = 1 THEN 0.7 WHEN kind = 0 THEN 0.5 ELSE 0 END::DOUBLE AS own, CASE WHEN shared > 0 THEN round((0.3::DOUBLE + 0.15::DOUBLE * shared) * 100) / 100 ELSE 0 END AS tok FROM sc), t AS (SELECT plan_id, file, name, greatest(own, tok) AS score, CASE WHEN tok > own THEN 'tokens' WHEN kind = 1 THEN 'run' ELSE 'constructor' END AS reason FROM ru WHERE own > 0 OR tok > 0) SELECT plan_id, file, name, score, reason FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, file ORDER BY score DESC, name) AS r FROM t) WHERE r <= 3")
def infer_mutations(spark, sf):
    """Functions named after parts, for every customer's planned brands and the words of all its parts."""
    parts = view(spark, sf, "part")
    c, n = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    kind = F.col("p_size") % 4
    name = F.when(kind == 0, F.concat(F.lit("NewCmd"), F.initcap(c))).when(kind == 1, F.concat(c, F.lit("Run"))).when(kind == 2, F.concat(F.initcap(n), F.initcap(c))).otherwise(F.concat(F.lit("Get"), F.initcap(n)))
    own = view(spark, sf, "planned").join(_task_plans(spark, sf)[0], "plan_id").select("plan_id", "text", "file")
    return infer.infer_mutations(own, parts.select(F.col("p_brand").alias("file"), name.alias("name")))
