import time

import pytest
from pyspark.sql import functions as F

from rippleframe.operators import comod, evaluate, forecast, graph, rank


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def commits(spark, groups):
    padded = [*groups, *[[f"pad{k}"] for k in range(12)]]
    return spark.createDataFrame([(k, f) for k, g in enumerate(padded) for f in g], "commit_id long, file string")


def files(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file string")


def test_a_file_that_three_planned_files_point_to_is_a_hub(spark):
    found = comod.gaps(commits(spark, [["a", "s"], ["b", "s"], ["c", "s"]]), files(spark, "a", "b", "c"))
    assert rows(comod.hubs(found), "file", "sources") == [("s", 3)]
    apart = comod.gaps(commits(spark, [[x, f"o{x}"] for x in "abcd" for _ in range(3)]), files(spark, *"abcd"))
    assert rows(comod.hubs(apart, planned=4)) == [] and apart.count() == 4
    both = comod.gaps(commits(spark, [["a", "s"], ["b", "s"]] * 2), files(spark, "a", "b"))
    assert rows(comod.hubs(both, planned=2), "file") == [("s",)]


def test_few_commits_say_nothing(spark):
    few = spark.createDataFrame([(k, f) for k in range(9) for f in "ab"], "commit_id long, file string")
    assert comod.gaps(few, files(spark, "a")).count() == 0
    more = few.union(spark.createDataFrame([(9, "z")], "commit_id long, file string"))
    assert rows(comod.gaps(more, files(spark, "a")), "file") == [("b",)]


def test_acknowledged_by_path_and_by_name(spark):
    found = spark.createDataFrame([("d/config.go", 1.0, 1), ("other.go", 1.0, 1), ("x.go", 1.0, 1)], "file string, best double, sources long")
    acks = spark.createDataFrame([("d/config.go", "p"), ("q/other.go", "b")], "file string, reason string")
    got = {r["file"]: (r["reason"], r["acknowledged"]) for r in comod.acknowledged(found, acks).collect()}
    assert got == {"d/config.go": ("p", True), "other.go": ("b", True), "x.go": (None, False)}


def test_test_pairs_take_the_first_variant(spark):
    m = spark.createDataFrame([("a/x.ts",), ("a/x.spec.ts",), ("a/x.test.ts",), ("b.go",), ("b_test.go",), ("c.go",)], "path string")
    assert rows(comod.test_pairs(m)) == [("a/x.ts", "a/x.test.ts"), ("b.go", "b_test.go")]


def _graph(spark, edges, tests=()):
    ids = sorted({x for e in edges for x in e} | set(tests))
    defs = spark.createDataFrame([(i, f"n{i}", "", f"f{i}.go", 1, i in tests, True) for i in ids], "id long, name string, receiver string, source_file string, module_id long, is_test boolean, exported boolean")
    return spark.createDataFrame(edges, "from_def long, to_def long"), defs


def test_closure_ends_on_a_cycle_and_at_its_hops(spark):
    refs, _ = _graph(spark, [(2, 1), (3, 2), (1, 3), (4, 3), (5, 4)])
    seeds = spark.createDataFrame([(1,)], "id long")
    assert rows(graph.reachable_callers(refs, seeds, 2)) == [(2, 0), (3, 1)]
    assert rows(graph.reachable_callers(refs, seeds, 9), "id") == [(1,), (2,), (3,), (4,), (5,)]
    assert graph.reachable_callers(refs, spark.createDataFrame([(5,)], "id long"), 3).count() == 0


def test_cascade_stops_at_tests_and_at_behaviour(spark):
    refs, defs = _graph(spark, [(2, 1), (3, 2), (9, 1), (4, 9)], tests=(9,))
    seed = lambda kind: spark.createDataFrame([(1, kind)], "id long, kind string")
    columns = ("depth", "file", "breaks", "new_breaks", "cumulative", "converged")
    assert rows(graph.cascade(refs, defs, seed("removal")), *columns) == [(0, "f2.go", 1, 1, 1, True), (1, "f3.go", 1, 1, 2, True)]
    assert rows(graph.cascade(refs, defs, seed("removal"), 1), *columns) == [(0, "f2.go", 1, 1, 1, False)]
    assert rows(graph.cascade(refs, defs, seed("behavior-change")), *columns) == [(0, "f2.go", 1, 1, 1, True)]


def _signals(spark, *xs):
    return spark.createDataFrame([(1, *x) for x in xs], "plan_id long, file string, source string, score double")


def test_combine_orders_excludes_and_labels(spark):
    s = _signals(spark, ("handler.go", "structural", 1.0), ("handler.go", "comod", 0.8), ("routes.go", "comod", 0.4), ("middleware.go", "semantic", 0.7), ("auth.go", "structural", 1.0))
    got = rank.combine(s, spark.createDataFrame([(1, "auth.go")], "plan_id long, file string")).orderBy(F.desc("combined")).collect()
    assert [r["file"] for r in got] == ["handler.go", "routes.go", "middleware.go"] and got[0]["confidence"] == "must"
    assert got[0]["combined"] > round(0.5 + 0.35 * 0.8, 3)


def test_calibrated_weights_sum_to_one(spark):
    p = rank.combine(_signals(spark, ("a", "structural", 0.9), ("b", "comod", 0.9)), spark.createDataFrame([], "plan_id long, file string"))
    w = rank.calibrate(p, spark.createDataFrame([(1, "a")], "plan_id long, file string")).first()
    assert w["structural"] + w["comod"] + w["semantic"] == pytest.approx(1, abs=1e-5) and w["structural"] > 0.5 and w["comod"] < 0.35


def test_gate_keeps_tiers_and_their_limits(spark):
    spike, both = ["verified-spike"], ["structural", "verified-spike"]
    data = [(1, f"b{k}", 0.9 - k / 10, both) for k in range(4)] + [(1, f"s{k}", 0.8 - k / 10, spike) for k in range(3)] + [(1, "w", 0.9, ["keyword-dir"]), (1, "c", 0.1, ["build-check"]), (2, "s", 0.9, spike)]
    got = rank.confidence_gate(spark.createDataFrame(data, "plan_id long, file string, score double, sources array<string>"))
    assert rows(got, "file", "tier") == [("b0", 1), ("b1", 1), ("b2", 1), ("c", 0), ("s0", 2), ("s1", 2)]


def test_forecasts_tell_good_plans_from_bad(spark):
    h = [(k, r, d, 5, 5, 0) for k, (r, d) in enumerate([(0.75, 0.5), (0.8, 0.48), (0.85, 0.52), (0.9, 0.55), (0.95, 0.56), (0.3, 0.16), (0.35, 0.18), (0.4, 0.2)])]
    outcomes = spark.createDataFrame(h, "id long, recall double, density double, complexity int, blast int, depth int")
    plans = spark.createDataFrame([(1, 5, 0.5, 40, 0), (2, 5, 0.1, 40, 0), (3, 500, 0.5, 40, 0)], "plan_id long, complexity int, density double, blast int, depth int")
    exact = {r["plan_id"]: r for r in forecast.forecast_exact(plans, outcomes).collect()}
    assert exact[1]["n"] == 5 and exact[2]["n"] == 3 and exact[3]["n"] == 0 and exact[3]["confidence"] == "low" and exact[1]["mean"] > exact[2]["mean"] and exact[2]["risk"] == "high"
    drawn = {r["plan_id"]: r for r in forecast.forecast_draws(plans, outcomes, 4000).collect()}
    assert drawn[1]["mean"] == pytest.approx(exact[1]["mean"], abs=0.01) and drawn[1]["p_clean"] == pytest.approx(exact[1]["p_clean"], abs=0.03)


def test_bootstrap_holds_the_mean(spark):
    v = spark.createDataFrame([(k, float(k % 5)) for k in range(50)], "task_id long, recall double")
    r = evaluate.bootstrap(v, "recall", 200).first()
    assert r["lo"] < 2.0 < r["hi"] and r["mean"] == pytest.approx(2.0, abs=0.1)
    base = spark.createDataFrame([(k, 0.1) for k in range(30)], "task_id long, recall double")
    better = spark.createDataFrame([(k, 0.5) for k in range(30)], "task_id long, recall double")
    assert evaluate.paired_difference(base, better, 100).first()["significant"] and not evaluate.paired_difference(base, base, 100).first()["significant"]


def test_a_name_that_very_many_bear_is_resolved_once(spark):
    n = 20_000
    defs = spark.range(n).select("id", F.lit("m").alias("name"), F.concat(F.lit("T"), F.col("id") % 7).alias("receiver"))
    refs = spark.createDataFrame([(1, 5), (2, 5), (1, 9)], "from_def long, to_def long")
    kinds = F.element_at(F.array(*map(F.lit, ("T3", "*4", "none", None))), (F.col("id") % 4 + 1).cast("int"))
    wanted = spark.range(n).select("id", kinds.alias("receiver")).select(F.col("id").alias("key"), F.lit("m").alias("name"), "receiver")
    began = time.time()
    got = graph.resolve(wanted, refs, defs).groupBy(F.col("key") % 4, "id", "how").count()
    assert rows(got) == [(0, 3, "exact", n // 4), (1, 4, "suffix", n // 4), (2, 5, "callers", n // 4), (3, 5, "callers", n // 4)]
    # Paired with each definition of the name, these were 400 million rows.
    assert time.time() - began < 40
