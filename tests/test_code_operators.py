"""Operators on names, paths, histories and sources, on small fixtures."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rippleframe.operators import addition, comod, compound, evaluate, forecast, gaps, graph, infer, keywords, quantile, rank, verified
from rippleframe.sources import views


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def like(p, h):
    gap = abs(h["complexity"] - p["complexity"])
    close = gap <= 3 or (p["complexity"] > 0 and gap / p["complexity"] < 0.5)
    dense = None not in (h["density"], p["density"]) and abs(h["density"] - p["density"]) < 0.2
    blast = None not in (h["blast"], p["blast"]) and ((p["blast"] <= 5 and h["blast"] <= 10) or (p["blast"] > 0 and 0.3 < h["blast"] / p["blast"] < 3.0))
    a, b = p["depth"] or 0, h["depth"] or 0
    return close and (not (a > 0 and b > 0) or abs(a - b) <= 1) and (dense or blast)


def history(r, n, spread):
    maybe = lambda x: None if r.random() < 0.1 else x
    return [{"id": k, "complexity": r.randrange(spread), "density": maybe(r.random()), "blast": maybe(r.randrange(spread)), "depth": maybe(r.randrange(9))} for k in range(n)]


SCHEMA = "id long, complexity int, density double, blast int, depth int"


def test_similar_is_the_nested_loop_and_has_none(spark):
    r = random.Random(5)
    plans, outcomes = history(r, 60, 200), history(r, 300, 200)
    p = spark.createDataFrame(plans, SCHEMA).withColumnRenamed("id", "plan_id")
    found = forecast.similar(p, spark.createDataFrame(outcomes, SCHEMA))
    assert rows(found, "plan_id", "id") == sorted((a["id"], b["id"]) for a in plans for b in outcomes if like(a, b))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_the_grid_compares_what_is_near(spark):
    """Both sides twice as long over twice the range of magnitudes: compared pairs about double, they do not quadruple."""

    def compared(scale):
        r = random.Random(3)
        spread = lambda n: [(k, 10 ** r.uniform(0, 2 * scale), r.random(), 10 ** r.uniform(0, 2 * scale), float(1 + r.randrange(3))) for k in range(n)]
        schema = "id long, complexity double, density double, blast double, depth double"
        p, h = spark.createDataFrame(spread(100 * scale), schema).withColumnRenamed("id", "plan_id"), spark.createDataFrame(spread(800 * scale), schema)
        return sum(x.count() for x in forecast._meetings(p, h))

    assert compared(2) < 3 * compared(1)


PLAN = "plan_id long, complexity int, density double, blast int, depth int, cascade_files int"
OUTCOME = "id long, recall double, outcome string, complexity int, density double, blast int, depth int"


def test_labels_count_before_recalls(spark):
    plans = spark.createDataFrame([(1, 5, 0.5, 3, 0, 0)], PLAN)
    say = lambda label: spark.createDataFrame([(k, 0.9, label, 5, 0.5, 3, 0) for k in range(6)], OUTCOME)
    for f in (forecast.forecast_exact, forecast.forecast_draws):
        told, plain = f(plans, say("failed")).first(), f(plans, say("")).first()
        assert (told["p_clean"], told["p_failed"], told["mean"]) == (0.0, 1.0, 0.9) and (plain["p_clean"], plain["p_failed"]) == (1.0, 0.0)
    some = say("").unionByName(spark.createDataFrame([(9, 0.1, "clean", 5, 0.5, 3, 0)], OUTCOME))
    assert forecast.forecast_exact(plans, some).first()["p_clean"] == 1.0


def test_few_similar_outcomes_fall_back_to_all(spark):
    outcomes = spark.createDataFrame([(k, k / 10, "", 5, 0.5, 3, 0) for k in range(10)], OUTCOME)
    plans = spark.createDataFrame([(1, 500, 0.5, 3, 3, 25), (2, 500, 0.5, 3, 3, 15), (3, 500, 0.5, 3, 0, 0)], PLAN)
    got = {r["plan_id"]: r for r in forecast.forecast_exact(plans, outcomes).collect()}
    assert [got[k]["n"] for k in (1, 2, 3)] == [0, 0, 0] and got[3]["p50"] == 0.4 and got[3]["mean"] == 0.45
    # Penalties of .15 and .08 by depth and files of the cascade.
    assert got[1]["p50"] == 0.25 and got[2]["p50"] == 0.32 and got[3]["p_clean"] == 0.2 and got[1]["p_clean"] == 0.0
    assert forecast.forecast_exact(plans, outcomes.limit(2)).count() == 0


def test_weights_stand_for_repeated_outcomes(spark):
    r = random.Random(2)
    data = [(k, r.randrange(11) / 10, "", 5, 0.5, 3, 0) for k in range(500)]
    got = forecast.forecast_exact(spark.createDataFrame([(1, 5, 0.5, 3, 0, 0)], PLAN), spark.createDataFrame(data, OUTCOME)).first()
    recalls = sorted(x[1] for x in data)
    assert got["n"] == 500 and [got[c] for c in ("p50", "p85", "p95")] == [round(recalls[math.floor(p * 499)], 2) for p in (0.5, 0.85, 0.95)]


def test_percentiles_by_counting(spark, monkeypatch):
    monkeypatch.setattr(quantile, "SORTED", 20)
    monkeypatch.setattr(quantile, "RANGES", 4)
    r = random.Random(7)
    data = [("a", r.gauss(0, 1) ** 5) for _ in range(800)] + [("b", 1.5)] * 300 + [("c", None), ("d", 2.0), ("d", -1e300), ("d", 1e300)] + [("e", float(k % 3)) for k in range(400)]
    got = {x["g"]: (x["p0"], x["p50"], x["p85"], x["p100"]) for x in quantile.exact_percentiles(spark.createDataFrame(data, "g string, x double"), "g", "x", {"p0": 0.0, "p50": 0.5, "p85": 0.85, "p100": 1.0}).collect()}
    for g in "abde":
        xs = sorted(x for k, x in data if k == g and x is not None)
        assert got[g] == tuple(xs[math.floor(p * (len(xs) - 1))] for p in (0.0, 0.5, 0.85, 1.0))
    assert "c" not in got


def test_numbers_run_through_all_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    got = sorted((r["row_no"], r["x"]) for r in quantile.numbered(df, ["x"]).collect())
    assert [n for n, _ in got] == list(range(1, 1001)) and [x for _, x in got] == sorted(x for _, x in got)


def test_poisson_bootstrap_is_like_the_normal_interval(spark):
    r = random.Random(1)
    xs = [r.random() for _ in range(400)]
    got = evaluate.bootstrap(spark.createDataFrame(list(enumerate(xs)), "task_id long, recall double"), "recall").first()
    mean = sum(xs) / 400
    half = 1.96 * math.sqrt(sum((x - mean) ** 2 for x in xs) / 400 / 400)
    assert got["mean"] == pytest.approx(mean) and got["lo"] == pytest.approx(mean - half, abs=0.006) and got["hi"] == pytest.approx(mean + half, abs=0.006)


def test_ungated_plans_and_planned_names(spark):
    ranked = spark.createDataFrame([(1, "a.go", 0.5, ["comod"]), (1, "b.go", 0.4, ["keyword-dir"])], "plan_id long, file string, score double, sources array<string>")
    assert rows(rank.confidence_gate(ranked), "file", "score", "tier") == [("a.go", 0.5, None), ("b.go", 0.4, None)]
    planned = spark.createDataFrame([(1, "pkg/auth.go")], "plan_id long, file string")
    signals = spark.createDataFrame([(1, f, "comod", 0.9) for f in ("auth.go", "pkg/auth.go", "other/auth.go", "x.go")], "plan_id long, file string, source string, score double")
    assert rows(rank.rank(signals, planned), "file") == rows(rank.combine(signals, planned), "file") == [("other/auth.go",), ("x.go",)]


def test_base_names_merge_into_their_only_path(spark):
    ranked = spark.createDataFrame([(1, "a.go", 0.25), (1, "p/a.go", 0.5), (1, "b.go", 0.1)], "plan_id long, file string, score double")
    files = spark.createDataFrame([("p/a.go", "a.go"), ("p/b.go", "b.go"), ("q/b.go", "b.go")], "path string, base string")
    assert rows(rank.merge_by_base(ranked, files), "file", "score") == [("b.go", 0.1), ("p/a.go", 0.75)]


def test_gaps_in_order_and_greenfield(spark):
    gaps = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.76), ("d", 0.75)], "file string, best double")
    assert [r["file"] for r in comod.sorted_gaps(gaps).collect()] == ["b", "c", "d", "a"]
    files = spark.createDataFrame([("old",)] * 3 + [("new",)], "dir string")
    plans = spark.createDataFrame([(1, "old/x.go"), (2, "new/x.go"), (3, "none/x.go")], "plan_id long, path string")
    assert rows(compound.greenfield(plans, files)) == [(1, False), (2, True), (3, True)]


def code(spark, edges, names, tests=(), receivers=()):
    defs = spark.createDataFrame([(i, n, dict(receivers).get(i, ""), f, i in tests, n[0].isupper()) for i, (n, f) in names.items()], "id long, name string, receiver string, source_file string, is_test boolean, exported boolean")
    return spark.createDataFrame(edges, "from_def long, to_def long"), defs


def test_verified_cascade_goes_on_from_real_calls(spark):
    names = {1: ("Plan", "plan.go"), 2: ("Use", "use.go"), 3: ("Fake", "fake.go"), 4: ("Far", "far.go"), 5: ("TestUse", "t.go"), 6: ("Again", "plan.go")}
    refs, defs = code(spark, [(2, 1), (3, 1), (4, 2), (5, 1), (6, 1), (1, 4)], names, tests=(5,))
    paths = [("x/plan.go", "plan.go"), ("a/use.go", "use.go"), ("b/use.go", "use.go"), ("c/use.go", "use.go"), ("d/use.go", "use.go"), ("x/fake.go", "fake.go"), ("x/far.go", "far.go"), ("x/t.go", "t.go")]
    files = spark.createDataFrame(paths, "path string, base string")
    calls = spark.createDataFrame([("b/use.go", "Plan"), ("b/use.go", "Plan"), ("d/use.go", "Plan"), ("x/far.go", "Use"), ("x/plan.go", "Far"), ("x/t.go", "Plan")], "path string, callee string")
    exports = spark.createDataFrame([("x/plan.go", "Plan"), ("b/use.go", "Use"), ("d/use.go", "Use"), ("x/far.go", "Far")], "path string, name string")
    planned = spark.createDataFrame([(1, "x/plan.go")], "plan_id long, path string")
    of = lambda **more: rows(verified.verified_cascade(refs, defs, files, calls, exports, planned, **more), "path", "depth", "score", "sites")
    # d/use.go is a fourth path of its name; fake.go has no call; tests and the plan's own file are left out.
    assert of(depth=9) == [("b/use.go", 0, 0.7, 2), ("x/far.go", 1, 0.5, 1)] and of(depth=1) == [("b/use.go", 0, 0.7, 2)]
    assert of(depth=2, paths=4) == [("b/use.go", 0, 0.7, 2), ("d/use.go", 0, 0.7, 1), ("x/far.go", 1, 0.5, 1)] and of(depth=2, k=1) == [("b/use.go", 0, 0.7, 2)]
    asked = files.select(F.lit(1).cast("long").alias("plan_id"), "path")
    assert rows(verified.verify_files(asked, calls, exports, planned)) == [(1, "b/use.go", 2, 0), (1, "d/use.go", 1, 0), (1, "x/far.go", 0, 1), (1, "x/t.go", 1, 0)]
    assert rows(verified.verified_discovery(refs, defs, files, calls, exports, planned), "path", "direction", "score", "sites") == [("b/use.go", "caller", 0.7, 2), ("d/use.go", "caller", 0.6, 1), ("x/far.go", "callee", 0.6, 1)]


def test_addition_counts_two_rings(spark):
    names = {1: ("A", "a.go"), 2: ("B", "b.go"), 3: ("C", "c.go"), 4: ("D", "d.go"), 5: ("E", "e.go"), 6: ("F", "f.go"), 7: ("T", "t_test.go"), 8: ("Z", "z.go")}
    # A and B are methods of R; they refer to C; C refers to D; E and T call D; F calls C.
    refs, defs = code(spark, [(1, 3), (2, 3), (6, 3), (3, 4), (5, 4), (7, 4), (3, 1)], names, tests=(7,), receivers=((1, "R"), (2, "R")))
    wanted = spark.createDataFrame([("r", "R"), ("none", "Q")], "key string, receiver string")
    got = rows(addition.addition_impact(refs, defs, wanted))
    # Ring: C with callers A, B, F. Second ring: D and A; callers of those beyond both: E and T of D (C calls A, and is seen).
    assert got == [("none", 0, 0, 0, 0, 0), ("r", 1, 2, 2, 4, 1)]


def test_names_are_met_by_parts(spark):
    terms = spark.createDataFrame([("re",), ("render",), ("",), ("x",)], "term string")
    names = spark.createDataFrame([("Render",), ("prerender",), ("Box",), ("care",), ("",)], "name string")
    assert rows(addition.names_containing(terms, names)) == [("re", "Render"), ("re", "care"), ("re", "prerender"), ("render", "Render"), ("render", "prerender"), ("x", "Box")]


def test_analogies_with_a_callee_that_half_of_all_share(spark):
    n = 400
    defs = [("r1", i, f"Name{i}", "", f"f{i}.go", False, True) for i in range(n)] + [("r1", 900, "Hot", "", "h.go", False, True), ("r2", 0, "Name0", "", "g.go", False, True), ("r2", 1, "Other", "", "g.go", False, True)]
    refs = [("r1", i, 900) for i in range(0, n, 2)] + [("r1", i, 0) for i in range(1, 6)] + [("r1", 2, 4), ("r1", 4, 6), ("r2", 1, 0)]
    d = spark.createDataFrame(defs, "repo string, id long, name string, receiver string, source_file string, is_test boolean, exported boolean")
    found, hits = addition.analogies(spark.createDataFrame(refs, "repo string, from_def long, to_def long"), d, spark.createDataFrame([("name0",)], "term string"))
    assert rows(found, "repo", "id", "callers", "references") == [("r1", 0, 5, ["Hot"]), ("r2", 0, 1, [])]
    # Siblings on Hot: Name4, Name6 of one caller, then Name10, Name100, Name102 by name, each with what it refers to.
    assert dict(rows(hits, "name", "hits")) == {"Hot": 1 + 5, "Name0": 1, "Name6": 1}


def test_keyword_directories(spark):
    files = [(p,) for p in ("cmd/pr/create/create.go", "cmd/pr/pr.go", "cmd/issue/create/create.go", "cmd/issue/list.go", "cmd/issue/shared.go", "cmd/issue/a_test.go", "cmd/label/x.go", "other/issue/y.go", "vendor/label/z.go", "a/b/c/d/e/label/deep.go")]
    f = spark.createDataFrame(files, "path string")
    plans = spark.createDataFrame([(1, "add issue and pr list"), (2, "touch the `label` of a pr"), (3, "nothing here")], "plan_id long, text string")
    planned = spark.createDataFrame([(1, "cmd/pr/create/create.go"), (2, "cmd/pr/pr.go"), (3, "cmd/pr/pr.go")], "plan_id long, path string")
    gaps = keywords.keyword_gaps(plans, planned, f)
    # other/issue has no covered peer; vendored and deep directories are not searched.
    assert rows(gaps) == [(1, "issue", "cmd/issue", "cmd/pr", "keyword-dir"), (2, "label", "cmd/label", "cmd/pr", "entity-dir")]
    got = rows(keywords.keyword_files(gaps, plans, planned, f), "plan_id", "path", "score", "source")
    assert got == [(1, "cmd/issue/create/create.go", 0.9, "keyword-dir"), (1, "cmd/issue/list.go", 0.8, "keyword-dir"), (1, "cmd/issue/shared.go", 0.7, "keyword-dir"), (2, "cmd/label/x.go", 0.7, "entity-dir")]
    assert rows(keywords.keyword_gaps(plans, planned, f, most=0)) == [(2, "label", "cmd/label", "cmd/pr", "entity-dir")]


def test_keyword_files_meet_plans_by_id_alone(spark):
    f = spark.createDataFrame([("a/xx/nn.go",), ("a/yy/nn.go",)], "path string")
    plans, planned = spark.createDataFrame([(1, "xx yy nn")], "plan_id long, text string"), spark.createDataFrame([(1, "a/xx/nn.go")], "plan_id long, path string")
    gaps = keywords.keyword_gaps(plans, planned, f)
    found = keywords.keyword_files(gaps, plans, planned, f)
    assert rows(found, "plan_id", "path", "score") == [(1, "a/yy/nn.go", 0.8)]
    # Joins by plan and directory, path or word moved the listed files once for each.
    assert not re.search(r"Join \[plan_id#\d+L?, ", found._jdf.queryExecution().executedPlan().toString())


def test_classes_of_similar_history_hold_every_customer_and_pair(spark):
    sf = "/root/testdata/sf0.001"
    from rippleframe.plans.registry import QUERIES

    got = rows(QUERIES["similar_history"](spark, sf), "kind", "id", "class_id")
    plan, outcome = ({i: c for kind, i, c in got if kind == k} for k in ("plan", "outcome"))
    assert set(plan) == {r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()}
    met = {(a, b) for kind, a, b in got if kind == "alike"}
    pairs = {(p, o) for p, a in plan.items() for o, b in outcome.items() if (a, b) in met}
    assert pairs == set(rows(forecast.similar(views.view(spark, sf, "customer_plans"), views.view(spark, sf, "outcomes")), "plan_id", "id"))


def test_grid_search_does_not_repeat_rows_for_a_weight(spark):
    scored = spark.createDataFrame([(1, "a", 0.6, 0.1), (1, "b", 0.1, 0.9), (2, "a", 1.0, 1.0), (1, "a", 0.2, 0.2)], "task_id long, file string, a double, b double")
    actual = spark.createDataFrame([(1, "a"), (1, "b"), (3, "x")], "task_id long, file string")
    found = evaluate.grid_search(scored, actual, [0.1, 0.9])
    assert rows(found, "w", "recall", "best") == [(0.1, 0.25, True), (0.9, 0.25, False)]
    # One generator, over the row of means.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_similar_history_lists_every_plan_with_every_outcome(spark):
    sf = "/root/testdata/sf0.001"
    from rippleframe.plans.registry import QUERIES

    features = ("complexity", "density", "blast", "depth")
    plans, outcomes = (rows(views.view(spark, sf, name), key, *features) for name, key in (("customer_plans", "plan_id"), ("outcomes", "id")))
    named = lambda x: dict(zip(features, x[1:]))
    want = sorted((p[0], o[0]) for p in plans for o in outcomes if like(named(p), named(o)))
    assert rows(QUERIES["similar_history"](spark, sf).filter("kind = 'pair'"), "id", "class_id") == want


def test_pairs_by_hands_are_the_similar_ones(spark, monkeypatch):
    monkeypatch.setattr(forecast, "HAND", 32)
    monkeypatch.setattr(forecast, "HAND_TASKS", 2)
    r = random.Random(9)
    plans, outcomes = history(r, 80, 12), history(r, 200, 12)
    # Repeated rows, an outcome without an id, and a hundred of equal features.
    plans += plans[:9]
    outcomes += outcomes[:9] + [{**outcomes[0], "id": None}] + [{**outcomes[1], "id": 1000 + k} for k in range(100)]
    p, h = spark.createDataFrame(plans, SCHEMA).withColumnRenamed("id", "plan_id"), spark.createDataFrame(outcomes, SCHEMA)
    found = forecast.similar_pairs(p, h)
    assert Counter(map(tuple, found.collect())) == Counter((a["id"], b["id"]) for a in plans for b in outcomes if like(a, b))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert forecast.similar_pairs(p.limit(0), h).count() == forecast.similar_pairs(p, h.limit(0)).count() == 0


def test_gold_files_match_once_in_order(spark):
    plans = spark.createDataFrame([(1, "a/b/x.go"), (1, "b/x.go"), (1, "/c/y.go/"), (1, "d/z.go"), (1, "e/z.go"), (2, "q.go"), (4, "p.go")], "task_id long, path string")
    gold = spark.createDataFrame([(1, "b/x.go"), (1, "root/a/b/x.go"), (1, "y.go"), (1, "other/y.go"), (1, "z.go"), (1, "n/z.go"), (2, "w.go"), (3, "v.go")], "task_id long, path string")
    assert rows(evaluate.gold_matches(gold, plans)) == [
        (1, "b/x.go", "b/x.go", "exact"), (1, "n/z.go", None, None), (1, "other/y.go", "c/y.go", "basename"), (1, "root/a/b/x.go", "a/b/x.go", "suffix"),
        (1, "y.go", "c/y.go", "suffix"), (1, "z.go", "d/z.go", "suffix"), (2, "w.go", None, None), (3, "v.go", None, None),
    ]
    assert rows(evaluate.gold_scores(gold, plans), "task_id", "gold", "hits", "recall", "precision") == [(1, 6, 5, 5 / 6, 1.0), (2, 1, 0, 0.0, 0.0), (3, 1, 0, 0.0, 0.0)]


def test_written_views_follow_their_input(spark, tmp_path):
    line = "l_orderkey long, l_linenumber int, l_partkey long"
    write = lambda data: spark.createDataFrame(data, line).write.mode("overwrite").parquet(f"file://{tmp_path}/lineitem.parquet")
    write([(1, 1, 10), (1, 2, 11)])
    assert rows(views.view(spark, f"file://{tmp_path}", "refs")) == [(10, 11)]
    write([(1, 1, 10), (1, 2, 12)])
    assert rows(views.view(spark, f"file://{tmp_path}", "refs")) == [(10, 12)]


def test_gaps_merge_in_order(spark):
    planned = spark.createDataFrame([(1, f) for f in ("a.go", "b.go", "c.css")], "plan_id long, file string")
    pairs = [("a.go", "hub.go", 0.9), ("b.go", "hub.go", 0.5), ("c.css", "hub.go", 0.5), ("a.go", "d/known.go", 0.8), ("a.go", "x_test.py", 0.9), ("a.go", "b.go", 1.0), ("c.css", "low.go", 0.1), ("a.go", "one.css", 0.8)]
    conf = spark.createDataFrame(pairs, "file_a string, file_b string, confidence double")
    blast = spark.createDataFrame([(1, "a.go", "hub.go", 9, 0.9, "high"), (1, "a.go", "graph.go", 5, 0.2, "high")], "plan_id long, plan_file string, file string, callers long, frequency double, confidence string")
    acks = spark.createDataFrame([(1, "known.go", "seen"), (2, "hub.go", "other plan"), (1, "hub.go", "")], "plan_id long, file string, reason string")
    got = gaps.merged_gaps(conf, blast, planned, acks, 0.4)
    assert [tuple(r) for r in got.select("file", "plan_file", "confidence", "cross_stack", "hub", "reason", "source").orderBy("place").collect()] == [
        ("hub.go", "a.go", "high", False, True, None, "comod"), ("d/known.go", "a.go", "high", False, False, "seen", "comod"), ("one.css", "a.go", "high", True, False, None, "comod"),
        ("graph.go", "a.go", "high", False, False, None, "refgraph"), ("hub.go", "b.go", "moderate", False, True, None, "comod"), ("hub.go", "c.css", "moderate", True, True, None, "comod"),
    ]
    assert rows(gaps.compact_counts(got)) == [(1, 5, 1, 2)] and rows(gaps.hub_explosions(got)) == [] and rows(gaps.hub_explosions(got, 1)) == [(1, 1, ["hub.go"])]
    dirs = spark.createDataFrame([(1, "a/b"), (1, "c"), (2, "c")], "plan_id long, dir string")
    assert rows(gaps.without_acknowledged(dirs, spark.createDataFrame([(1, "c/"), (1, "a")], "plan_id long, dir string"))) == [(1, "a/b"), (2, "c")]


def test_what_an_agent_looked_at(spark):
    calls = [("s", 3, "find", "a.go"), ("s", 1, "find", "a.go"), ("s", 2, "find", "once.go"), ("s", 1, "read", "b.go"), ("s", 2, "code", "b.go"), ("s", 1, "code", "c_test.go"), ("s", 1, "code", "done.go"), ("s", 1, "read", "gone.go"), ("s", 5, "constructors", "d.go")]
    c = spark.createDataFrame(calls, "session string, turn int, tool string, path string")
    files = spark.createDataFrame([(p,) for p in ("a.go", "b.go", "c_test.go", "d.go", "done.go", "once.go")], "path string")
    got = gaps.exploration_scores(c, spark.createDataFrame([("s", "done.go")], "session string, path string"), files)
    assert rows(got, "path", "tool_rank", "hits", "turn", "score") == [("a.go", 1, 2, 2, 0.4), ("b.go", 3, 2, 2, 0.6), ("d.go", 3, 1, 6, 0.5)]
    said = spark.createDataFrame([("q", "a.go:1:x\na.go:2:y\nb.go:3:z\nc_test.go:1:x\nno match\nc.go:1:x\nd.go:1:x"), ("e", "")], "id string, text string")
    assert rows(gaps.find_hits(said)) == [("q", "a.go", 2), ("q", "b.go", 1), ("q", "c.go", 1)]


def test_plans_are_halved_by_risk(spark):
    r = random.Random(4)
    plans = {p: [(r.choice([0, 0, 0, 1, 2, 9, 30]), r.choice([0, 0, 1, 8])) for _ in range(n)] for p, n in enumerate((1, 2, 3, 4, 5, 17, 64))}

    def divided(xs, start):
        risk = lambda ys: "high" if sum(a for a, _ in ys) >= 10 or sum(b for _, b in ys) >= 30 else "moderate" if sum(a for a, _ in ys) >= 3 or sum(b for _, b in ys) >= 10 else "low"
        if len(xs) <= 3:
            return [(start + k, start + k, risk([x])) for k, x in enumerate(xs)]
        out, mid = [], len(xs) // 2
        for part, at in ((xs[:mid], start), (xs[mid:], start + mid)):
            out += divided(part, at) if risk(part) == "high" and len(part) > 2 else [(at, at + len(part) - 1, risk(part))]
        return out

    data = [(p, k, a, b) for p, xs in plans.items() for k, (a, b) in enumerate(xs, 1)]
    got = graph.subdivide_plans(spark.createDataFrame(data, "plan_id int, pos int, callers long, tests long"))
    assert rows(got, "plan_id", "first", "last", "risk") == sorted((p, *s) for p, xs in plans.items() for s in divided(xs, 1))


def test_impact_texts(spark):
    refs, defs = code(spark, [(2, 1), (3, 1), (4, 1)], {1: ("Save", "a.go"), 2: ("Use", "b.go"), 3: ("run", "c.go"), 4: ("TestSave", "a_test.go")}, tests=(4,), receivers=((1, "*DB"), (3, "App")))
    kinds = spark.createDataFrame([(1, "removal"), (2, "signature-change")], "id long, kind string")
    got = {r["id"]: r for r in graph.impact_report(refs, defs, kinds).collect()}
    assert got[1]["impact"] == "(*DB).Save removal: 2 production callers + 1 test callers will fail to compile" and got[1]["top_callers"] == ["Use", "(App).run"]
    assert got[2]["impact"] == "Use signature change: 0 production callers will break, 0 tests cover this" and got[2]["top_callers"] == [] and got[1]["confidence"] == "moderate"


def test_what_words_say_about_code(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(infer.concepts(F.lit("Add a Rate limiter to the AUTH handlers; serialize events"))) == ["handler", "auth", "serializ", "rate", "limit", "event"]
    patterns = lambda objective, *steps: one(infer.body_patterns(F.lit(objective), F.array(*map(F.lit, steps)) if steps else F.array().cast("array<string>")))
    assert patterns("modernize loops", "use range over ints") == ["for %:= 0%<%++", "for %:= 0%<%+="]
    assert patterns("Rename IsValidName to IsInvalidName, drop isvalidname") == ["IsValidName", "IsInvalidName,", "IsInvalidName"][:2]
    assert patterns("migrate github.com/x/y away", "improve error handling", "deprecate Old") == ["if err != nil", "github.com/x/y", "Deprecated"]
    assert patterns("nothing to see") == []


def test_functions_a_task_is_likely_to_change(spark):
    names = ["createRun", "NewCmdCreate", "ListIssues", "Helper", "CreateIssue", "fooBar"]
    functions = spark.createDataFrame([("a.go", n) for n in names], "file string, name string")
    plans = spark.createDataFrame([(1, "Add a flag to create an issue", "a.go"), (2, "call helper from the list of issues", "a.go"), (3, "unrelated", "a.go")], "plan_id long, text string, file string")
    got = rows(infer.infer_mutations(plans, functions), "plan_id", "name", "score", "reason")
    assert got == [
        (1, "CreateIssue", 0.6, "tokens"), (1, "NewCmdCreate", 0.8, "constructor"), (1, "createRun", 0.7, "run"),
        (2, "Helper", 0.9, "mentioned"), (2, "ListIssues", 0.6, "tokens"), (2, "createRun", 0.7, "run"),
        (3, "NewCmdCreate", 0.5, "constructor"), (3, "createRun", 0.7, "run"),
    ]


def test_a_name_in_many_files_is_scored_once_a_plan(spark, monkeypatch):
    seen, write = {}, infer.written
    monkeypatch.setattr(infer, "written", lambda df, label: seen.setdefault(label, write(df, label)))
    shared = [f"x{k}Run" for k in range(12)]
    # The last file has none of the first eight names of the plan, the one before it two.
    held = [(f"{n}.go", name) for n in range(5) for name in shared] + [("y.go", "x0Run"), ("y.go", "x1Run"), ("y.go", "zRun"), ("z.go", "yRun"), ("z.go", "zRun")]
    functions = spark.createDataFrame(held, "file string, name string")
    files = sorted({f for f, _ in held})
    plans = spark.createDataFrame([(1, "nothing", f) for f in files], "plan_id long, text string, file string")
    got = rows(infer.infer_mutations(plans, functions).select("file", "name"))
    assert got == sorted((f, n) for f in files for n in sorted(m for g, m in held if g == f)[:3])
    assert seen["scored"].count() == 14
