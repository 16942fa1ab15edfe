import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rippleframe.functions import text as T
from rippleframe.operators import comod, forecast, graph, rank


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def many(spark, f, cases):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, x string")
    return [r["y"] for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


@pytest.mark.parametrize("files, want", [(0, 1.0), (4, 1.0), (10, 2 / math.sqrt(10)), (25, 0.4), (100, 0.4), (1000, 0.4)])
def test_adaptive_threshold(spark, files, want):
    assert one(spark, comod.adaptive_threshold(F.lit(files))) == pytest.approx(want)


def test_confidence_levels(spark):
    assert [one(spark, T.confidence_level(F.lit(x))) for x in (0.75, 0.76)] == ["moderate", "high"]
    pairs = [(0, 0), (1, 10), (2, 10), (5, 10), (3, 4)]
    assert [one(spark, T.caller_confidence(F.lit(a), F.lit(b))) for a, b in pairs] == ["moderate"] * 3 + ["high"] * 2


def test_words(spark):
    words = ["issues", "prs", "branches", "queries", "codespace", "pr", "boxes", "class", "is"]
    assert many(spark, T.singularize, words) == ["issue", "pr", "branch", "query", "codespace", "pr", "box", "class", "is"]
    assert many(spark, T.tokenize, ["Add Issues, issues and PRs! x 2", "", "Été été"]) == [["add", "issues", "issue", "and", "prs", "pr"], [], ["été"]]
    assert many(spark, T.file_tokens, ["queries_pr.go", "a/b-cd.go"]) == [["queries", "query", "pr"], ["cd"]]
    assert many(spark, T.camel_tokens, ["NewCmdCreate", "createRun", "aB"]) == [["new", "cmd", "create"], ["create", "run"], []]
    assert many(spark, T.task_tokens, ["fix the fix of ab abc1"]) == [["abc1", "fix", "the"]]
    assert many(spark, T.entities, ["add `list` and view commands", "the merge command"]) == [["list", "view"], ["merge"]]
    assert many(spark, T.plan_files, ["edit cmd/a.go, a_test.go and `b.go`"]) == [["cmd/a.go", "b.go"]]


def test_paths(spark):
    paths = ["a/tests/x.py", "a/__test__/b.js", "x.spec.ts", "test_a.py", "b_test.py", "a/testing.py", "x_test.go"]
    assert many(spark, T.is_test_file, paths) == [True, True, True, True, True, False, False]
    assert many(spark, T.layer, ["x.go", "a/api/z.js", "v.css", "ui/b.ts", "src/app.js", "lib/x.js", "api.ts"]) == ["backend", "backend", "frontend", "frontend", "frontend", "unknown", "backend"]
    assert many(spark, T.is_source_file, ["a.cjs", "a.mjs", "a.go", "a.txt"]) == [True, True, True, False]
    assert many(spark, T.is_skipped, ["vendor", ".cache", "src"]) == [True, True, False]
    stale = lambda files, steps: one(spark, T.lock_is_stale(F.array(*map(F.lit, files)), F.array(*map(F.lit, steps))))
    assert stale(["a/go.mod"], ["edit"]) and not stale(["a/go.mod"], ["run go mod tidy"]) and not stale(["a/x.go"], ["edit"])
    assert one(spark, T.is_cross_stack(F.lit("a.go"), F.lit("b.css"))) and not one(spark, T.is_cross_stack(F.lit("a.go"), F.lit("b.txt")))
    assert many(spark, T.basename, ["a/b.go", "b.go"]) == ["b.go", "b.go"] and many(spark, T.dirname, ["a/b/c.go", "c.go"]) == ["a/b", "."]
    assert many(spark, T.clean_path, ["./a//b/", "a\\b", "a/./b"]) == ["a/b"] * 3
    assert many(spark, T.extension, ["a/b.go", "a.x/b"]) == [".go", ""]


def test_names(spark):
    name = lambda n, r: one(spark, T.display_name(F.lit(n), F.lit(r)))
    assert [name("Foo", ""), name("Render", "*Context"), name("Bar", "MyType")] == ["Foo", "(*Context).Render", "(MyType).Bar"]
    assert [tuple(x) for x in many(spark, T.parse_mutation, ["removal:Context.Render", "removal:(*T).M", "addition:Foo"])] == [("removal", "Context", "Render"), ("removal", "*T", "M"), ("addition", "", "Foo")]
    assert one(spark, T.escape_sql(F.lit("it's"))) == "it''s"
    files = lambda *x: F.array(*map(F.lit, x))
    same = one(spark, T.plan_hash(F.lit("o"), files("b", "a")))
    assert same == one(spark, T.plan_hash(F.lit("o"), files("a", "b"))) == hashlib.sha256(b"o\0a\0b").hexdigest()[:16] and same != one(spark, T.plan_hash(F.lit("p"), files("a", "b")))
    for path in ("ab", "", "/home/user/project", "/répertoire/ü" * 5):
        want = 0
        for c in path.encode():
            want = (want * 31 + c) % 2**64
        assert one(spark, T.poly31(F.lit(path))) == f"{want:016x}"
    assert one(spark, T.poly31(F.lit("/home/user/project"))) == "2709da73a14c5bb6"
    assert one(spark, T.json_object_in(F.lit('says {"a": {"b": 1}} so'))) == '{"a": {"b": 1}}' and one(spark, T.json_object_in(F.lit("no"))) is None


def test_scores(spark):
    assert one(spark, rank.extremize(F.lit(0.6), 1.3)) > 0.6 and one(spark, rank.extremize(F.lit(0.3), 1.3)) < 0.3
    assert [one(spark, rank.extremize(F.lit(x), 1.3)) for x in (0.0, 1.0)] == [0.0, 1.0]
    assert [one(spark, T.required_rounds(F.lit(n))) for n in (4, 5, 10, 11, 20, 21)] == [1, 2, 2, 3, 3, 4]
    assert one(spark, T.suggest_confidence(F.lit(9))) == 0.8
    assert one(spark, forecast.percentile_at(F.array(*map(F.lit, (0.4, 0.1, 0.9, 0.5))), 0.5)) == 0.4
    bodies = {"a.Foo(x)": "pass-through", "Foo (x)": "pass-through", "v.(*Foo)": "indirect", "a.Foo = 1": "field", "var x Foo": "type-ref", "Food(x)": "unknown"}
    assert {b: one(spark, graph.coupling_kind(F.lit(b), F.lit("Foo"))) for b in bodies} == bodies
