from pyspark.sql import functions as F

from rippleframe.sources import parse


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def texts(spark, *xs):
    return spark.createDataFrame([(f"t{k}", x) for k, x in enumerate(xs)], "id string, text string")


PATCH = "diff --git a/x/a.go b/x/a.go\n@@ -1,2 +3,4 @@ func (c *Ctx) Render(w int) {\n+a\ndiff --git a/y/b_test.go b/y/b_test.go\n@@ -1 +1 @@ func TestB(t *T) {\n@@ -9 +9 @@\n"
SOURCE = 'package p\n\nimport (\n\t"fmt"\n\t"m.org/q/r"\n)\nimport "os"\n\n// Run does it.\n// Twice.\nfunc (s *Srv) Run(a, b int) (int, error) {\n\tfmt.Println(help(a))\n\treturn b, nil\n}\n\nfunc help(a int) int { return a }\n\nfunc TestX(t *T) { Run(1, 2) }\n\ntype Conf struct {\n\tA, B int\n\tC string\n}\n\nvar c = &Conf{A: 1}\n'


def test_history_texts(spark):
    log = texts(spark, "COMMIT\na.go\nb.go\n\nCOMMIT\na.go\nCOMMIT\nc.go")
    assert rows(parse.commit_files(log, keep=2), "seq", "file") == [(1, "a.go"), (1, "b.go"), (2, "a.go")]


def test_diffs(spark):
    p = texts(spark, PATCH)
    assert rows(parse.diff_hunks(p), "file", "func", "receiver") == [("x/a.go", "Render", "Ctx"), ("y/b_test.go", "", ""), ("y/b_test.go", "TestB", "")]
    assert rows(parse.first_changed_func(p)) == [("t0", "x/a.go", "Render", "Ctx")]
    assert rows(parse.changed_files(p), "file") == [("x/a.go",)]
    none = spark.createDataFrame([], "id string, file string")
    assert rows(parse.test_dirs(p, none), "dir", "n") == [("y", 1)]
    assert rows(parse.test_dirs(p, spark.createDataFrame([("t0", "y/b.go")], "id string, file string"))) == []


def test_failing_tests(spark):
    x = texts(spark, "['TestA/sub one', 'TestB']", "").select(parse.failing_tests(F.col("text")).alias("n"), "id").orderBy("id").collect()
    assert [r["n"] for r in x] == [["TestA", "TestB"], []]


def test_compiler_output(spark):
    log = texts(spark, "# pkg\na/b.go:3:14: undefined: X\na/b.go:9:1: undefined: Y\nc.go:1:2: m\nnoise")
    errors = parse.compile_errors(log)
    assert rows(errors, "file", "at_line", "col", "message")[0] == ("a/b.go", 3, 14, "undefined: X")
    by = parse.errors_by_file(errors, spark.createDataFrame([("t0", "c.go")], "id string, file string"))
    assert rows(by, "file", "n", "kind") == [("a/b.go", 2, "obligation"), ("c.go", 1, "spike")]


def test_error_window_holds_its_bound(spark):
    log = texts(spark, "2024-01-01T00:00:00Z old\n2024-01-01T00:00:01Z bound\n2024-01-02T00:00:00Z new\nno time")
    got = parse.recent_errors(log, F.lit("2024-01-02 00:00:01").cast("timestamp"))
    assert [r[0][21:] for r in rows(got, "line")] == ["bound", "new"]


def test_sources(spark):
    s = texts(spark, SOURCE)
    assert rows(parse.imports(s), "package") == [("fmt",), ("m.org/q/r",), ("os",)] and rows(parse.imports(s, "m.org/"), "package") == [("m.org/q/r",)]
    assert rows(parse.signatures(s), "name", "receiver", "params", "results") == [("Run", "Srv", 2, 2), ("TestX", "", 1, 0), ("help", "", 1, 1)]
    assert rows(parse.exported_signatures(s), "name") == [("Run",)]
    assert rows(parse.call_sites(s), "caller", "callee", "full") == [("Run", "Println", "fmt.Println"), ("Run", "help", "help"), ("TestX", "Run", "Run")]
    assert rows(parse.struct_fields(s), "type", "field") == [("Conf", "A"), ("Conf", "B"), ("Conf", "C")]
    assert rows(parse.struct_literals(s), "type") == [("Conf",)]
    assert rows(parse.tests_mentioning(s, "Run(1"), "test") == [("TestX",)]
    assert rows(parse.grep(s, "Conf{"), "line") == [(25,)]
    assert s.select(parse.source_slice(F.col("text"), F.lit(11), F.lit(12)).alias("x")).first()["x"] == "// Run does it.\n// Twice.\nfunc (s *Srv) Run(a, b int) (int, error) {\n\tfmt.Println(help(a))"
    assert spark.createDataFrame([("x\nmodule a.b/c\n",)], "t string").select(parse.module_path(F.col("t")).alias("m")).first()["m"] == "a.b/c"
    assert rows(parse.page(s, 7, 1), "line") == [('import "os"',)]


def test_changes(spark):
    after = texts(spark, SOURCE.replace("a, b int)", "a, b, c int)").replace("C string", "C string\n\tD bool"))
    before = texts(spark, SOURCE)
    assert rows(parse.signature_breaks(before, after), "name", "params_before", "params_after") == [("Run", 2, 3)]
    assert rows(parse.added_fields(before, after), "field") == [("D",)]
    others = spark.createDataFrame([("o.go", "func F() {\n\ts.Run(1, 2)\n\tx := Conf{}\n}"), ("n.go", "func G() {}")], "id string, text string")
    assert rows(parse.obligations(before, after, others)) == [("o.go", "signature"), ("o.go", "struct")]
    assert rows(parse.change_summary(before, after), "change") == [("struct-field",)]
    assert rows(parse.change_summary(before, texts(spark, SOURCE.replace("b, nil", "a, nil"))), "change") == [("body",)]
    assert rows(parse.new_calls(before, texts(spark, SOURCE.replace("help(a)", "other(a)"))), "callee") == [("other",)]


def test_blocks_and_importers(spark):
    said = texts(spark, "text\n// a/b.go\n```go\npackage a\n```\n### `c.go`\n```\nx\n```\n")
    assert rows(parse.file_blocks(said), "file", "code") == [("a/b.go", "package a\n"), ("c.go", "x\n")]
    src = spark.createDataFrame([("a.ts", "import { x } from './router'"), ("b.py", "from .router import y"), ("c.js", "const r = require('./router')"), ("d.js", "router()")], "id string, text string")
    assert rows(parse.importers(src, spark.createDataFrame([("src/router.ts", "router")], "target string, stem string")), "id") == [("a.ts",), ("b.py",), ("c.js",)]
