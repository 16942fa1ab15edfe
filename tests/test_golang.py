"""Hand-written tables of what Go sources declare and call."""

import pytest

from rippleframe.sources import golang, parse
from rippleframe.sources.golang import GoFile

# Source of a declaration, its name, receiver, parameters and results.
DECLARED = [
    ("func A() {}", "A", "", 0, 0),
    ("func A(x int) {}", "A", "", 1, 0),
    ("func A(a, b int) {}", "A", "", 2, 0),
    ("func A(int, string) {}", "A", "", 2, 0),
    ("func A(a, b int, c string) error {}", "A", "", 3, 1),
    ("func A(a func(int, int) error, b map[string][]int) {}", "A", "", 2, 0),
    ("func A(xs ...string) (n int, err error) {}", "A", "", 1, 2),
    ("func A() (int, error) {}", "A", "", 0, 2),
    ("func A() (a, b int) {}", "A", "", 0, 2),
    ("func (s *Srv) A(x int) {}", "A", "Srv", 1, 0),
    ("func (Srv) A() {}", "A", "Srv", 0, 0),
    ("func (s *List[T]) A(x T) T {}", "A", "List", 1, 1),
    ("func A[T any, U comparable](x T, y U) {}", "A", "", 2, 0),
    ("func A(\n\ta int,\n\tb string,\n) (\n\tint,\n\terror,\n) {\n}", "A", "", 2, 2),
    ("func A(a struct{ X, Y int }, b interface{ M(int, int) }) {}", "A", "", 2, 0),
    ("func A() func(int, int) (string, error) {}", "A", "", 0, 1),
    ("func A() map[string]struct{ X int } {}", "A", "", 0, 1),
    ("func A() interface{} { return nil }", "A", "", 0, 1),
    ("func A() <-chan int {}", "A", "", 0, 1),
    ("func A(x /* a, b */ int) {} // c, d", "A", "", 1, 0),
    ("func A(x pkg.T, y *pkg.U) *pkg.V {}", "A", "", 2, 1),
    ("func A(x [3]int, y []func()) [2]string {}", "A", "", 2, 1),
    ("func A(x int) error", "A", "", 1, 1),
    ('const s = "func B(x int) {}"\nfunc A() {}', "A", "", 0, 0),
    ("var r = `\nfunc B() {\n`\nfunc A(x int) {}", "A", "", 1, 0),
    ("var q = '\"'\nfunc A(x, y int) {}", "A", "", 2, 0),
]

# Body of a function, its calls as callee and number of arguments.
CALLED = [
    ("f()", [("f", 0)]),
    ("f(1, 2)", [("f", 2)]),
    ("pkg.F(x)", [("pkg.F", 1)]),
    ("a.b.C(x, y)", [("a.b.C", 2)]),
    ("f(g(1, 2), h())", [("f", 2), ("g", 2), ("h", 0)]),
    ("if ok(x) { run() }", [("ok", 1), ("run", 0)]),
    ("for i := range list() { use(i) }", [("list", 0), ("use", 1)]),
    ("// f(1)\ng()", [("g", 0)]),
    ('x := "f(1)" + g("a, b")', [("g", 1)]),
    ("r := `f(\n` + g()", [("g", 0)]),
    ("c := '('; f(c)", [("f", 1)]),
    ("F[int](x)", [("F", 1)]),
    ("p.F[K, V](x, y)", [("p.F", 2)]),
    ("fs[0](x)", [("fs", 1)]),
    ("[]byte(x)", []),
    ("(*T)(x)", []),
    ("func() { f() }()", [("f", 0)]),
    ("go f(func(a, b int) { g(a, b) }, 1)", [("f", 2), ("g", 2)]),
    ("a().B().C(1)", [("a", 0), ("B", 0), ("C", 1)]),
    ("x.(T).M()", [("M", 0)]),
    ("xs[f(1)].M(2)", [("f", 1), ("xs.M", 1)]),
    ("f(\n\ta,\n\tb,\n)", [("f", 2)]),
    ("a.\n\tB(1)", [("a.B", 1)]),
    ("T{X: f(1)}.M()", [("f", 1), ("M", 0)]),
    ("var v interface{ M(int) }\nf(v)", [("f", 1)]),
    ("f(xs...)", [("f", 1)]),
    ("switch y := f(x); y { case g(): h() }", [("f", 1), ("g", 0), ("h", 0)]),
    ("defer mu.Unlock()", [("mu.Unlock", 0)]),
]


@pytest.mark.parametrize("source, name, receiver, params, results", DECLARED)
def test_declared(source, name, receiver, params, results):
    found = GoFile("package p\n\n" + source).functions()
    assert [(f["name"], f["receiver"], f["params"], f["results"]) for f in found] == [(name, receiver, params, results)]


@pytest.mark.parametrize("body, calls", CALLED)
def test_called(body, calls):
    file = GoFile("package p\nfunc A() {\n" + body + "\n}\nfunc B() { last() }\n")
    a, b = file.functions()
    assert sorted((c, n) for _, c, n in file.calls(a["body"])) == sorted(calls) and file.calls(b["body"]) == [(file.functions()[1]["line"], "last", 0)]


def test_lines_are_those_of_the_first_name():
    file = GoFile("package p\nfunc A() {\n\tx := a.\n\t\tB(1)\n\ta().\n\t\tC()\n}\n")
    assert file.calls(file.functions()[0]["body"]) == [(3, "a.B", 1), (5, "a", 0), (5, "C", 0)]


@pytest.mark.parametrize("text", ["", "func", "func (", "func A(", "func A(x int", "func A() {", "func A() { f(", "}}))", "func A() { x := \"", "/* open", "func A() { a.b.c.", "func 1() {}"])
def test_broken_files_are_read_to_their_end(text):
    file = GoFile(text)
    for f in file.functions():
        file.calls(f["body"])
    file.references()


def test_long_chains_take_linear_time():
    file = GoFile("func A() { x" + ".f(1)" * 20_000 + " }")
    assert len(file.calls(file.functions()[0]["body"])) == 20_000


def test_stub_references(spark):
    stub = "func (c *Ctx) Render(code int, w io.Writer) (n int, err error) {\n\tout := echo.New(code)\n\tc.Send(out)\n\treturn fmt.Fprint(w, helper(n)), err\n}"
    row = golang.stub_references(spark.createDataFrame([("s", stub), ("e", None), ("x", "no code")], "id string, text string")).collect()
    assert [(r["id"], r["name"], r["receiver"]) for r in row] == [("s", "Render", "Ctx")]
    # Locals give their methods alone; what is declared inside still counts, as scopes are not read.
    assert row[0]["references"] == ["Fprint", "New", "Send", "echo", "echo.New", "fmt.Fprint", "helper", "out"]


def test_files_break_by_themselves(spark):
    before = spark.createDataFrame([("a.go", "func Run(a int) {}"), ("b.go", "func Run(a, b int) {}")], "id string, text string")
    after = spark.createDataFrame([("a.go", "func Run(a int) {}"), ("b.go", "func Run(a, b, c int) {}")], "id string, text string")
    assert [(r["id"], r["params_before"], r["params_after"]) for r in parse.signature_breaks(before, after).collect()] == [("b.go", 2, 3)]
    sites = {(r["callee"], r["args"]) for r in parse.call_sites(spark.createDataFrame([("c.go", "func F() { p.Run(1, g(2)) }")], "id string, text string")).collect()}
    assert sites == {("Run", 2), ("g", 1)}


def test_names_are_functions_and_calls_of_one_reading(spark):
    text = "package m\n\nfunc A(f func(int) int) {\n\tx.B(1)\n\t// C(1)\n\tb()\n}\nfunc b() {}\n"
    texts = spark.createDataFrame([(f"f{i}", text) for i in range(40)] + [("none", None)], "id string, text string").coalesce(1)
    found = golang.names(texts)
    assert sorted(found.filter("id = 'f7'").select("kind", "name").collect()) == [("call", "B"), ("call", "b"), ("function", "A"), ("function", "b")]
    both = golang.calls(texts).selectExpr("id", "'call' AS kind", "callee").union(golang.functions(texts).selectExpr("id", "'function'", "name"))
    assert sorted(found.collect()) == sorted(both.collect())
    # However few tasks hold the texts, reading them is dealt out.
    assert found.rdd.getNumPartitions() >= 4
