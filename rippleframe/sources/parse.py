"""Relations from texts: histories, diffs, compiler output, sources. Texts stand in columns (id, text) and may be of any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.functions.text import dirname
from rippleframe.sources import golang

# Heads of functions in diff hunks, which show one line alone.
_FUNC = r"^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\("


def lines(texts: DataFrame) -> DataFrame:
    """id, pos, line."""
    return texts.select("id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _running(c: Column) -> Column:
    return F.last(c, ignorenulls=True).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))


def commit_files(logs: DataFrame, delimiter: str = "COMMIT", keep: int = 200) -> DataFrame:
    """id, seq (1 for the first listed), file: names-only history texts whose commits begin with a delimiter line."""
    each = lines(logs).withColumn("line", F.trim("line"))
    seq = F.sum((F.col("line") == delimiter).cast("int")).over(Window.partitionBy("id").orderBy("pos"))
    return each.withColumn("seq", seq.cast("int")).filter(f"line <> '' AND line <> '{delimiter}' AND seq BETWEEN 1 AND {keep}").select("id", "seq", F.col("line").alias("file")).distinct()


def diff_hunks(patches: DataFrame) -> DataFrame:
    """id, pos, file, func, receiver: the hunks of unified diffs with the function their headers name."""
    each = lines(patches).withColumn("file", _running(F.nullif(F.regexp_extract("line", r"^diff --git a/.* b/(.*)$", 1), F.lit(""))))
    head = F.regexp_extract("line", r"^@@ [^@]*@@ ?(.*)$", 1)
    hunks = each.filter("startswith(line, '@@ ')").withColumn("head", head)
    return hunks.select("id", "pos", "file", F.regexp_extract("head", _FUNC, 2).alias("func"), F.regexp_extract("head", _FUNC, 1).alias("receiver"))


def first_changed_func(patches: DataFrame) -> DataFrame:
    """id, file, func, receiver of the first hunk of each patch that names one."""
    named = diff_hunks(patches).filter("func <> ''")
    return named.groupBy("id").agg(F.min_by(F.struct("file", "func", "receiver"), "pos").alias("f")).select("id", "f.*")


def changed_files(patches: DataFrame, suffix: str = ".go") -> DataFrame:
    """id, file: distinct files of diffs that end so and are no Go tests."""
    found = lines(patches).select("id", F.regexp_extract("line", r"^diff --git a/.* b/(.*)$", 1).alias("file"))
    return found.filter(F.endswith("file", F.lit(suffix)) & ~F.endswith("file", F.lit("_test.go"))).distinct()


def test_dirs(patches: DataFrame, planned: DataFrame, k: int = 5) -> DataFrame:
    """id, dir, n: directories of the tests in a diff by frequency, those of planned files (id, file) left out."""
    found = lines(patches).select("id", F.regexp_extract("line", r"^diff --git a/.* b/(.*_test\.go)$", 1).alias("file")).filter("file <> ''")
    dirs = found.groupBy("id", dirname(F.col("file")).alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    rest = dirs.join(planned.select("id", dirname(F.col("file")).alias("dir")).distinct(), ["id", "dir"], "left_anti")
    w = Window.partitionBy("id").orderBy(F.desc("n"), "dir")
    return rest.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def failing_tests(listed: Column) -> Column:
    """Test names of a list or of its text, sub-tests cut off."""
    return F.array_distinct(F.regexp_extract_all(listed, F.lit(r"(Test\w+)(?:/[^'\",\]]*)?"), F.lit(1)))


def compile_errors(logs: DataFrame) -> DataFrame:
    """id, file, line, col, message of "file.go:line:col: message" lines."""
    pattern = r"^\s*(\S+\.go):(\d+):(\d+): (.*)$"
    g = lambda k: F.regexp_extract("line", pattern, k)
    return lines(logs).filter(F.col("line").rlike(pattern)).select("id", g(1).alias("file"), g(2).cast("int").alias("at_line"), g(3).cast("int").alias("col"), g(4).alias("message"))


def errors_by_file(errors: DataFrame, spiked: DataFrame) -> DataFrame:
    """id, file, n, messages, kind: errors of a file, in the spike's own files (id, file) or obligations elsewhere."""
    found = errors.groupBy("id", "file").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("message")).alias("messages"))
    joined = found.join(spiked.select("id", "file", F.lit("spike").alias("s")).distinct(), ["id", "file"], "left")
    return joined.withColumn("kind", F.coalesce("s", F.lit("obligation"))).drop("s")


def recent_errors(logs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """id, ts, line: lines whose leading time lies in the last hours, the bound included."""
    ts = F.try_to_timestamp(F.regexp_extract("line", r"^\[?(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:Z|[+-]\d\d:\d\d)?)", 1))
    return lines(logs).withColumn("ts", ts).filter(F.col("ts") >= now - F.make_interval(hours=F.lit(hours))).select("id", "ts", "line")


def module_path(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?m)^\s*module\s+(\S+)", 1), F.lit(""))


def imports(texts: DataFrame, prefix: str = "") -> DataFrame:
    """id, package: imports of Go sources, grouped or single, that begin with a prefix."""
    block = F.array_join(F.regexp_extract_all("text", F.lit(r"(?s)\bimport\s*\(([^)]*)\)"), F.lit(1)), "\n")
    found = F.concat(F.regexp_extract_all(block, F.lit(r'"([^"]+)"'), F.lit(1)), F.regexp_extract_all("text", F.lit(r'(?m)^import\s+(?:\w+\s+)?"([^"]+)"'), F.lit(1)))
    return texts.select("id", F.explode(F.array_distinct(found)).alias("package")).filter(F.startswith("package", F.lit(prefix)))


def signatures(texts: DataFrame) -> DataFrame:
    """id, line, name, receiver, params, results: functions of Go sources."""
    return golang.functions(texts)


def exported_signatures(texts: DataFrame) -> DataFrame:
    """Those whose names begin with a capital, tests left out."""
    return signatures(texts).filter(F.col("name").rlike("^[A-Z]") & ~F.col("name").rlike("^Test"))


def call_sites(texts: DataFrame) -> DataFrame:
    """id, line, caller, callee, full, args: calls in Go sources; ``full`` keeps the selector, callee is its last part."""
    return golang.calls(texts)


def struct_fields(texts: DataFrame) -> DataFrame:
    """id, type, field: fields of Go structs, embedded ones by their type."""
    pattern = r"(?s)type\s+(\w+)\s+struct\s*\{([^}]*)\}"
    both = F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("type"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("body"))).alias("s")
    fields = texts.select("id", both).select("id", "s.type", F.explode(F.split("s.body", "\n")).alias("f"))
    named = fields.select("id", "type", F.explode(F.split(F.regexp_extract("f", r"^\s*([\w, ]*?\w)(?:\s+[^\s,]|\s*$)", 1), r"\s*,\s*")).alias("field"))
    return named.filter("field <> ''")


def added_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    return struct_fields(after).join(struct_fields(before), ["id", "type", "field"], "left_anti")


def struct_literals(texts: DataFrame) -> DataFrame:
    """id, line, type: places that build a struct by a literal."""
    found = lines(texts).select("id", (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("line", F.lit(r"&?([A-Z]\w*)\{"), F.lit(1))).alias("type"))
    return found.filter("type <> ''")


def signature_breaks(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, name, receiver and both arities of a file's exported functions whose parameters or results changed in number."""
    side = lambda t, c: exported_signatures(t).select("id", "name", "receiver", F.col("params").alias(f"params_{c}"), F.col("results").alias(f"results_{c}"))
    return side(before, "before").join(side(after, "after"), ["id", "name", "receiver"]).filter("params_before <> params_after OR results_before <> results_after")


def obligations(before: DataFrame, after: DataFrame, others: DataFrame) -> DataFrame:
    """file, kind: other sources (id, text) that call a function whose arity changed, or build a struct that gained fields."""
    broken = signature_breaks(before, after).select(F.col("name").alias("callee")).distinct()
    grown = added_fields(before, after).select("type").distinct()
    calls = call_sites(others).join(broken, "callee", "left_semi").select(F.col("id").alias("file"), F.lit("signature").alias("kind"))
    built = struct_literals(others).join(grown, "type", "left_semi").select(F.col("id").alias("file"), F.lit("struct").alias("kind"))
    return calls.union(built).distinct()


def new_calls(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, callee: called after and not before."""
    return call_sites(after).select("id", "callee").distinct().join(call_sites(before).select("id", "callee"), ["id", "callee"], "left_anti")


def change_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change: the weightiest of struct-field, new-function, signature and body for each text that changed."""
    fields = added_fields(before, after).select("id", F.lit(0).alias("p"))
    key = ["id", "name", "receiver"]
    fresh = signatures(after).join(signatures(before), key, "left_anti").select("id", F.lit(1))
    old = signatures(before).select(*key, F.col("params").alias("p0"), F.col("results").alias("r0"))
    arity = signatures(after).join(old, key).filter("params <> p0 OR results <> r0").select("id", F.lit(2))
    body = after.join(before.select("id", F.col("text").alias("t0")), "id").filter("text <> t0").select("id", F.lit(3))
    least = fields.union(fresh).union(arity).union(body).groupBy("id").agg(F.min("p").alias("p"))
    return least.select("id", F.element_at(F.array(*map(F.lit, ("struct-field", "new-function", "signature", "body"))), F.col("p") + 1).alias("change"))


def file_blocks(texts: DataFrame) -> DataFrame:
    """id, file, code: fenced blocks of model text under a "// path.go", "### path.go" or "FILE: path.go" line."""
    pattern = r"(?s)(?:^|\n)(?://|#+|FILE:)\s*`?([\w./-]+\.go)`?[^\n]*\n+```\w*\n(.*?)```"
    pick = lambda k: F.regexp_extract_all("text", F.lit(pattern), F.lit(k))
    return texts.select("id", F.explode(F.arrays_zip(pick(1).alias("file"), pick(2).alias("code"))).alias("b")).select("id", "b.file", "b.code")


def grep(texts: DataFrame, needle: str) -> DataFrame:
    """id, line, text of the lines that hold a fixed string."""
    return lines(texts).filter(F.contains("line", F.lit(needle))).select("id", (F.col("pos") + 1).alias("line"), F.col("line").alias("text"))


def tests_mentioning(texts: DataFrame, symbol: str) -> DataFrame:
    """id, test: tests of sources that mention a symbol."""
    return texts.filter(F.contains("text", F.lit(symbol))).select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"func (Test\w+)\("), F.lit(1)))).alias("test"))


def page(texts: DataFrame, start: int, size: int = 300) -> DataFrame:
    """Lines start .. start + size - 1, counted from 1."""
    return lines(texts).withColumn("n", F.col("pos") + 1).filter(F.col("n").between(start, start + size - 1)).select("id", "n", "line")


def source_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first .. last and the comment lines right above them."""
    every = F.split(text, "\n", -1)
    above = F.reverse(F.slice(every, F.lit(1), first - 1))
    stop = F.array_position(F.transform(above, lambda x: x.rlike(r"^\s*//")), F.lit(False))
    n = F.when(stop == 0, F.size(above)).otherwise(stop - 1).cast("int")
    return F.array_join(F.slice(every, first - n, last - first + 1 + n), "\n")


def importers(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id: sources (id, text) that import or require a target (target, stem), in any of six languages.

    Words of import lines are joined with stems, so nothing is compared pair by pair.
    """
    statement = r"^\s*(import\b|from\b|export\b.*\bfrom\b|require\b|.*\brequire\s*\(|use\b|#include\b|const\b.*\bimport\s*\()"
    names = F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z_][\w-]*)(?=\b)"), F.lit(1)))).alias("stem")
    words = lines(sources).filter(F.col("line").rlike(statement)).select("id", names)
    return words.join(targets.select("target", "stem"), "stem").select("target", "id").distinct()
