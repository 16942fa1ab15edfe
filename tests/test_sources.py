"""Scans of folders, archives and benchmark files."""

import json
import os
import zipfile

from pyspark.sql import functions as F

from rippleframe.sources import archive, benchmarks, scan


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def files_read(df):
    """How many files a query opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    while leaves.size() == 1 and leaves.head().getClass().getSimpleName() in ("AdaptiveSparkPlanExec",):
        leaves = leaves.head().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numFiles").value()


def tree(tmp_path):
    said = {"a.go": "package a\n", "x/b.go": "package b\n\nfunc B() {}", "x/y/c.py": "c\n", "x/y/z/d.go": "d\n", "vendor/e.go": "e", ".git/f.go": "f", "x/node_modules/g.js": "g", "x/notes.txt": "n", "x/ü b.go": "ü\n"}
    for k, (name, text) in enumerate(said.items()):
        f = tmp_path / "tree" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
        os.utime(f, (1_700_000_000 + 1000 * k, 1_700_000_000 + 1000 * k))
    return str(tmp_path / "tree")


def test_manifest(spark, tmp_path):
    root = tree(tmp_path)
    got = rows(scan.manifest(spark, root), "path", "dir", "base", "depth", "length")
    assert [g[0] for g in got] == ["a.go", "x/b.go", "x/notes.txt", "x/y/c.py", "x/y/z/d.go", "x/ü b.go"] and got[3] == ("x/y/c.py", "x/y", "c.py", 2, 2)
    assert rows(scan.manifest(spark, root, deepest=1, names=r"\.go$"), "path") == [("a.go",), ("x/b.go",), ("x/ü b.go",)]


def test_only_stale_files_are_read(spark, tmp_path):
    root = tree(tmp_path)
    assert rows(scan.texts(spark, root), "id", "text")[-1] == ("x/ü b.go", "ü\n")
    assert files_read(scan.texts(spark, root, names=r"\.go$")) == 4
    since = scan.manifest(spark, root).filter("path = 'x/y/c.py'").first()["modified"]
    late = scan.texts(spark, root, since=str(since))
    assert rows(late, "id") == [("x/y/z/d.go",), ("x/ü b.go",)] and files_read(late) == 2
    assert rows(scan.line_counts(spark, root, names=r"\.go$")) == [(".", 1, 1), ("x", 2, 4), ("x/y/z", 1, 1)]


def test_staleness_by_file(spark, tmp_path):
    root = tree(tmp_path)
    then = scan.manifest(spark, root).select("path", "modified")
    known = then.filter("path <> 'a.go'").union(spark.createDataFrame([("gone.go", None)], "path string, modified timestamp"))
    old = known.withColumn("modified", F.when(F.col("path") == "x/b.go", F.col("modified") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("modified")))
    assert rows(scan.stale(then, old)) == [("a.go", "new"), ("gone.go", "gone"), ("x/b.go", "changed")]


def test_roots_are_one_read(spark, tmp_path):
    spark.createDataFrame([(1, "f")], "id long, name string").write.parquet(f"{tmp_path}/repos/r1/defs.parquet")
    spark.createDataFrame([(1, "g", True)], "id long, name string, test boolean").write.parquet(f"{tmp_path}/repos/r2/defs.parquet")
    (tmp_path / "repos" / "empty").mkdir()
    assert rows(scan.roots(spark, f"{tmp_path}/repos", "defs"), "repo", "id", "name") == [("r1", 1, "f"), ("r2", 1, "g")]


def test_archives_are_read_in_ranges(spark, tmp_path):
    archive.register(spark)
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/", "")
        for k in range(25):
            z.writestr(f"d/{k:02d}.json", json.dumps({"k": k}) * 50)
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("good", "fine")
        z.writestr("bad", "broken content")
    data = (tmp_path / "two.zip").read_bytes().replace(b"broken content", b"brokem content", 1)
    (tmp_path / "two.zip").write_bytes(data)
    (tmp_path / "three.zip").write_bytes(b"no archive")
    read = spark.read.format("zip_members").option("membersPerTask", "10").option("path", f"{tmp_path}/*.zip")
    every = read.load()
    assert every.rdd.getNumPartitions() == 5 and every.filter("error IS NULL").count() == 26
    assert rows(every.filter("error IS NOT NULL").select(F.regexp_extract("archive", "[a-z]+.zip$", 0), "member")) == [("three.zip", None), ("two.zip", "bad")]
    names = spark.read.format("zip_members").schema("member string, size long").option("path", f"{tmp_path}/two.zip").load()
    assert rows(names) == [("bad", 14), ("good", 4)]
    first = spark.read.format("zip_members").option("first", "5").option("path", f"{tmp_path}/one.zip").load()
    assert first.count() == 5 and spark.read.format("zip_members").option("path", f"{tmp_path}/none*.zip").load().count() == 0


def test_benchmark_files(spark, tmp_path):
    patch = "diff --git a/x.go b/x.go\ndiff --git a/y.go b/y.go\ndiff --git a/y_test.go b/y_test.go\n"
    lines = [json.dumps({"instance_id": "i1", "title": "t" * 80, "fix_patch": patch}), "not json", json.dumps({"instance_id": "i2", "fix_patch": patch[:26]}), json.dumps({"fix_patch": patch})]
    (tmp_path / "tasks.jsonl").write_text("\n".join(lines))
    got = rows(benchmarks.jsonl_tasks(spark, f"{tmp_path}/tasks.jsonl"))
    assert got == [("?", "?", ["x.go", "y.go"]), ("i1", "t" * 50, ["x.go", "y.go"])]
    (tmp_path / "gin.json").write_text(json.dumps([{"pr": 7, "body": "long", "files": ["b.go", "a.go", "a_test.go"]}, {"number": 8, "files": ["a.go"]}, {"number": 9}]))
    prs = benchmarks.pull_requests(spark, f"{tmp_path}/gin.json")
    assert rows(prs, "repo", "number", "files") == [("gin", 7, ["a.go", "b.go"])] and rows(benchmarks.corpus_stats(prs)) == [("gin", 1, 4.0, 2.0)]
    tasks = spark.createDataFrame([(f"t{k}", f"org__gin.{k}", "p") for k in range(5)] + [("u", "other", "p")], "instance_id string, repo string, patch string")
    kept = benchmarks.table_tasks(tasks, spark.createDataFrame([("gin", "org__gin"), ("echo", "echo")], "name string, pattern string"), 2)
    assert rows(kept, "name", "instance_id") == [("gin", "t0"), ("gin", "t1")]
