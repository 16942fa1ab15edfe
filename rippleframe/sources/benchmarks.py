"""Labelled tasks from the forms that benchmarks come in, as tasks(task_id, repo, files ..)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def source_files(paths: Column, ext: str = ".go") -> Column:
    """Distinct sources of a language, tests left out, sorted."""
    return F.array_sort(F.array_distinct(F.filter(paths, lambda f: F.endswith(f, F.lit(ext)) & ~F.contains(f, F.lit(f"_test{ext}")))))


def patched_files(patch: Column) -> Column:
    """Old paths of a unified diff."""
    return F.regexp_extract_all(patch, F.lit(r"diff --git a/(.*?) b/"), F.lit(1))


def jsonl_tasks(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """task_id, title (50 characters), files of JSON lines with a fix_patch of ``least`` sources or more; bad lines are left out."""
    schema = "instance_id string, title string, fix_patch string, bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    # Raw lines are kept beside, so a bad one can be told from one without fields.
    tasks = rows.filter("bad IS NULL").select(F.coalesce("instance_id", F.lit("?")).alias("task_id"), F.substring(F.coalesce("title", F.lit("?")), 1, 50).alias("title"), source_files(patched_files(F.coalesce("fix_patch", F.lit("")))).alias("files"))
    return tasks.filter(F.size("files") >= least)


def pull_requests(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """repo (name of the file), number, body, files of JSON arrays of pull requests with ``least`` sources or more; ``pr`` and ``number`` both name one."""
    schema = "number long, pr long, title string, body string, files array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    repo = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)
    out = rows.select(repo.alias("repo"), F.coalesce("number", "pr").alias("number"), "title", "body", source_files(F.coalesce("files", F.array().cast("array<string>"))).alias("files"))
    return out.filter(F.size("files") >= least)


def table_tasks(tasks: DataFrame, repos: DataFrame, k: int = 80) -> DataFrame:
    """tasks(instance_id, repo, patch), repos(name, pattern) -> name and the tasks whose repo contains the pattern, the ``k`` first by id of each."""
    hit = tasks.join(F.broadcast(repos), F.contains(F.col("repo"), F.col("pattern")))
    w = Window.partitionBy("name").orderBy("instance_id")
    return hit.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r", "pattern")


def corpus_stats(prs: DataFrame) -> DataFrame:
    """repo, n, mean length of bodies and mean number of files of pull requests."""
    return prs.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(F.coalesce("body", F.lit("")))).alias("body_length"), F.avg(F.size("files")).alias("n_files"))
