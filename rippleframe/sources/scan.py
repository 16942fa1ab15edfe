"""Scans of source folders: what is there, what it says, and what has changed since it was read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.functions.text import SKIPPED, SOURCE_EXT, basename, dirname


def _root(spark: SparkSession, folder: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri()
    return f"{whole.getScheme()}:/{(whole.getAuthority() or '')}{whole.getPath()}".rstrip("/")


def _below(root: str, column: str) -> Column:
    """The path below the root; a scheme may be followed by any number of slashes."""
    plain = re.sub("^([a-z0-9]+):/+", r"\1:/", root)
    return F.substring(F.regexp_replace(column, "^([a-z0-9]+):/+", "$1:/"), len(plain) + 2, 1 << 30)


def _wanted(relative: Column, deepest: int | None, names: str | None, skipped: tuple[str, ...]) -> Column:
    """Whether a path is deep at most so many folders, has a name like the pattern, and lies in no skipped folder."""
    folders = F.slice(F.split(relative, "/"), F.lit(1), F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0)))
    out = ~F.exists(folders, lambda x: x.isin(*skipped) | F.startswith(x, F.lit(".")))
    if deepest is not None:
        out = out & (F.size(folders) <= deepest)
    return out & relative.rlike(names) if names else out


def _files(spark: SparkSession, folder: str, deepest: int | None, names: str | None, skipped: tuple[str, ...]) -> DataFrame:
    """The binary source below a folder; what the metadata of a file rules out is pruned before any file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.filter(_wanted(_below(_root(spark, folder), "_metadata.file_path"), deepest, names, skipped))


def manifest(spark: SparkSession, folder: str, deepest: int | None = None, names: str | None = None, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path (below the folder), dir, base, depth, length, modified of files; contents are not read."""
    path = _below(_root(spark, folder), "path")
    listed = _files(spark, folder, deepest, names, skipped).select(path.alias("path"), "length", F.col("modificationTime").alias("modified"))
    return listed.select("path", dirname(F.col("path")).alias("dir"), basename(F.col("path")).alias("base"), (F.size(F.split("path", "/")) - 1).alias("depth"), "length", "modified")


def texts(spark: SparkSession, folder: str, since: str | None = None, deepest: int | None = None, names: str | None = SOURCE_EXT, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """id (path below the folder), text, modified of source files, of those changed after ``since`` (a timestamp) alone if given."""
    files = _files(spark, folder, deepest, names, skipped)
    if since is not None:
        files = files.filter(F.col("_metadata.file_modification_time") > F.lit(since).cast("timestamp"))
    return files.select(_below(_root(spark, folder), "path").alias("id"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def stale(files: DataFrame, ingested: DataFrame) -> DataFrame:
    """files(path, modified), ingested(path, modified) -> path, why: new, changed since it was read, or gone."""
    then = ingested.groupBy("path").agg(F.max("modified").alias("read"), F.lit(True).alias("known"))
    both = files.select("path", "modified", F.lit(True).alias("there")).join(then, "path", "full_outer")
    why = F.when(F.col("there").isNull(), "gone").when(F.col("known").isNull(), "new").when(F.col("modified") > F.col("read"), "changed")
    return both.select("path", why.alias("why")).filter("why IS NOT NULL")


def roots(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of every repository right below a folder, as one read, with the column repo.

    Columns that some repositories lack are null there; a repository without the table has no rows.
    """
    root = _root(spark, folder)
    every = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(f"{folder}/*/{name}.parquet")
    return every.select("*", F.split(_below(root, "_metadata.file_path"), "/").getItem(0).alias("repo"))


def line_counts(spark: SparkSession, folder: str, **which) -> DataFrame:
    """dir, files, lines of the source files right in each directory."""
    each = texts(spark, folder, **which).select(dirname(F.col("id")).alias("dir"), (F.size(F.split("text", "\n", -1)) - F.endswith("text", F.lit("\n")).cast("int")).alias("n"))
    return each.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"))
