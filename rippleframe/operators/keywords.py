"""Directories that a task names and a plan leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.functions.text import basename, dirname, entities, tokenize
from rippleframe.sources.scratch import written

# Folders that the search passes over, and names of files that are often shared.
PASSED = (".git", ".defn", "vendor", "node_modules", "testdata")
COMMON = ("common", "shared", "utils", "helpers")
#: Directories deeper than this many slashes are not searched.
DEEPEST = 4


def ancestors(path: Column) -> Column:
    """All directories above a path, from the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def directories(files: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """dir, base (lower case), parent, depth of the directories above files(path)."""
    every = files.select(F.explode(ancestors(F.col("path"))).alias("dir")).distinct()
    depth = F.size(F.split("dir", "/")) - 1
    kept = every.filter((depth <= deepest) & ~F.arrays_overlap(F.split("dir", "/"), F.array(*map(F.lit, PASSED))))
    return kept.select("dir", F.lower(basename(F.col("dir"))).alias("base"), dirname(F.col("dir")).alias("parent"), depth.alias("depth"))


def keyword_gaps(plans: DataFrame, planned: DataFrame, files: DataFrame, most: int = 3, most_entity: int = 5) -> DataFrame:
    """plan_id, token, dir, covered_dir, source: directories named by a word of plans(plan_id, text) that planned(plan_id, path) leaves out.

    A word counts where a covered directory, named too, has the same parent and depth, and no
    more than ``most`` directories bear the word; a name that the text quotes counts without,
    up to ``most_entity`` directories. An index from words to directories answers; words of
    more directories than that are only looked up among what the plan covers, so a word that
    very many bear costs nothing.

    A plan's words and the directories it covers come together in one row, so all that tells gaps
    apart is read there; only the index, which is small beside the plans, is joined afterwards.
    """
    dirs = written(directories(files), "directories")
    few = dirs.groupBy("base").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max(most, most_entity))
    index = written(dirs.join(few, "base").withColumnRenamed("base", "token"), "named-directories")
    known = planned.select("plan_id", F.explode(ancestors(F.col("path"))).alias("dir")).join(dirs, "dir").groupBy("plan_id").agg(F.collect_set(F.struct("dir", "base", "parent", "depth")).alias("known"))
    told = plans.select("plan_id", tokenize(F.col("text")).alias("words"), entities(F.col("text")).alias("quoted")).join(known, "plan_id", "left")
    each = told.select("plan_id", "words", "quoted", F.col("known.dir").alias("covered"), F.filter("known", lambda d: F.array_contains("words", d["base"])).alias("peers"))
    each = each.select("plan_id", "quoted", "covered", "peers", F.explode("words").alias("token"))
    named = each.select("plan_id", "token", "covered", "peers", F.array_contains("quoted", F.col("token")).alias("entity")).join(index, "token").filter(~F.coalesce(F.array_contains("covered", F.col("dir")), F.lit(False)))
    beside = F.filter("peers", lambda d: (d["parent"] == F.col("parent")) & (d["depth"] == F.col("depth")))
    both = named.select("plan_id", "token", "dir", "entity", "n", F.array_min(beside)["dir"].alias("peer"), F.array_min("peers")["dir"].alias("any_peer"))
    kept = both.filter((F.col("entity") & (F.col("n") <= most_entity)) | (~F.col("entity") & F.col("peer").isNotNull() & (F.col("n") <= most)))
    return kept.select("plan_id", "token", "dir", F.coalesce("peer", "any_peer", F.lit("(none)")).alias("covered_dir"), F.when(F.col("entity"), "entity-dir").otherwise("keyword-dir").alias("source"))


def keyword_files(gaps: DataFrame, plans: DataFrame, planned: DataFrame, files: DataFrame, k: int = 3) -> DataFrame:
    """plan_id, dir, path, score, source: of each gap the ``k`` best Go files in it and right below, tests left out.

    .9 where a planned file of the covered directory has the same folder and name, .8 where the
    name is a word of the text, .7 for names that are often shared, else .5; quoted names add .2.
    """
    source_files = files.filter(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).select("path").distinct()
    up, base = dirname(F.col("path")), basename(F.col("path"))
    near = source_files.select("path", F.explode(F.array_distinct(F.array(up, dirname(up)))).alias("dir"), F.lower(F.regexp_replace(base, r"\.go$", "")).alias("stem"), F.concat(basename(up), F.lit("/"), base).alias("sub"))
    near = written(near.filter("dir <> '.'"), "files-near")
    # Gaps meet their plan's words and files in one row, and go on to the files of their directory without another exchange.
    own = plans.select("plan_id", tokenize(F.col("text")).alias("words")).join(planned.groupBy("plan_id").agg(F.collect_set("path").alias("paths")), "plan_id", "left")
    listed = gaps.join(own, "plan_id", "left").join(near, "dir")
    told = listed.select("plan_id", "dir", "token", "source", "path", "stem", F.array_contains("paths", F.concat("covered_dir", F.lit("/"), "sub")).alias("mirrors"), F.array_contains("words", F.col("stem")).alias("said"))
    score = F.when(F.col("mirrors"), 0.9).when(F.col("said"), 0.8).when(F.col("stem").isin(*COMMON), 0.7).otherwise(0.5)
    w = Window.partitionBy("plan_id", "dir", "token").orderBy(F.desc("score"), "path")
    best = told.withColumn("score", score).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    lifted = F.when(F.col("source") == "entity-dir", F.least(F.lit(1.0), F.round((F.col("score") + 0.2) * 10) / 10)).otherwise(F.col("score"))
    return best.select("plan_id", "dir", "path", lifted.alias("score"), "source")
