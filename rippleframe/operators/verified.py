"""Relations in the code that call sites in the sources bear out, for many plans at once.

defs(id, name, receiver, source_file, is_test) with base names as files, refs(from_def, to_def),
files(path, base), calls(path, callee) and exports(path, name) as the sources give them,
planned(plan_id, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.functions.text import basename, dirname
from rippleframe.sources.scratch import written

DEEPEST = 3


def cascade_score(depth: Column) -> Column:
    """By level, from 0: direct callers, their callers, and further ones."""
    return F.when(depth == 0, 0.7).when(depth == 1, 0.5).otherwise(0.35)


def _plain(defs: DataFrame) -> DataFrame:
    """name, id: the one definition without receiver that a name stands for, the first by id."""
    return defs.filter("receiver = ''").groupBy("name").agg(F.min("id").alias("id"))


def _first_paths(files: DataFrame, k: int) -> DataFrame:
    """base, path: of each base name the ``k`` first paths."""
    w = Window.partitionBy("base").orderBy("path")
    return files.select("base", "path").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def verified_cascade(refs: DataFrame, defs: DataFrame, files: DataFrame, calls: DataFrame, exports: DataFrame, planned: DataFrame, depth: int = 2, paths: int = 3, k: int = 10) -> DataFrame:
    """plan_id, path, depth, score, sites: files that call what the plan changes, and what those files export, level by level.

    A level goes from names to definitions, from those to the files of their callers in the
    graph, and from these to call sites in the sources; only files with a call of a name of the
    level go on, with what they export. Files of the plan, also by base name, and files of
    earlier levels are left out; depth is three at most; of each plan the ``k`` best stay.
    """
    own = planned.select("plan_id", "path").distinct()
    taken = own.select("plan_id", basename(F.col("path")).alias("base")).distinct()
    callers = refs.join(defs.filter("NOT is_test AND source_file <> ''").select(F.col("id").alias("from_def"), F.col("source_file").alias("base")), "from_def").select(F.col("to_def").alias("id"), "base").distinct()
    called_from = _plain(defs).join(callers, "id").select("name", "base").distinct()
    at = _first_paths(files, paths)
    names = own.join(exports, "path").select("plan_id", "name").distinct()
    found, level = None, None
    for d in range(min(depth, DEEPEST)):
        bases = names.join(called_from, "name").select("plan_id", "base").distinct().join(taken, ["plan_id", "base"], "left_anti")
        candidates = bases.join(at, "base").select("plan_id", "path").join(own, ["plan_id", "path"], "left_anti")
        if found is not None:
            candidates = candidates.join(found.select("plan_id", "path"), ["plan_id", "path"], "left_anti")
        sites = candidates.join(calls, "path").join(names.withColumnRenamed("name", "callee"), ["plan_id", "callee"])
        level = written(sites.groupBy("plan_id", "path").agg(F.count(F.lit(1)).alias("sites")).withColumn("depth", F.lit(d)), "verified")
        found = level if found is None else found.unionByName(level)
        names = level.join(exports, "path").select("plan_id", "name").distinct()
        if level.isEmpty():
            break
    if found is None:
        return planned.sparkSession.createDataFrame([], planned.select("plan_id", "path").withColumns({"depth": F.lit(0), "score": F.lit(0.0), "sites": F.lit(0).cast("long")}).schema)
    w = Window.partitionBy("plan_id").orderBy("depth", "path")
    best = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return best.select("plan_id", "path", "depth", cascade_score(F.col("depth")).alias("score"), "sites")


def verify_files(candidates: DataFrame, calls: DataFrame, exports: DataFrame, planned: DataFrame) -> DataFrame:
    """candidates(plan_id, path) -> plan_id, path, caller_sites, callee_sites: calls of the plan's exports there, and the plan's calls of theirs; those without either are left out."""
    asked, own = candidates.select("plan_id", "path").distinct(), planned.select("plan_id", "path").distinct()
    plan_names = own.join(exports, "path").select("plan_id", F.col("name").alias("callee")).distinct()
    forward = asked.join(calls, "path").join(plan_names, ["plan_id", "callee"]).select("plan_id", "path", F.lit(1).alias("f"), F.lit(0).alias("b"))
    plan_calls = own.join(calls, "path").groupBy("plan_id", F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    reverse = asked.join(exports.select("path", "name").distinct(), "path").join(plan_calls, ["plan_id", "name"]).select("plan_id", "path", F.lit(0).alias("f"), F.col("n").alias("b"))
    return forward.unionByName(reverse).groupBy("plan_id", "path").agg(F.sum("f").alias("caller_sites"), F.sum("b").alias("callee_sites"))


def verified_discovery(refs: DataFrame, defs: DataFrame, files: DataFrame, calls: DataFrame, exports: DataFrame, planned: DataFrame, paths: int = 5) -> DataFrame:
    """plan_id, path, direction, score, sites: files of callers and callees in the graph that the sources bear out.

    Of each base name the paths near the plan come first, in its files' directories and two
    above; .6, .7 and .8 for one, two and more sites.
    """
    own = planned.select("plan_id", "path").distinct()
    taken = own.select("plan_id", basename(F.col("path")).alias("base")).distinct()
    real = defs.filter("NOT is_test AND source_file <> ''")
    ends = refs.join(real.select(F.col("id").alias("from_def"), F.col("source_file").alias("from_base"), F.col("name").alias("from_name")), "from_def").join(
        real.select(F.col("id").alias("to_def"), F.col("source_file").alias("to_base"), F.col("name").alias("to_name")), "to_def"
    )
    named = own.join(exports, "path").select("plan_id", "name").distinct()
    hit = lambda known, other: named.join(ends.select(F.col(known).alias("name"), F.col(other).alias("base")).distinct(), "name").select("plan_id", "base")
    bases = hit("to_name", "from_base").union(hit("from_name", "to_base")).distinct().join(taken, ["plan_id", "base"], "left_anti")
    up = dirname(F.col("path"))
    near = own.select("plan_id", F.explode(F.array(up, dirname(up), dirname(dirname(up)))).alias("dir")).filter("dir <> '.'").distinct().withColumn("near", F.lit(True))
    at = bases.join(files.select("base", "path").distinct(), "base").withColumn("dir", dirname(F.col("path"))).join(near, ["plan_id", "dir"], "left")
    w = Window.partitionBy("plan_id", "base").orderBy(F.desc_nulls_last("near"), "path")
    first = at.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= paths).select("plan_id", "path").join(own, ["plan_id", "path"], "left_anti")
    sites = F.col("caller_sites") + F.col("callee_sites")
    score = F.when(sites >= 3, 0.8).when(sites == 2, 0.7).otherwise(0.6)
    return verify_files(first, calls, exports, planned).select("plan_id", "path", F.when(F.col("caller_sites") > 0, "caller").otherwise("callee").alias("direction"), score.alias("score"), sites.alias("sites"))
