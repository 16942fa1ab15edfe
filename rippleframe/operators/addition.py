"""What adding a definition sets in motion, and what other repositories do in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.operators.graph import callers_each


def _first(rows: DataFrame, key: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("r") <= k).drop("r")


def resolve_names(wanted: DataFrame, refs: DataFrame, defs: DataFrame) -> DataFrame:
    """wanted(key, name) -> key, name, id: the definition without receiver, else the only one of the name, else the most referred to; tests aside, ties to the smaller id."""
    known = callers_each(refs, defs.filter("NOT is_test")).groupBy("name").agg(
        F.min(F.when(F.col("receiver") == "", F.col("id"))).alias("plain"), F.max(F.struct("callers", -F.col("id"))).alias("top")
    )
    best = F.coalesce("plain", -F.col("top.col2"))
    return wanted.join(known, "name").select("key", "name", best.alias("id"))


def addition_impact(refs: DataFrame, defs: DataFrame, additions: DataFrame, siblings: int = 10, references: int = 10) -> DataFrame:
    """additions(key, receiver) -> key, n_references, chain_depth, files, production_callers, test_callers.

    A new method is taken to refer to what its siblings do: the first ``references`` names
    that the first ``siblings`` exported methods of the receiver refer to, by id. Their callers
    count; what they refer to in turn is the second ring, and callers of that ring that lie in
    neither count too. Keys without siblings that refer to anything have zeros.
    """
    edges = refs.select("from_def", "to_def")
    own = additions.join(_first(defs.filter("exported AND NOT is_test AND receiver <> ''").select("receiver", "id"), ["receiver"], ["id"], siblings), "receiver").select("key", F.col("id").alias("from_def"))
    target = defs.filter("NOT is_test").select(F.col("id").alias("to_def"), "name")
    named = own.join(edges, "from_def").join(target, "to_def").groupBy("key", "name").agg(F.min(F.struct("from_def", "to_def")).alias("at"))
    names = _first(named, ["key"], ["at"], references)
    ring = resolve_names(names.select("key", "name"), refs, defs).select("key", "id").distinct()
    kinds = defs.select(F.col("id").alias("from_def"), "is_test", F.col("source_file").alias("file"))
    into = lambda rows: rows.join(edges, F.col("id") == F.col("to_def")).select("key", "from_def").join(kinds, "from_def")
    second = ring.join(edges, F.col("id") == F.col("from_def")).select("key", F.col("to_def").alias("id")).distinct().join(ring, ["key", "id"], "left_anti")
    seen = ring.unionByName(second).select("key", F.col("id").alias("from_def"))
    far = into(second).join(seen, ["key", "from_def"], "left_anti")
    counted = into(ring).select("key", "is_test", F.lit(None).cast("string").alias("file")).unionByName(
        far.select("key", "is_test", F.when(~F.col("is_test") & (F.col("file") != ""), F.col("file")).alias("file"))
    )
    files = ring.join(defs.select("id", F.col("source_file").alias("file")), "id").filter("file <> ''").select("key", F.lit(None).cast("boolean").alias("is_test"), "file")
    totals = counted.unionByName(files).groupBy("key").agg(
        F.countDistinct("file").alias("files"), F.count_if(~F.col("is_test")).alias("production_callers"), F.count_if("is_test").alias("test_callers")
    )
    sizes = names.groupBy("key").agg(F.count(F.lit(1)).alias("n_references"))
    depth = ring.select("key", F.lit(1).alias("d")).unionByName(second.select("key", F.lit(2).alias("d"))).groupBy("key").agg(F.max("d").alias("chain_depth"))
    out = additions.select("key").distinct().join(sizes, "key", "left").join(depth, "key", "left").join(totals, "key", "left")
    return out.na.fill(0).select("key", "n_references", "chain_depth", "files", "production_callers", "test_callers")


def names_containing(terms: DataFrame, names: DataFrame, gram: int = 3) -> DataFrame:
    """term, name: names that contain a term, or it with a capital first letter; met by parts of up to ``gram`` characters, not pair by pair."""
    capital = F.concat(F.upper(F.substring("term", 1, 1)), F.substring("term", 2, 1 << 30))
    forms = terms.filter("term <> ''").select("term", F.explode(F.array_distinct(F.array(F.col("term"), capital))).alias("form"))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda n: F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.col("name"), i, n))))
    cut = names.filter("name <> ''").select("name").distinct().select("name", F.explode(F.array_distinct(parts)).alias("part"))
    return forms.withColumn("part", F.substring("form", 1, gram)).join(cut, "part").filter(F.contains("name", F.col("form"))).select("term", "name").distinct()


def analogies(refs: DataFrame, defs: DataFrame, terms: DataFrame, matches: int = 3, references: int = 10, siblings: int = 5, sibling_references: int = 5, connected: int = 3) -> tuple[DataFrame, DataFrame]:
    """What repositories have by the name of a term, and the names those things refer to.

    refs(repo, from_def, to_def), defs(repo, id, name, receiver, source_file, is_test, exported),
    terms(term). The first frame has term, repo, id, name, callers, source_file and references of
    the ``matches`` most referred to in a repository; the second term, name, hits: how often a
    name is referred to by matches, and by siblings that share one of the references of a match with
    ``connected`` callers or more. Names of two hits or more are the pattern of a term.

    Things that share a reference are counted before they are paired: of each reference the
    ``siblings`` + 1 most referred to stay, so one that half of a repository refers to costs no
    more than any other.
    """
    key = ["repo", "id"]
    degree = refs.groupBy("repo", F.col("to_def").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    known = defs.join(degree, key, "left").withColumn("callers", F.coalesce("callers", F.lit(0).cast("long")))
    real = defs.filter("NOT is_test")
    source, target = real.select("repo", F.col("id").alias("from_def"), F.col("name").alias("from_name")), real.select("repo", F.col("id").alias("to_def"), F.col("name").alias("to_name"))
    uses = refs.join(source, ["repo", "from_def"]).join(target, ["repo", "to_def"]).select("repo", F.col("from_name").alias("name"), F.col("to_name").alias("reference")).distinct()
    found = names_containing(terms, real.filter("exported")).join(known.filter("exported AND NOT is_test"), "name")
    best = _first(found, ["term", "repo"], [F.desc("callers"), "id"], matches).filter("callers > 0")
    named = _first(best.select("term", "repo", "id", "name", "callers", "source_file").join(uses, ["repo", "name"]), ["term", "repo", "id"], ["reference"], references)
    listed = named.groupBy("term", "repo", "id").agg(F.array_sort(F.collect_set("reference")).alias("references"))
    out = best.join(listed, ["term", "repo", "id"], "left").select("term", "repo", "id", "name", "callers", "source_file", F.coalesce("references", F.array().cast("array<string>")).alias("references"))

    # Who refers to a name, by its definition of most callers, with how many refer to it.
    top = known.filter("exported AND NOT is_test").groupBy("repo", "name").agg(F.max("callers").alias("fame"))
    sharing = _first(uses.join(top, ["repo", "name"]).select("repo", "reference", F.col("name").alias("sibling"), "fame"), ["repo", "reference"], [F.desc("fame"), "sibling"], siblings + 1)
    near = named.filter(F.col("callers") >= connected).select("term", "repo", "id", "name", "reference").join(sharing, ["repo", "reference"]).filter("sibling <> name")
    kin = _first(near, ["term", "repo", "id", "reference"], [F.desc("fame"), "sibling"], siblings).select("term", "repo", "sibling").distinct()
    theirs = _first(kin.join(uses.withColumnRenamed("name", "sibling"), ["repo", "sibling"]), ["term", "repo", "sibling"], ["reference"], sibling_references)
    hits = named.select("term", "reference").unionByName(theirs.select("term", "reference")).groupBy("term", F.col("reference").alias("name")).agg(F.count(F.lit(1)).alias("hits"))
    return out, hits
