"""Secret scan by corpus-wide ownership, with DataFrame functions alone.

Three base kinds are matched by pattern. The method adds unlabelled high-variety strings
(kind ``token``): a candidate's hash is counted over the distinct repositories and owners
that hold it; what at most ``max_owners`` owners hold is live-looking and added, what more
hold is a copied example and is not.

Positions come from the lengths of a text's pieces between matches and of the matches,
in code points. Defined results: a null text counts as empty; texts are scanned whole,
however long, in time that grows with their length and matches; a null owner or repository
counts as one of its own; a null id keeps its row; rows that repeat are each returned, and
count once for their owner; an empty table gives an empty result. Only the four named
columns are read, so extra columns of any name change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "token")
MAX_OWNERS = 1


#: A value that this share of all spans has is looked up by broadcast; at most as many values can have it.
HEAVY = 10_000


def _matches(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches: their lengths, those of the pieces before them, and their values; null without any."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), F.transform(found, F.length).alias("length"), values.alias("value"))
    return F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), zipped.alias("found")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """rid, doc_id of each row; rid, owner, repo, kind, start, end, digest of each span: base ones, and tokens that no base span touches.

    A match begins where the pieces and matches before it end; running sums over a text's
    matches give that, so time grows with their number. Tokens need a digit and letters of both
    cases; a token touches a base span that begins before it ends and ends after it begins.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), F.concat_ws("/", owner_col, repo_col).alias("repo"), t.alias("t")).withColumn("rid", F.monotonically_increasing_id())
    kinds = F.array_compact(F.array(_matches(F.col("t"), ASSIGN, 0, 2), _matches(F.col("t"), ACCESS, 1), _matches(F.col("t"), HEX, 2), _matches(F.col("t"), TOKEN, 3)))
    held = materialize(rows.select("rid", "doc_id", "owner", "repo", kinds.alias("kinds")), "secret-scan")
    each = held.select("rid", "owner", "repo", F.explode("kinds").alias("k")).select("rid", "owner", "repo", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("pos", "m"))
    own = Window.partitionBy("rid", "kind").orderBy("pos")
    upto = F.sum(F.col("m.piece") + F.col("m.length")).over(own)
    placed = each.repartition("rid").withColumn("end", upto.cast("int")).withColumn("start", F.col("end") - F.col("m.length"))
    v, base = F.col("m.value"), F.col("kind") < 3
    fits = F.when(F.col("kind") == 0, F.length(v) >= 6).when(base, True).otherwise(v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]"))
    spans = placed.filter(fits).select("rid", "owner", "repo", "kind", "start", "end", F.sha2(v, 256).alias("digest"))
    # What follows is asked of the opposite order, where it is a running minimum too.
    earlier = Window.partitionBy("rid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(base, F.col("end"))).over(earlier)
    after = F.min(F.when(base, F.col("start"))).over(later)
    touched = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    apart = spans.withColumn("touched", ~base & touched).filter("NOT touched").drop("touched")
    return held.select("rid", "doc_id"), materialize(apart, "secret-spans")


def ownership(spans: DataFrame) -> DataFrame:
    """digest, n_owners, n_repos, n_spans of every candidate value of the corpus; copies of one owner and repository are folded before the shuffle."""
    each = spans.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_spans"))


def find_secrets(spans: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """rid, kind, start, end, digest, n_owners, n_repos, live: one row a candidate span.

    Values with a ten-thousandth of all spans or more, of which there are ten thousand at most,
    are broadcast; so no key of the join on the other values is hot.
    """
    owned = materialize(ownership(spans), "secret-owners")
    total = owned.agg(F.coalesce(F.sum("n_spans"), F.lit(0))).first()[0]
    heavy = F.col("n_spans") * HEAVY >= total
    columns = ["digest", "n_owners", "n_repos"]
    few = F.broadcast(owned.filter(heavy).select(*columns))
    joined = spans.join(few, "digest").unionByName(spans.join(few.select("digest"), "digest", "left_anti").join(owned.filter(~heavy).select(*columns), "digest"))
    return joined.select("rid", "kind", "start", "end", "digest", "n_owners", "n_repos", (F.col("n_owners") <= max_owners).alias("live"))


def _said(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"]))


def verdicts(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, ownership for every row of ``scan``.

    ``ownership`` has kind, start, end, n_owners, n_repos and live of every candidate span, base
    spans and copied tokens too, in the order of their starts.
    """
    owned = find_secrets(spans).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repos", "live"))).alias("owned"))
    every = F.coalesce("owned", F.array().cast("array<struct<start:int,kind:int,end:int,n_owners:bigint,n_repos:bigint,live:boolean>>"))
    both = rows.join(owned, "rid", "left").withColumn("owned", every)
    base, kept = F.filter("owned", lambda s: s["kind"] < 3), F.filter("owned", lambda s: (s["kind"] < 3) | s["live"])
    kinds = F.array(*map(F.lit, KINDS))
    told = F.transform("owned", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"], s["n_owners"], s["n_repos"], F.when(s["live"], "live").otherwise("copied")))
    count = [F.size(F.expr(f"filter(owned, s -> s.kind = {k})")).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    joined = lambda x: F.array_join(x, ",")
    return both.select("doc_id", *count, F.sha2(joined(_said(base)), 256).alias("base_sha256"), joined(_said(kept)).alias("spans"), joined(told).alias("ownership"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, ownership for every document."""
    return verdicts(*scan(read_table(spark, sf_dir, "documents")))
