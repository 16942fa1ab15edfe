"""Token counts from an exact length histogram.

Documents are counted by encoded length; suffix sums over the histogram answer, for every
length taken as a context limit, the documents and tokens beyond it, the totals when texts
are cut at it, and which quantile it is. The sums run in two levels, within ranges of
``RANGE`` lengths and over the ranges, so no task holds the whole histogram.

Defined results: a null or empty text has length 0; repeated rows each count; an empty
table gives an empty histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import count_tokens
from .common import materialize, read_table

RANGE = 512


def histogram(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """length, n_docs."""
    return count_tokens(docs, id_col, text_col).groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """length, n_docs, docs_over, tokens_over (of longer documents), truncated_tokens, total_tokens, quantile."""
    h = materialize(hist, "length-histogram").withColumn("part", F.floor(F.col("length") / RANGE))
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("p_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("p_tokens"))
    beyond = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each range: their number depends on the longest text alone.
    ranges = parts.select(
        "part", *(F.coalesce(F.sum(c).over(beyond), F.lit(0)).alias(f"{c}_beyond") for c in ("p_docs", "p_tokens")),
        F.sum("p_docs").over(every).alias("all_docs"), F.sum("p_tokens").over(every).alias("all_tokens"),
    )
    w = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    docs_over = F.coalesce(F.sum("n_docs").over(w), F.lit(0)) + F.col("p_docs_beyond")
    tokens_over = F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(w), F.lit(0)) + F.col("p_tokens_beyond")
    return h.join(ranges, "part").select("length", "n_docs", docs_over.alias("docs_over"), tokens_over.alias("tokens_over"), "all_docs", "all_tokens").select(
        "length", "n_docs", "docs_over", "tokens_over",
        (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("truncated_tokens"),
        F.col("all_tokens").alias("total_tokens"), (1 - F.col("docs_over") / F.col("all_docs")).alias("quantile"),
    )


def at_limit(answers: DataFrame, limit: int) -> dict:
    """Totals for any limit, from the longest length that does not exceed it."""
    row = answers.filter(F.col("length") <= limit).orderBy(F.desc("length")).first()
    if row is None:
        row = answers.orderBy("length").first()
        if row is None:
            return {"docs_over": 0, "tokens_over": 0, "truncated_tokens": 0}
        n = row["docs_over"] + row["n_docs"]
        return {"docs_over": n, "tokens_over": row["total_tokens"], "truncated_tokens": n * limit}
    cut = row["total_tokens"] - row["tokens_over"] + row["docs_over"] * limit
    return {"docs_over": row["docs_over"], "tokens_over": row["tokens_over"], "truncated_tokens": cut}


def length_at_quantile(answers: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of the documents do not exceed."""
    row = answers.filter(F.col("quantile") >= q).orderBy("length").first()
    return row and row["length"]


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each length that occurs, with the totals of that context limit."""
    return limits(histogram(read_table(spark, sf_dir, "documents")))
