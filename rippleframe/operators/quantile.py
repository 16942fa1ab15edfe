"""Exact order statistics and row numbers of tables that no task can sort whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.sources.scratch import discard, written

#: Ranges that a group's values are counted in, in one round.
RANGES = 1024
#: Values that are left to one sort.
SORTED = 10_000


def exact_percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key and one column a share: the value at floor(share * (n - 1)) of each group's values, ascending.

    Selection by counting: a round counts a group's values in ``RANGES`` equal ranges between
    its bounds, keeps the range that holds the wanted place, and takes the least and the most
    of its values as the next bounds. A group is never one array nor one sort; values that are
    left in a range are sorted once there are at most ``SORTED`` of them. Nulls are left out;
    a group of nulls alone has no row.
    """
    data = rows.select(F.col(key).alias("g"), F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    sizes = data.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(c).alias("share"), F.floor(p * (F.col("n") - 1)).cast("long").alias("place")) for c, p in shares.items()])).alias("w")
    left = written(sizes.select("g", wanted, "lo", "hi", "n").select("g", "w.share", "w.place", "lo", "hi", "n"), "percentile-bounds")
    while not left.filter(f"lo < hi AND n > {SORTED}").isEmpty():
        opened = left.filter(f"lo < hi AND n > {SORTED}")
        within = data.join(opened, "g").filter("x BETWEEN lo AND hi")
        at = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * RANGES), F.lit(RANGES - 1))
        counts = within.groupBy("g", "share", "place", at.alias("range")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("g", "share").orderBy("range"))
        hit = counts.withColumn("before", upto - F.col("n")).filter("before <= place AND place < before + n")
        moved = hit.select("g", "share", (F.col("place") - F.col("before")).alias("place"), "lo", "hi", "n")
        nxt = written(left.filter(f"NOT (lo < hi AND n > {SORTED})").unionByName(moved), "percentile-bounds")
        discard(left)
        left = nxt
    same = left.filter("lo = hi").select("g", "share", F.col("lo").alias("x"))
    few = data.join(left.filter("lo < hi"), "g").filter("x BETWEEN lo AND hi")
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("g", "share").orderBy("x")) - 1).filter("r = place").select("g", "share", "x")
    return same.unionByName(ranked).groupBy("g").agg(*[F.max(F.when(F.col("share") == c, F.col("x"))).alias(c) for c in shares]).withColumnRenamed("g", key)


def numbered(rows: DataFrame, order: list[str | Column], name: str = "row_no") -> DataFrame:
    """Rows with their place in an order, from 1: ranges are sorted apart and moved on by the sizes of those before."""
    parts = written(rows.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("range_no", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    # One row a range.
    before = sizes.select("range_no", (F.sum("n").over(Window.orderBy("range_no")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    return parts.withColumn("own_no", own).join(F.broadcast(before), "range_no").withColumn(name, F.col("own_no") + F.col("before")).drop("own_no", "before", "range_no")
