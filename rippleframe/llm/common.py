"""Shared helpers: reading tables, shared scratch tables, names that clash with none."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_CHECKPOINT_DIR = "file:///tmp/checkpoints"

#: Most bytes of one broadcast value; larger inputs go in blocks or through a shuffle.
BROADCAST_BYTES = 32 << 20

#: Spark's setting that deletes a statement's shuffle files once it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (root or LOCAL_CHECKPOINT_DIR).rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors.

    The write's shuffle files go once the table is there, as nothing reads them again, and so
    do the tables that ``df`` alone reads (see ``reading``).
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tables/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    discard(*getattr(df, "_reads", ()))
    return out


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which alone reads these written tables; ``materialize`` deletes them once it has written it."""
    df._reads = tables
    return df


def discard(*tables: DataFrame | None) -> None:
    """Delete the tables behind frames from ``materialize`` once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            df._scratch_path = None


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until none of them is a column of ``df`` (names compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
