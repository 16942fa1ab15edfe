"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (root or "file:///tmp/checkpoints").rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage and survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/core/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the tables behind frames from ``written`` once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            df._scratch_path = None
