"""Frames written out between the rounds of an iterative job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that all executors share, spark.checkpoint.dir. A temporary
    folder takes its place only where the setting is absent on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomspark-")
        spark.sparkContext.setCheckpointDir(path)
    return f"{path.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The frame, written to the shared folder and read again."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """df with the place of every row in the given order, from 0: ranges are sorted side by side
    and counted, and each starts where the ranges before it end. Rows equal in order may lie in
    any order but share a range, so order should tell them apart."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows, "numbered").withColumn("_range", F.shiftright("_at", 33))
    # one row a range
    counts = rows.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    out = rows.join(F.broadcast(starts), "_range")
    return out.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_range", "_start")


def numbered_within(df: DataFrame, key: str, *order: str, name: str = "n") -> DataFrame:
    """As numbered, but from 0 in every group of key; a group may span many ranges."""
    rows = numbered(df, key, *order, name="_all")
    first = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_all").alias("_first"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.col("_all") - F.col("_first")).drop("_all", "_key", "_first")
