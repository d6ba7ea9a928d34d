"""Numbers by key and order without a window on a hot key, and the folder that settles what is numbered."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share; where all runs in one process, a new local one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("paperloom.shared.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("paperloom.shared.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`, their number from 1 within their keys by order (unique within a key).

    Rows are sorted by ranges of keys and order, so a key with many rows spreads over partitions; what is summed in one place are the
    counts of a key's partitions. Null keys are a key.
    """
    by = [F.col(c) for c in (*keys, *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows must stand where they are counted, so they are settled before
    x = settled(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = x.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select(*(F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)), F.col("_part").alias("_p"), "_first", "_base")
    same: Column = part == F.col("_p")
    for n, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{n}"))
    out = x.join(counts, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_base") + 1)
    return out.select(*rows.columns, name)
