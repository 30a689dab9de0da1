"""Places of rows in the order of a whole table, without one task that holds them all."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id keeps a row's place in its partition in so many low bits.
PLACE_BITS = 33


def _ready(spark: SparkSession) -> None:
    """Name a folder for checkpoints where none is set, which only a single machine allows."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="ranks-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the folder for checkpoints."""
    _ready(df.sparkSession)
    return df.checkpoint(eager=True)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place from 0 in the given order; rows that tie get their places in any order.

    The table is sorted by ranges and checkpointed, so that no later run draws
    other ranges; a row's place is then that in its range plus the rows of the
    ranges before, of which there are as many as shuffle partitions. An empty
    table gives no rows.
    """
    rows = checkpointed(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", PLACE_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    return rows.join(F.broadcast(starts), "_range").withColumn(name, place).drop("_at", "_range", "_start")
