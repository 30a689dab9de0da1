"""As-of joins: each row with the latest version that was in force when it happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, versions: DataFrame, by: list[str], at: str, value: Column, name: str, span: Column | None = None) -> DataFrame:
    """rows with the value of the last version of the same key at or before them, as column ``name``.

    Both sides go through one shuffle as one table and the last version is
    carried forward, so nothing is compared pair by pair. ``at`` is a column of
    both. ``span`` names the stretch of time that a row of either side lies in, as
    a number that grows with ``at``: rows are then dealt out by key and span, and
    only the last version of each span is carried to the next ones, so one key
    with most of the rows is many tasks. Without it a key is one task's.

    Versions at the same moment as a row count as before it; of several versions at
    one moment the greatest value counts. Null keys meet null keys, a null moment
    is before all others. Rows without a version have null.
    """
    one_span = span is None
    moment = lambda df: df.withColumn("_span", F.lit(0) if one_span else span)
    left = moment(rows.withColumns({"_is_row": F.lit(1), "_value": F.lit(None)}))
    right = moment(versions.select(*by, at, F.struct(value.alias("v")).alias("_value"), F.lit(0).alias("_is_row")))
    both = left.withColumn("_value", F.col("_value").cast(right.schema["_value"].dataType)).unionByName(right, allowMissingColumns=True)
    before = Window.partitionBy(*by, "_span").orderBy(F.col(at).asc_nulls_first(), "_is_row", "_value").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(before)).filter("_is_row = 1")
    if not one_span:
        # what is in force when a span begins: one row for each key and span that has rows or versions
        last = F.max_by("_value", F.struct(F.col("_value").isNotNull(), at, "_value"))
        earlier = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        starts = both.groupBy(*by, "_span").agg(last.alias("_last")).select(*by, "_span", F.last("_last", ignorenulls=True).over(earlier).alias("_start"))
        same = [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "_span")]
        on = same[0]
        for c in same[1:]:
            on = on & c
        filled = filled.alias("f").join(starts.alias("s"), on, "left").select("f.*", F.coalesce("f._seen", "s._start").alias("_in_force")).withColumn("_seen", F.col("_in_force"))
    return filled.select(*rows.columns, F.col("_seen.v").alias(name))
