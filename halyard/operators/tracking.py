"""Rectangles of a session's frames, held over frames that show none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..presets import RECTANGLE_HOLD_FRAMES


def hold_rectangles(frames: DataFrame, by: list[str], order: list[str], rectangle: Column, least: float = 0.6, most: int = RECTANGLE_HOLD_FRAMES) -> DataFrame:
    """frames, which have detected and confidence, with used, shown and held_for.

    A rectangle that is detected with confidence is used; the frames after it use
    it on until another comes, up to ``most`` of them, whether they detect nothing
    or only little. So frames fall into islands, each begun by a confident one,
    and a place in the island says whether its rectangle is still held. Shown is
    what a frame detects itself, or else the held one. held_for counts the frames
    since, and is null where nothing is used. Sessions are a task's sort each,
    with no more state than the last few rows.
    """
    found = F.coalesce(F.col("detected"), F.lit(False)) & rectangle.isNotNull()
    sure = found & F.coalesce(F.col("confidence") >= least, F.lit(False))
    recent = Window.partitionBy(*by).orderBy(*order).rowsBetween(-most, 0)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    marked = frames.withColumns({"_sure": sure, "_place": place, "_own": F.when(found, rectangle)})
    last = F.last(F.when(F.col("_sure"), F.struct("_own", "_place")), ignorenulls=True).over(recent)
    held = marked.withColumn("_held", last)
    return held.select(
        *frames.columns, F.col("_held._own").alias("used"), F.coalesce("_own", "_held._own").alias("shown"),
        (F.col("_place") - F.col("_held._place")).cast("int").alias("held_for"),
    )
