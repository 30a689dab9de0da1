"""Classifiers and small extractors: statuses, log lines, thumbnails, enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a log says of videos that can't be had.
UNAVAILABLE = (r"video (is )?not available", r"video unavailable", r"this video is unavailable", r"private video")
ENTRY = r"(?i)ERROR:\s+\[(?:youtube(?::(?:music|tab))?)\]\s+([A-Za-z0-9_-]+):\s+([^\n]+)"


def _first_true(pairs: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for on, name in reversed(pairs):
        out = F.when(F.coalesce(on, F.lit(False)), name).otherwise(out)
    return out


def experience_status(error: Column, switch: Column, playing: Column, ready: Column, paused: Column) -> Column:
    return _first_true([(error, "error"), (switch, "switch-available"), (playing, "playing"), (ready, "ready"), (paused, "paused")], "idle")


def recognition_status(recognized: Column, recognizing: Column, last_hash: Column) -> Column:
    return _first_true([(recognized.isNotNull(), "RECOGNIZED"), (recognizing, "MATCHING"), (last_hash.isNotNull(), "CHECKING")], "IDLE")


def unavailable_entries(log: Column) -> Column:
    """array<struct<id, message>> of the log's errors about videos that can't be had."""
    ids, messages = (F.regexp_extract_all(log, F.lit(ENTRY), F.lit(g)) for g in (1, 2))
    both = F.transform(F.arrays_zip(ids.alias("id"), messages.alias("message")), lambda e: F.struct(e["id"].alias("id"), F.trim(e["message"]).alias("message")))
    return F.filter(both, lambda e: e["message"].rlike("(?i)" + "|".join(UNAVAILABLE)))


def already_archived(log: Column) -> Column:
    return F.coalesce(log.rlike("(?i)has already been recorded in the archive"), F.lit(False))


def best_thumbnail(thumbnails: Column, direct: Column) -> Column:
    """The url of the first of the largest thumbnails, else the direct one; thumbnails are struct<url, width, height>."""
    with_url = F.filter(thumbnails, lambda t: F.coalesce(t["url"], F.lit("")) != "")
    sized = F.transform(with_url, lambda t, i: F.struct((-F.coalesce(t["width"], F.lit(0)) * F.coalesce(t["height"], F.lit(0))).alias("a"), i.alias("i"), t["url"].alias("u")))
    return F.coalesce(F.array_min(sized)["u"], direct)


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    low = F.lower(value)
    return F.when(low.isin(*allowed), low).otherwise(default)


def saved_flags(saved: DataFrame, supported: list[str]) -> DataFrame:
    """Saved flags (id, enabled) that are known and set."""
    return saved.filter(F.col("id").isin(*supported) & F.col("enabled").isNotNull()).select("id", "enabled")


def freshness(version: Column, today: Column, most_days: int) -> Column:
    """struct<age_days, ok> of a yyyy.MM.dd version; a version of another form isn't fresh."""
    age = F.datediff(today, F.try_to_date(F.when(F.trim(version).rlike(r"^\d{4}\.\d{2}\.\d{2}$"), F.trim(version)), "yyyy.MM.dd"))
    return F.struct(age.alias("age_days"), F.coalesce(age <= most_days, F.lit(False)).alias("ok"))


def id_list(df: DataFrame, column: str) -> DataFrame:
    """One row: the distinct ids, in order, with commas between; null where there is none."""
    ids = F.array_sort(F.collect_set(column))
    return df.agg(F.nullif(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), F.lit("")).alias("ids"))
