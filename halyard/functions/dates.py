"""Dates in texts and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names and their short forms.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
NUMERIC = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
COMPACT = r"(\d{4})(\d{2})(\d{2})"
TEXTUAL = "(?i)(" + "|".join(sorted((m.capitalize() for m in MONTHS), key=lambda m: -len(m))) + r")\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
DISPLAY_ZONE = "America/Chicago"


def _date(text: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    """yyyy-mm-dd by a pattern's year, month and day groups; null if month or day can't be."""
    year, month, day = (F.regexp_extract(text, pattern, g) for g in groups)
    if pattern.startswith("(?i)"):
        names = F.create_map(*(F.lit(x) for m, n in MONTHS.items() for x in (m, str(n))))
        month = F.element_at(names, F.lower(month))
    two = lambda x: F.lpad(x, 2, "0")
    fine = month.cast("int").between(1, 12) & day.cast("int").between(1, 31)
    return F.when(text.rlike(pattern) & fine, F.concat_ws("-", year, two(month), two(day)))


def _first_kind(text: Column, numeric: str, compact: str, textual: str) -> Column:
    """The first kind that occurs decides, even if what it says isn't a date."""
    return (
        F.when(text.rlike(numeric), _date(text, numeric, (1, 2, 3)))
        .when(text.rlike(compact), _date(text, compact, (1, 2, 3)))
        .when(text.rlike(textual), _date(text, textual, (3, 1, 2)))
    )


def normalize_date(x: Column) -> Column:
    """yyyy-mm-dd of a text that is a date and nothing else."""
    return _first_kind(F.trim(x), f"^{NUMERIC}$", f"^{COMPACT}$", "(?i)^" + TEXTUAL[4:] + "$")


def find_date(text: Column) -> Column:
    """yyyy-mm-dd of the first date in a text: of its numeric ones, else compact, else with month names."""
    return _first_kind(F.regexp_replace(text, r"\s+", " "), NUMERIC, COMPACT, TEXTUAL)


def first_date(fields: list[Column], texts: list[Column]) -> Column:
    """The first field that is a date, else the first found in the texts, else unknown."""
    return F.coalesce(*map(normalize_date, fields), *map(find_date, texts), F.lit("unknown"))


def has_time(value: Column) -> Column:
    return value.rlike(r"T\d{2}:\d{2}")


def display_timestamp(
    value: Column, include_time: bool = True, include_zone: bool = True, fallback: str = "Date unavailable",
    session_zone: str = "UTC",
) -> Column:
    """``MMMM d, yyyy`` and, where the text has a time, `` at h:mm a z``, in Chicago time."""
    at = F.try_to_timestamp(F.trim(value))
    local = F.from_utc_timestamp(F.to_utc_timestamp(at, session_zone), DISPLAY_ZONE)
    offset = F.unix_seconds(local) - F.unix_seconds(F.to_utc_timestamp(at, session_zone))
    zone = F.when(offset == -18000, " CDT").otherwise(" CST") if include_zone else F.lit("")
    day = F.date_format(local, "MMMM d, yyyy")
    timed = F.concat(day, F.lit(" at "), F.date_format(local, "h:mm a"), zone)
    shown = F.when(has_time(value) & F.lit(include_time), timed).otherwise(day)
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", fallback).otherwise(F.coalesce(shown, F.lit(fallback)))


def search_text(value: Column) -> Column:
    return F.lower(display_timestamp(value, include_zone=False, fallback=""))


def central_timestamp(at: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss with the Chicago offset of an instant given as UTC wall time."""
    at = at.cast("timestamp")
    local = F.from_utc_timestamp(at, DISPLAY_ZONE)
    offset = F.when(F.unix_seconds(local) - F.unix_seconds(at) == -18000, "-05:00").otherwise("-06:00")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def day_of_week(iso: Column) -> Column:
    """0 (Sunday) to 6 of the date that a text begins with, whatever its offset."""
    return F.dayofweek(F.try_to_date(F.substring(iso, 1, 10))) - 1


def version_age(version: Column, today: Column) -> Column:
    """Whole days since the date of a yyyy.MM.dd version."""
    return F.datediff(today, F.try_to_date(version, "yyyy.MM.dd"))
