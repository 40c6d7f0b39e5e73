"""Row filters of the jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.time import parse_any


def known_home_and_work(df: DataFrame, home: str = "home", work: str = "work", unknown: str = "NA") -> DataFrame:
    """Rows with both places known; nulls go as well."""
    return df.where((F.col(home) != unknown) & (F.col(work) != unknown))


def full_match(column: Column | str, pattern: str) -> Column:
    """The whole text matches the pattern, a final line break included."""
    c = F.col(column) if isinstance(column, str) else column
    return c.rlike(rf"\A(?:{pattern})\z")


def _instant(text: Column | str, tz: str) -> Column:
    return parse_any(F.lit(text) if isinstance(text, str) else text, tz)


def updates_between(df: DataFrame, start: str, end: str | None = None, column: str = "timestamp", tz: str = "UTC") -> DataFrame:
    """Long-form updates from start to end, both included, compared as instants; ``tz`` is the zone of times without one.

    Updates whose time cannot be read go.
    """
    at = _instant(F.col(column), tz)
    kept = at >= _instant(start, tz)
    return df.where(kept if end is None else kept & (at <= _instant(end, tz)))


def filter_updates(df: DataFrame, start: str, end: str | None = None, column: str = "updates", tz: str = "UTC") -> DataFrame:
    """Nested updates from start to end, as ``updates_between``; a trajectory stays even when none is left."""

    def wanted(u: Column) -> Column:
        at = _instant(u["timestamp"], tz)
        after = at >= _instant(start, tz)
        return after if end is None else after & (at <= _instant(end, tz))

    return df.withColumn(column, F.filter(column, wanted))


def has_rings(lines: DataFrame, column: str = "value") -> DataFrame:
    """Pipe-separated lines whose second field holds polygon rings."""
    return lines.where(F.get(F.split(column, "\\|", -1), F.lit(1)).contains("rings"))
