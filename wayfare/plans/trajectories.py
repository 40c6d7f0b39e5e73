"""Location events to ordered trajectories of agents: whole paths in long form or in rows of bounded length, or day by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.geo import CELL_TOWER
from wayfare.functions.time import format_plain
from wayfare.operators.filters import full_match
from wayfare.operators.lookup import locate_events
from wayfare.operators.ordered import with_place
from wayfare.sources.events import EventLayout, parse_cells, parse_events
from wayfare.sources.trajectories import UPDATE_FIELDS, format_trajectories


def event_updates(events: DataFrame) -> DataFrame:
    """Located events as updates in long form, the canonical form of trajectories."""
    return events.select(
        "agent_id",
        "lon",
        "lat",
        format_plain("event_time").alias("timestamp"),
        F.lit(CELL_TOWER).alias("cell_type"),
        F.col("cgi").alias("cell"),
    )


#: Order of an agent's updates: those of equal time follow their other fields.
ORDER = ("timestamp", "lon", "lat", "cell_type", "cell")
#: Updates in a row of a whole path.
ROW_UPDATES = 1_000


def whole_trajectories(updates: DataFrame) -> DataFrame:
    """Updates with ``position``, the place of each in its agent's whole path from 0.

    The canonical form of paths of any length: no agent is gathered anywhere, see ``wayfare.operators.ordered``.
    """
    return with_place(updates.select("agent_id", *UPDATE_FIELDS), ["agent_id"], ORDER)


def path_rows(updates: DataFrame, size: int = ROW_UPDATES) -> DataFrame:
    """Whole paths as nested rows: ``agent_id``, ``part`` (from 0) and the ``updates`` of that part, ``size`` at most.

    An agent's rows in order of ``part`` are its path from the first update to the last; all rows but the last one are full.
    """
    parts = whole_trajectories(updates).withColumn("part", F.floor(F.col("position") / size))
    gathered = parts.groupBy("agent_id", "part").agg(F.array_sort(F.collect_list(F.struct("position", *UPDATE_FIELDS))).alias("_u"))
    bare = F.transform("_u", lambda u: F.struct(*[u[f].alias(f) for f in UPDATE_FIELDS]))
    return gathered.select("agent_id", "part", bare.alias("updates"))


def build_trajectories(updates: DataFrame) -> DataFrame:
    """``agent_id``, ``day`` and the ordered ``updates`` of that day.

    A day (the date in the update's own text) is the unit of a row at every size. Updates of equal time follow their
    other fields, and days follow one another, so an agent's rows by day are its whole path.
    """
    daily = updates.select("agent_id", F.substring("timestamp", 1, 10).alias("day"), *ORDER)
    gathered = daily.groupBy("agent_id", "day").agg(F.array_sort(F.collect_list(F.struct(*ORDER))).alias("_u"))
    arranged = F.transform("_u", lambda u: F.struct(*[u[f].alias(f) for f in UPDATE_FIELDS]))
    return gathered.select("agent_id", "day", arranged.alias("updates"))


def located_updates(
    event_lines: DataFrame, cells: DataFrame, layout: EventLayout = EventLayout(), id_regex: str = ".*"
) -> DataFrame:
    """Event lines to updates: parse, place by cell, keep agents whose whole id matches."""
    wanted = parse_events(event_lines, layout).where(full_match("agent_id", id_regex))
    return event_updates(locate_events(wanted, cells))


def trajectory_lines(
    event_lines: DataFrame, cell_lines: DataFrame, layout: EventLayout = EventLayout(), id_regex: str = ".*"
) -> DataFrame:
    """The whole job: event and cell lines in, trajectory text of each agent and day out (column ``value``)."""
    updates = located_updates(event_lines, parse_cells(cell_lines), layout, id_regex)
    return build_trajectories(updates).select("agent_id", "day", format_trajectories().alias("value"))


def path_lines(
    event_lines: DataFrame, cell_lines: DataFrame, layout: EventLayout = EventLayout(), id_regex: str = ".*", size: int = ROW_UPDATES
) -> DataFrame:
    """The whole job for paths of any length: a line of text for each agent and part of its path."""
    updates = located_updates(event_lines, parse_cells(cell_lines), layout, id_regex)
    return path_rows(updates, size).select("agent_id", "part", format_trajectories().alias("value"))
