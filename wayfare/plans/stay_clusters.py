"""Trajectory text to stay clusters per time slot."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wayfare.functions.time import format_offset_ts
from wayfare.operators.stays import SLOT_SECONDS, clusters, with_slot
from wayfare.sources.trajectories import parse_trajectories, to_long


def stay_clusters(
    updates: DataFrame, distance: int, seconds: int = SLOT_SECONDS, tz: str = "UTC", centroid: str = "mean"
) -> DataFrame:
    """Centre, radius and status of each agent's updates in each slot."""
    slotted = with_slot(updates.select("agent_id", "lon", "lat", "timestamp"), seconds, tz)
    found = clusters(slotted, ["agent_id", "slot"], distance, centroid)
    return found.withColumn("slot_key", format_offset_ts("slot", tz))


def stay_clusters_from_lines(lines: DataFrame, distance: int, **options) -> DataFrame:
    return stay_clusters(to_long(parse_trajectories(lines)), distance, **options)
