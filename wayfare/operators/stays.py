"""Time slots of trajectories, and the centre, radius and status of the updates in a slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.geo import haversine
from wayfare.functions.time import floor_time, format_offset_ts, parse_any
from wayfare.operators.joins import join_null_safe
from wayfare.operators.percentile import weighted_summary
from wayfare.session import materialize

SLOT_SECONDS = 300


def with_slot(updates: DataFrame, seconds: int = SLOT_SECONDS, tz: str = "UTC", time: str = "timestamp") -> DataFrame:
    """Add ``at`` (instant of the update) and ``slot`` (start of its time slot); unreadable times go."""
    readable = F.filter(F.array(parse_any(time, tz)), lambda at: at.isNotNull())
    return updates.withColumn("at", F.explode(readable)).withColumn("slot", floor_time("at", seconds, tz))


def slot_groups(
    updates: DataFrame,
    seconds: int = SLOT_SECONDS,
    tz: str = "UTC",
    fields: Sequence[str] = ("lon", "lat", "timestamp", "cell_type", "cell"),
) -> DataFrame:
    """Updates of each agent by slot, in order of time; ``slot_key`` is the slot's start with its offset."""
    slotted = with_slot(updates.select("agent_id", *fields), seconds, tz)
    gathered = slotted.groupBy("agent_id", "slot").agg(F.array_sort(F.collect_list(F.struct("at", *fields))).alias("_u"))
    bare = F.transform("_u", lambda u: F.struct(*[u[f].alias(f) for f in fields]))
    return gathered.select("agent_id", "slot", format_offset_ts("slot", tz).alias("slot_key"), bare.alias("updates"))


def sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Point on the unit sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def from_sphere(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    return F.degrees(F.atan2(z, F.hypot(x, y))), F.degrees(F.atan2(y, x))


def stay_status(radius: Column | str, distance: int) -> Column:
    """stay up to half the distance (whole metres), move from the distance on, transit between."""
    r = F.col(radius) if isinstance(radius, str) else radius
    return F.when(r <= distance // 2, "stay").when(r < distance, "transit").otherwise("move")


def clusters(
    updates: DataFrame, keys: Sequence[str], distance: int, centroid: str = "mean", time: str = "at"
) -> DataFrame:
    """One row per group: bounds, size, centre, radius and status.

    Updates without both coordinates are left out. Updates at one place are summed up before anything is grouped. The mean
    comes from sums of each group, and the radius from the largest distance to the centre that is joined back, so
    nothing holds or orders a whole group. The median centre takes the middle value of each axis on its own; as it reads the
    places several times, they are stored in the shared folder.
    """
    if centroid not in ("mean", "median"):
        raise ValueError("centroid must be mean or median")
    keys = list(keys)
    located = updates.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    places = located.groupBy(*keys, "lat", "lon").agg(
        F.count(F.lit(1)).alias("_n"), F.min(time).alias("_first"), F.max(time).alias("_last")
    )
    axes = dict(zip(("_x", "_y", "_z"), sphere(F.col("lat"), F.col("lon"))))
    sums = [F.sum("_n").alias("n"), F.min("_first").alias("first_at"), F.max("_last").alias("last_at")]
    if centroid == "mean":
        groups = places.groupBy(*keys).agg(*sums, *[(F.sum(c * F.col("_n")) / F.sum("_n")).alias(a) for a, c in axes.items()])
    else:
        places = materialize(places, "places")
        groups = places.groupBy(*keys).agg(*sums)
        each = F.explode(F.array(*[F.struct(F.lit(axis).alias("_axis"), place.alias("_at")) for axis, place in axes.items()]))
        middle = weighted_summary(places.select(*keys, "_n", each.alias("_p")).select(*keys, "_n", "_p.*"), [*keys, "_axis"], "_at", "_n")
        centre = [F.max(F.when(F.col("_axis") == axis, F.col("percentile"))).alias(axis) for axis in axes]
        groups = join_null_safe(groups, middle.groupBy(*keys).agg(*centre), keys)
    lat, lon = from_sphere(F.col("_x"), F.col("_y"), F.col("_z"))
    bounds = ["n", "first_at", "last_at"]
    centres = groups.select(*keys, *bounds, lat.alias("centre_lat"), lon.alias("centre_lon"))
    away = haversine(F.col("lat"), F.col("lon"), F.col("centre_lat"), F.col("centre_lon"))
    same = [F.first(c).alias(c) for c in (*bounds, "centre_lat", "centre_lon")]  # one value in all rows of a group
    measured = join_null_safe(places, centres, keys).groupBy(*keys).agg(*same, F.max(away).alias("radius"))
    return measured.withColumn(
        "duration_s", F.unix_timestamp("last_at") - F.unix_timestamp("first_at")
    ).withColumn("status", stay_status("radius", distance))
