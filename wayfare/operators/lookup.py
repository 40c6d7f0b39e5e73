"""Coordinates of events from the table of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.geo import with_coords


def one_row_per_cell(cells: DataFrame) -> DataFrame:
    """One position per cell; of several the largest (lat, lon), so that runs agree."""
    best = F.max(F.struct("lat", "lon"))
    return cells.groupBy("cgi").agg(best.alias("_c")).select("cgi", F.col("_c.lat").alias("cell_lat"), F.col("_c.lon").alias("cell_lon"))


def locate_events(events: DataFrame, cells: DataFrame) -> DataFrame:
    """Events with their cell's coordinates; an event of an unknown cell keeps its own if it has both, else it goes.

    No side is forced to be broadcast: Spark does so when the cell table's size allows, and otherwise splits cells
    with very many events when it joins by shuffle.
    """
    joined = events.join(one_row_per_cell(cells), "cgi", "left")
    found = F.col("cell_lat").isNotNull() & F.col("cell_lon").isNotNull()
    placed = joined.where(found | (F.col("lat").isNotNull() & F.col("lon").isNotNull()))
    located = with_coords(
        placed,
        F.when(found, F.col("cell_lat")).otherwise(F.col("lat")),
        F.when(found, F.col("cell_lon")).otherwise(F.col("lon")),
    )
    return located.select(*events.columns)
