"""Cell-site counts and the areas that cells cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.geo import full_cell_id
from wayfare.functions.geometry import bbox, polygons_sql
from wayfare.operators.spatial import coverage_lists, coverage_ratio, spatial_join


def active_cells(inventory: DataFrame, active: str = "ACTIVE") -> DataFrame:
    """Full id, site type and status of the active cells that have a location area code."""
    ids = full_cell_id("technology", "lac", "sac_id", "cell_id")
    return (
        inventory.where(F.col("cell_status") == active)
        .select(ids.alias("full_id"), "site_type", "cell_status")
        .where(F.col("full_id").isNotNull())
    )


def cell_inventory(inventory: DataFrame, date: str, in_building: str = "In Building") -> DataFrame:
    """One row: date, distinct active cells, distinct active cells inside buildings."""
    return (
        active_cells(inventory)
        .distinct()
        .agg(
            F.count(F.lit(1)).alias("cell_count"),
            F.count_if(F.coalesce(F.col("site_type") == in_building, F.lit(False))).alias("in_building_count"),
        )
        .select(F.lit(date).alias("date"), "cell_count", "in_building_count")
    )


def cell_coverage_pairs(cells: DataFrame, areas: DataFrame, predicate: str = "covers", tile: float = 1.0) -> DataFrame:
    """One row per cell and covered area with the share of the cell it takes.

    ``tile_x`` and ``tile_y`` number the square of side ``tile`` that the area's lower left corner lies in.
    Both tables come from ``readers.wkt_table``: ``wkt`` and ``user_data``.
    """
    a = cells.select(F.col("user_data").alias("cell"), F.col("wkt").alias("cell_wkt"))
    corner = bbox(polygons_sql("wkt"))
    b = areas.select(F.col("user_data").alias("geo_unit"), F.col("wkt").alias("area_wkt"), corner.alias("_corner"))
    pairs = spatial_join(a, b, "cell_wkt", "area_wkt", predicate)
    tiles = [F.floor(F.col("_corner")[c] / F.lit(float(tile))).cast("long").alias(f"tile_{c[0]}") for c in ("x0", "y0")]
    return pairs.select("cell", "geo_unit", *tiles, coverage_ratio().alias("percentage"))


def cell_coverage(
    cells: DataFrame, areas: DataFrame, predicate: str = "covers", tile: float = 1.0, digits: int | None = None
) -> DataFrame:
    """Text lines ``cell|[{geoUnit, percentage}, ...]``, one for each cell and tile of areas; cells without a match do not appear.

    Shares are rounded to ``digits`` places if given.
    """
    pairs = cell_coverage_pairs(cells, areas, predicate, tile)
    if digits is not None:
        pairs = pairs.withColumn("percentage", F.round("percentage", digits))
    lists = coverage_lists(pairs, "cell", "geo_unit", "percentage", ("tile_x", "tile_y"))
    return lists.select("cell", "tile_x", "tile_y", F.concat_ws("|", "cell", "coverage").alias("value"))
