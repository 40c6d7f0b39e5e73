"""Extracts: rail links of a state, trips of one category, polygons as WKT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.filters import has_rings
from wayfare.sources.esri import esri_to_wkt


def rail_links(links: DataFrame, state: str = "") -> DataFrame:
    """Train and rail links whose id contains the state's text."""
    rail = F.col("mode").isin("TRAIN", "RAIL")
    return links.where(rail & F.col("link_id").contains(state)).select("agent_id", "mode", "link_id")


def trips_of_category(trips: DataFrame, category: str = "sa2_sa2") -> DataFrame:
    return trips.where(F.col("category") == category)


def esri_lines_to_wkt(lines: DataFrame) -> DataFrame:
    """``id|quoted Esri JSON`` lines to ``id|WKT`` lines; unreadable polygons leave the WKT empty."""
    parts = F.split("value", "\\|", -1)
    kept = has_rings(lines).select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("polygon"))
    wkt = esri_to_wkt("polygon", on_error="", quoted=True)
    return kept.select(F.concat("id", F.lit("|"), wkt).alias("value"))
