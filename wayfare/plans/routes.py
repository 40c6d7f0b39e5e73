"""Route identifier repair and public transport routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.sources.routes import format_routes, parse_routes

# Fixed values.
PUBLIC_MODES = ("TRAIN", "FERRY", "TRAM", "SUBWAY")


def repair_route_ids(routes: DataFrame, id_map: DataFrame) -> DataFrame:
    """Replace start and end codes by ids; a route with a code the map lacks goes."""
    start = id_map.select(F.col("sub_mtz").alias("start_geo"), F.col("id").alias("_start"))
    end = id_map.select(F.col("sub_mtz").alias("end_geo"), F.col("id").alias("_end"))
    mapped = routes.join(start, "start_geo").join(end, "end_geo")
    return mapped.withColumns({"start_geo": F.col("_start"), "end_geo": F.col("_end")}).select(*routes.columns)


def repaired_route_lines(lines: DataFrame, id_map: DataFrame) -> DataFrame:
    return repair_route_ids(parse_routes(lines), id_map).select(format_routes().alias("value"))


def is_public_transport(legs: str | Column) -> Column:
    """Every leg's mode is public transport; a route without legs is not."""
    column = F.col(legs) if isinstance(legs, str) else legs
    return (F.size(column) > 0) & F.forall(column, lambda leg: leg["mode"].isin(*PUBLIC_MODES))


def public_link_id(legs: str | Column) -> Column:
    """Routes taken on the public transport legs, joined by ``;``."""
    column = F.col(legs) if isinstance(legs, str) else legs
    public = F.filter(column, lambda leg: leg["mode"].isin(*PUBLIC_MODES))
    return F.array_join(F.transform(public, lambda leg: leg["route_taken"]), ";")


def routes_in_state(routes: DataFrame, hierarchy: DataFrame, state: str = "1", column: str = "start_sa1") -> DataFrame:
    """Routes that start in an area of the state.

    Nested routes pack so well that Spark takes their files for a table small enough to send to every task, through the driver. The join
    is therefore told to build on the areas, of which each task holds its share.
    """
    areas = hierarchy.where(F.col("state") == state).select(F.col("sa1").alias(column), "state").distinct()
    return routes.join(areas.hint("shuffle_hash"), column)


def candidate_legs(candidate: str | Column = "candidate") -> Column:
    """Legs of all candidates of a nested route row."""
    column = F.col(candidate) if isinstance(candidate, str) else candidate
    return F.flatten(F.transform(column, lambda c: c["legs"]))


def public_transport_routes(
    routes: DataFrame, hierarchy: DataFrame, state: str = "1", legs: str | Column = "route"
) -> DataFrame:
    """``public_link_id`` of the routes that start in the state and use public transport throughout."""
    wanted = routes.where(is_public_transport(legs)).select("start_sa1", public_link_id(legs).alias("public_link_id"))
    return routes_in_state(wanted, hierarchy, state).select("public_link_id")
