"""The library's functions by name in SQL.

``register`` makes temporary functions of a session. Those written here are SQL functions, which the optimizer replaces by their bodies:
they run and are pushed down like any built-in expression, without Python. Relations and distances of geometries (``geo_*``) are backed
by Python, in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from wayfare.functions import polygon
from wayfare.functions.geo import EARTH_RADIUS_M
from wayfare.functions.geometry import _let, area_sql, polygons_sql, wkt_sql
from wayfare.sources.esri import rings_sql

_BLOCK = 1_024


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    )
    return _let(a, "a", f"{2 * EARTH_RADIUS_M}D * atan2(sqrt(a), sqrt(abs(1 - a)))")


def _grid(unit: str, part: int) -> str:
    return f"try_cast(get(split({unit}, '_'), {part}) as double)"


def _grid_distance(a: str, b: str) -> str:
    """Metres between two area ids; each id is split once."""
    ends = f"named_struct('y1', {_grid(a, 4)}, 'x1', {_grid(a, 3)}, 'y2', {_grid(b, 4)}, 'x2', {_grid(b, 3)})"
    return _let(ends, "e", _haversine("e.y1", "e.x1", "e.y2", "e.x2"))


_SIZES = f"named_struct('n', {area_sql(polygons_sql('new_wkt'))}, 'o', {area_sql(polygons_sql('old_wkt'))})"

#: Name, arguments and body of each scalar function, with its result type.
SCALARS: dict[str, tuple[str, str, str]] = {
    "overlap_seconds": (
        "in1 timestamp, out1 timestamp, in2 timestamp, out2 timestamp", "bigint",
        "case when in1 < out2 and in2 < out1 then unix_timestamp(least(out1, out2)) - unix_timestamp(greatest(in1, in2)) else 0 end",
    ),
    "haversine_m": ("lat1 double, lon1 double, lat2 double, lon2 double", "double", _haversine("lat1", "lon1", "lat2", "lon2")),
    "home_work_m": ("home string, work string", "double", _grid_distance("home", "work")),
    "radius_m": ("geo_units array<string>, home string", "double", f"array_max(transform(geo_units, u -> {_grid_distance('u', 'home')}))"),
    "size_diff": ("new_wkt string, old_wkt string", "double", _let(_SIZES, "z", "try_divide(abs(z.n - z.o), z.o)")),
    "esri_wkt": ("esri string", "string", f"coalesce({rings_sql('esri', quoted=True)}, 'POLYGON EMPTY')"),
    "wkt_area": ("wkt string", "double", area_sql(polygons_sql("wkt"))),
    "tidy_wkt": ("wkt string", "string", wkt_sql(polygons_sql("wkt"))),
}

_WHOLE = "try_cast(try_cast(weight as double) as int)"
#: Copies of a weight, numbered from 1, made block by block; none for weights below one or no numbers.
_COPIES = f"""
select b * {_BLOCK} + i + 1 as copy from
  (select b, explode(sequence(0, cast(least({_BLOCK}, n - b * {_BLOCK}) as int) - 1)) as i from
    (select n, explode(sequence(0, cast(floor((n - 1) / {_BLOCK}) as int))) as b from (select {_WHOLE} as n) where n > 0))"""
TABLES: dict[str, tuple[str, str, str]] = {"weight_copies": ("weight string", "copy bigint", _COPIES)}


def register(spark: SparkSession) -> None:
    """Define the functions in a session: ``SCALARS``, the table function ``weight_copies`` and the ``geo_*`` functions."""
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {result} return {body}")
    for name, (arguments, columns, body) in TABLES.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns table({columns}) return {body}")
    polygon.register(spark)
