"""Esri polygon JSON to WKT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfare.functions.geometry import POLYGONS, ring_area_sql, wkt_sql


def _polygons_of_rings(rings: str) -> str:
    """Group rings into polygons: clockwise rings are shells, the others holes of the shell before them.

    Open rings are closed.
    """
    points = "transform(g, p -> named_struct('x', p[0], 'y', p[1]))"
    closed = f"if(g[0] = element_at(g, -1), {points}, array_append({points}, named_struct('x', g[0][0], 'y', g[0][1])))"
    usable = f"transform(filter({rings}, g -> size(g) > 0), g -> {closed})"
    is_hole = f"{ring_area_sql('r')} > 0 and size(acc) > 0"
    grown = "array_append(slice(acc, 1, size(acc) - 1), array_append(element_at(acc, -1), r))"
    return f"aggregate({usable}, cast(array() as {POLYGONS}), (acc, r) -> if({is_hole}, {grown}, array_append(acc, array(r))))"


def rings_sql(text: str, quoted: bool = False, always_multi: bool = False) -> str:
    """WKT of the rings in an Esri text, null where none can be read."""
    plain = f"replace({text}, r'\\', '')"
    if quoted:
        plain = f"substring({plain}, 2, greatest(length({plain}) - 2, 0))"
    rings = f"from_json({plain}, 'struct<rings:array<array<array<double>>>>').rings"
    broken = "exists(flatten(v), p -> size(p) < 2 or get(p, 0) is null or get(p, 1) is null)"
    return f"get(transform(array({rings}), v -> if({broken}, null, {wkt_sql(_polygons_of_rings('v'), always_multi)})), 0)"


def esri_to_wkt(text: str, on_error: str = "POLYGON EMPTY", quoted: bool = False, always_multi: bool = False) -> Column:
    """WKT of an Esri polygon held in a column.

    Backslashes are removed; ``quoted`` also removes the first and the last character. Text without readable
    rings gives ``on_error``.
    """
    return F.coalesce(F.expr(rings_sql(text, quoted, always_multi)), F.lit(on_error))
