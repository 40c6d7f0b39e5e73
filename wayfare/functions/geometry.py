"""Polygon text as columns: WKT in and out, bounding boxes, areas, oriented edges.

A polygon value is ``array<polygon>``, each polygon an array of rings (shell first), each ring an array of
``struct<x, y>``. Everything here stays on the JVM side. Arguments are column names or SQL texts; nested array
functions read better, and are built much faster, as SQL lambdas than as nested Column calls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGONS = "array<array<array<struct<x:double,y:double>>>>"


def _let(value: str, name: str, body: str) -> str:
    """The body with ``name`` standing for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def geometry_type(wkt: str) -> Column:
    """Upper-case type name of a WKT text, null when there is none."""
    return F.expr(f"nullif(upper(regexp_extract({wkt}, r'^\\s*([A-Za-z]+)', 1)), '')")


def polygons_sql(wkt: str) -> str:
    body = f"regexp_extract({wkt}, r'(?is)^\\s*(?:MULTI)?POLYGON\\s*\\(\\s*\\((.*)\\)\\s*\\)\\s*$', 1)"
    # One separator per level of nesting, so that every split is by a single character.
    tidy = f"regexp_replace(regexp_replace({body}, r'\\s*([(),])\\s*', '$1'), r'\\s+', ' ')"
    marked = f"translate(replace(replace({tidy}, ')),((', ';'), '),(', '/'), '()', '')"
    point = "named_struct('x', try_cast(substring_index(p, ' ', 1) as double), 'y', try_cast(get(split(p, ' '), 1) as double))"
    shapes = f"transform(split({marked}, ';'), s -> transform(split(s, '/'), r -> transform(split(r, ','), p -> {point})))"
    broken = "exists(v, s -> exists(s, r -> exists(r, p -> p.x is null or p.y is null)))"
    empty = f"{wkt} rlike r'(?i)^\\s*(?:MULTI)?POLYGON\\s+EMPTY\\s*$'"
    return f"case when {empty} then cast(array() as {POLYGONS}) else {_let(shapes, 'v', f'if({broken}, null, v)')} end"


def wkt_polygons(wkt: str) -> Column:
    """Rings of POLYGON and MULTIPOLYGON text; null for other types and malformed coordinates."""
    return F.expr(polygons_sql(wkt))


def _positions(ring: str) -> str:
    """Index of the first point of each edge."""
    return f"if(size({ring}) >= 2, sequence(0, size({ring}) - 2), cast(array() as array<int>))"


def ring_area_sql(ring: str) -> str:
    """Signed area of a ring held in a lambda variable, positive when the ring runs counter-clockwise.

    Taken relative to the first point, which keeps the terms small.
    """
    r = ring
    cross = f"({r}[i].x - {r}[0].x) * ({r}[i + 1].y - {r}[0].y) - ({r}[i + 1].x - {r}[0].x) * ({r}[i].y - {r}[0].y)"
    return f"(aggregate({_positions(r)}, 0D, (t, i) -> t + {cross}) / 2)"


def area_sql(polygons: str) -> str:
    parts = f"flatten(transform({polygons}, s -> transform(s, (r, k) -> abs({ring_area_sql('r')}) * if(k = 0, 1, -1))))"
    return f"aggregate({parts}, 0D, (t, a) -> t + a)"


def area(polygons: str) -> Column:
    """Planar area, holes subtracted whatever their direction."""
    return F.expr(area_sql(polygons))


def wkt_area(wkt: str) -> Column:
    """Area of a WKT text; points and lines have none."""
    flat = f"{wkt} rlike r'(?i)^\\s*(?:MULTI)?(?:POINT|LINESTRING)\\b'"
    return F.expr(f"case when {flat} then 0D else {area_sql(polygons_sql(wkt))} end")


def bbox(polygons: str) -> Column:
    """``struct<x0, y0, x1, y1>`` over the shells."""
    corner = "array_{0}(transform(v, p -> p.{1}))"
    fields = ", ".join(
        f"'{name}', {corner.format(which, axis)}"
        for name, which, axis in (("x0", "min", "x"), ("y0", "min", "y"), ("x1", "max", "x"), ("y1", "max", "y"))
    )
    return F.expr(_let(f"flatten(transform({polygons}, s -> s[0]))", "v", f"named_struct({fields})"))


def oriented_edges(polygons: str) -> Column:
    """Edges as one flat ``array<double>`` of x, y, x', y' with shells counter-clockwise and holes clockwise.

    Edges that run straight up or down are left out: the area integral over x has no use for them.
    """
    edge = "if(w[i].x <> w[i + 1].x, array(w[i].x, w[i].y, w[i + 1].x, w[i + 1].y), cast(array() as array<double>))"
    edges = f"flatten(transform({_positions('w')}, i -> {edge}))"
    way = f"if(({ring_area_sql('r')} < 0) = (k = 0), reverse(r), r)"
    return F.expr(f"flatten(transform({polygons}, s -> flatten(transform(s, (r, k) -> {_let(way, 'w', edges)}))))")


def all_edges(polygons: str) -> Column:
    """Every edge of every ring as one flat ``array<double>`` of x, y, x', y'."""
    edges = f"flatten(transform({_positions('r')}, i -> array(r[i].x, r[i].y, r[i + 1].x, r[i + 1].y)))"
    return F.expr(f"flatten(transform({polygons}, s -> flatten(transform(s, r -> {edges}))))")


def size_diff(new_wkt: str, old_wkt: str) -> Column:
    """Relative change of area; null when the old area is zero."""
    sizes = f"named_struct('n', {area_sql(polygons_sql(new_wkt))}, 'o', {area_sql(polygons_sql(old_wkt))})"
    return F.expr(_let(sizes, "z", "try_divide(abs(z.n - z.o), z.o)"))


def _number_text(x: str) -> str:
    """Shortest text of a coordinate: whole numbers without a fraction."""
    return f"if({x} = floor({x}) and abs({x}) < 1e15, cast(floor({x}) as string), cast({x} as string))"


def wkt_sql(polygons: str, always_multi: bool = False) -> str:
    """WKT text; one polygon prints as POLYGON unless ``always_multi``."""
    points = f"transform(r, p -> concat({_number_text('p.x')}, ' ', {_number_text('p.y')}))"
    bodies = f"transform({polygons}, s -> concat('(', array_join(transform(s, r -> concat('(', array_join({points}, ', '), ')')), ', '), ')'))"
    multi = "concat('MULTIPOLYGON (', array_join(b, ', '), ')')"
    one = multi if always_multi else "concat('POLYGON ', b[0])"
    empty = "MULTIPOLYGON EMPTY" if always_multi else "POLYGON EMPTY"
    return _let(bodies, "b", f"case when size(b) = 0 then '{empty}' when size(b) = 1 then {one} when size(b) > 1 then {multi} end")


def polygons_to_wkt(polygons: str, always_multi: bool = False) -> Column:
    return F.expr(wkt_sql(polygons, always_multi))
