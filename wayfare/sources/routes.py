"""Multi-leg route lines: day, query time, start code, end code and legs, tab-separated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _leg_sql(text: str) -> str:
    """Leg of a text held in a lambda variable, null when it is too short or a coordinate is no number."""

    def number(i: int) -> str:
        return f"try_cast(trim(f[{i}]) as double)"

    fields = {
        "start_time": "f[0]",
        "start_lon": number(1),
        "start_lat": number(2),
        "end_lon": number(4),
        "end_lat": number(5),
        "end_time": "f[3]",
        "mode": "f[6]",
        "route_taken": "f[7]",
    }
    leg = "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"
    read = f"get(transform(filter(array(split({text}, ',', -1)), f -> size(f) >= 8), f -> {leg}), 0)"
    known = "v.start_lon is not null and v.start_lat is not null and v.end_lon is not null and v.end_lat is not null"
    return f"get(filter(array({read}), v -> {known}), 0)"


def parse_routes(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines (column ``value``) to routes. One bad leg drops the whole route; quotes around codes are removed.

    A line becomes an array of one route or none, so that every text is taken apart once.
    """
    route = (
        "named_struct('day_of_week', p[0], 'query_time', p[1], 'start_geo', replace(p[2], '\"', ''), "
        f"'end_geo', replace(p[3], '\"', ''), 'route', transform(split(p[4], ';', -1), x -> {_leg_sql('x')}))"
    )
    wide = "filter(array(split(value, '\t', -1)), p -> size(p) >= 5)"
    rows = f"filter(transform({wide}, p -> {route}), o -> forall(o.route, leg -> leg is not null))"
    return lines.select(*keep, F.inline(F.expr(rows)))


def format_routes(route: str = "route") -> Column:
    """Text of a route; within a leg the end time comes before the end coordinates."""

    def text(leg: Column) -> Column:
        names = ("start_time", "start_lon", "start_lat", "end_time", "end_lon", "end_lat", "mode", "route_taken")
        return F.concat_ws(",", *[leg[n].cast("string") for n in names])

    return F.concat_ws(
        "\t", "day_of_week", "query_time", "start_geo", "end_geo", F.array_join(F.transform(route, text), ";")
    )
