"""Distances, area ids that embed coordinates, cell identifiers and sensor codes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6378126.0
NETWORK_PREFIX = "505-02"
SENSOR_TYPES = {0: "Unknown", 1: "CellTower", 2: "Wifi", 3: "GPS", 10: "Interpolated"}
CELL_TOWER = 1


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # For opposite points rounding may lift the term just above one.
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.abs(1 - a)))


def grid_to_coord(grid: Column | str, target: str = "lat") -> Column:
    """Coordinate embedded in an area id: part 3 is lon, part 4 is lat.

    ``all`` gives both parts as text in a struct.
    """
    parts = F.split(_col(grid), "_")
    lon, lat = F.get(parts, F.lit(3)), F.get(parts, F.lit(4))
    if target == "lat":
        return lat.try_cast("double")
    if target == "lon":
        return lon.try_cast("double")
    if target == "all":
        return F.struct(lat.alias("lat"), lon.alias("lon"))
    raise ValueError(f"unknown target: {target}")


def grid_distance(a: Column | str, b: Column | str) -> Column:
    """Metres between two area ids; null when either has no coordinates."""
    return haversine(grid_to_coord(a), grid_to_coord(a, "lon"), grid_to_coord(b), grid_to_coord(b, "lon"))


def home_work_distance(home: Column | str, work: Column | str) -> Column:
    """Metres between home and work. Meant for filters, where Spark would compute repeated terms again and again:
    the four coordinates are taken once and handed on.
    """
    ends = F.struct(
        grid_to_coord(home).alias("lat1"),
        grid_to_coord(home, "lon").alias("lon1"),
        grid_to_coord(work).alias("lat2"),
        grid_to_coord(work, "lon").alias("lon2"),
    )
    metres = F.transform(F.array(ends), lambda c: haversine(c["lat1"], c["lon1"], c["lat2"], c["lon2"]))
    return F.get(metres, F.lit(0))


def movement_index(max_distance: Column | str, home_work: Column | str) -> Column:
    return F.try_divide(_col(max_distance), _col(home_work))


def full_cell_id(
    technology: Column | str,
    lac: Column | str,
    sac_id: Column | str,
    cell_id: Column | str,
    prefix: str = NETWORK_PREFIX,
) -> Column:
    """Network-wide cell id; empty for other technologies, null without a location area code.

    A missing last part prints as ``null``.
    """
    tech, area = _col(technology), _col(lac)

    def text(last: Column | str) -> Column:
        return F.concat(F.lit(f"{prefix}-"), area, F.lit("-"), F.coalesce(_col(last), F.lit("null")))

    built = F.when(tech == "UMTS", text(sac_id)).when(tech == "LTE", text(cell_id)).otherwise(F.lit(""))
    return F.when(area.isNotNull(), built)


def split_cgi(cgi: Column | str) -> Column:
    """Location area code and cell id of a global cell identity, both empty below four parts."""
    parts = F.split(_col(cgi), "-", -1)
    wide = F.size(parts) >= 4
    return F.struct(
        F.when(wide, F.get(parts, F.lit(2))).otherwise("").alias("lac"),
        F.when(wide, F.get(parts, F.lit(3))).otherwise("").alias("cell_id"),
    )


def cell_key(lac: Column | str, cell_id: Column | str) -> Column:
    return F.concat_ws("-", _col(lac), _col(cell_id))


def full_cell_key(cgi: Column | str) -> Column:
    return _col(cgi)


def with_coords(df: DataFrame, lat: Column, lon: Column) -> DataFrame:
    """Replace an event's coordinates and the text made from them."""
    text = F.concat_ws(",", lat.cast("string"), lon.cast("string"))
    return df.withColumns({"lat": lat, "lon": lon, "location": text})


def _sensor_map() -> Column:
    return F.create_map(*[F.lit(v) for pair in SENSOR_TYPES.items() for v in pair])


def sensor_name(code: Column | str) -> Column:
    """Name of a sensor code; an unknown code fails the query."""
    c = _col(code).cast("int")
    name = F.try_element_at(_sensor_map(), c)
    unknown = F.raise_error(F.concat(F.lit("unknown sensor code: "), c.cast("string")))
    return F.when(c.isNull() | name.isNotNull(), name).otherwise(unknown.cast("string"))


def sensor_code(text: Column | str) -> Column:
    """Code for a sensor name or for a code written as text; null when unknown."""
    value = _col(text)
    by_name = F.create_map(*[F.lit(v) for code, name in SENSOR_TYPES.items() for v in (name, code)])
    number = value.try_cast("int")
    known = F.when(number.isin(*SENSOR_TYPES), number)
    return F.coalesce(known, F.try_element_at(by_name, value))
