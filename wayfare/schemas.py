"""Record layouts. Names and order are part of the file formats; headerless files bind by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _strings(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names.split()]


EVENT = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("cgi", T.StringType()),
        T.StructField("lac", T.StringType()),
        T.StructField("cell_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("msisdn", T.StringType()),
        T.StructField("imei", T.StringType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("grid_id", T.IntegerType()),
    ]
)

UPDATE = T.StructType(
    [
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("cell_type", T.IntegerType()),
        T.StructField("cell", T.StringType()),
    ]
)

CELL = T.StructType(
    [
        T.StructField("cgi", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("is_kde", T.BooleanType()),
        T.StructField("is_indoor", T.BooleanType()),
        T.StructField("building", T.StringType()),
    ]
)

# The 28 columns of a cell inventory file, in file order.
_INVENTORY_COLUMNS = """
site_id site_name lac lga_name site_type cell_lon cell_lat technology band cell_sector cell_id cell_name
sac_id sa3_code rnc_bsc cell_first_seen antenna_azimuth beam_width_horizontal beam_width_vertical
antenna_electric_down_tilt antenna_mechanical_down_tilt antenna_height antenna_gain antenna_type cell_power
feeder_length feeder_size cell_status
"""
_INVENTORY_TYPES = {
    "cell_lon": T.DoubleType(),
    "cell_lat": T.DoubleType(),
    "antenna_azimuth": T.IntegerType(),
    "beam_width_horizontal": T.IntegerType(),
    "beam_width_vertical": T.IntegerType(),
}
CELL_INVENTORY = T.StructType(
    [T.StructField(f.name, _INVENTORY_TYPES.get(f.name, f.dataType)) for f in _strings(_INVENTORY_COLUMNS)]
)

LEG = T.StructType(
    [
        T.StructField("start_time", T.StringType()),
        T.StructField("start_lon", T.DoubleType()),
        T.StructField("start_lat", T.DoubleType()),
        T.StructField("end_lon", T.DoubleType()),
        T.StructField("end_lat", T.DoubleType()),
        T.StructField("end_time", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("route_taken", T.StringType()),
    ]
)

ROUTE = T.StructType(
    _strings("day_of_week query_time start_geo end_geo") + [T.StructField("route", T.ArrayType(LEG))]
)

ROUTE_CANDIDATES = T.StructType(
    _strings("day_of_week start_sa1 end_sa1")
    + [
        T.StructField("time_band_start", T.ArrayType(T.StringType())),
        T.StructField("time_band_end", T.ArrayType(T.StringType())),
        T.StructField(
            "candidate",
            T.ArrayType(
                T.StructType(
                    _strings("start_time end_time polygon")
                    + [T.StructField("legs", T.ArrayType(LEG)), T.StructField("distance", T.DoubleType())]
                )
            ),
        ),
    ]
)

WEIGHT = T.StructType(_strings("agent_id weight"))
ID_MAP = T.StructType(_strings("sub_mtz id"))
FEATURE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StringType()),
    ]
)


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Fail when a declared column is missing or has another type; extra columns are kept."""
    found = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in expected.fields if f.name not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    wrong = [
        f"{f.name} is {found[f.name].simpleString()}, expected {f.dataType.simpleString()}"
        for f in expected.fields
        if found[f.name] != f.dataType
    ]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df
