"""Trajectory text: ``agent;lon,lat,time,type,cell;...``"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.geo import SENSOR_TYPES, sensor_name

UPDATE_FIELDS = ("lon", "lat", "timestamp", "cell_type", "cell")


def _update_sql(text: str) -> str:
    """Update of a text held in a lambda variable; a malformed one fails the query."""
    codes = ", ".join(f"'{name}', {code}, '{code}', {code}" for code, name in SENSOR_TYPES.items())
    update = (
        "named_struct('lon', try_cast(get(f, 0) as double), 'lat', try_cast(get(f, 1) as double), 'timestamp', get(f, 2), "
        f"'cell_type', try_element_at(map({codes}), get(f, 3)), 'cell', get(f, 4))"
    )
    whole = "v.lon is not null and v.lat is not null and v.cell_type is not null and v.cell is not null"
    read = f"get(transform(array(split({text}, ',', -1)), f -> {update}), 0)"
    return f"get(transform(array({read}), v -> if({whole}, v, raise_error(concat('malformed update: ', {text})))), 0)"


def parse_trajectories(lines: DataFrame) -> DataFrame:
    """Lines (column ``value``) to ``agent_id`` and ``updates``; a malformed update fails the query."""
    trimmed = F.regexp_replace("value", ";+$", "")
    rest = f"transform(slice(_parts, 2, size(_parts)), u -> {_update_sql('u')})"
    return lines.withColumn("_parts", F.split(trimmed, ";", -1)).select(
        F.get("_parts", F.lit(0)).alias("agent_id"), F.expr(rest).alias("updates")
    )


def to_long(trajectories: DataFrame) -> DataFrame:
    """One row per update."""
    return trajectories.select(
        *[c for c in trajectories.columns if c != "updates"], F.inline("updates")
    )


def format_trajectories(
    agent: Column | str = "agent_id", updates: Column | str = "updates", type_names: bool = False
) -> Column:
    """Text of one trajectory; sensor types print as codes unless ``type_names``."""
    agent_col = F.col(agent) if isinstance(agent, str) else agent
    array = F.col(updates) if isinstance(updates, str) else updates

    def text(u: Column) -> Column:
        kind = sensor_name(u["cell_type"]) if type_names else u["cell_type"].cast("string")
        fields = [u["lon"].cast("string"), u["lat"].cast("string"), u["timestamp"], kind, u["cell"]]
        return F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields])

    return F.concat_ws(";", agent_col, F.transform(array, text))

