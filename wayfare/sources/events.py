"""Location event lines and cell lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.geo import split_cgi
from wayfare.functions.time import LENIENT_FORMAT, format_offset_ts
from wayfare.schemas import EVENT


@dataclass(frozen=True)
class EventLayout:
    """0-based positions of an event line's fields, and the zone of its time."""

    ts: int = 0
    agent: int = 1
    msisdn: int = 2
    cgi: int = 3
    event_type: int = 4
    lat: int = 5
    lon: int = 6
    imei: int = 7
    tz: str = "UTC"

    @property
    def width(self) -> int:
        """Fields a line needs."""
        return 1 + max(self.ts, self.agent, self.msisdn, self.cgi, self.event_type, self.lat, self.lon, self.imei)


SINGAPORE = EventLayout(tz="Asia/Singapore")
SYDNEY = EventLayout(ts=8, tz="Australia/Sydney")


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '\\"') + '"'


def parse_events(lines: DataFrame, layout: EventLayout = EventLayout(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Pipe-separated lines (column ``value``) to events.

    Coordinates that are no numbers become null; ``location`` keeps the text of both as it stands. Lines that are too short or have no valid time are dropped.
    ``keep`` names further input columns to carry along.
    """
    fields = {
        "event_time": f"to_utc_timestamp(try_to_timestamp(p[{layout.ts}], {_quoted(LENIENT_FORMAT)}), {_quoted(layout.tz)})",
        "agent_id": f"p[{layout.agent}]",
        "msisdn": f"p[{layout.msisdn}]",
        "cgi": f"p[{layout.cgi}]",
        "event_type": f"p[{layout.event_type}]",
        "lat": f"try_cast(p[{layout.lat}] as double)",
        "lon": f"try_cast(p[{layout.lon}] as double)",
        "location": f"concat(p[{layout.lat}], ',', p[{layout.lon}])",
        "imei": f"p[{layout.imei}]",
    }
    event = "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"
    # A line becomes an array of one event or none, so that its text and its time are read once.
    wide = f"filter(array(split(value, '\\\\|', -1)), p -> size(p) >= {layout.width})"
    rows = f"filter(transform({wide}, p -> {event}), e -> e.event_time is not null)"
    parsed = lines.select(*keep, F.inline(F.expr(rows)))
    cell = split_cgi(F.col("cgi"))
    complete = parsed.withColumns(
        {"lac": cell["lac"], "cell_id": cell["cell_id"], "grid_id": F.lit(0)}
    )
    return complete.select(*keep, *[f.name for f in EVENT.fields])


def format_events(events: DataFrame, tz: str = "UTC") -> Column:
    """The text of an event: time with offset, agent, msisdn, cgi, type, lat, lon, imei."""

    def text(name: str) -> Column:
        return F.coalesce(events[name].cast("string"), F.lit(""))

    names = ("agent_id", "msisdn", "cgi", "event_type", "lat", "lon", "imei")
    return F.concat_ws("|", format_offset_ts(events["event_time"], tz), *[text(n) for n in names])


def parse_cells(lines: DataFrame) -> DataFrame:
    """Pipe-separated cell lines: 0 cgi, 3 lat, 4 lon and, in lines of 12 fields, 9 and 10 flags, 11 building.

    A coordinate that is no number fails the query.
    """
    parts = F.split("value", "\\|", -1)
    full = F.size("_parts") == 12

    def field(i: int) -> Column:
        return F.get(F.col("_parts"), F.lit(i))

    def number(i: int, name: str) -> Column:
        value = F.trim(field(i)).try_cast("double")
        refuse = F.raise_error(F.concat(F.lit(f"cell line with bad {name}: "), F.col("value"))).cast("double")
        return F.when(value.isNotNull(), value).otherwise(refuse)

    def flag(i: int) -> Column:
        return F.when(full, F.coalesce(F.lower(F.trim(field(i))).try_cast("boolean"), F.lit(False))).otherwise(False)

    building = F.when(full & (F.trim(field(11)) != ""), field(11)).otherwise(F.lit("Unknown"))
    return lines.withColumn("_parts", parts).select(
        field(0).alias("cgi"),
        number(3, "latitude").alias("lat"),
        number(4, "longitude").alias("lon"),
        flag(9).alias("is_kde"),
        flag(10).alias("is_indoor"),
        building.alias("building"),
    )
