"""Streams: the given events arrive in parts, the stream is restarted for each, and late events come last."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.checks.geo_checks import haversine_sql
from wayfare.checks.registry import check, r
from wayfare.checks.table_checks import _DISTANCE
from wayfare.functions.time import format_plain
from wayfare.session import scratch_path
from wayfare.sources.writers import write_parquet
from wayfare.streaming import stays as S

_SECONDS = 3600

# Every fiftieth event comes after all others. It is late where its slot had closed by then: ten minutes before the last of the others.
_STREAM_SQL = f"""
with e as (select event_id, agent_id, ts, time_bucket(interval {_SECONDS} second, ts) as slot, lat_s::double as lat, lon_s::double as lon, event_id % 50 = 0 as behind from lbs_event),
w as (select to_timestamp(epoch_ms(max(ts)) / 1000.0)::timestamp - interval 10 minute as until from e where not behind),
k as (select *, behind and slot + interval {_SECONDS} second <= until as late, radians(lat) as la, radians(lon) as lo from e, w),
c as (select agent_id, slot, count(*) as n, min(ts) as first_at, max(ts) as last_at, avg(cos(la) * cos(lo)) as x, avg(cos(la) * sin(lo)) as y, avg(sin(la)) as z from k where not late group by 1, 2),
d as (select *, degrees(atan2(z, sqrt(x * x + y * y))) as centre_lat, degrees(atan2(y, x)) as centre_lon from c),
g as (select d.agent_id, d.slot, any_value(n) as n, any_value(first_at) as first_at, any_value(last_at) as last_at, any_value(centre_lat) as centre_lat, any_value(centre_lon) as centre_lon,
    max({haversine_sql('k.lat', 'k.lon', 'd.centre_lat', 'd.centre_lon')}) as radius
  from d join k on k.agent_id = d.agent_id and k.slot = d.slot where not k.late group by 1, 2)
select agent_id, strftime(slot, '%Y-%m-%d %H:%M:%S') as slot, n, strftime(first_at, '%Y-%m-%d %H:%M:%S') as first_at, strftime(last_at, '%Y-%m-%d %H:%M:%S') as last_at,
  round(centre_lat, 6) + 0.0 as centre_lat, round(centre_lon, 6) + 0.0 as centre_lon, round(radius, 3) + 0.0 as radius,
  case when radius <= {_DISTANCE // 2} then 'stay' when radius < {_DISTANCE} then 'transit' else 'move' end as status, (select count(*) from k where late) as late_updates
from g"""


def _parts(t):
    """The events in three parts by time, then those that come behind."""
    events = t.sql("select event_id, agent_id, ts, cast(lat_s as double) as lat, cast(lon_s as double) as lon from lbs_event")
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    step = (ends.hi - ends.lo) / 3
    on_time = F.col("event_id") % 50 != 0
    cuts = [ends.lo + step, ends.lo + 2 * step]
    yield events.where(on_time & (F.col("ts") < cuts[0]))
    yield events.where(on_time & (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]))
    yield events.where(on_time & (F.col("ts") >= cuts[1]))
    yield events.where(~on_time)


@check("stream_stay_clusters", _STREAM_SQL)
def stream_stay_clusters(t):
    source, out, state = (scratch_path(t.spark, label) for label in ("updates", "clusters", "state"))
    late = 0
    for part in _parts(t):
        write_parquet(part, source, mode="append")
        schema = t.spark.read.parquet(source).schema
        found = S.stay_clusters_stream(t.spark.readStream.schema(schema).parquet(source), "ts", _DISTANCE, _SECONDS)
        query = S.write_batches(found, out, state)
        query.awaitTermination()
        late += S.late_updates(query)
    rest = S.open_clusters(t.spark.read.parquet(source), "ts", S.closed_until(query), _DISTANCE, _SECONDS)
    whole = S.read_batches(t.spark, out, found.schema).unionByName(rest)
    return whole.select(
        "agent_id", format_plain("slot").alias("slot"), "n", format_plain("first_at").alias("first_at"), format_plain("last_at").alias("last_at"),
        r("centre_lat").alias("centre_lat"), r("centre_lon").alias("centre_lon"), r("radius", 3).alias("radius"), "status", F.lit(late).cast("long").alias("late_updates"),
    )
