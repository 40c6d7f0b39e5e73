"""Time functions over the events and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.checks.registry import check
from wayfare.functions import time as W
from wayfare.operators import intervals

SYD = "Australia/Sydney"
_LOCAL = f"timezone('{SYD}', timezone('UTC', ts))"
_OFFSET = f"cast(epoch({_LOCAL}) - epoch(ts) as bigint)"
_OFFSET_TEXT = (
    f"case when {_OFFSET} < 0 then '-' else '+' end || lpad(cast(abs({_OFFSET}) // 3600 as varchar), 2, '0') "
    f"|| lpad(cast(abs({_OFFSET}) % 3600 // 60 as varchar), 2, '0')"
)
_MIDNIGHT = f"timezone('UTC', timezone('{SYD}', date_trunc('day', {_LOCAL})))"
_PLAIN = "'%Y-%m-%d %H:%M:%S'"
_ELAPSED = f"cast(epoch(date_trunc('second', ts)) - epoch({_MIDNIGHT}) as bigint)"


def _stamped(t):
    """Event times, and order times far apart in the year so that both sides of clock changes occur."""
    return t.sql("select event_id as id, ts from events union all select -1 - o_orderkey as id, o_orderdate as ts from orders")


_STAMPED = "with s as (select event_id as id, ts from events union all select -1 - o_orderkey as id, o_orderdate as ts from orders) "


@check("t1_parse_offset_ts", f"""
select event_id, case when event_type = 'error' then null else strftime(date_trunc('second', ts) - interval 10 hour - interval 30 minute, {_PLAIN}) end as instant
from lbs_event""")
def t1(t):
    text = F.concat("ts_s", F.when(F.col("event_type") == "error", " junk").otherwise("+1030"))
    return t["lbs_event"].select("event_id", W.format_plain(W.parse_offset_ts(text)).alias("instant"))


@check("t2_format_offset_ts", f"{_STAMPED} select id, strftime(ts, {_PLAIN}) || '+0000' as utc_text from s")
def t2(t):
    return _stamped(t).select("id", W.format_offset_ts("ts").alias("utc_text"))


@check("t3_date_strings", "select o_orderkey, strftime(o_orderdate + interval 1 day, '%Y-%m-%d') as next_day from orders")
def t3(t):
    text = W.date_to_string("o_orderdate")
    return t["orders"].select("o_orderkey", W.date_to_string(F.date_add(W.date_from_string(text), 1)).alias("next_day"))


@check("t4_parse_local", f"""
select event_id, case when event_type = 'error' then null else strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') end as parsed
from events""")
def t4(t):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    milli = F.date_format("ts", "SSS")
    text = (
        F.when(F.col("event_type") == "error", F.concat(stamp, F.lit("."), F.date_format("ts", "SSSSSS")))
        .when(F.col("event_type") == "click", F.concat(F.replace(stamp, F.lit(" "), F.lit("T")), F.lit(","), milli))
        .otherwise(F.concat(stamp, F.lit("."), milli))
    )
    parsed = F.date_format(W.parse_local(text), "yyyy-MM-dd HH:mm:ss.SSS")
    return t["events"].select("event_id", parsed.alias("parsed"))


@check("t5_parse_to_utc", f"""
select event_id, strftime(timezone('UTC', timezone('{SYD}', date_trunc('second', ts))), {_PLAIN}) as instant from events""")
def t5(t):
    return t["lbs_event"].select("event_id", W.format_plain(W.parse_to_utc("ts_s", SYD)).alias("instant"))


@check("t6_to_other_tz", f"{_STAMPED} select id, strftime({_LOCAL}, {_PLAIN}) || {_OFFSET_TEXT} as text from s")
def t6(t):
    return _stamped(t).select("id", W.to_other_tz("ts", SYD).alias("text"))


@check("t7_date_text", f"{_STAMPED} select id, strftime({_LOCAL}, '%Y-%m-%d') as day from s")
def t7(t):
    return _stamped(t).select("id", W.date_text("ts", SYD).alias("day"))


@check("t8_start_of_day", f"{_STAMPED} select id, strftime({_MIDNIGHT}, {_PLAIN}) as midnight from s")
def t8(t):
    return _stamped(t).select("id", W.format_plain(W.start_of_day("ts", SYD)).alias("midnight"))


@check("t9_time_difference", """
select event_id, cast(trunc((epoch_us(date_trunc('hour', ts)) - epoch_us(ts)) / 1000000.0) as bigint) as back_s,
  cast(trunc((epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 1000000.0) as bigint) as ahead_s from events""")
def t9(t):
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return t["events"].select(
        "event_id", W.time_difference("ts", hour).alias("back_s"), W.time_difference(hour, "ts").alias("ahead_s")
    )


@check("t10_round_time", f"""{_STAMPED}
select id, strftime({_MIDNIGHT} + to_seconds(cast(floor({_ELAPSED} / 420.0 + 0.5) * 420 as bigint)), {_PLAIN}) as rounded from s""")
def t10(t):
    return _stamped(t).select("id", W.format_plain(W.round_time("ts", 420, SYD)).alias("rounded"))


@check("t12_floor_time", f"""{_STAMPED}
select id, strftime({_MIDNIGHT} + to_seconds(cast(floor({_ELAPSED} / 420.0) * 420 as bigint)), {_PLAIN}) as slot from s""")
def t12(t):
    return _stamped(t).select("id", W.format_plain(W.floor_time("ts", 420, SYD)).alias("slot"))


@check("t13_format_plain", f"{_STAMPED} select id, strftime(ts, {_PLAIN}) as plain from s")
def t13(t):
    return _stamped(t).select("id", W.format_plain("ts").alias("plain"))


@check("t14_time_of_day", """
select event_id, strftime(ts, '%H:%M:%S') as printed, case when event_type = 'error' then null else strftime(ts, '%H:%M:%S') end as parsed from events""")
def t14(t):
    printed = W.format_time_of_day("ts")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("9"), printed)).otherwise(printed)
    return t["events"].select("event_id", printed.alias("printed"), W.time_of_day(text).alias("parsed"))


@check("t15a_utc_to_offset_local", f"""
select event_id, strftime(ts + interval 9 hour + interval 30 minute, {_PLAIN}) as adelaide, strftime(ts - interval 3 hour - interval 30 minute, {_PLAIN}) as st_johns from events""")
def t15a(t):
    return t["events"].select(
        "event_id",
        W.format_plain(W.utc_to_offset_local("ts", 9.5)).alias("adelaide"),
        W.format_plain(W.utc_to_offset_local("ts", -3.5)).alias("st_johns"),
    )


@check("t15b_date_range", """
select id, strftime(cast(unnest(generate_series(cast(cast(in_ts as date) as timestamp), cast(cast(out_ts as date) as timestamp), interval 2 day)) as date), '%Y-%m-%d') as day
from stay_interval""")
def t15b(t):
    days = W.explode_dates(t["stay_interval"], "in_ts", "out_ts", 2, "day")
    return days.select("id", W.date_to_string("day").alias("day"))


@check("t15c_epoch_to_ts", f"{_STAMPED} select id, strftime({_LOCAL}, {_PLAIN}) as local from s")
def t15c(t):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return _stamped(t).select("id", W.format_plain(W.epoch_to_ts(seconds, SYD)).alias("local"))


@check("t16_overlap_seconds", """
select a.id as a_id, b.id as b_id,
  case when a.in_ts < b.out_ts and b.in_ts < a.out_ts
    then cast(epoch(least(a.out_ts, b.out_ts)) - epoch(greatest(a.in_ts, b.in_ts)) as bigint) else 0 end as overlap_s
from stay_interval a join stay_interval b on a.id + 1 = b.id""")
def t16(t):
    return t.sql("""
        select a.id as a_id, a.in_ts as in1, a.out_ts as out1, b.id as b_id, b.in_ts as in2, b.out_ts as out2
        from stay_interval a join stay_interval b on a.id + 1 = b.id""").select(
        "a_id", "b_id", intervals.overlap_seconds("in1", "out1", "in2", "out2").alias("overlap_s")
    )


@check("t17_extract_time", """
select event_id, hour(ts)::int as hour, minute(ts)::int as minute, day(ts)::int as day, month(ts)::int as month, year(ts)::int as year,
  strftime(ts, '%Y-%m-%d') as date from events""")
def t17(t):
    targets = ("hour", "minute", "day", "month", "year", "date")
    return t["lbs_event"].select("event_id", *[W.extract_time("ts_s", k).alias(k) for k in targets])
