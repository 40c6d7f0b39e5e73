"""Filters, joins, aggregations, ordering and binning."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.checks.geo_checks import coord_sql, haversine_sql, unit_distance_sql
from wayfare.checks.registry import check, r
from wayfare.functions.time import format_offset_ts, format_plain
from wayfare.operators import binning, filters, intervals, lookup, percentile, quality, stays
from wayfare.plans import cells as C
from wayfare.plans import extracts as X
from wayfare.plans import movement as M
from wayfare.plans import routes as R
from wayfare.plans import stay_clusters as E
from wayfare.plans import trajectories as T
from wayfare.schemas import ROUTE_CANDIDATES
from wayfare.session import scratch_path
from wayfare.sources.events import parse_cells, parse_events
from wayfare.sources.readers import read_parquet_typed
from wayfare.sources.routes import parse_routes
from wayfare.sources.trajectories import format_trajectories

DATE = "2024-01-31"


def updates(t, events="lbs_event"):
    """The events as updates in long form."""
    return t.sql(f"""
        select agent_id, cast(lon_s as double) as lon, cast(lat_s as double) as lat, ts_s as timestamp, 1 as cell_type, cgi as cell
        from {events}""")


# ---------------------------------------------------------------- filters


@check("p1_eq_filter", "select trip_id, metric from trips where category = 'sa2_sa2'")
def p1(t):
    return X.trips_of_category(t["trips"]).select("trip_id", "metric")


@check("p2_or_filter", "select o_orderkey, mode from denorm_links where mode in ('TRAIN', 'RAIL')")
def p2(t):
    return t["denorm_links"].where(F.col("mode").isin("TRAIN", "RAIL")).select("o_orderkey", "mode")


@check("p3_contains_filter", "select o_orderkey, link_id from denorm_links where contains(link_id, 'NSW')")
def p3(t):
    return t["denorm_links"].where(F.col("link_id").contains("NSW")).select("o_orderkey", "link_id")


@check("p4_sentinel_filter", "select agent_id, home, work from homework where home <> 'NA' and work <> 'NA'")
def p4(t):
    return filters.known_home_and_work(t["homework"])


@check("p5_regex_full_match", "select event_id, agent_id from lbs_event where regexp_full_match(agent_id, 'A[1-9][0-9]')")
def p5(t):
    return t["lbs_event"].where(filters.full_match("agent_id", "A[1-9][0-9]")).select("event_id", "agent_id")


@check("p6_threshold_filter", f"select agent_id from homework where home <> 'NA' and work <> 'NA' and {unit_distance_sql('home', 'work')} >= 1000")
def p6(t):
    near = filters.known_home_and_work(t["homework"])
    return near.where(M.home_work_distance("home", "work") >= M.MIN_HOME_WORK_M).select("agent_id")


@check("p7_not_null_filter", "select p_partkey, lac from inventory where lac is not null")
def p7(t):
    return t["inventory"].where(F.col("lac").isNotNull()).select("p_partkey", "lac")


@check("p8_projection", f"select geo_hierarchy_base_id as home, sa1, sa2, '{DATE}' as date from geo_hierarchy")
def p8(t):
    renamed = t["geo_hierarchy"].withColumnRenamed("geo_hierarchy_base_id", "home")
    return renamed.withColumn("date", F.lit(DATE)).drop("sa3", "gcc", "state")


# Every third update is written in another zone; what is kept is shown in its own text.
_ZONED = """case when event_id % 3 = 0 then strftime(ts_s::timestamp + interval 11 hour, '%Y-%m-%d %H:%M:%S') || '+1100' else ts_s || '+0000' end"""


@check("p9_trajectory_time_filter", f"""
with z as (select agent_id, ts_s, {_ZONED} as shown from lbs_event)
select 'closed' as kind, agent_id, shown from z where ts_s between '2024-01-05 00:00:00' and '2024-01-20 12:00:00'
union all select 'open' as kind, agent_id, shown from z where ts_s >= '2024-01-05 00:00:00'""")
def p9(t):
    zoned = t.sql("""
        select agent_id, cast(lon_s as double) as lon, cast(lat_s as double) as lat, case when event_id % 3 = 0
            then concat(cast(cast(ts_s as timestamp) + interval '11' hour as string), '+1100') else concat(ts_s, '+0000') end as timestamp,
          1 as cell_type, cgi as cell from lbs_event""")
    closed = filters.filter_updates(T.build_trajectories(zoned), "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    closed = closed.select(F.lit("closed").alias("kind"), "agent_id", F.explode("updates").alias("u"))
    later = filters.updates_between(zoned, "2024-01-05 11:00:00+1100").select(F.lit("open").alias("kind"), "agent_id", F.col("timestamp").alias("shown"))
    return closed.select("kind", "agent_id", F.col("u.timestamp").alias("shown")).unionByName(later)


def _neighbours(t):
    return t.sql("""
        select a.id as a_id, a.in_ts as in1, a.out_ts as out1, b.id as b_id, b.in_ts as in2, b.out_ts as out2
        from stay_interval a join stay_interval b on a.grp = b.grp + 1""")


@check("p10_interval_overlap", """
select a.id as a_id, b.id as b_id, a.in_ts < b.out_ts and b.in_ts < a.out_ts as overlaps from stay_interval a join stay_interval b on a.grp = b.grp + 1""")
def p10(t):
    test = intervals.is_overlap("in1", "out1", "in2", "out2")
    return _neighbours(t).select("a_id", "b_id", test.alias("overlaps"))


@check("p11_rings_filter", "select id from esri_line where contains(split_part(value, '|', 2), 'rings')")
def p11(t):
    return filters.has_rings(t["esri_line"]).select("id")


_PARSES = "event_id % 23 <> 0 and event_id % 19 <> 0"


@check("p12_drop_unparsed", f"select event_id, agent_id from lbs_event where {_PARSES}")
def p12(t):
    return parse_events(t["lbs_line"], keep=("event_id",)).select("event_id", "agent_id")


@check("p13_active_cell_filter", """
select case technology when 'UMTS' then '505-02-' || lac || '-' || coalesce(sac_id, 'null') when 'LTE' then '505-02-' || lac || '-' || cell_id else '' end as full_id, site_type, cell_status
from inventory where lac is not null and cell_status = 'ACTIVE'""")
def p13(t):
    return C.active_cells(t["inventory"])


@check("p14_quarantine", f"""
select agent_id, count(*) as lines, count(*) filter (where {_PARSES}) as good, count(*) filter (where not ({_PARSES})) as bad from lbs_event group by agent_id""")
def p14(t):
    parts = F.split("value", "\\|", -1)
    lines = t["lbs_line"].withColumn("agent_id", F.get(parts, F.lit(1)))
    wide = F.when(F.size(parts) >= 8, F.try_to_timestamp(F.get(parts, F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss")))
    good, bad = quality.quarantine(lines, wide)
    share = quality.valid_share(lines, wide, ("agent_id",)).select("agent_id", F.col("rows").alias("lines"))
    return (
        share.join(good.groupBy("agent_id").agg(F.count("*").alias("good")), "agent_id", "left")
        .join(bad.groupBy("agent_id").agg(F.count("*").alias("bad")), "agent_id", "left")
        .select("agent_id", "lines", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    )


# ---------------------------------------------------------------- joins


@check("j1_inner_join_agent", "select s.agent_id, home, geo_unit_id, count(*) as visits from staypoint s join homework h on s.agent_id = h.agent_id where home <> 'NA' and work <> 'NA' group by all")
def j1(t):
    known = filters.known_home_and_work(t["homework"]).select("agent_id", "home")
    visits = t["staypoint"].groupBy("agent_id", "geo_unit_id").agg(F.count("*").alias("visits"))
    return visits.join(known, "agent_id").select("agent_id", "home", "geo_unit_id", "visits")


@check("j2_inner_join_geo", "select agent_id, home, sa1, sa2 from homework join geo_hierarchy on home = geo_hierarchy_base_id")
def j2(t):
    areas = t["geo_hierarchy"].select(F.col("geo_hierarchy_base_id").alias("home"), "sa1", "sa2")
    return t["homework"].join(areas, "home").select("agent_id", "home", "sa1", "sa2")


@check("j3_left_join_not_null", """
select w.agent_id, h.home from weight w left join (select agent_id, home from homework where home <> 'NA') h on w.agent_id = h.agent_id where h.home is not null""")
def j3(t):
    known = t["homework"].where("home <> 'NA'").select("agent_id", "home")
    return t["weight"].join(known, "agent_id", "inner").select("agent_id", "home")


_LOCATED = f"""
with parsed as (select event_id, agent_id, ts_s, cgi, case when event_id % 17 = 0 then null else try_cast(lat_s as double) end as lat, lon_s::double as lon from lbs_event where {_PARSES}),
located as (select p.*, coalesce(c.lat_s::double, p.lat) as new_lat, case when c.cgi is not null then c.lon_s::double else p.lon end as new_lon
  from parsed p left join cell c on p.cgi = c.cgi where c.cgi is not null or (p.lat is not null and p.lon is not null)) """


@check("j4_lookup_override", _LOCATED + "select event_id, agent_id, new_lat as lat, new_lon as lon from located")
def j4(t):
    return lookup_of(t).select("event_id", "agent_id", "lat", "lon")


def lookup_of(t):
    return lookup.locate_events(parse_events(t["lbs_line"], keep=("event_id",)), parse_cells(t["cell_line"]))


_ROUTE = """
with parsed as (select id, split_part(value, chr(9), 1) as day_of_week, split_part(value, chr(9), 2) as query_time,
  replace(split_part(value, chr(9), 3), '"', '') as start_geo, replace(split_part(value, chr(9), 4), '"', '') as end_geo, split_part(value, chr(9), 5) as legs
  from route_line where not contains(value, 'bad,leg')) """


@check("j5_double_dim_lookup", _ROUTE + """
select p.id, s.id as start_geo, e.id as end_geo from parsed p join id_map s on p.start_geo = s.sub_mtz join id_map e on p.end_geo = e.sub_mtz""")
def j5(t):
    return R.repair_route_ids(parse_routes(t["route_line"], keep=("id",)), t["id_map"]).select("id", "start_geo", "end_geo")


@check("j7_interval_overlap_join", """
select a.id as a_id, b.id as b_id, cast(epoch(least(a.out_ts, b.out_ts)) - epoch(greatest(a.in_ts, b.in_ts)) as bigint) as overlap_s
from stay_interval a join stay_interval b on a.grp = b.grp and a.in_ts < b.out_ts and b.in_ts < a.out_ts""")
def j7(t):
    left = t["stay_interval"].toDF("a_id", "a_grp", "a_in", "a_out")
    right = t["stay_interval"].toDF("b_id", "b_grp", "b_in", "b_out")
    pairs = intervals.overlap_join(left, right, ("a_in", "a_out"), ("b_in", "b_out"), [("a_grp", "b_grp")])
    return pairs.select("a_id", "b_id", "overlap_s")


@check("j7_interval_overlap_join_keyless", """
with e as (select event_id, date_trunc('second', ts) as ts from events),
s as (select id, timestamp '2024-01-01 00:00:00' + (id % 43200) * interval 1 minute as in_ts, timestamp '2024-01-01 00:05:00' + (id % 43200) * interval 1 minute as out_ts from stay_interval)
select e.event_id, s.id as stay_id, cast(epoch(least(e.ts + interval 60 second, s.out_ts)) - epoch(greatest(e.ts, s.in_ts)) as bigint) as overlap_s
from e join s on e.ts < s.out_ts and s.in_ts < e.ts + interval 60 second""")
def j7_keyless(t):
    events = t.sql("select event_id, date_trunc('second', ts) as a_in, date_trunc('second', ts) + interval '60' second as a_out from events")
    stays_ = t.sql("select id as stay_id, timestamp '2024-01-01 00:00:00' + interval '1' minute * (id % 43200) as b_in, timestamp '2024-01-01 00:05:00' + interval '1' minute * (id % 43200) as b_out from stay_interval")
    pairs = intervals.overlap_join(events, stays_, ("a_in", "a_out"), ("b_in", "b_out"))
    return pairs.select("event_id", "stay_id", "overlap_s")


@check("j8_distinct_dim_join", _ROUTE + """
select p.id, p.start_geo as start_sa1, d.state from parsed p join (select distinct sa1, state from route_area) d on p.start_geo = d.sa1 where d.state = '1'""")
def j8(t):
    routes = parse_routes(t["route_line"], keep=("id",)).withColumnRenamed("start_geo", "start_sa1")
    return R.routes_in_state(routes, t["route_area"]).select("id", "start_sa1", "state")


# ---------------------------------------------------------------- aggregations


@check("a1_collect_list", """
with v as (select agent_id, floor(split_part(geo_unit_id, '_', 4)::double / 0.1)::bigint as tile_lon, floor(split_part(geo_unit_id, '_', 5)::double / 0.1)::bigint as tile_lat, geo_unit_id from staypoint),
p as (select *, (row_number() over (partition by agent_id, tile_lon, tile_lat order by geo_unit_id) - 1) // 5 as part from v)
select agent_id, tile_lon, tile_lat, part, string_agg(geo_unit_id, ';' order by geo_unit_id) as geo_units from p group by all""")
def a1(t):
    return M.visited_units(t["staypoint"], size=5).withColumn("geo_units", F.array_join("geo_units", ";"))


_INDEX = f"""
with res as (
  select h.agent_id, h.home, h.work, g.sa1, g.sa2, g.gcc, g.state, {unit_distance_sql('h.home', 'h.work')} as hw_dist, m.max_dis, m.max_dis / {unit_distance_sql('h.home', 'h.work')} as idx
  from homework h join geo_hierarchy g on h.home = g.geo_hierarchy_base_id
  join (select s.agent_id, max({haversine_sql(coord_sql('s.geo_unit_id', 4), coord_sql('s.geo_unit_id', 3), coord_sql('k.home', 4), coord_sql('k.home', 3))}) as max_dis
    from staypoint s join homework k on s.agent_id = k.agent_id where k.home <> 'NA' group by s.agent_id) m on m.agent_id = h.agent_id
  where h.home <> 'NA' and h.work <> 'NA' and {unit_distance_sql('h.home', 'h.work')} >= 1000),
movement as (select res.* from res join weight w on res.agent_id = w.agent_id join range(0, 4) k(i) on k.i < try_cast(w.weight as int)) """


def _level(level: str, area: str, extra: str = "") -> str:
    return (
        f"select '{level}' as level, {area} as area, '{DATE}' as date, round(avg(idx), 6) + 0.0 as mean, "
        f"round(quantile_disc(idx, 0.5), 6) + 0.0 as median{extra} from movement group by {area}"
    )


_AREAS_SQL = _INDEX + _level("sa1", "sa1") + " union all " + _level("sa2", "sa2")
_COUNT = ", count(*) as weighted_agent_num"
_LEVELS_SQL = (
    _INDEX
    + " union all ".join(_level(k, k, _COUNT) for k in ("sa2", "gcc", "state"))
    + f" union all select 'nation' as level, null as area, '{DATE}' as date, round(avg(idx), 6) + 0.0 as mean, "
    f"round(quantile_disc(idx, 0.5), 6) + 0.0 as median{_COUNT} from movement"
)


def _inputs(t):
    return t["staypoint"], t["homework"], t["geo_hierarchy"], t["weight"]


def _rounded(df):
    return df.withColumns({"mean": r("mean"), "median": r("median")})


@check("a2_mean_median_by_area", _INDEX + f"""
select 'sa1' as level, sa1 as area, '{DATE}' as date, round(avg(max_dis), 3) + 0.0 as mean, round(quantile_disc(max_dis, 0.5), 3) + 0.0 as median from movement group by sa1
union all select 'sa2' as level, sa2 as area, '{DATE}' as date, round(avg(max_dis), 3) + 0.0 as mean, round(quantile_disc(max_dis, 0.5), 3) + 0.0 as median from movement group by sa2""")
def a2(t):
    index = M.agent_index(*_inputs(t)[:3], M.AREA_LEVELS).withColumn("index", F.col("max_dis"))
    result = M.by_level(M.weighted_index(index, t["weight"]), M.AREA_LEVELS, DATE).drop("weighted_agent_num")
    return result.withColumns({"mean": r("mean", 3), "median": r("median", 3)})


@check("a3_mean_median_4_levels", _LEVELS_SQL.replace("idx", "hw_dist").replace("as hw_dist from", "as unused from").replace(", 6)", ", 3)"))
def a3(t):
    index = M.agent_index(*_inputs(t)[:3], ["sa2", "gcc", "state"]).withColumn("index", F.col("hw_dist"))
    result = M.by_level(M.weighted_index(index, t["weight"]), M.INDEX_LEVELS, DATE)
    return result.withColumns({"mean": r("mean", 3), "median": r("median", 3)})


@check("a4_weight_replication", "select agent_id from weight w join range(0, 4) k(i) on k.i < try_cast(w.weight as int)")
def a4(t):
    return M.repeat_by_weight(t["weight"])


@check("a4_weighted_median", """
select l_returnflag, cast(sum(l_quantity) as bigint) as total, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) + 0.0 as mean,
  (select min(p) from (select l_extendedprice as p, sum(sum(l_quantity)) over (order by l_extendedprice) as run from lineitem i where i.l_returnflag = o.l_returnflag group by l_extendedprice)
   where run >= ceil(0.5 * (select sum(l_quantity) from lineitem j where j.l_returnflag = o.l_returnflag))) as percentile
from lineitem o group by l_returnflag""")
def a4_weighted(t):
    summed = percentile.weighted_summary(t["lineitem"], ["l_returnflag"], "l_extendedprice", "l_quantity")
    return summed.withColumn("mean", r("mean", 4))


_PATH = "string_agg(cast(lon_s::double as varchar) || ',' || cast(lat_s::double as varchar) || ',' || ts_s || ',1,' || cgi, ';' order by ts_s, lon_s::double, lat_s::double, cgi)"


@check("a5_build_trajectory", f"select agent_id, substr(ts_s, 1, 10) as day, agent_id || ';' || {_PATH} as value from lbs_event group by agent_id, day")
def a5(t):
    return T.build_trajectories(updates(t)).select("agent_id", "day", format_trajectories().alias("value"))


@check("a5_whole_trajectory", """
select agent_id, row_number() over (partition by agent_id order by ts_s, lon_s::double, lat_s::double, cgi) - 1 as position, ts_s as timestamp, lon_s::double as lon, lat_s::double as lat, cgi as cell
from lbs_crowd""")
def a5_whole(t):
    return T.whole_trajectories(updates(t, "lbs_crowd")).select("agent_id", "position", "timestamp", "lon", "lat", "cell")


@check("a6_count_distinct", f"""
with c as (select distinct case technology when 'UMTS' then '505-02-' || lac || '-' || coalesce(sac_id, 'null') when 'LTE' then '505-02-' || lac || '-' || cell_id else '' end as full_id, site_type, cell_status
  from inventory where lac is not null and cell_status = 'ACTIVE')
select count(*) as cell_count, count(*) filter (where site_type = 'In Building') as in_building_count from c""")
def a6(t):
    return C.cell_inventory(t["inventory"], DATE).drop("date")


@check("a7_row_count", "select count(*) as n from lbs_event")
def a7(t):
    return t["lbs_event"].agg(F.count(F.lit(1)).alias("n"))


@check("a8_nearest_rank_percentile", """
select l_shipdate::date::varchar as day, quantile_disc(l_extendedprice, 0.9) as percentile from lineitem group by 1
union all select 'all' as day, quantile_disc(l_extendedprice, 0.9) as percentile from lineitem""")
def a8(t):
    levels = F.explode(F.array(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("all")))
    return percentile.nearest_rank_percentile(t["lineitem"].select("l_extendedprice", levels.alias("day")), "l_extendedprice", 0.9, ["day"])


# All prices lie within one part in a thousand million of each other but one, which is a million times as large.
@check("a8_percentile_of_close_values", """
with v as (select l_returnflag, case when l_orderkey = (select min(l_orderkey) from lineitem) then 1e12 else 1e6 + l_extendedprice * 1e-9 end as x from lineitem)
select l_returnflag, quantile_disc(x, 0.37) as percentile from v group by 1""")
def a8_close(t):
    least = t["lineitem"].agg(F.min("l_orderkey").alias("k")).scalar()
    x = F.when(F.col("l_orderkey") == least, F.lit(1e12)).otherwise(F.lit(1e6) + F.col("l_extendedprice") * F.lit(1e-9))
    return percentile.nearest_rank_percentile(t["lineitem"].select("l_returnflag", x.alias("x")), "x", 0.37, ["l_returnflag"])


@check("a9_max_distance_from_home", f"""
select k.agent_id, k.home, round(max({unit_distance_sql('s.geo_unit_id', 'k.home')}), 3) + 0.0 as max_dis
from staypoint s join homework k on s.agent_id = k.agent_id where k.home <> 'NA' group by k.agent_id, k.home""")
def a9(t):
    homes = t["homework"].where("home <> 'NA'")
    return M.radius_from_home(t["staypoint"], homes).withColumn("max_dis", r("max_dis", 3))


# Updates of a day make a cluster; a cluster's centre is the mean, or the middle of each axis.
_X = "cos(radians(lat_s::double)) * cos(radians(lon_s::double))"
_Y = "cos(radians(lat_s::double)) * sin(radians(lon_s::double))"
_Z = "sin(radians(lat_s::double))"


def _centre_sql(agg: str, slot: str) -> str:
    x, y, z = (agg.format(v) for v in (_X, _Y, _Z))
    return f"""
c as (select agent_id, {slot} as slot, {x} as x, {y} as y, {z} as z, count(*) as n, min(ts_s) as first_at, max(ts_s) as last_at from lbs_event group by 1, 2),
d as (select agent_id, slot, n, first_at, last_at, degrees(atan2(z, sqrt(x * x + y * y))) as centre_lat, degrees(atan2(y, x)) as centre_lon from c),
e as (select d.agent_id, d.slot, max({haversine_sql('l.lat_s::double', 'l.lon_s::double', 'd.centre_lat', 'd.centre_lon')}) as radius
  from lbs_event l join d on l.agent_id = d.agent_id and {slot.replace('ts_s', 'l.ts_s')} = d.slot group by 1, 2) """


_DAY = "substr(ts_s, 1, 10)"
_SLOT = "strftime(to_timestamp(cast(floor(epoch(ts_s::timestamp) / 21600.0) * 21600 as bigint)) at time zone 'UTC', '%Y-%m-%d %H:%M:%S')"
_MEAN, _MEDIAN = "avg({})", "quantile_disc({}, 0.5)"
_DISTANCE = 30001


def _day_clusters(t, centroid):
    slotted = stays.with_slot(updates(t), 86400)
    return stays.clusters(slotted, ["agent_id", "slot"], _DISTANCE, centroid).withColumn(
        "slot", F.date_format("slot", "yyyy-MM-dd")
    )


@check("a10_centroid_mean", f"with {_centre_sql(_MEAN, _DAY)} select agent_id, slot, n, round(centre_lat, 6) + 0.0 as lat, round(centre_lon, 6) + 0.0 as lon from d")
def a10(t):
    return _day_clusters(t, "mean").select("agent_id", "slot", "n", r("centre_lat").alias("lat"), r("centre_lon").alias("lon"))


@check("a11_centroid_median", f"with {_centre_sql(_MEDIAN, _DAY)} select agent_id, slot, n, round(centre_lat, 6) + 0.0 as lat, round(centre_lon, 6) + 0.0 as lon from d")
def a11(t):
    return _day_clusters(t, "median").select("agent_id", "slot", "n", r("centre_lat").alias("lat"), r("centre_lon").alias("lon"))


@check("a12_cluster_radius", f"with {_centre_sql(_MEAN, _DAY)} select agent_id, slot, round(radius, 3) + 0.0 as radius from e")
def a12(t):
    return _day_clusters(t, "mean").select("agent_id", "slot", r("radius", 3).alias("radius"))


@check("a13_cluster_bounds", f"""
select agent_id, {_DAY} as slot, min(ts_s) as first_at, max(ts_s) as last_at, cast(epoch(max(ts_s)::timestamp) - epoch(min(ts_s)::timestamp) as bigint) as duration_s from lbs_event group by 1, 2""")
def a13(t):
    return _day_clusters(t, "mean").select(
        "agent_id", "slot", format_plain("first_at").alias("first_at"), format_plain("last_at").alias("last_at"), "duration_s"
    )


_STATUS = f"case when radius <= {_DISTANCE // 2} then 'stay' when radius < {_DISTANCE} then 'transit' else 'move' end"


@check("a14_stay_status", f"with {_centre_sql(_MEAN, _DAY)} select agent_id, slot, {_STATUS} as status from e")
def a14(t):
    return _day_clusters(t, "mean").select("agent_id", "slot", "status")


@check("a15_time_slot_group", f"""
select agent_id, {_SLOT} || '+0000' as slot_key, count(*)::int as n, string_agg(ts_s, ';' order by ts_s) as times from lbs_event group by agent_id, {_SLOT}""")
def a15(t):
    groups = stays.slot_groups(updates(t), 21600)
    times = F.array_join(F.transform("updates", lambda u: u["timestamp"]), ";")
    return groups.select("agent_id", "slot_key", F.size("updates").alias("n"), times.alias("times"))


@check("o1_sort_in_group", f"select agent_id, substr(ts_s, 1, 10) as day, {_PATH} as path from lbs_event group by agent_id, day")
def o1(t):
    built = T.build_trajectories(updates(t))
    return built.select("agent_id", "day", F.regexp_replace(format_trajectories(), "^[^;]*;", "").alias("path"))


@check("o2_sort_slots", f"""
select agent_id, string_agg(slot_key, ';' order by slot_key) as slots from (select distinct agent_id, {_SLOT} || '+0000' as slot_key from lbs_event) group by agent_id""")
def o2(t):
    slots = stays.with_slot(updates(t), 21600).select("agent_id", "slot").distinct()
    ordered = F.array_sort(F.collect_list("slot"))
    keys = F.transform(ordered, lambda s: format_offset_ts(s))
    return slots.groupBy("agent_id").agg(F.array_join(keys, ";").alias("slots"))


@check("d1_distinct", "select distinct site_type, cell_status, technology from inventory")
def d1(t):
    return t["inventory"].select("site_type", "cell_status", "technology").distinct()


# ---------------------------------------------------------------- binning


@check("b1_equal_bin", "select l_orderkey, l_linenumber, least(floor(l_quantity / 7), 7) as bin from lineitem")
def b1(t):
    return binning.equal_bin(t["lineitem"], 0, 56, 7, "l_quantity", "bin").select("l_orderkey", "l_linenumber", "bin")


@check("b2_custom_bin", """
select l_orderkey, l_linenumber, case when l_quantity < 5 then 0.0 when l_quantity < 10.5 then 1.0 when l_quantity < 30 then 2.0 else 3.0 end::double as bin from lineitem""")
def b2(t):
    return binning.custom_bin(t["lineitem"], [0, 5, 10.5, 30, 50], "l_quantity", "bin").select(
        "l_orderkey", "l_linenumber", "bin"
    )


# ---------------------------------------------------------------- whole jobs


@check("e1_job_movement", _AREAS_SQL)
def e1(t):
    return _rounded(M.movement_by_area(*_inputs(t), DATE))


@check("e2_job_movement_index", _LEVELS_SQL)
def e2(t):
    return _rounded(M.movement_index_by_level(*_inputs(t), DATE))


@check("e3_job_trajectories", _LOCATED + """
select agent_id, substr(ts_s, 1, 10) as day, agent_id || ';' || string_agg(cast(new_lon as varchar) || ',' || cast(new_lat as varchar) || ',' || ts_s || ',1,' || cgi, ';' order by ts_s, new_lon, new_lat, cgi) as value
from located where regexp_full_match(agent_id, 'A[0-9]+') group by agent_id, day""")
def e3(t):
    return T.trajectory_lines(t["lbs_line"], t["cell_line"], id_regex="A[0-9]+")


@check("e3_job_whole_trajectories", _LOCATED + """,
placed as (select *, row_number() over (partition by agent_id order by ts_s, new_lon, new_lat, cgi) - 1 as position from located where regexp_full_match(agent_id, 'A[0-9]+'))
select agent_id, position // 20 as part, agent_id || ';' || string_agg(cast(new_lon as varchar) || ',' || cast(new_lat as varchar) || ',' || ts_s || ',1,' || cgi, ';' order by position) as value
from placed group by agent_id, position // 20""")
def e3_whole(t):
    return T.path_lines(t["lbs_line"], t["cell_line"], id_regex="A[0-9]+", size=20)


@check("e4_job_cell_inventory", f"""
with c as (select distinct case technology when 'UMTS' then '505-02-' || lac || '-' || coalesce(sac_id, 'null') when 'LTE' then '505-02-' || lac || '-' || cell_id else '' end as full_id, site_type, cell_status
  from inventory where lac is not null and cell_status = 'ACTIVE')
select '{DATE}' as date, count(*) as cell_count, count(*) filter (where site_type = 'In Building') as in_building_count from c""")
def e4(t):
    return C.cell_inventory(t["inventory"], DATE)


@check("e5_job_links", "select agent_id, mode, link_id from denorm_links where mode in ('TRAIN', 'RAIL') and contains(link_id, 'NSW')")
def e5(t):
    return X.rail_links(t["denorm_links"], "NSW")


@check("e6_job_trip_count", "select trip_id, category, metric from trips where category = 'sa2_sa2'")
def e6(t):
    return X.trips_of_category(t["trips"])


@check("e7_job_route_ids", _ROUTE + """
select concat_ws(chr(9), day_of_week, query_time, s.id, e.id, legs) as value from parsed p join id_map s on p.start_geo = s.sub_mtz join id_map e on p.end_geo = e.sub_mtz""")
def e7(t):
    return R.repaired_route_lines(t["route_line"].drop("id"), t["id_map"])


@check("e8_job_esri_to_wkt", """
select id || '|' || case when x1 - x0 = 4 then '' else concat('POLYGON ((', x0, ' ', y0, ', ', x0, ' ', y1, ', ', x1, ' ', y1, ', ', x1, ' ', y0, ', ', x0, ' ', y0, '))') end as value
from box where x1 - x0 <> 5""")
def e8(t):
    return X.esri_lines_to_wkt(t["esri_line"].drop("id"))


def _stay_sql(agg: str) -> str:
    return f"""with {_centre_sql(agg, _SLOT)}
select d.agent_id, d.slot || '+0000' as slot_key, n, first_at, last_at, round(centre_lat, 6) + 0.0 as centre_lat, round(centre_lon, 6) + 0.0 as centre_lon, round(radius, 3) + 0.0 as radius, {_STATUS} as status
from d join e on d.agent_id = e.agent_id and d.slot = e.slot"""


def _stays(t, centroid):
    lines = T.build_trajectories(updates(t)).select(format_trajectories().alias("value"))
    found = E.stay_clusters_from_lines(lines, _DISTANCE, seconds=21600, centroid=centroid)
    return found.select(
        "agent_id",
        "slot_key",
        "n",
        format_plain("first_at").alias("first_at"),
        format_plain("last_at").alias("last_at"),
        r("centre_lat").alias("centre_lat"),
        r("centre_lon").alias("centre_lon"),
        r("radius", 3).alias("radius"),
        "status",
    )


@check("e10_job_stay_clusters", _stay_sql(_MEAN))
def e10(t):
    return _stays(t, "mean")


@check("e10_job_stay_clusters_median", _stay_sql(_MEDIAN))
def e10_median(t):
    return _stays(t, "median")


_PUBLIC = _ROUTE + """, pub as (select p.*, list_transform(string_split(legs, ';'), lambda x: string_split(x, ',')) as l from parsed p) """


@check("g15_trip_mode", _PUBLIC + "select id, len(list_filter(l, lambda x: x[7] not in ('TRAIN', 'FERRY', 'TRAM', 'SUBWAY'))) = 0 as public from pub")
def g15(t):
    return parse_routes(t["route_line"], keep=("id",)).select("id", R.is_public_transport("route").alias("public"))


@check("g16_route_join_text", _PUBLIC + "select id, array_to_string(list_transform(list_filter(l, lambda x: x[7] in ('TRAIN', 'FERRY', 'TRAM', 'SUBWAY')), lambda x: x[8]), ';') as link_id from pub")
def g16(t):
    return parse_routes(t["route_line"], keep=("id",)).select("id", R.public_link_id("route").alias("link_id"))


@check("e11_job_public_transport", _PUBLIC + """
select array_to_string(list_transform(list_filter(l, lambda x: x[7] in ('TRAIN', 'FERRY', 'TRAM', 'SUBWAY')), lambda x: x[8]), ';') as public_link_id
from pub join (select distinct sa1, state from route_area) d on pub.start_geo = d.sa1
where d.state = '1' and len(list_filter(l, lambda x: x[7] not in ('TRAIN', 'FERRY', 'TRAM', 'SUBWAY'))) = 0""")
def e11(t):
    routes = parse_routes(t["route_line"]).withColumnRenamed("start_geo", "start_sa1")
    return R.public_transport_routes(routes, t["route_area"])


# Nested rows of candidates, stored and read as such: the route itself, and its first leg alone.
@check("e11_job_nested_routes", _PUBLIC + """
select array_to_string(list_transform(list_filter(list_concat(l, l[1:1]), lambda x: x[7] in ('TRAIN', 'FERRY', 'TRAM', 'SUBWAY')), lambda x: x[8]), ';') as public_link_id
from pub join (select distinct sa1, state from route_area) d on pub.start_geo = d.sa1
where d.state = '1' and len(list_filter(l, lambda x: x[7] not in ('TRAIN', 'FERRY', 'TRAM', 'SUBWAY'))) = 0""")
def e11_nested(t):
    def candidate(legs):
        first, last = F.get(legs, F.lit(0)), F.element_at(legs, -1)
        return F.struct(
            first["start_time"].alias("start_time"), last["end_time"].alias("end_time"), F.lit("").alias("polygon"), legs.alias("legs"), F.size(legs).cast("double").alias("distance")
        )

    routes = parse_routes(t["route_line"])
    nested = routes.select(
        "day_of_week", F.col("start_geo").alias("start_sa1"), F.col("end_geo").alias("end_sa1"), F.array("query_time").alias("time_band_start"), F.array("query_time").alias("time_band_end"),
        F.array(candidate(F.col("route")), candidate(F.slice("route", 1, 1))).alias("candidate"),
    )
    path = scratch_path(t.spark, "candidates")
    nested.write.parquet(path)
    stored = read_parquet_typed(t.spark, path, ROUTE_CANDIDATES)
    return R.public_transport_routes(stored, t["route_area"], legs=R.candidate_legs())
