"""Distances, identifiers, polygon functions, relations and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.checks.registry import check, r
from wayfare.functions import geo as G
from wayfare.functions import geometry as Y
from wayfare.functions.sql import register
from wayfare.operators import spatial as S
from wayfare.plans import cells as C
from wayfare.sources import esri
from wayfare.sources.readers import wkt_table

RADIUS = "6378126.0"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    )
    return f"(2 * {RADIUS} * atan2(sqrt({a}), sqrt(1 - {a})))"


def coord_sql(unit: str, part: int) -> str:
    return f"try_cast(split_part({unit}, '_', {part + 1}) as double)"


def unit_distance_sql(a: str, b: str) -> str:
    return haversine_sql(coord_sql(a, 4), coord_sql(a, 3), coord_sql(b, 4), coord_sql(b, 3))


@check("g1_haversine", f"""
select a.event_id, round({haversine_sql('a.lat_s::double', 'a.lon_s::double', 'b.lat_s::double', 'b.lon_s::double')}, 3) + 0.0 as metres
from lbs_event a join lbs_event b on a.event_id + 1 = b.event_id""")
def g1(t):
    pairs = t.sql("""
        select a.event_id, cast(a.lat_s as double) as lat1, cast(a.lon_s as double) as lon1,
          cast(b.lat_s as double) as lat2, cast(b.lon_s as double) as lon2
        from lbs_event a join lbs_event b on a.event_id + 1 = b.event_id""")
    metres = G.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return pairs.select("event_id", r(metres, 3).alias("metres"))


@check("g2_home_work_distance", f"select agent_id, round({unit_distance_sql('home', 'work')}, 3) + 0.0 as hw_dist from homework")
def g2(t):
    return t["homework"].select("agent_id", r(G.home_work_distance("home", "work"), 3).alias("hw_dist"))


@check("g3_grid_to_coord", f"""
select agent_id, {coord_sql('home', 4)} as lat, {coord_sql('home', 3)} as lon, nullif(split_part(home, '_', 5), '') as lat_text, nullif(split_part(home, '_', 4), '') as lon_text
from homework""")
def g3(t):
    both = G.grid_to_coord("home", "all")
    return t["homework"].select(
        "agent_id",
        G.grid_to_coord("home").alias("lat"),
        G.grid_to_coord("home", "lon").alias("lon"),
        both["lat"].alias("lat_text"),
        both["lon"].alias("lon_text"),
    )


@check("g4_movement_index", "select l_orderkey, l_linenumber, round(case when l_discount = 0 then null else l_extendedprice / l_discount end, 3) + 0.0 as idx from lineitem")
def g4(t):
    idx = G.movement_index("l_extendedprice", "l_discount")
    return t["lineitem"].select("l_orderkey", "l_linenumber", r(idx, 3).alias("idx"))


@check("g5_full_cell_id", """
select p_partkey, case when lac is null then null when technology = 'UMTS' then '505-02-' || lac || '-' || coalesce(sac_id, 'null')
  when technology = 'LTE' then '505-02-' || lac || '-' || coalesce(cell_id, 'null') else '' end as full_id from inventory""")
def g5(t):
    return t["inventory"].select("p_partkey", G.full_cell_id("technology", "lac", "sac_id", "cell_id").alias("full_id"))


_ODD_CGI = "case when event_type = 'error' then '505-02' else cgi end"


@check("g6_split_cgi", f"""
select event_id, case when event_type = 'error' then '' else split_part(cgi, '-', 3) end as lac,
  case when event_type = 'error' then '' else split_part(cgi, '-', 4) end as cell_id from lbs_event""")
def g6(t):
    parts = G.split_cgi(F.expr(_ODD_CGI))
    return t["lbs_event"].select("event_id", parts["lac"].alias("lac"), parts["cell_id"].alias("cell_id"))


@check("g7_cell_keys", "select event_id, split_part(cgi, '-', 3) || '-' || split_part(cgi, '-', 4) as cell_key, cgi as full_key from lbs_event")
def g7(t):
    parts = G.split_cgi("cgi")
    return t["lbs_event"].select(
        "event_id", G.cell_key(parts["lac"], parts["cell_id"]).alias("cell_key"), G.full_cell_key("cgi").alias("full_key")
    )


@check("g8_with_coords", """
select event_id, lon_s::double as lat, lat_s::double as lon, cast(lon_s::double as varchar) || ',' || cast(lat_s::double as varchar) as location from lbs_event""")
def g8(t):
    return G.with_coords(t["lbs_event"], F.col("lon_s").cast("double"), F.col("lat_s").cast("double")).select(
        "event_id", "lat", "lon", "location"
    )


_HOLED = """
select id, concat('MULTIPOLYGON (((', cast(x0 as string), ' ', cast(y0 as string), ', ', cast(x0 as string), ' ', cast(y0 + 8 as string), ', ',
  cast(x0 + 8 as string), ' ', cast(y0 + 8 as string), ', ', cast(x0 + 8 as string), ' ', cast(y0 as string), ', ', cast(x0 as string), ' ', cast(y0 as string),
  '), (', cast(x0 + 1 as string), ' ', cast(y0 + 1 as string), ', ', cast(x0 + 1 as string), ' ', cast(y0 + 2 as string), ', ',
  cast(x0 + 2 as string), ' ', cast(y0 + 2 as string), ', ', cast(x0 + 2 as string), ' ', cast(y0 + 1 as string), ', ', cast(x0 + 1 as string), ' ', cast(y0 + 1 as string),
  ')), ((', cast(x0 + 20 as string), ' ', cast(y0 as string), ', ', cast(x0 + 21 as string), ' ', cast(y0 as string), ', ', cast(x0 + 20 as string), ' ', cast(y1 as string),
  ', ', cast(x0 + 20 as string), ' ', cast(y0 as string), ')))') as wkt, x0, y0, x1, y1
from box"""


@check("g9_polygon_area", "select id, 63.0 + (y1 - y0) / 2.0 as holed_area, cast((x1 - x0) * (y1 - y0) as double) as box_area, 0.0::double as line_area from box")
def g9(t):
    holed = t.sql(_HOLED).select("id", Y.wkt_area("wkt").alias("holed_area"))
    line = t["box_wkt"].select("id", "wkt", F.concat(F.lit("LINESTRING "), F.regexp_extract("wkt", r"\((\(.*\))\)", 1)).alias("line"))
    return holed.join(line.select("id", Y.wkt_area("wkt").alias("box_area"), Y.wkt_area("line").alias("line_area")), "id")


_PAIR_COMMON = "(greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0)))"


def _ring(p: str) -> str:
    corner = {"ll": ("x0", "y0"), "lr": ("x1", "y0"), "ur": ("x1", "y1"), "ul": ("x0", "y1")}
    points = ", ', ', ".join(
        f"cast({p}{corner[k][0]} as string), ' ', cast({p}{corner[k][1]} as string)" for k in ("ll", "lr", "ur", "ul", "ll")
    )
    return f"concat('POLYGON ((', {points}, '))')"


# Geometry costs far more a row than the size of its file tells; rebalanced, a table of few file splits is dealt over all tasks.
_PAIR = f"select /*+ rebalance */ a_id, b_id, {_ring('a')} as a_wkt, {_ring('b')} as b_wkt from box_pair"


def _pairs(t):
    return t.sql(_PAIR)


@check("g10_coverage_ratio", f"select a_id, b_id, round({_PAIR_COMMON} / ((bx1 - bx0) * (by1 - by0) + 0.0), 9) + 0.0 as coverage from box_pair")
def g10(t):
    covered = S.with_coverage(_pairs(t), "a_wkt", "b_wkt")
    return covered.select("a_id", "b_id", r("coverage", 9).alias("coverage"))


@check("g11_size_diff", """
select a_id, b_id, round(abs((ax1 - ax0) * (ay1 - ay0) - (bx1 - bx0) * (by1 - by0)) / ((bx1 - bx0) * (by1 - by0) + 0.0), 9) + 0.0 as diff from box_pair""")
def g11(t):
    return _pairs(t).select("a_id", "b_id", r(Y.size_diff("a_wkt", "b_wkt"), 9).alias("diff"))


_MEET = "(ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1)"
_INTERIORS = "(ax0 < bx1 and bx0 < ax1 and ay0 < by1 and by0 < ay1)"
_A_HAS_B = "(ax0 <= bx0 and ay0 <= by0 and ax1 >= bx1 and ay1 >= by1)"
_B_HAS_A = "(bx0 <= ax0 and by0 <= ay0 and bx1 >= ax1 and by1 >= ay1)"
_RELATION_SQL = {
    "g12a_contains": ("contains", _A_HAS_B),
    "g12b_within": ("within", _B_HAS_A),
    "g12c_overlaps": ("overlaps", f"({_INTERIORS} and not {_A_HAS_B} and not {_B_HAS_A})"),
    "g12d_touches": ("touches", f"({_MEET} and not {_INTERIORS})"),
    "g12f_disjoint": ("disjoint", f"(not {_MEET})"),
}


def _register_relation(name: str, relation: str, sql: str) -> None:
    @check(name, f"select a_id, b_id, {sql} as {relation} from box_pair")
    def query(t):
        return S.with_relation(_pairs(t), "a_wkt", "b_wkt", relation).select("a_id", "b_id", relation)


for _name, (_relation, _sql) in _RELATION_SQL.items():
    _register_relation(_name, _relation, _sql)


# A level line through the middle height of the first box, from its left side to the right side of the second.
@check("g12e_crosses", """
select a_id, b_id, (bx0 < ax1 and bx1 > ax0 and ay0 + 0.5 > by0 and ay0 + 0.5 < by1 and (ax0 < bx0 or ax1 > bx1)) as crosses from box_pair""")
def g12e(t):
    line = "concat('LINESTRING (', cast(ax0 as string), ' ', cast(ay0 as string), '.5, ', cast(ax1 as string), ' ', cast(ay0 as string), '.5)')"
    pairs = t.sql(f"select /*+ rebalance */ a_id, b_id, {line} as line, {_ring('b')} as b_wkt from box_pair")
    return S.with_relation(pairs, "line", "b_wkt", "crosses").select("a_id", "b_id", "crosses")


@check("g13a_distance", """
select a_id, b_id, round(sqrt(pow(greatest(0, ax0 - bx1, bx0 - ax1), 2) + pow(greatest(0, ay0 - by1, by0 - ay1), 2)), 6) + 0.0 as distance from box_pair""")
def g13a(t):
    return S.with_distance(_pairs(t), "a_wkt", "b_wkt").select("a_id", "b_id", r("distance").alias("distance"))


# Along the equator a geodesic is an arc of the circle of the long half axis.
@check("g13b_geodesic_distance", """
select event_id, 'along the equator' as way, round(6378137.0 * radians(abs(lon_s::double - 100.0)), 3) + 0.0 as distance_m from lbs_event
union all select event_id, 'to the pole' as way, 10001965.729 as distance_m from lbs_event""")
def g13b(t):
    points = t["lbs_event"].select(
        "event_id", F.concat(F.lit("POINT ("), "lon_s", F.lit(" 0)")).alias("a"), F.lit("POINT (100 0)").alias("b")
    )
    # A quarter of a meridian has a known length, wherever it starts on the equator.
    poles = points.select("event_id", "a", F.lit("POINT (0 90)").alias("b"), F.lit("to the pole").alias("way"))
    points = points.withColumn("way", F.lit("along the equator")).unionByName(poles)
    return S.with_geodesic(points, "a", "b").select("event_id", "way", r("distance_m", 3).alias("distance_m"))


@check("g14_wkt_parse", """
select id, case when kind = 0 then 'POLYGON' else 'LINESTRING' end as type, case when kind = 0 then 1 end as polygons, case when kind = 0 then 5 end as points,
  case when kind = 0 then x0::double end as x0, case when kind = 0 then y0::double end as y0, case when kind = 0 then x1::double end as x1, case when kind = 0 then y1::double end as y1 from box""")
def g14(t):
    text = F.when(F.col("kind") == 0, F.col("wkt")).otherwise(
        F.regexp_replace(F.regexp_replace("wkt", "POLYGON \\(", "  LineString "), "\\)\\)$", ")")
    )
    shaped = t["box_wkt"].select("id", text.alias("wkt")).withColumn("p", Y.wkt_polygons("wkt"))
    some = F.col("p").isNotNull()
    box = Y.bbox("p")
    return shaped.select(
        "id",
        Y.geometry_type("wkt").alias("type"),
        F.when(some, F.size("p")).alias("polygons"),
        F.when(some, F.size(F.flatten(F.flatten("p")))).alias("points"),
        *[F.when(some, box[k]).alias(k) for k in ("x0", "y0", "x1", "y1")],
    )


@check("g17_sensor_code", """
with s as (select event_id, case event_id % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 else 10 end as code from events)
select event_id, case code when 0 then 'Unknown' when 1 then 'CellTower' when 2 then 'Wifi' when 3 then 'GPS' else 'Interpolated' end as name, code as code from s""")
def g17(t):
    coded = t.sql("select event_id, case event_id % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 else 10 end as c from events")
    return coded.select("event_id", G.sensor_name("c").alias("name"), G.sensor_code(G.sensor_name("c")).alias("code"))


# ---------------------------------------------------------------- joins of polygon tables


def _tables(t):
    lines = t["box_wkt"]
    cell_lines = lines.where("kind = 0").select(F.concat_ws("\t", F.concat(F.lit("c"), "id"), "wkt").alias("value"))
    area_lines = lines.where("kind = 1").select(
        F.concat_ws("\t", F.lit("x"), F.concat(F.lit("u"), "id"), F.lit("y"), "wkt").alias("value")
    )
    return wkt_table(cell_lines, 1), wkt_table(area_lines, 3)


_SPATIAL = """
from box a join box b on a.kind = 0 and b.kind = 1 and {on}"""
_COVERS_SQL = _SPATIAL.format(on="a.x0 <= b.x0 and a.y0 <= b.y0 and a.x1 >= b.x1 and a.y1 >= b.y1")
_TOUCH_SQL = _SPATIAL.format(on="a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1")
_SHARE = "((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) / ((a.x1 - a.x0) * (a.y1 - a.y0) + 0.0)"


@check("j6_spatial_containment_join", f"select concat('c', a.id) as cell, concat('x', chr(9), 'u', b.id, chr(9), 'y') as geo_unit {_COVERS_SQL}")
def j6(t):
    return C.cell_coverage_pairs(*_tables(t)).select("cell", "geo_unit")


@check("j6_spatial_intersection_join", f"""
select concat('c', a.id) as cell, concat('x', chr(9), 'u', b.id, chr(9), 'y') as geo_unit, round({_SHARE}, 9) + 0.0 as percentage {_TOUCH_SQL}""")
def j6_intersects(t):
    pairs = C.cell_coverage_pairs(*_tables(t), predicate="intersects")
    return pairs.select("cell", "geo_unit", r("percentage", 9).alias("percentage"))


# Half of the areas in one city: leaves of the tree follow the crowd.
@check("j6_crowded_city", """
select z.id as zone, s.id as site, round(s.area / z.area, 12) + 0.0 as share
from (select *, (x1 - x0) * (y1 - y0) as area from zone) z join (select *, (x1 - x0) * (y1 - y0) as area from site) s
  on z.x0 <= s.x0 and z.y0 <= s.y0 and z.x1 >= s.x1 and z.y1 >= s.y1""")
def j6_city(t):
    zones = t.sql(f"select id as zone, {_ring('')} as zone_wkt from zone")
    sites = t.sql(f"select id as site, {_ring('')} as site_wkt from site")
    pairs = S.spatial_join(zones, sites, "zone_wkt", "site_wkt")
    return pairs.select("zone", "site", r(S.coverage_ratio(), 12).alias("share"))


_LIST = f"""
with p as (select concat('c', a.id) as cell, concat('x', chr(92), 't', 'u', b.id, chr(92), 't', 'y') as unit, concat('x', chr(9), 'u', b.id, chr(9), 'y') as unit_raw, {_SHARE} as share, floor(b.x0 / 16.0)::bigint as tile_x, floor(b.y0 / 16.0)::bigint as tile_y {_COVERS_SQL})
select cell, tile_x, tile_y, concat('[', string_agg(concat('{{"geoUnit":"', unit, '","percentage":', cast(round(share, 6) as varchar), '}}'), ',' order by unit_raw), ']') as coverage
from p group by cell, tile_x, tile_y"""


def _coarse_share(pairs):
    return pairs.withColumn("percentage", F.round("percentage", 6))


@check("a16_coverage_list", _LIST)
def a16(t):
    pairs = _coarse_share(C.cell_coverage_pairs(*_tables(t), tile=16))
    return S.coverage_lists(pairs, "cell", "geo_unit", by=("tile_x", "tile_y"))


@check("e9_job_cell_coverage", f"select cell, tile_x, tile_y, concat(cell, '|', coverage) as value from ({_LIST}) l")
def e9(t):
    return C.cell_coverage(*_tables(t), tile=16, digits=6)


# ---------------------------------------------------------------- Esri polygons

_BOX_TEXT = """concat('POLYGON ((', x0, ' ', y0, ', ', x0, ' ', y1, ', ', x1, ' ', y1, ', ', x1, ' ', y0, ', ', x0, ' ', y0, '))')"""


@check("x8_esri_to_wkt", f"""
select id, case when x1 - x0 in (4, 5) then '' else {_BOX_TEXT} end as quoted_wkt, case when x1 - x0 in (4, 5) then 'POLYGON EMPTY' else {_BOX_TEXT} end as plain_wkt from box""")
def x8(t):
    polygons = t["esri_line"].withColumn("quoted", F.get(F.split("value", "\\|", -1), F.lit(1)))
    polygons = polygons.withColumn("plain", F.regexp_replace("quoted", '^"|"$', ""))
    return polygons.select(
        "id",
        esri.esri_to_wkt("quoted", on_error="", quoted=True).alias("quoted_wkt"),
        esri.esri_to_wkt("plain").alias("plain_wkt"),
    )


# A collection of the first box, a point far to the left of it and, nested, a line along its lower side that goes on for two.
@check("g12_collections", f"""
select a_id, b_id, ({_MEET} or (by0 <= ay0 and by1 >= ay0 and bx0 <= ax1 + 2 and bx1 >= ax0)) as intersects, round(least(
    sqrt(pow(greatest(0, bx0 - ax1, ax0 - bx1), 2) + pow(greatest(0, by0 - ay1, ay0 - by1), 2)), sqrt(pow(greatest(0, bx0 - ax0 + 1000, ax0 - 1000 - bx1), 2) + pow(greatest(0, by0 - ay0, ay0 - by1), 2)),
    sqrt(pow(greatest(0, bx0 - ax1 - 2, ax0 - bx1), 2) + pow(greatest(0, by0 - ay0, ay0 - by1), 2))), 9) + 0.0 as distance from box_pair""")
def g12_collections(t):
    line = "concat('LINESTRING (', cast(ax0 as string), ' ', cast(ay0 as string), ', ', cast(ax1 + 2 as string), ' ', cast(ay0 as string), ')')"
    point = "concat('POINT (', cast(ax0 - 1000 as string), ' ', cast(ay0 as string), ')')"
    both = t.sql(f"select /*+ rebalance */ a_id, b_id, concat('GEOMETRYCOLLECTION (', {_ring('a')}, ', ', {point}, ', GEOMETRYCOLLECTION (', {line}, '))') as a_wkt, {_ring('b')} as b_wkt from box_pair")
    related = S.with_distance(S.with_relation(both, "a_wkt", "b_wkt", "intersects"), "a_wkt", "b_wkt")
    return related.select("a_id", "b_id", "intersects", r("distance", 9).alias("distance"))


# ---------------------------------------------------------------- functions by name in SQL

_TWO_RADII = f"""
with place as (select distinct agent_id, geo_unit_id from staypoint), one as (select agent_id, min(home) as home from homework where home <> 'NA' group by agent_id)
select p.agent_id, max({unit_distance_sql('p.geo_unit_id', 'o.home')}) as metres from place p join one o on p.agent_id = o.agent_id group by 1"""


@check("sql_functions", f"""
with radius as ({_TWO_RADII}),
copies as (select w.agent_id, count(*) as n from weight w join range(0, 4) k(i) on k.i < try_cast(w.weight as int) group by 1)
select 'overlap' as what, id::varchar as id, null as id2, cast(greatest(0, epoch(least(out_ts, in_ts + interval 36 hour)) - epoch(greatest(in_ts, in_ts + interval 12 hour))) as double) as number, null as text from stay_interval
union all select 'home_work', agent_id, home, round({unit_distance_sql('home', 'work')}, 3) + 0.0, null from homework
union all select 'radius', agent_id, null, round(metres, 3) + 0.0, null from radius
union all select 'copies', agent_id, null, n, null from copies
union all select 'size_diff', a_id::varchar, b_id::varchar, round(abs((ax1 - ax0) * (ay1 - ay0) - (bx1 - bx0) * (by1 - by0)) / ((bx1 - bx0) * (by1 - by0) + 0.0), 9) + 0.0, null from box_pair
union all select 'area', id::varchar, null, (x1 - x0) * (y1 - y0), null from box
union all select 'esri', id::varchar, null, null, case when x1 - x0 in (4, 5) then 'POLYGON EMPTY' else {_BOX_TEXT} end from box
union all select 'contains', a_id::varchar, b_id::varchar, {_A_HAS_B}::int, null from box_pair
union all select 'distance', a_id::varchar, b_id::varchar, round(sqrt(pow(greatest(0, bx0 - ax1, ax0 - bx1), 2) + pow(greatest(0, by0 - ay1, ay0 - by1), 2)), 9) + 0.0, null from box_pair""")
def sql_functions(t):
    register(t.spark)
    return t.sql(f"""
select 'overlap' as what, cast(id as string) as id, cast(null as string) as id2,
  cast(overlap_seconds(in_ts, out_ts, in_ts + interval '12' hour, in_ts + interval '36' hour) as double) as number, cast(null as string) as text from stay_interval
union all select 'home_work', agent_id, home, round(home_work_m(home, work), 3) + 0.0D, null from homework
union all select 'radius', agent_id, null, round(radius_m(geo_units, home), 3) + 0.0D, null from
  (select s.agent_id, any_value(o.home) as home, collect_set(s.geo_unit_id) as geo_units
   from staypoint s join (select agent_id, min(home) as home from homework where home <> 'NA' group by agent_id) o on s.agent_id = o.agent_id group by s.agent_id)
union all select 'copies', agent_id, null, cast(count(*) as double), null from weight, lateral weight_copies(weight) group by agent_id
union all select 'size_diff', cast(a_id as string), cast(b_id as string), round(size_diff(a_wkt, b_wkt), 9) + 0.0D, null from ({_PAIR})
union all select 'area', cast(id as string), null, wkt_area(wkt), null from box_wkt
union all select 'esri', cast(id as string), null, null, esri_wkt(split_part(value, '|', 2)) from esri_line
union all select 'contains', cast(a_id as string), cast(b_id as string), cast(cast(geo_contains(a_wkt, b_wkt) as int) as double), null from ({_PAIR})
union all select 'distance', cast(a_id as string), cast(b_id as string), round(geo_distance(a_wkt, b_wkt), 9) + 0.0D, null from ({_PAIR})""")
