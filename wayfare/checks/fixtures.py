"""Inputs of the operators, derived from the given tables by SQL that Spark and DuckDB read alike.

Faulty values are part of the inputs: short lines, bad times, missing coordinates, unknown cells, ``NA`` places,
unreadable weights, unmapped codes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "lbs_event": """
select event_id, concat('A', cast(user_id as string)) as agent_id, event_type, ts,
  cast(date_trunc('second', ts) as string) as ts_s,
  concat('505-02-', cast(100 + event_id % 10 as string), '-', cast(1 + event_id % 40 as string)) as cgi,
  concat('1.', lpad(cast(200 + (event_id * 7) % 280 as string), 3, '0')) as lat_s,
  concat('103.', lpad(cast(600 + event_id % 400 as string), 3, '0')) as lon_s
from events""",
    # One agent has half of all events.
    "lbs_crowd": """
select event_id, case when event_id % 2 = 0 then 'A0' else agent_id end as agent_id, ts_s, cgi, lat_s, lon_s
from lbs_event""",
    "lbs_line": """
select event_id, case
    when event_id % 23 = 0 then concat_ws('|', ts_s, agent_id, 'short')
    when event_id % 19 = 0 then concat_ws('|', 'not-a-time', agent_id, 'm', cgi, event_type, lat_s, lon_s, 'imei')
    when event_id % 17 = 0 then concat_ws('|', ts_s, agent_id, 'm', cgi, event_type, '', lon_s, 'imei')
    else concat_ws('|', ts_s, agent_id, 'm', cgi, event_type, lat_s, lon_s, 'imei') end as value
from lbs_event""",
    "cell": """
select cgi, min(lat_s) as lat_s, max(lon_s) as lon_s
from lbs_event where split_part(cgi, '-', 3) <> '107' group by cgi""",
    "cell_line": """
select cgi, case when lat_s < '1.23' then concat_ws('|', cgi, 's', 'n', lat_s, lon_s, 'short')
    else concat_ws('|', cgi, 's', 'n', lat_s, lon_s, 'a', 'b', 'c', 'd',
      case when lat_s < '1.25' then 'true' else 'no flag' end, 'false', case when lon_s < '103.97' then '' else 'Tower' end)
  end as value
from cell""",
    "staypoint": "select agent_id, concat('g_1_2_', lon_s, '_', lat_s) as geo_unit_id from lbs_event",
    "homework": """
select distinct concat('A', cast(user_id as string)) as agent_id,
  case when user_id % 7 = 0 then 'NA' else concat('g_1_2_103.', lpad(cast(600 + (user_id * 37) % 400 as string), 3, '0'), '_1.', lpad(cast(200 + (user_id * 11) % 280 as string), 3, '0')) end as home,
  case when user_id % 11 = 0 then 'NA' else concat('g_1_2_103.', lpad(cast(600 + (user_id * 53) % 400 as string), 3, '0'), '_1.', lpad(cast(200 + (user_id * 29) % 280 as string), 3, '0')) end as work
from events""",
    "geo_hierarchy": """
select home as geo_hierarchy_base_id,
  concat('sa1_', substr(home, 11, 2)) as sa1,
  concat('sa2_', substr(home, 12, 1)) as sa2,
  concat('sa3_', substr(home, 13, 1)) as sa3,
  concat('gcc_', substr(home, 11, 1)) as gcc,
  case when substr(home, 11, 1) < '8' then '1' else '2' end as state
from homework where home <> 'NA' group by home""",
    "weight": """
select distinct concat('A', cast(user_id as string)) as agent_id,
  case when user_id % 13 = 0 then 'x' else cast(user_id % 4 as string) end as weight
from events""",
    "denorm_links": """
select o_orderkey, concat('C', cast(o_custkey as string)) as agent_id,
  case o_orderkey % 4 when 0 then 'TRAIN' when 1 then 'RAIL' when 2 then 'BUS' else 'CAR' end as mode,
  concat(case when o_custkey % 2 = 0 then 'NSW' else 'VIC' end, '-', cast(o_orderkey % 100 as string)) as link_id
from orders""",
    "trips": """
select o_orderkey as trip_id, case o_orderkey % 3 when 0 then 'sa2_sa2' when 1 then 'sa3_sa3' else 'gcc_gcc' end as category,
  o_totalprice as metric from orders""",
    "inventory": """
select p_partkey, case when p_partkey % 29 = 0 then null else cast(100 + p_partkey % 50 as string) end as lac,
  case p_partkey % 3 when 0 then 'UMTS' when 1 then 'LTE' else 'GSM' end as technology,
  case when p_partkey % 31 = 0 then null else cast(p_partkey % 97 as string) end as sac_id,
  cast(p_partkey % 89 as string) as cell_id,
  case when p_size % 5 = 0 then 'In Building' else 'Macro' end as site_type,
  case when p_size % 7 = 0 then 'RETIRED' else 'ACTIVE' end as cell_status
from part""",
    "stay_interval": """
select o_orderkey as id, o_custkey as grp, date_trunc('second', o_orderdate) as in_ts,
  date_trunc('second', o_orderdate) + interval '1' day * (o_orderkey % 5) as out_ts
from orders""",
    "route_line": """
select o_orderkey as id, concat(
    case when o_orderkey % 2 = 0 then 'WEEKDAY' else 'WEEKEND' end, chr(9), '08:00:00', chr(9),
    chr(34), 'S', cast(o_custkey % 20 as string), chr(34), chr(9), 'S', cast(o_orderkey % 25 as string), chr(9),
    '08:00:00,103.5,1.25,08:10:00,103.75,1.5,',
    case o_orderkey % 3 when 0 then 'TRAIN' when 1 then 'WALK' else 'TRAM' end, ',r',
    cast(o_orderkey % 9 as string),
    case when o_orderkey % 13 = 0 then ';bad,leg' else ';08:10:00,103.75,1.5,08:20:00,104.5,1.75,TRAIN,r1' end) as value
from orders""",
    "id_map": "select distinct concat('S', cast(o_custkey % 20 as string)) as sub_mtz, cast(1000 + o_custkey % 20 as string) as id from orders",
    "route_area": """
select distinct concat('S', cast(o_custkey % 20 as string)) as sa1, case when o_custkey % 20 < 12 then '1' else '2' end as state
from orders""",
    "box": """
select p_partkey as id, p_partkey % 2 as kind,
  (p_partkey * 3) % 40 as x0, cast(floor(p_partkey / 20) as bigint) as y0,
  (p_partkey * 3) % 40 + 1 + p_size % 6 as x1, cast(floor(p_partkey / 20) as bigint) + 1 + p_size % 4 as y1
from part""",
    "box_wkt": """
select id, kind, concat('POLYGON ((', cast(x0 as string), ' ', cast(y0 as string), ', ', cast(x1 as string), ' ', cast(y0 as string), ', ',
  cast(x1 as string), ' ', cast(y1 as string), ', ', cast(x0 as string), ' ', cast(y1 as string), ', ', cast(x0 as string), ' ', cast(y0 as string), '))') as wkt
from box""",
    # Neighbours in id order, and boxes of the same column forty ids on: two partners for each box.
    "box_pair": """
select a.id as a_id, b.id as b_id, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1,
  b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1
from box a join (
  select id - 1 as partner, id, x0, y0, x1, y1 from box union all select id - 40 as partner, id, x0, y0 - 2, x1, y1 - 2 from box
) b on a.id = b.partner""",
    "esri_line": """
select id, concat(cast(id as string), '|', case
    when x1 - x0 = 5 then '{}'
    when x1 - x0 = 4 then concat(chr(34), '{', chr(92), chr(34), 'rings', chr(92), chr(34), ':oops}', chr(34))
    else concat(chr(34), '{', chr(92), chr(34), 'rings', chr(92), chr(34), ':[[[', cast(x0 as string), ',', cast(y0 as string), '],[',
      cast(x0 as string), ',', cast(y1 as string), '],[', cast(x1 as string), ',', cast(y1 as string), '],[',
      cast(x1 as string), ',', cast(y0 as string), '],[', cast(x0 as string), ',', cast(y0 as string), ']]]}', chr(34)) end) as value
from box""",
    # Half of the sites stand in one small city, and so do a tenth of the zones; one zone holds the whole city.
    "site": """
select id, x0, y0, x0 + 1 + id % 3 as x1, y0 + 1 + id % 2 as y1 from (select o_orderkey as id,
  case when o_orderkey % 2 = 0 then 100000 + (o_orderkey * 7919) % 1000 else (o_orderkey * 104729) % 200000 end as x0,
  case when o_orderkey % 2 = 0 then 100000 + (o_orderkey * 6101) % 1000 else (o_orderkey * 15485863) % 200000 end as y0 from orders) s""",
    "zone": """
select id, x0, y0, x0 + side as x1, y0 + side as y1 from (select c_custkey as id,
  case when c_custkey = 100 then 99990 when c_custkey % 10 = 0 then 100000 + c_custkey % 900 else (c_custkey * 7919) % 200000 end as x0,
  case when c_custkey = 100 then 99990 when c_custkey % 10 = 0 then 100000 + (c_custkey * 31) % 900 else (c_custkey * 3571) % 200000 end as y0,
  case when c_custkey = 100 then 1020 when c_custkey % 10 = 0 then 20 + c_custkey % 40 else 40 * (1 + c_custkey % 50) end as side from customer) z""",
    "box_geojson": """
select id, kind, concat('{"type":"Polygon","coordinates":[[[', cast(x0 as string), '.0,', cast(y0 as string), '.0],[', cast(x1 as string), '.0,', cast(y0 as string),
  '.0],[', cast(x1 as string), '.0,', cast(y1 as string), '.0],[', cast(x0 as string), '.0,', cast(y1 as string), '.0],[', cast(x0 as string), '.0,', cast(y0 as string), '.0]]]}') as geometry
from box""",
    "feature_doc": """
select id, kind, geometry, concat('{"type":"FeatureCollection","features":[{"type":"Feature","id":"b', cast(id as string),
  '","properties":{"name":"box ', cast(id as string), '","kind":', cast(kind as string), '},"geometry":', geometry,
  '},{"type":"Feature","properties":{"name":"', case when kind = 0 then 'cell' else 'area' end, '"},"geometry":', geometry, '}]}') as value
from box_geojson""",
}

_NAME = re.compile(r"[a-z_][a-z_0-9]*")


def _needed(sql: str) -> list[str]:
    """Views a text refers to, in order of definition, with the views those need."""
    wanted: set[str] = set()
    open_texts = [sql]
    while open_texts:
        for name in set(_NAME.findall(open_texts.pop())):
            if name in VIEWS and name not in wanted:
                wanted.add(name)
                open_texts.append(VIEWS[name])
    return [name for name in VIEWS if name in wanted]


def with_views(sql: str, bases: dict[str, str] | None = None) -> str:
    """The text with the views it needs as common table expressions."""
    text = sql.strip()
    parts = [f"{name} as ({body})" for name, body in (bases or {}).items()]
    parts += [f"{name} as ({VIEWS[name].strip()})" for name in _needed(text)]
    if not parts:
        return text
    if text.lower().startswith("with "):
        return "with " + ", ".join(parts) + ", " + text[5:]
    return "with " + ", ".join(parts) + " " + text


class Inputs:
    """Tables and derived inputs of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.sql(f"select * from {name}")

    def sql(self, text: str) -> DataFrame:
        views = " ".join(VIEWS[name] for name in _needed(text))
        used = set(_NAME.findall(text)) | set(_NAME.findall(views))
        bases = {
            table: f"select * from parquet.`{self.folder}/{table}.parquet`" for table in BASE_TABLES if table in used
        }
        return self.spark.sql(with_views(text, bases))
