"""Sources and sinks: write derived inputs to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare import schemas as S
from wayfare.checks.registry import check, r
from wayfare.checks.table_checks import _LEVELS_SQL, _PARSES, updates
from wayfare.operators import quality
from wayfare.plans.cells import cell_inventory
from wayfare.plans.movement import movement_index_by_level, store_by_agent, write_levels
from wayfare.session import scratch_path
from wayfare.sources import readers as R
from wayfare.sources import writers as K
from wayfare.streaming.slots import slot_centroids, write_slots


def _inventory_file(t):
    """The inventory as a headerless pipe file of 28 columns."""
    inventory = t["inventory"].withColumns(
        {"site_id": F.col("p_partkey").cast("string"), "cell_lat": F.lit(-33.5), "antenna_azimuth": F.col("p_partkey").cast("int")}
    )
    columns = [
        F.col(f.name) if f.name in inventory.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in S.CELL_INVENTORY.fields
    ]
    path = scratch_path(t.spark, "inventory")
    K.write_csv(inventory.select(*columns), path, delimiter="|", header=False)
    return path


_FILLED = {
    "site_id": "cast(p_partkey as varchar)", "lac": "lac", "technology": "technology", "sac_id": "sac_id", "cell_id": "cell_id",
    "site_type": "site_type", "cell_status": "cell_status", "cell_lat": "-33.5::double", "antenna_azimuth": "p_partkey::int",
}
_SQL_TYPES = {"string": "varchar", "double": "double", "int": "int"}
_EVERY_COLUMN = ", ".join(
    f"{_FILLED.get(f.name, 'null::' + _SQL_TYPES[f.dataType.simpleString()])} as {f.name}" for f in S.CELL_INVENTORY.fields
)


@check("s1_read_csv_typed", f"select {_EVERY_COLUMN} from inventory")
def s1(t):
    return R.read_csv_typed(t.spark, _inventory_file(t), S.CELL_INVENTORY, "|")


@check("s2_read_parquet_typed", "select agent_id, weight from weight")
def s2(t):
    path = scratch_path(t.spark, "weights")
    K.write_parquet(t["weight"], path)
    return R.read_parquet_typed(t.spark, path, S.WEIGHT)


# Avro itself needs Spark's avro module, which is no part of the plain distribution; the reader is the same for every self-describing format.
@check("s3_read_orc_typed", "select sub_mtz, id from id_map")
def s3(t):
    path = scratch_path(t.spark, "ids")
    t["id_map"].write.orc(path)
    return R.read_typed(t.spark, path, S.ID_MAP, fmt="orc")


@check("s4_read_default", "select agent_id, geo_unit_id from staypoint")
def s4(t):
    path = scratch_path(t.spark, "staypoint")
    K.write_parquet(t["staypoint"], path)
    return R.read_default(t.spark, path)


@check("s5_read_csv_header", "select sub_mtz, id from id_map")
def s5(t):
    path = scratch_path(t.spark, "ids")
    K.write_csv(t["id_map"], path)
    return R.read_csv_header(t.spark, path)


@check("s6_read_csv_positional", "select agent_id, try_cast(weight as int) as w from weight")
def s6(t):
    path = scratch_path(t.spark, "weights")
    K.write_csv(t["weight"], path, header=False)
    from wayfare.plans.movement import weight_number

    return R.read_weights(t.spark, path).select("agent_id", weight_number().alias("w"))


@check("s7_read_text_lines", "select value from lbs_line")
def s7(t):
    path = scratch_path(t.spark, "lines")
    K.write_text(t["lbs_line"], "value", path)
    return R.read_text_lines(t.spark, path)


@check("s8_read_wkt_table", "select wkt, concat('c', id, chr(9), kind) as user_data from box_wkt")
def s8(t):
    path = scratch_path(t.spark, "wkt")
    K.write_text(t["box_wkt"], F.concat_ws("\t", F.concat(F.lit("c"), "id"), "wkt", "kind"), path)
    return R.read_wkt_table(t.spark, path, 1)


@check("s9_resolve_dated_source", """
select trip_id, 'compute' as origin from trips where category = 'sa2_sa2' union all select trip_id, 'archive' as origin from trips where category <> 'sa2_sa2'""")
def s9(t):
    compute, archive = scratch_path(t.spark, "compute"), scratch_path(t.spark, "archive")
    first, rest = t["trips"].where("category = 'sa2_sa2'"), t["trips"].where("category <> 'sa2_sa2'")
    K.write_parquet(first, f"{compute}/lbs/2024-01-01")
    K.write_parquet(rest, f"{archive}/lbs/2024-01-01")
    K.write_parquet(rest, f"{archive}/lbs/2024-01-02")
    roots = (compute, archive)
    assert R.resolve_dated(t.spark, roots, "2024-01-03") is None
    newest = R.read_dated(t.spark, roots, "2024-01-01").select("trip_id", F.lit("compute").alias("origin"))
    older = R.read_dated(t.spark, roots, "2024-01-02").select("trip_id", F.lit("archive").alias("origin"))
    return newest.unionByName(older)


@check("k1_write_csv", "select trip_id, category, metric from trips")
def k1(t):
    path = scratch_path(t.spark, "trips")
    K.write_csv(t["trips"], path, delimiter=";")
    schema = T.StructType().add("trip_id", "long").add("category", "string").add("metric", "double")
    return t.spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


@check("k2_write_csv_append", "select trip_id, category from trips where category in ('sa2_sa2', 'sa3_sa3')")
def k2(t):
    path = scratch_path(t.spark, "trips")
    for category in ("sa2_sa2", "sa3_sa3"):
        K.append_csv(t["trips"].where(F.col("category") == category).select("trip_id", "category"), path)
    return t.spark.read.schema("trip_id long, category string").csv(path)


@check("k3_write_parquet", _LEVELS_SQL)
def k3(t):
    path = scratch_path(t.spark, "levels")
    result = movement_index_by_level(t["staypoint"], t["homework"], t["geo_hierarchy"], t["weight"], "2024-01-31")
    write_levels(result, path)
    return t.spark.read.parquet(path).withColumns({"mean": r("mean"), "median": r("median")})


# The day's visits, homes and weights are kept by agent once; the job then reads the tables.
@check("e2_over_tables_by_agent", _LEVELS_SQL)
def e2_by_agent(t):
    folder = scratch_path(t.spark, "agents")
    names = [f"{kind}_{folder[-32:]}" for kind in ("visits", "homes", "weights")]
    store_by_agent(t["staypoint"], t["homework"], t["weight"], names, buckets=8, folder=folder)
    visits, homes, weights = (t.spark.table(n) for n in names)
    found = movement_index_by_level(visits, homes, t["geo_hierarchy"], weights, "2024-01-31")
    return found.withColumns({"mean": r("mean"), "median": r("median")})


@check("k4_write_text", "select agent_id || '|' || cgi as value from lbs_event")
def k4(t):
    path = scratch_path(t.spark, "text")
    K.write_text(t["lbs_event"], F.concat_ws("|", "agent_id", "cgi"), path)
    return t.spark.read.text(path)


@check("k5_append_metric", """
with c as (select distinct case technology when 'UMTS' then '505-02-' || lac || '-' || coalesce(sac_id, 'null') when 'LTE' then '505-02-' || lac || '-' || cell_id else '' end as full_id, site_type
  from inventory where lac is not null and cell_status = 'ACTIVE'),
m as (select count(*) as cell_count, count(*) filter (where site_type = 'In Building') as in_building_count from c)
select d as date, cell_count, in_building_count from m, (values ('2024-01-01'), ('2024-01-02')) v(d)""")
def k5(t):
    path = scratch_path(t.spark, "metric")
    for date in ("2024-01-01", "2024-01-02"):
        K.append_metric(cell_inventory(t["inventory"], date), path)
    return t.spark.read.schema("date string, cell_count long, in_building_count long").csv(path)


# Three days are written; then the second runs again with other figures and the third has no rows any more. A run replaces its own days only.
@check("k3_rerun_of_a_day", """
with d as (select o_orderkey, o_totalprice, case o_orderkey % 3 when 0 then '2024-01-01' when 1 then '2024-01-02' else '2024-01-03' end as date from orders)
select date, o_orderkey, case when date = '2024-01-02' then o_totalprice * 2 else o_totalprice end as metric from d where date < '2024-01-02' or date > '2024-01-02' or o_orderkey % 2 = 0""")
def k3_rerun(t):
    path = scratch_path(t.spark, "days")
    third = F.col("o_orderkey") % 3
    dated = t["orders"].select("o_orderkey", F.col("o_totalprice").alias("metric"), F.when(third == 0, "2024-01-01").when(third == 1, "2024-01-02").otherwise("2024-01-03").alias("date"))
    K.write_days(dated, path)
    K.write_days(dated.where("date = '2024-01-02' and o_orderkey % 2 = 0").withColumn("metric", F.col("metric") * 2), path)
    return R.read_days(t.spark, path, "o_orderkey long, metric double, date string", "2024-01-01", "2024-01-03").select("date", "o_orderkey", "metric")


@check("k1_rerun_of_a_day_csv", "select trip_id, category, '2024-02-02' as date from trips where category <> 'sa3_sa3'")
def k1_rerun(t):
    path = scratch_path(t.spark, "days")
    trips = t["trips"].select("trip_id", "category")
    for day in ("2024-02-01", "2024-02-02", "2024-02-02"):
        K.write_days(trips.where("category <> 'sa3_sa3'").withColumn("date", F.lit(day)), path, fmt="csv", sep="|")
    return R.read_days(t.spark, path, "trip_id long, category string, date string", "2024-02-02", fmt="csv", sep="|")


# Lines and faults are counted by the pass that writes both kinds; the metric rows come from those counts.
@check("p14_counted_write", f"""
select agent_id, count(*) as good, (select count(*) from lbs_event) as lines, (select count(*) from lbs_event where not ({_PARSES})) as failures,
  (select count(*) from lbs_event where {_PARSES} and event_type = 'click') as clicks from lbs_event where {_PARSES} group by agent_id""")
def p14_counted(t):
    parts = F.split("value", "\\|", -1)
    lines = t["lbs_line"].withColumn("agent_id", F.get(parts, F.lit(1)))
    at = F.when(F.size(parts) >= 8, F.try_to_timestamp(F.get(parts, F.lit(0)), F.lit("yyyy-MM-dd HH:mm:ss")))
    path, metric = scratch_path(t.spark, "lines"), scratch_path(t.spark, "metric")
    counts = quality.write_counted(lines, at, path, conditions={"clicks": F.get(parts, F.lit(4)) == "click"})
    K.append_metric(t.spark.createDataFrame([(counts.rows, counts.failures, counts.others["clicks"])], "lines long, failures long, clicks long"), metric)
    good = t.spark.read.schema("agent_id string, is_valid boolean").parquet(path).where("is_valid").groupBy("agent_id").agg(F.count("*").alias("good"))
    figures = t.spark.read.schema("lines long, failures long, clicks long").csv(metric)
    one = {c: figures.select(F.max(c)).scalar() for c in figures.columns}
    return good.select("agent_id", "good", *[c.alias(n) for n, c in one.items()])


# Slots that the watermark has passed: their end lies at least ten minutes before the latest event.
@check("stream_slot_centroids", """
with e as (select agent_id, ts, time_bucket(interval 300 second, ts) as slot, radians(lat_s::double) as la, radians(lon_s::double) as lo from lbs_event)
select agent_id, strftime(slot, '%Y-%m-%d %H:%M:%S') as slot, count(*) as n,
  round(degrees(atan2(avg(sin(la)), sqrt(pow(avg(cos(la) * cos(lo)), 2) + pow(avg(cos(la) * sin(lo)), 2)))), 6) + 0.0 as centre_lat,
  round(degrees(atan2(avg(cos(la) * sin(lo)), avg(cos(la) * cos(lo)))), 6) + 0.0 as centre_lon
from e group by agent_id, slot having slot + interval 300 second <= (select to_timestamp(epoch_ms(max(ts)) / 1000.0)::timestamp - interval 10 minute from e)""")
def stream_slots(t):
    source, out = scratch_path(t.spark, "updates"), scratch_path(t.spark, "slots")
    K.write_parquet(updates(t).withColumn("at", t_stamp()), source)
    stream = t.spark.readStream.schema(t.spark.read.parquet(source).schema).parquet(source)
    write_slots(slot_centroids(stream, "at"), out, scratch_path(t.spark, "state")).awaitTermination()
    slots = t.spark.read.parquet(out)
    return slots.select(
        "agent_id",
        F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"),
        "n",
        r("centre_lat").alias("centre_lat"),
        r("centre_lon").alias("centre_lon"),
    )


def t_stamp():
    return F.col("timestamp").cast("timestamp")
