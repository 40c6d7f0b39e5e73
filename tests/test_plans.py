"""Properties of physical plans that matter at scale."""

import re

import pytest

from __spark_entry__ import queries
from wayfare.checks.fixtures import Inputs
from wayfare.operators import spatial
from wayfare.plans import cells, extracts, movement
from wayfare.sources.events import parse_events
from wayfare.sources.readers import wkt_table

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield spark
    for name in names:
        spark.conf.unset(name)


JOINS = [
    "e1_job_movement",
    "e2_job_movement_index",
    "e3_job_trajectories",
    "e7_job_route_ids",
    "e10_job_stay_clusters",
    "e11_job_public_transport",
    "j4_lookup_override",
    "j6_spatial_containment_join",
    "j6_spatial_intersection_join",
    "j7_interval_overlap_join",
    "j7_interval_overlap_join_keyless",
    "a8_nearest_rank_percentile",
]


@pytest.mark.parametrize("name", JOINS)
def test_joins_are_equi_joins(no_broadcast, name):
    text = plan(queries()[name](no_broadcast, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "links")
    Inputs(spark, FOLDER)["denorm_links"].write.parquet(path)
    text = plan(extracts.rail_links(spark.read.parquet(path), "NSW"))
    assert re.search(r"PushedFilters: \[.*In\(mode, \[RAIL,TRAIN\]\).*StringContains\(link_id,NSW\)", text)
    assert "ReadSchema: struct<agent_id:string,mode:string,link_id:string>" in text


def test_homework_filter_is_pushed(spark, tmp_path):
    path = str(tmp_path / "homework")
    t = Inputs(spark, FOLDER)
    t["homework"].write.parquet(path)
    index = movement.agent_index(t["staypoint"], spark.read.parquet(path), t["geo_hierarchy"], ["sa2"])
    assert "Not(EqualTo(home,NA)), Not(EqualTo(work,NA))" in plan(index)


def test_python_runs_once_per_pair(spark):
    t = Inputs(spark, FOLDER)
    lines = t["box_wkt"].selectExpr("concat_ws('\t', id, wkt) as value", "kind")
    pairs = cells.cell_coverage_pairs(wkt_table(lines.where("kind = 0"), 1), wkt_table(lines.where("kind = 1"), 1))
    # the common area, and the test of areas without surface
    assert plan(pairs.where("percentage > 0.5")).count("ArrowEvalPython") == 2
    both = t["box_wkt"].selectExpr("wkt as a", "wkt as b")
    tested = spatial.with_relation(both, "a", "b", "contains")
    assert plan(tested.where("contains")).count("ArrowEvalPython") == plan(tested).count("ArrowEvalPython")


def test_lines_are_split_once(spark):
    lines = Inputs(spark, FOLDER)["lbs_line"]
    assert plan(parse_events(lines)).count("split(value") == 1


def test_percentiles_order_nothing_in_windows(spark):
    t = Inputs(spark, FOLDER)
    result = movement.movement_index_by_level(t["staypoint"], t["homework"], t["geo_hierarchy"], t["weight"], "d")
    assert "Window" not in plan(result)


def test_tables_by_agent_need_no_exchange(spark, tmp_path):
    t = Inputs(spark, FOLDER)
    names = ["test_visits", "test_homes", "test_weights"]
    movement.store_by_agent(t["staypoint"], t["homework"], t["weight"], names, buckets=4, folder=str(tmp_path))
    visits, homes, weights = (spark.table(n) for n in names)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pairs = homes.groupBy("agent_id", "home", "work").count()
        places = visits.distinct()
        joined = places.join(pairs, "agent_id").groupBy("agent_id", "home").count().join(weights, "agent_id")
        assert "Exchange" not in plan(joined)
        index = movement.agent_index(visits, homes, t["geo_hierarchy"].hint("broadcast"), ["sa2"])
        assert "hashpartitioning(agent_id" not in plan(movement.weighted_index(index, weights))
        plain = movement.agent_index(t["staypoint"], t["homework"], t["geo_hierarchy"], ["sa2"])
        assert sorted(index.collect()) == sorted(plain.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in names:
            spark.sql(f"drop table {n}")


def test_geometries_are_read_once_and_not_shuffled_to_tiles(spark):
    t = Inputs(spark, FOLDER)
    both = t["box_wkt"].selectExpr("id as a", "wkt as a_wkt"), t["box_wkt"].selectExpr("id as b", "wkt as b_wkt")
    text = plan(spatial.spatial_join(*both, "a_wkt", "b_wkt"))
    assert "regexp_extract" not in text
    pairing = text[text.index("FlatMapGroupsInPandas") :]
    assert "edges" not in pairing.split("Scan parquet")[0] and "wkt" not in pairing.split("Scan parquet")[0]


@pytest.mark.parametrize("name", ["a5_build_trajectory", "a15_time_slot_group", "e3_job_trajectories", "x10_geojson_write"])
def test_nothing_runs_while_a_query_is_built(spark, name):
    """Only the schemas of parquet files are read before the first action."""
    spark.sparkContext.setJobGroup(name, name)
    queries()[name](spark, FOLDER)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds]
    assert all(s is None or s.name.startswith("parquet") or s.numTasks == 1 for s in stages)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["e11_job_nested_routes", "e11_job_public_transport"])
def test_routes_are_not_sent_to_every_task(spark, name):
    """However small their files look; each task builds on its share of the areas."""
    text = plan(queries()[name](spark, FOLDER))
    assert "BroadcastExchange" not in text and re.search(r"ShuffledHashJoin .*BuildRight", text)


@pytest.mark.parametrize("name", ["g12d_touches", "g12e_crosses", "g12f_disjoint", "g12_collections", "sql_functions"])
def test_pairs_are_dealt_over_all_tasks(spark, name):
    """Pairs come from few splits of a small file; geometry begins above the exchange."""
    assert "REBALANCE_PARTITIONS" in plan(queries()[name](spark, FOLDER))


def test_pairs_of_a_crowd_are_not_shuffled(spark):
    t = Inputs(spark, FOLDER)
    both = t["box_wkt"].selectExpr("id as a", "wkt as a_wkt"), t["box_wkt"].selectExpr("id as b", "wkt as b_wkt")
    text = plan(spatial.spatial_join(*both, "a_wkt", "b_wkt"))
    assert "FlatMapGroupsInArrow" in text and "Join" not in text[: text.index("FlatMapGroupsInArrow")]
