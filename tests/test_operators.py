import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayfare.operators import binning, filters, intervals, lookup, percentile, quality, spatial, stays
from wayfare.plans import cells, movement, routes, trajectories
from wayfare.sources.trajectories import format_trajectories, parse_trajectories


def hot_rows(seed=1, n=900):
    """A third of the rows belong to one key, and a third of those are copies of one row."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        key = "hot" if k % 3 == 0 else f"k{rnd.randint(0, 20)}"
        minute = "00:00" if k % 9 == 0 else f"{rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}"
        rows.append((key, f"2024-01-01 {minute}:{0 if k % 9 == 0 else rnd.randint(0, 59):02d}"))
    return rows


def test_trajectories_by_day_make_the_whole_path(spark):
    rows = [(k, 1.5, 2.5, t.replace("01-01", f"01-0{1 + i % 3}"), 1, "c") for i, (k, t) in enumerate(hot_rows())]
    updates = spark.createDataFrame(rows, "agent_id string, lon double, lat double, timestamp string, cell_type int, cell string")
    found = trajectories.build_trajectories(updates).collect()
    assert len({(r.agent_id, r.day) for r in found}) == len(found)
    for agent in {r[0] for r in rows}:
        mine = sorted((r for r in found if r.agent_id == agent), key=lambda r: r.day)
        assert [u.timestamp for r in mine for u in r.updates] == sorted(r[3] for r in rows if r[0] == agent)


def test_visit_lists_by_tile(spark):
    rows = [("a", f"g_1_2_103.{k % 4}5_1.25") for k in range(12)] + [("a", None), ("a", "NA"), ("b", "g_1_2_103.05_1.25")]
    visits = spark.createDataFrame(rows, "agent_id string, geo_unit_id string")
    found = {(r.agent_id, r.tile_lon, r.part): r.geo_units for r in movement.visited_units(visits, size=2).collect()}
    assert found.pop(("a", None, 0)) == ["NA"]
    expected = {("a", 1030 + k, part): n for k in range(4) for part, n in ((0, 2), (1, 1))}
    assert {k: len(v) for k, v in found.items()} == expected | {("b", 1030, 0): 1}


def test_whole_paths_in_bounded_rows(spark):
    rows = [("busy" if k % 3 else f"a{k % 7}", float(k % 11), 1.0, f"2024-01-{k % 28 + 1:02d} 00:00:{k % 60:02d}", 1, f"c{k}") for k in range(500)]
    updates = spark.createDataFrame(rows, "agent_id string, lon double, lat double, timestamp string, cell_type int, cell string").repartition(6)
    plan = trajectories.whole_trajectories(updates)._jdf.queryExecution().toString()
    assert "Window" not in plan and "collect_list" not in plan
    placed = trajectories.whole_trajectories(updates).collect()
    parts = trajectories.path_rows(updates, 40).collect()
    assert max(len(r.updates) for r in parts) == 40
    for agent in {r[0] for r in rows}:
        order = sorted((r[3], r[1], r[2], r[4], r[5]) for r in rows if r[0] == agent)
        mine = sorted((r for r in placed if r.agent_id == agent), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(order))) and [(r.timestamp, r.lon, r.lat, r.cell_type, r.cell) for r in mine] == order
        told = [u for r in sorted((r for r in parts if r.agent_id == agent), key=lambda r: r.part) for u in r.updates]
        assert [(u.timestamp, u.lon, u.lat, u.cell_type, u.cell) for u in told] == order


def brute_percentile(values, p):
    ordered = sorted(values)
    return ordered[max(math.ceil(p * len(ordered)), 1) - 1]


@pytest.mark.parametrize("p", [0, 0.01, 0.5, 0.9, 1])
def test_percentile_against_sorting(spark, p):
    rnd = random.Random(7)
    groups = {
        "wide": [rnd.uniform(-1, 1) * 10 ** rnd.randint(-12, 12) for _ in range(300)],
        "same": [3.25] * 100,
        "signs": [-5.0, -1.0, -0.0, 0.0, 1e-300, 2.0],
        None: [1.0, 2.0, 3.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("wide", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.percentile for r in percentile.nearest_rank_percentile(df, "v", p, ["k"]).collect()}
    assert got == {k: brute_percentile(vs, p) for k, vs in groups.items()}
    alone = percentile.nearest_rank_percentile(df, "v", p).first()["percentile"]
    assert alone == brute_percentile([v for vs in groups.values() for v in vs], p)


def test_percentile_checks_p(spark):
    with pytest.raises(ValueError):
        percentile.nearest_rank_percentile(spark.range(1), "id", 1.5)


def test_weights_equal_repeating(spark):
    rnd = random.Random(9)
    rows = [("hot" if k % 3 == 0 else f"g{k % 5}", rnd.uniform(0, 9), rnd.randint(-1, 6)) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    got = {r.k: r for r in percentile.weighted_summary(df, ["k"], "v", "w").collect()}
    repeated = defaultdict(list)
    for k, v, w in rows:
        repeated[k] += [v] * max(w, 0)
    for k, vs in repeated.items():
        assert got[k].total == len(vs)
        assert got[k].mean == pytest.approx(sum(vs) / len(vs))
        assert got[k].percentile == brute_percentile(vs, 0.5)


def test_weights_that_are_no_numbers(spark):
    weights = spark.createDataFrame([("a", "2"), ("b", "0"), ("c", "-1"), ("d", "x"), ("e", None), ("f", "2.7")], "agent_id string, weight string")
    assert Counter(r.agent_id for r in movement.repeat_by_weight(weights).collect()) == {"a": 2, "f": 2}


def test_a_weight_of_millions_is_made_in_blocks(spark):
    weights = spark.createDataFrame([("a", "3000001"), ("b", "1024"), ("c", "1025"), ("d", "0")], "agent_id string, weight string")
    copies = movement.repeat_by_weight(weights)
    assert {r.agent_id: r["count"] for r in copies.groupBy("agent_id").count().collect()} == {"a": 3_000_001, "b": 1_024, "c": 1_025}


def test_percentile_of_close_values_beside_an_outlier(spark):
    values = [1e6 + k * 1e-9 for k in range(30_000)] + [1e300, float("nan")]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    found = percentile.weighted_summary(frame, [], "v", None, 0.5).first()
    assert (found.total, found.percentile) == (30_002, brute_percentile([*values[:-1], math.inf], 0.5))


def test_counts_of_the_pass_that_writes(spark, tmp_path):
    frame = spark.createDataFrame([("1", 1), ("x", 2), (None, 3), ("4", 4)], "v string, k int")
    counts = quality.write_counted(frame, F.col("v").try_cast("int"), f"{tmp_path}/out", conditions={"even": F.col("k") % 2 == 0, "none": F.col("k") > 9})
    assert (counts.rows, counts.failures, counts.others) == (4, 2, {"even": 1, "none": 0})
    read = spark.read.schema("v string, k int, is_valid boolean").parquet(f"{tmp_path}/out")
    assert {(r.v, r.is_valid) for r in read.collect()} == {("1", True), ("4", True), ("x", False), (None, False)}


def test_overlap_join_against_all_pairs(spark):
    rnd = random.Random(11)

    def rows(n):
        out = []
        for k in range(n):
            start = rnd.randint(0, 100_000)
            length = rnd.choice([0, 0, 1, 60, 3600, 90_000]) * rnd.choice([1, 1, 1, -1])
            out.append((k, "hot" if k % 3 == 0 else f"g{k % 4}", start, start + length))
        return out

    left, right = rows(120), rows(150)
    schema = "id int, g string, i long, o long"

    def table(data, p):
        df = spark.createDataFrame(data, schema)
        return df.select(
            F.col("id").alias(f"{p}_id"), F.col("g").alias(f"{p}_g"), F.timestamp_seconds("i").alias(f"{p}_in"), F.timestamp_seconds("o").alias(f"{p}_out")
        )

    a, b = table(left, "a"), table(right, "b")
    for on in ([("a_g", "b_g")], []):
        got = intervals.overlap_join(a, b, ("a_in", "a_out"), ("b_in", "b_out"), on).collect()
        expected = {
            (x[0], y[0]): min(x[3], y[3]) - max(x[2], y[2])
            for x in left
            for y in right
            if x[2] < y[3] and y[2] < x[3] and (not on or x[1] == y[1])
        }
        assert len(got) == len(expected)
        assert {(r.a_id, r.b_id): r.overlap_s for r in got} == expected


def test_overlap_join_deals_few_candidates_over_all_tasks(spark):
    def table(p, step, length):
        start = F.timestamp_seconds(F.col("id") * step)
        return spark.range(2_000).select(F.col("id").alias(f"{p}_id"), start.alias(f"{p}_in"), (start + F.make_dt_interval(secs=F.lit(length))).alias(f"{p}_out"))

    a, b = table("a", 7, 60), table("b", 7, 300)
    got = intervals.overlap_join(a, b, ("a_in", "a_out"), ("b_in", "b_out"))
    pairs = got.count()
    assert pairs == sum(7 * x < 7 * y + 300 and 7 * y < 7 * x + 60 for x in range(2_000) for y in range(2_000))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan  # not in the tasks of a few files
    sides = [intervals._with_grid(df, (f"{p}_in", f"{p}_out"), f"_{p}") for df, p in ((a, "a"), (b, "b"))]
    levels = [intervals.levels_in(df, f"_{p}_level") for df, p in zip(sides, "ab")]
    left = intervals._slots(sides[0], "_a", levels[1], "role").withColumnsRenamed({"_a_grid": "grid", "_a_t0": "slot"})
    right = intervals._slots(sides[1], "_b", levels[0], "role").withColumnsRenamed({"_b_grid": "grid", "_b_t0": "slot"})
    assert left.count() <= 7 * 2_000 and right.count() <= 7 * 2_000
    assert left.join(right, ["role", "grid", "slot"]).count() < 1.6 * pairs


def test_cells_override_and_ties(spark):
    events = spark.createDataFrame(
        [("e1", "c1", 1.0, 1.0), ("e2", "c1", None, None), ("e3", "c9", 5.0, 6.0), ("e4", "c9", None, 6.0)], "id string, cgi string, lat double, lon double"
    ).withColumn("location", F.lit(None).cast("string"))
    table = spark.createDataFrame([("c1", 2.0, 3.0), ("c1", 2.5, 1.0)], "cgi string, lat double, lon double")
    got = {r.id: (r.lat, r.lon, r.location) for r in lookup.locate_events(events, table).collect()}
    assert got == {"e1": (2.5, 1.0, "2.5,1.0"), "e2": (2.5, 1.0, "2.5,1.0"), "e3": (5.0, 6.0, "5.0,6.0")}


def test_status_bounds(one):
    # Half of the distance is a whole number of metres: 1001 // 2 = 500.
    got = [one(stays.stay_status(F.lit(x), 1001)) for x in (500.0, 500.4, 1000.9, 1001.0)]
    assert got == ["stay", "transit", "transit", "move"]


@pytest.mark.parametrize("centroid, lat", [("mean", 0.25), ("median", 0.0)])
def test_cluster_of_repeated_places(spark, centroid, lat):
    rows = [("a", 0.0, 10.0, k) for k in range(3)] + [("a", 1.0, 10.0, 9)]
    df = spark.createDataFrame(rows, "agent_id string, lat double, lon double, s long").withColumn("at", F.timestamp_seconds("s"))
    row = stays.clusters(df, ["agent_id"], 1000, centroid).first()
    assert row.n == 4 and row.duration_s == 9
    assert row.centre_lat == pytest.approx(lat, abs=1e-4) and row.centre_lon == pytest.approx(10)
    assert row.radius == pytest.approx(111_318 * (1 - lat), rel=1e-3) and row.status == "move"
    with pytest.raises(ValueError):
        stays.clusters(df, ["agent_id"], 1000, "mode")


def test_slot_groups(spark):
    rows = [("a", 1.0, 1.0, f"2024-01-01 00:00:{s:02d}", 1, "c") for s in range(60)] + [("a", 1.0, 1.0, "2024-01-01 00:05:00", 1, "c")]
    df = spark.createDataFrame(rows, "agent_id string, lon double, lat double, timestamp string, cell_type int, cell string")
    got = stays.slot_groups(df).orderBy("slot").collect()
    assert [(r.slot_key, len(r.updates)) for r in got] == [("2024-01-01 00:00:00+0000", 60), ("2024-01-01 00:05:00+0000", 1)]
    assert [u.timestamp for r in got for u in r.updates] == [r[3] for r in rows]


def test_coverage_lists_by_named_columns(spark):
    pairs = spark.createDataFrame([("c", f"u{k:02d}", k / 100, k // 12) for k in range(30)] + [("d", "u1", 0.5, 0)], "cell string, unit string, percentage double, tile int")
    got = spatial.coverage_lists(pairs, "cell", "unit", by=("tile",)).collect()
    assert sorted(r.coverage.count("geoUnit") for r in got) == [1, 6, 12, 12]
    assert [r.coverage for r in got if r.cell == "d"] == ['[{"geoUnit":"u1","percentage":0.5}]']


def test_bins():
    assert binning.equal_splits(0, 10, 4) == [0, 4, 8]
    assert binning.equal_splits(0, 10, 4, extend_last=True) == [0, 4, 8, 10]
    assert binning.equal_splits(0, 0.3, 0.1) == pytest.approx([0, 0.1, 0.2, 0.3])
    with pytest.raises(ValueError):
        binning.equal_splits(0, 10, 0)


def test_bin_edges(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (8.0,)], "v double")
    assert [r.b for r in binning.equal_bin(df, 0, 8, 4, "v", "b").collect()] == [0.0, 1.0, 1.0]
    with pytest.raises(Exception):
        binning.equal_bin(df, 0, 7, 4, "v", "b").collect()


def test_whole_match_includes_line_breaks(one):
    assert one(filters.full_match(F.lit("A1"), "A[0-9]|B"))
    assert not one(filters.full_match(F.lit("A1\n"), "A[0-9]|B"))
    assert not one(filters.full_match(F.lit("A12"), "A[0-9]|B"))


def test_quarantine(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "v string")
    good, bad = quality.quarantine(df, F.col("v").try_cast("int"))
    assert [r.v for r in good.collect()] == ["1"] and {r.v for r in bad.collect()} == {"x", None}
    divided = quality.flag_valid(spark.createDataFrame([(0,), (2,)], "d int"), F.try_divide(F.lit(1), F.col("d")))
    assert [r.is_valid for r in divided.orderBy("d").collect()] == [False, True]


def test_inventory_counts_other_technologies_once_per_site_type(spark):
    rows = [("1", "GSM", "2", "3", "Macro", "ACTIVE"), ("9", "NR", "2", "3", "Macro", "ACTIVE"), ("1", "LTE", "2", "3", "In Building", "ACTIVE"), ("1", "LTE", "2", "4", None, "ACTIVE"), (None, "LTE", "2", "3", "Macro", "ACTIVE")]
    df = spark.createDataFrame(rows, "lac string, technology string, sac_id string, cell_id string, site_type string, cell_status string")
    assert tuple(cells.cell_inventory(df, "d").first()) == ("d", 3, 1)


def movement_tables(spark):
    unit = "g_1_2_103.{:03d}_1.{:03d}".format
    home = spark.createDataFrame(
        [("a", unit(500, 100), unit(600, 100)), ("b", unit(500, 100), unit(500, 101)), ("c", "NA", unit(1, 1)), ("d", "short", unit(1, 1)), ("e", unit(500, 100), unit(700, 100))],
        "agent_id string, home string, work string",
    )
    visits = spark.createDataFrame(
        [("a", unit(500, 100)), ("a", unit(700, 100)), ("a", None), ("b", unit(1, 1)), ("c", unit(1, 1)), ("d", unit(1, 1)), ("e", None)], "agent_id string, geo_unit_id string"
    )
    areas = spark.createDataFrame([(unit(500, 100), "s1", "s2", "g", "1"), (unit(500, 100), "s1b", "s2", "g", "1")], "geo_hierarchy_base_id string, sa1 string, sa2 string, gcc string, state string")
    weights = spark.createDataFrame([("a", "3"), ("b", "2"), ("z", "4"), ("e", "1")], "agent_id string, weight string")
    return visits, home, areas, weights


def test_movement_drops_and_multiplies(spark):
    visits, home, areas, weights = movement_tables(spark)
    got = {(r.level, r.area): r for r in movement.movement_index_by_level(visits, home, areas, weights, "2024-01-01").collect()}
    # Only agent a is left: b works too near, c and d have no usable home, e has no visits. Two dimension rows double it.
    assert {k: r.weighted_agent_num for k, r in got.items()} == {("sa2", "s2"): 6, ("gcc", "g"): 6, ("state", "1"): 6, ("nation", None): 6}
    assert got["nation", None].median == pytest.approx(2, rel=1e-3) and got["nation", None].date == "2024-01-01"
    small = movement.movement_by_area(visits, home, areas, weights, "2024-01-01").collect()
    assert {(r.level, r.area) for r in small} == {("sa1", "s1"), ("sa1", "s1b"), ("sa2", "s2")}


def test_route_without_legs_is_not_public(spark):
    legs = "array<struct<mode:string,route_taken:string>>"
    df = spark.createDataFrame([([],), ([("TRAIN", "r1"), ("FERRY", "r2")],), ([("TRAIN", "r1"), ("WALK", "w")],)], f"route {legs}")
    got = df.select(routes.is_public_transport("route").alias("p"), routes.public_link_id("route").alias("l")).collect()
    assert [tuple(r) for r in got] == [(False, ""), (True, "r1;r2"), (False, "r1")]


def test_nested_candidates(spark):
    from wayfare.schemas import ROUTE_CANDIDATES

    leg = ("08:00", 1.0, 2.0, 3.0, 4.0, "09:00", "TRAIN", "r1")
    row = ("WEEKDAY", "s1", "s2", ["08"], ["09"], [("08:00", "09:00", "p", [leg], 5.0), ("08:00", "09:00", "p", [leg[:7] + ("r2",)], 6.0)])
    df = spark.createDataFrame([row], ROUTE_CANDIDATES)
    areas = spark.createDataFrame([("s1", "1"), ("s1", "1")], "sa1 string, state string")
    got = routes.public_transport_routes(df, areas, legs=routes.candidate_legs()).collect()
    assert [r.public_link_id for r in got] == ["r1;r2"]


def test_median_clusters_read_the_updates_once(spark, tmp_path):
    path = f"{tmp_path}/updates"
    rows = [(k % 5 and f"a{k % 5}" or None, float(k % 7), 10.0, k) for k in range(60)]
    spark.createDataFrame(rows, "agent_id string, lat double, lon double, s long").write.parquet(path)
    stored = spark.read.parquet(path).withColumn("at", F.timestamp_seconds("s"))
    found = stays.clusters(stored, ["agent_id"], 1000, "median")
    assert path not in found._jdf.queryExecution().toString()  # what is left to do reads the places
    got = {r.agent_id: r for r in found.collect()}
    assert set(got) == {None, "a1", "a2", "a3", "a4"}
    for k, agent in enumerate([None, "a1", "a2", "a3", "a4"]):
        lats = sorted(r[1] for r in rows if r[0] == agent)
        assert got[agent].n == 12 and got[agent].duration_s == 55 and got[agent].first_at.timestamp() % 60 == k
        assert got[agent].centre_lat == pytest.approx(lats[5], abs=1e-2)


def test_trajectory_text(spark):
    line = "A;103.5,1.25,2020-01-01 00:00:00+0000,1,c1;103.75,1.5,2020-01-01 00:01:00+0000,10,c2;;"
    parsed = parse_trajectories(spark.createDataFrame([(line,)], "value string"))
    row = parsed.first()
    assert row.agent_id == "A"
    assert [(u.lon, u.lat, u.cell_type) for u in row.updates] == [(103.5, 1.25, 1), (103.75, 1.5, 10)]
    assert parsed.select(format_trajectories().alias("v")).first()["v"] == line.rstrip(";")
    kept = filters.filter_updates(parsed, "2020-01-01 00:01:00+0000", "2020-01-01 00:01:00+0000").first().updates
    assert [u.cell for u in kept] == ["c2"]
    assert filters.filter_updates(parsed, "2021").first().updates == []
    with pytest.raises(Exception, match="malformed update"):
        parse_trajectories(spark.createDataFrame([("A;103.5,x,t,1,c",)], "value string")).collect()


def test_cells_cover_areas_without_surface_only_where_they_lie(spark):
    cell = "POLYGON ((0 0, 4 0, 4 1, 1 1, 1 4, 0 4, 0 0))"
    areas = ["POLYGON ((2 2, 3 3, 2 2, 2 2))", "POLYGON ((0.2 0.2, 0.8 0.8, 0.2 0.2, 0.2 0.2))", "POLYGON ((0.5 3, 3 0.5, 0.5 3, 0.5 3))", "POLYGON ((0 0, 1 0, 1 1, 0 0))"]
    cells = spark.createDataFrame([("l", cell)], "cell string, cell_wkt string")
    found = spatial.spatial_join(cells, spark.createDataFrame(list(enumerate(areas)), "area int, area_wkt string"), "cell_wkt", "area_wkt")
    assert sorted(r.area for r in found.collect()) == [1, 3]


def test_stays_leave_out_updates_without_coordinates(spark):
    rows = [("a", None, 10.0), ("a", 5.0, None), ("a", None, None)] + [("a", lat, 10.0) for lat in (10.0, 11.0, 12.0)]
    df = spark.createDataFrame(rows, "agent_id string, lat double, lon double").withColumn("at", F.timestamp_seconds(F.lit(1)))
    for centroid in ("mean", "median"):
        row = stays.clusters(df, ["agent_id"], 1000, centroid).first()
        assert row.n == 3 and row.centre_lat == pytest.approx(11, abs=0.01)


def test_percentiles_with_nan_and_of_close_values(spark):
    odd = spark.createDataFrame([(v,) for v in (100.0, 200.0, 300.0, float("nan"))], "v double")
    assert percentile.nearest_rank_percentile(odd, "v", 0.5).first().percentile == 200
    close = spark.range(20_000).selectExpr("id % 3 as k", "1704067200 + id * 7 % 2592000 as v")
    found = {r.k: r.percentile for r in percentile.nearest_rank_percentile(close, "v", 0.3, ["k"]).collect()}
    for k in range(3):
        values = sorted(1704067200 + i * 7 % 2592000 for i in range(20_000) if i % 3 == k)
        assert found[k] == values[math.ceil(0.3 * len(values)) - 1]
