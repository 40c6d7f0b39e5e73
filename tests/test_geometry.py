import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions import forest, geo, geometry, polygon, relations
from wayfare.functions.polygon import Shape, relate
from wayfare.operators import spatial
from wayfare.sources.esri import esri_to_wkt
from wayfare.sources.readers import wkt_table


def box(x0, y0, x1, y1):
    return f"POLYGON (({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))"


def star(cx, cy, outer, inner, points, turn=0.0):
    ring = []
    for k in range(2 * points):
        radius = outer if k % 2 == 0 else inner
        angle = turn + math.pi * k / points
        ring.append((cx + radius * math.cos(angle), cy + radius * math.sin(angle)))
    ring.append(ring[0])
    return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + "))"


L_SHAPE = "POLYGON ((0 0, 2 0, 2 1, 1 1, 1 2, 0 2, 0 0))"
HOLED = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"
HOLED_SAME_WAY = "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))"


@pytest.mark.parametrize(
    "wkt, expected",
    [
        (box(0, 0, 2, 3), 6.0),
        (L_SHAPE, 3.0),
        (HOLED, 12.0),
        (HOLED_SAME_WAY, 12.0),
        ("  multipolygon(((0 0,1 0,1 1,0 1,0 0)) ,\n((5 5, 7 5, 7 7, 5 7, 5 5),(5.5 5.5, 6 5.5, 6 6, 5.5 5.5)))", 4.875),
        ("POLYGON EMPTY", 0.0),
        ("POINT (1 2)", 0.0),
        ("POLYGON ((0 0, 1 x, 1 1, 0 0))", None),
        (None, None),
    ],
)
def test_area(spark, wkt, expected):
    row = spark.createDataFrame([(wkt,)], "wkt string").select(geometry.wkt_area("wkt").alias("a")).first()
    assert row["a"] == expected


@pytest.mark.parametrize(
    "a, b, expected",
    [
        (L_SHAPE, box(0.5, 0.5, 3, 3), 1.25),
        (HOLED, box(0, 0, 2, 2), 3.0),
        (HOLED_SAME_WAY, box(0, 0, 2, 2), 3.0),
        (HOLED, box(1.5, 1.5, 2, 2), 0.0),
        (box(0, 0, 1, 1), box(1, 0, 2, 1), 0.0),
        ("POLYGON ((0 0, 2 0, 1 2, 0 0))", "POLYGON ((0 2, 1 0, 2 2, 0 2))", 1.0),
    ],
)
def test_common_area(spark, a, b, expected):
    df = spatial.with_common_area(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b")
    assert df.first()["common_area"] == pytest.approx(expected, abs=1e-12)


def inside(shape, points):
    return relations.locate(points, np.zeros(len(points), int), relations.Side([shape]), np.array([1e-12])) >= 0


def test_common_area_of_stars_against_sampling():
    a, b = Shape(star(0, 0, 1, 0.4, 5)), Shape(star(0.3, 0.2, 0.9, 0.5, 7, 0.4))
    exact = polygon.overlay_areas(polygon._shape_edges(a), polygon._shape_edges(b))[0]
    rng = np.random.default_rng(5)
    points = rng.uniform(-1, 1.5, (60_000, 2))
    share = (inside(a, points) & inside(b, points)).mean() * 6.25
    assert exact == pytest.approx(share, abs=0.03)


def test_large_polygons_take_the_blocked_path():
    a, b = Shape(star(0, 0, 1, 0.9, 1500)), Shape(star(0.2, 0, 1, 0.9, 1500))
    edges_a, edges_b = polygon._shape_edges(a)[0].reshape(-1, 4), polygon._shape_edges(b)[0].reshape(-1, 4)
    assert len(edges_a) * len(edges_b) > polygon._CHUNK
    blocked = polygon.overlay_areas([edges_a.ravel()], [edges_b.ravel()])[0]
    plain = 0.0
    for k in range(0, len(edges_a), 200):
        part = edges_a[k : k + 200]
        plain += polygon._common_area_below(np.repeat(part, len(edges_b), 0), np.tile(edges_b, (len(part), 1))).sum()
    assert blocked == pytest.approx(plain, rel=1e-9)


RELATIONS = [
    # a, b, relations that hold
    (box(0, 0, 4, 4), box(1, 1, 2, 2), {"contains", "covers", "intersects"}),
    (box(0, 0, 4, 4), box(0, 0, 4, 4), {"contains", "within", "covers", "intersects"}),
    (box(0, 0, 4, 4), box(4, 0, 5, 1), {"touches", "intersects"}),
    (box(0, 0, 4, 4), box(4, 4, 5, 5), {"touches", "intersects"}),
    (box(0, 0, 4, 4), box(3, 3, 6, 6), {"overlaps", "intersects"}),
    (box(0, 0, 4, 4), box(7, 7, 8, 8), {"disjoint"}),
    (box(1, 1, 2, 2), box(0, 0, 4, 4), {"within", "intersects"}),
    (HOLED, box(1.5, 1.5, 2, 2), {"disjoint"}),
    (HOLED, box(1, 1, 3, 3), {"touches", "intersects"}),
    (box(0, 0, 4, 4), "LINESTRING (-1 2, 5 2)", {"crosses", "intersects"}),
    (box(0, 0, 4, 4), "LINESTRING (1 1, 2 2)", {"contains", "covers", "intersects"}),
    (box(0, 0, 4, 4), "LINESTRING (4 0, 4 4)", {"touches", "covers", "intersects"}),
    (box(0, 0, 4, 4), "POINT (2 2)", {"contains", "covers", "intersects"}),
    (box(0, 0, 4, 4), "POINT (4 2)", {"touches", "covers", "intersects"}),
    ("LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", {"crosses", "intersects"}),
    ("LINESTRING (0 0, 2 2)", "LINESTRING (1 1, 3 3)", {"overlaps", "intersects"}),
    ("LINESTRING (0 0, 2 2)", "LINESTRING (2 2, 3 0)", {"touches", "intersects"}),
    ("LINESTRING (0 0, 2 2)", "POINT (1 1)", {"contains", "covers", "intersects"}),
    ("LINESTRING (0 0, 2 2)", "POINT (0 0)", {"touches", "covers", "intersects"}),
    ("POINT (1 1)", "POINT (1 1)", {"contains", "within", "covers", "intersects"}),
    ("MULTIPOINT ((1 1), (9 9))", box(0, 0, 4, 4), {"crosses", "intersects"}),
    ("POLYGON EMPTY", box(0, 0, 4, 4), {"disjoint"}),
]


@pytest.mark.parametrize("a, b, held", RELATIONS)
def test_relations(a, b, held):
    assert {r for r in polygon.RELATIONS if relate(Shape(a), Shape(b), r)} == held


@pytest.mark.parametrize("relation", polygon.RELATIONS)
def test_relation_columns_agree_with_single_pairs(spark, relation):
    df = spark.createDataFrame([(a, b) for a, b, _ in RELATIONS] + [(None, box(0, 0, 1, 1))], "a string, b string")
    got = spatial.with_relation(df, "a", "b", relation, "r").collect()
    for row in got:
        expected = None if row.a is None else relate(Shape(row.a), Shape(row.b), relation)
        assert row.r == expected, (row.a, row.b)


COLLECTION = "GeometryCollection (POINT (9 9), GEOMETRYCOLLECTION (POLYGON ((0 0, 1 0, 1 1, 0 0)), LINESTRING (3 3, 4 4)), GEOMETRYCOLLECTION EMPTY)"


def test_collections_are_related_by_their_members(spark):
    assert [p.kind for p in polygon.parts_of(COLLECTION)] == ["POINT", "POLYGON", "LINESTRING", "POINT"]
    rows = [(COLLECTION, "POINT (9 9)"), ("LINESTRING (3 4, 4 3)", COLLECTION), (COLLECTION, "POINT (6 6)"), ("GEOMETRYCOLLECTION EMPTY", COLLECTION), (COLLECTION, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    for relation, held in (("intersects", [True, True, False, False, None]), ("disjoint", [False, False, True, True, None])):
        assert [r.r for r in spatial.with_relation(df, "a", "b", relation, "r").collect()] == held
    found = [r.distance for r in spatial.with_distance(df, "a", "b").collect()]
    assert found[:2] == [0, 0] and found[2] == pytest.approx(8**0.5) and found[3:] == [None, None]
    with pytest.raises(Exception, match="geometry collections"):
        spatial.with_relation(df, "a", "b", "contains", "r").collect()


def test_whole_batches_agree_with_single_pairs():
    shapes = [(Shape(a), Shape(b)) for a, b, _ in RELATIONS]
    left, right = [a for a, _ in shapes], [b for _, b in shapes]
    for relation in polygon.RELATIONS:
        assert polygon.relate_all(left, right, relation).tolist() == [relation in held for _, _, held in RELATIONS]
    found = polygon.distances_of(left, right)
    assert [None if np.isnan(d) else d > 0 for d in found] == [None if a.empty else "disjoint" in held for (a, _), (_, _, held) in zip(shapes, RELATIONS)]


@pytest.mark.parametrize("chunk, fan", [(forest.CHUNK, forest.FAN), (40, 2)])
def test_trees_against_all_rows(monkeypatch, chunk, fan):
    monkeypatch.setattr(forest, "CHUNK", chunk)
    monkeypatch.setattr(forest, "FAN", fan)
    rng = np.random.default_rng(8)
    groups = 9
    a, b = (np.concatenate([x, x + rng.normal(size=x.shape) * rng.choice([0, 1, 8], (len(x), 1))], axis=1) for x in (rng.uniform(0, 60, (n, 2)) for n in (150, 110)))
    ga, gb = rng.integers(0, groups - 1, len(a)), rng.integers(1, groups, len(b))
    tree = forest.Forest(forest.segment_boxes(b), gb, groups)
    found = {(i, j) for rows, hits in tree.meeting(forest.segment_boxes(a), ga) for i, j in zip(rows.tolist(), hits.tolist())}
    p, q = forest.segment_boxes(a), forest.segment_boxes(b)
    assert found == {(i, j) for i in range(len(a)) for j in range(len(b)) if ga[i] == gb[j] and (p[i, :2] <= q[j, 2:]).all() and (q[j, :2] <= p[i, 2:]).all()}
    best = forest.nearest(a, ga, b, gb, groups)
    for g in range(groups):
        i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(ga == g), np.flatnonzero(gb == g)))
        if not len(i):
            assert best[g] == np.inf
            continue
        ends = [forest.point_to_segment(a[i, :2], b[j]), forest.point_to_segment(a[i, 2:], b[j]), forest.point_to_segment(b[j, :2], a[i]), forest.point_to_segment(b[j, 2:], a[i])]
        crossing, _ = forest.cross_at(a[i], b[j], np.zeros(len(i)))
        assert best[g] == (0.0 if crossing.any() else pytest.approx(np.min(ends), abs=1e-12))


def test_polygons_of_a_hundred_thousand_edges():
    """Near, apart, overlapping and nested; memory does not follow the product of the edges."""
    import tracemalloc

    def round_star(x, size, edges=100_000):
        shape = Shape.__new__(Shape)
        turn = np.linspace(0, 2 * np.pi, edges + 1)[:-1]
        radius = size * (1 + 0.0001 * (np.arange(edges) % 2))
        ring = np.stack([x + radius * np.cos(turn), radius * np.sin(turn)], axis=1)
        shape.kind, shape.dim, shape.paths = "POLYGON", 2, [np.concatenate([ring, ring[:1]])]
        shape.points = shape.paths[0]
        shape.low, shape.high = shape.points.min(axis=0), shape.points.max(axis=0)
        shape.segments = np.concatenate([shape.points[:-1], shape.points[1:]], axis=1)
        return shape

    a, far, over, core = round_star(0, 1), round_star(2.5, 1), round_star(1.2, 1), round_star(0.1, 0.5)
    tracemalloc.start()
    found = polygon.distances_of([a, a, a], [far, over, core])
    assert found[0] == pytest.approx(2.5 - 2 * 1.0001, abs=1e-4) and found[1:].tolist() == [0, 0]
    assert not relate(a, far, "intersects") and relate(round_star(0, 1, 20_000), round_star(1.2, 1, 20_000), "overlaps")
    assert relate(round_star(0, 1, 20_000), round_star(0.1, 0.5, 20_000), "contains")
    assert tracemalloc.get_traced_memory()[1] < 1_500_000_000
    tracemalloc.stop()


def test_contact_in_blocks(monkeypatch):
    monkeypatch.setattr(polygon, "_CHUNK", 5)
    a, b, c = (Shape(w).segments.ravel() for w in (box(0, 0, 4, 4), box(4, 4, 5, 5), box(6, 6, 7, 7)))
    assert polygon.boundary_contacts([a, a, b, None], [b, c, a, a]).tolist() == [True, False, True, False]


def test_distances(spark):
    df = spark.createDataFrame([(box(0, 0, 1, 1), box(4, 5, 6, 6)), (box(0, 0, 9, 9), "POINT (2 2)")], "a string, b string")
    assert [r.distance for r in spatial.with_distance(df, "a", "b").collect()] == [5.0, 0.0]


def test_geodesic():
    def metres(*pair):
        return polygon.geodesic_inverse(*[np.array([float(v)]) for v in pair])[0]

    assert metres(0, 0, 1, 0) == pytest.approx(111319.491, abs=1e-3)
    assert metres(0, 0, 0, 90) == pytest.approx(10001965.729, abs=1e-3)
    assert metres(10, 20, 10, 20) == 0
    assert metres(179.5, 0, -179.5, 0) == pytest.approx(111319.491, abs=1e-3)
    # Nearly antipodal, where the plain iteration does not settle.
    assert metres(0, 0, 179.5, 0.5) == pytest.approx(19936288.579, abs=0.01)
    assert metres(0, 0, 180, 0) == pytest.approx(2 * 10001965.729, abs=0.01)


def test_geodesic_takes_points_only(spark):
    df = spark.createDataFrame([(box(0, 0, 1, 1), "POINT (0 0)")], "a string, b string")
    with pytest.raises(Exception, match="needs points"):
        spatial.with_geodesic(df, "a", "b").collect()


@pytest.mark.parametrize("predicate", ["covers", "intersects"])
def test_spatial_join_against_all_pairs(spark, predicate):
    rnd = random.Random(3)

    def shapes(prefix, n, low, high):
        rows = []
        for k in range(n):
            size = math.exp(rnd.uniform(math.log(low), math.log(high)))
            at = rnd.uniform(-20, 20), rnd.uniform(-20, 20)
            rows.append((f"{prefix}{k}", star(*at, size, size * 0.6, rnd.randint(3, 7), rnd.uniform(0, 3))))
        return rows

    cells, areas = shapes("c", 40, 0.5, 60), shapes("u", 60, 0.01, 10)
    cells += [("whole", box(-100, -100, 100, 100)), ("edge", box(0, 0, 4, 4))]
    areas += [("same", box(0, 0, 4, 4)), ("beside", box(4, 1, 5, 2))]
    a = spark.createDataFrame(cells, "cell string, cell_wkt string")
    b = spark.createDataFrame(areas, "unit string, area_wkt string")
    got = spatial.spatial_join(a, b, "cell_wkt", "area_wkt", predicate).select("cell", "unit").collect()
    expected = {(c, u) for c, cw in cells for u, uw in areas if relate(Shape(cw), Shape(uw), predicate)}
    assert len(got) == len(set(got)), "a pair came twice"
    assert {tuple(r) for r in got} == expected


def test_spatial_join_refuses_other_geometries(spark):
    a = spark.createDataFrame([("c", "POINT (1 1)")], "cell string, cell_wkt string")
    b = spark.createDataFrame([("u", box(0, 0, 1, 1))], "unit string, area_wkt string")
    with pytest.raises(Exception, match="not a polygon"):
        spatial.spatial_join(a, b, "cell_wkt", "area_wkt").collect()


def test_wkt_table(spark):
    lines = spark.createDataFrame([("a\t" + box(0, 0, 1, 1) + "\tb",), ("a\tPOLYGON oops\tb",)], "value string")
    with pytest.raises(Exception, match="not a geometry"):
        wkt_table(lines, 1).collect()
    kept = wkt_table(lines, 1, skip_invalid=True).collect()
    assert [(r.wkt, r.user_data) for r in kept] == [(box(0, 0, 1, 1), "a\tb")]


def test_esri(spark):
    shell = "[[0,0],[0,4],[4,4],[4,0],[0,0]]"
    hole = "[[1,1],[3,1],[3,3],[1,3],[1,1]]"
    open_shell = "[[9,9],[9,10.5],[10,10]]"
    rows = [('{"rings":[%s,%s,%s]}' % (shell, hole, open_shell),), ("{}",), ("[",), ('{"rings":[[[1]]]}',), ('{"rings":[]}',)]
    got = [r.w for r in spark.createDataFrame(rows, "t string").select(esri_to_wkt("t").alias("w")).collect()]
    assert got == [
        "MULTIPOLYGON (((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1)), ((9 9, 9 10.5, 10 10, 9 9)))",
        "POLYGON EMPTY",
        "POLYGON EMPTY",
        "POLYGON EMPTY",
        "POLYGON EMPTY",
    ]


def test_size_diff_of_nothing(spark):
    df = spark.createDataFrame([(box(0, 0, 1, 1), "POLYGON EMPTY")], "a string, b string")
    assert df.select(geometry.size_diff("a", "b").alias("d")).first()["d"] is None


def test_grid_ids(one):
    assert one(geo.grid_to_coord(F.lit("g_1_2_103.5_1.25"))) == 1.25
    assert one(geo.grid_to_coord(F.lit("g_1"))) is None
    assert one(geo.home_work_distance(F.lit("g_1"), F.lit("g_1_2_103.5_1.25"))) is None
    with pytest.raises(ValueError):
        geo.grid_to_coord("g", "height")


def test_sensor_codes(one):
    assert one(geo.sensor_name(F.lit(10))) == "Interpolated"
    assert one(geo.sensor_code(F.lit("GPS"))) == 3
    assert one(geo.sensor_code(F.lit("7"))) is None
    with pytest.raises(Exception, match="unknown sensor"):
        one(geo.sensor_name(F.lit(4)))


def test_full_cell_id(one):
    def cell(tech, lac, sac, cid):
        return one(geo.full_cell_id(*[F.lit(v).cast("string") for v in (tech, lac, sac, cid)]))

    assert cell("UMTS", "1", None, "3") == "505-02-1-null"
    assert cell("LTE", "1", "2", "3") == "505-02-1-3"
    assert cell("GSM", "1", "2", "3") == ""
    assert cell("LTE", None, "2", "3") is None


def test_sql_names(spark):
    polygon.register(spark)
    a, b = box(0, 0, 4, 4), box(1, 1, 2, 2)
    row = spark.sql(f"select geo_contains('{a}', '{b}') c, geo_distance('{a}', 'POINT (7 8)') d, geo_geodesic(0D, 0D, 1D, 0D) g").first()
    assert row.c is True and row.d == 5.0 and row.g == pytest.approx(111319.491, abs=1e-3)
