"""Joins of polygon tables, coverage shares, relations and distances between geometry columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import geometry as G
from wayfare.functions import polygon as P
from wayfare.operators.box_tree import BOX, box_join
from wayfare.session import materialize

_REL_TOLERANCE = 1e-9


def _prepared(df: DataFrame, wkt: str, prefix: str, boundary: bool) -> DataFrame:
    """Number, bounding box, edges, area and, if asked, the whole boundary: a table in the shared folder, so that a geometry is read once.

    Empty polygons go, since nothing matches them; a text that is no polygon fails the query.
    """
    refuse = F.raise_error(F.concat(F.lit("not a polygon: "), F.substring(wkt, 1, 60))).cast(G.POLYGONS)
    parsed = F.coalesce(G.wkt_polygons(wkt), F.when(F.col(wkt).isNotNull(), refuse))
    # A filter would be pushed below the parsing and so repeat it; exploding one value or none does not.
    some = F.filter(F.array(parsed), lambda v: F.size(v) > 0)
    # Reading a text costs far more than the size of its file tells, so that texts of few file splits are first dealt over all tasks.
    polygons = df.hint("rebalance").withColumn(f"{prefix}_polygons", F.explode(some))
    box = polygons.withColumn(f"{prefix}_box", G.bbox(f"{prefix}_polygons"))
    columns = {f"{prefix}_{k}": F.col(f"{prefix}_box")[k] for k in ("x0", "y0", "x1", "y1")}
    columns[f"{prefix}_edges"] = G.oriented_edges(f"{prefix}_polygons")
    columns[f"{prefix}_area"] = G.area(f"{prefix}_polygons")
    if boundary:
        columns[f"{prefix}_boundary"] = G.all_edges(f"{prefix}_polygons")
    columns[f"{prefix}_id"] = F.monotonically_increasing_id()
    return materialize(box.withColumns(columns).drop(f"{prefix}_polygons", f"{prefix}_box"), "geometries")


def spatial_join(
    cells: DataFrame, areas: DataFrame, cell_wkt: str, area_wkt: str, predicate: str = "covers"
) -> DataFrame:
    """Pairs of polygons, each pair once, with ``common_area``, ``cell_area`` and ``area_area``.

    ``covers`` keeps areas that lie wholly in the cell, ``intersects`` also those that overlap or touch it. Column
    names of the two sides must differ.

    Numbers and boxes alone are partitioned and paired, see ``wayfare.operators.box_tree``; geometries are then fetched by each block of boxes
    that holds pairs of theirs, and no pair is shuffled.
    """
    if predicate not in ("covers", "intersects"):
        raise ValueError("predicate must be covers or intersects")
    a = _prepared(cells, cell_wkt, "_a", predicate == "intersects")
    b = _prepared(areas, area_wkt, "_b", predicate == "intersects")
    kept = [*cells.columns, *areas.columns]
    sides = [side.withColumnsRenamed({f"{p}_{k}": k for k in ("id", *BOX)}) for side, p in ((a, "_a"), (b, "_b"))]
    pairs = box_join(*sides, covers=predicate == "covers")
    result = [*kept, "cell_area", "area_area", "common_area"]
    measured = pairs.withColumns(
        {
            "cell_area": F.col("_a_area"),
            "area_area": F.col("_b_area"),
            "common_area": P.common_area("_a_edges", "_b_edges"),
        }
    )
    least = F.least("cell_area", "area_area") * _REL_TOLERANCE
    if predicate == "covers":
        share = F.col("area_area") - F.col("common_area") <= F.col("area_area") * _REL_TOLERANCE
        # An area without surface has no share to compare; its lines are tested against the cell.
        flat = F.col("area_area") == 0
        inside = P.relation_udf("covers")(F.when(flat, F.col(cell_wkt)), F.when(flat, F.col(area_wkt)))
        found = measured.withColumn("_inside", inside).where(F.when(flat, F.col("_inside")).otherwise(share))
        return found.select(*result)
    overlap = F.col("common_area") > least
    touch = P.boundaries_touch(F.when(~overlap, F.col("_a_boundary")), F.when(~overlap, F.col("_b_boundary")))
    return measured.withColumn("_touch", touch).where(overlap | F.col("_touch")).select(*result)


def coverage_ratio(common_area: Column | str = "common_area", cell_area: Column | str = "cell_area") -> Column:
    """Share of the cell that the area takes."""
    c, a = (F.col(x) if isinstance(x, str) else x for x in (common_area, cell_area))
    return F.try_divide(c, a)


def with_common_area(df: DataFrame, a_wkt: str, b_wkt: str, out: str = "common_area") -> DataFrame:
    """Common area of two WKT columns of the same row."""
    edges = {f"_{i}_edges": G.oriented_edges(G.polygons_sql(c)) for i, c in enumerate((a_wkt, b_wkt))}
    return df.withColumns(edges).withColumn(out, _common_area("_0_edges", "_1_edges")).drop(*edges)


def _common_area(a: str, b: str) -> Column:
    """Zero without edges."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    known = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(both, P.common_area(a, b)).when(known, F.lit(0.0))


def with_coverage(df: DataFrame, a_wkt: str, b_wkt: str, out: str = "coverage") -> DataFrame:
    """area(a and b) / area(b) of two WKT columns of the same row."""
    measured = with_common_area(df, a_wkt, b_wkt, "_common")
    return measured.withColumn(out, F.try_divide(F.col("_common"), G.wkt_area(b_wkt))).drop("_common")


def with_relation(df: DataFrame, a_wkt: str, b_wkt: str, relation: str, out: str | None = None) -> DataFrame:
    """True or false for one relation (contains, within, overlaps, touches, crosses, disjoint, ...) per row.

    Polygons whose boxes are apart are settled on the JVM side; areas, taken for whole batches at once, settle
    most other pairs of polygons. What is left is tested pair by pair.
    """
    polygons = df.withColumns({"_pa": G.wkt_polygons(a_wkt), "_pb": G.wkt_polygons(b_wkt)})
    shaped = polygons.withColumns(
        {
            "_ba": G.bbox("_pa"),
            "_bb": G.bbox("_pb"),
            "_ea": G.oriented_edges("_pa"),
            "_eb": G.oriented_edges("_pb"),
            "_sa": G.area("_pa"),
            "_sb": G.area("_pb"),
            "_la": G.all_edges("_pa"),
            "_lb": G.all_edges("_pb"),
        }
    ).drop("_pa", "_pb")
    a, b = F.col("_ba"), F.col("_bb")
    apart = F.coalesce(
        (a["x0"] > b["x1"]) | (b["x0"] > a["x1"]) | (a["y0"] > b["y1"]) | (b["y0"] > a["y1"]), F.lit(False)
    )
    measured = shaped.withColumns({"_apart": apart, "_common": _common_area("_ea", "_eb")}).drop("_ba", "_bb", "_ea", "_eb")
    settled = F.when(F.col("_apart"), F.lit(relation == "disjoint")).when(
        (F.col("_sa") > 0) & (F.col("_sb") > 0), _by_areas(relation, F.col("_sa"), F.col("_sb"), F.col("_common"))
    )
    known = measured.withColumn("_settled", settled)
    open_ = F.col("_settled").isNull()
    if relation in ("touches", "disjoint", "intersects"):
        flat = open_ & (F.col("_sa") > 0) & (F.col("_sb") > 0)
        meet = P.boundaries_touch(F.when(flat, F.col("_la")), F.when(flat, F.col("_lb")))
        known = known.withColumn("_meet", meet).withColumn(
            "_settled", F.coalesce("_settled", ~F.col("_meet") if relation == "disjoint" else F.col("_meet"))
        )
    tested = P.relation_udf(relation)(F.when(open_, F.col(a_wkt)), F.when(open_, F.col(b_wkt)))
    return (
        known.withColumn("_test", tested)
        .withColumn(out or relation, F.coalesce("_settled", "_test"))
        .select(*df.columns, out or relation)
    )


def _by_areas(relation: str, a: Column, b: Column, common: Column) -> Column:
    """The answer for two polygons as far as areas give it, null where boundaries decide."""
    least = F.least(a, b) * _REL_TOLERANCE
    share = common > least
    a_has_b, b_has_a = b - common <= b * _REL_TOLERANCE, a - common <= a * _REL_TOLERANCE
    if relation in ("contains", "covers"):
        return a_has_b
    if relation == "within":
        return b_has_a
    if relation == "overlaps":
        return share & (a - common > least) & (b - common > least)
    if relation == "crosses":
        return F.lit(False)
    return F.when(share, F.lit(relation == "intersects"))


def with_distance(df: DataFrame, a_wkt: str, b_wkt: str, out: str = "distance") -> DataFrame:
    return df.withColumn(out, P.planar_distance(a_wkt, b_wkt))


def with_geodesic(df: DataFrame, a_wkt: str, b_wkt: str, out: str = "distance_m") -> DataFrame:
    return df.withColumn(out, P.geodesic_distance_wkt(F.col(a_wkt), F.col(b_wkt)))


def coverage_lists(pairs: DataFrame, cell: str, area: str, percentage: str = "percentage", by: Sequence[str] = ()) -> DataFrame:
    """JSON arrays of areas and their shares, sorted by area: one for each cell and value of ``by``.

    ``by`` names columns that keep a list small whatever the number of areas, such as the tile of the area.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(area).alias("geoUnit"), F.col(percentage).alias("percentage"))))
    return pairs.groupBy(cell, *by).agg(F.to_json(listed).alias("coverage"))
