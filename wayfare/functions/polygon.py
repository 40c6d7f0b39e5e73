"""Polygon work that Column expressions cannot carry: overlay areas, relations, distances.

Arrow batches in, numpy inside, whole batches at once: overlay and boundary contact here, relations and distances in
``relations`` with trees over all segments of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.functions import relations
from wayfare.session import ship_package

RELATIONS = ("contains", "within", "overlaps", "touches", "crosses", "disjoint", "intersects", "covers")
_CHUNK = 2_000_000


# ---------------------------------------------------------------- overlay area


_NO_EDGES = np.zeros(0)


def _edge_rows(edges: Sequence[np.ndarray | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat edge rows (n, 4) and the number of edges per input row."""
    if isinstance(edges, pa.Array):
        counts = pc.fill_null(pc.list_value_length(edges), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        return np.asarray(edges.flatten(), np.float64).reshape(-1, 4), counts
    arrays = [_NO_EDGES if e is None else e for e in edges]
    counts = np.fromiter((len(e) for e in arrays), np.int64, len(arrays)) // 4
    values = np.concatenate(arrays) if arrays else _NO_EDGES
    return values.reshape(-1, 4), counts


def _common_area_below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signed area below both edges, over the x range they share, for aligned rows of edges.

    Summed over all edge pairs of two oriented polygons this is the area they have in common: a polygon is the
    signed sum of the regions below its edges, and two such regions share what lies below the lower edge.
    """
    sign = np.where(a[:, 2] < a[:, 0], 1.0, -1.0) * np.where(b[:, 2] < b[:, 0], 1.0, -1.0)
    left = np.maximum(np.minimum(a[:, 0], a[:, 2]), np.minimum(b[:, 0], b[:, 2]))
    right = np.minimum(np.maximum(a[:, 0], a[:, 2]), np.maximum(b[:, 0], b[:, 2]))
    width = np.maximum(right - left, 0.0)
    slope_a = (a[:, 3] - a[:, 1]) / (a[:, 2] - a[:, 0])
    slope_b = (b[:, 3] - b[:, 1]) / (b[:, 2] - b[:, 0])
    a_left, a_right = a[:, 1] + slope_a * (left - a[:, 0]), a[:, 1] + slope_a * (right - a[:, 0])
    b_left, b_right = b[:, 1] + slope_b * (left - b[:, 0]), b[:, 1] + slope_b * (right - b[:, 0])
    gap_left, gap_right = a_left - b_left, a_right - b_right
    span = np.abs(gap_left) + np.abs(gap_right)
    crossing = (gap_left * gap_right) < 0
    mean_gap = np.where(
        crossing,
        (gap_left**2 + gap_right**2) / np.where(span == 0, 1.0, span) / 2,
        span / 2,
    )
    mean_height = (a_left + a_right + b_left + b_right) / 4
    return sign * width * (mean_height - mean_gap / 2)


def _rows_of_pairs(na: np.ndarray, nb: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, lo: int, hi: int):
    """Row numbers of every edge pair of rows lo..hi, and the row each pair belongs to."""
    sizes = na[lo:hi] * nb[lo:hi]
    owner = np.repeat(np.arange(lo, hi), sizes)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return start_a[owner] + within // nb[owner], start_b[owner] + within % nb[owner], owner


def overlay_areas(edges_a: Sequence[np.ndarray | None] | pa.Array, edges_b: Sequence[np.ndarray | None] | pa.Array) -> np.ndarray:
    """Common area of each row's two polygons, given as flat oriented edges."""
    a, na = _edge_rows(edges_a)
    b, nb = _edge_rows(edges_b)
    n = len(na)
    start_a, start_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    # A local origin per row keeps the sums small next to the areas.
    has = na > 0
    origin = np.zeros((n, 2))
    origin[has] = a[start_a[has], :2]
    a = a - np.tile(np.repeat(origin, na, axis=0), 2)
    b = b - np.tile(np.repeat(origin, nb, axis=0), 2)
    out = np.zeros(n)
    sizes = na * nb
    lo = 0
    while lo < n:
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), _CHUNK, side="right")))
        if hi == lo + 1 and sizes[lo] > _CHUNK:
            out[lo] = _large_overlay(a[start_a[lo] : start_a[lo] + na[lo]], b[start_b[lo] : start_b[lo] + nb[lo]])
        else:
            ia, ib, owner = _rows_of_pairs(na, nb, start_a, start_b, lo, hi)
            if len(owner):
                out[lo:hi] = np.bincount(owner - lo, weights=_common_area_below(a[ia], b[ib]), minlength=hi - lo)
        lo = hi
    return np.maximum(out, 0.0)


def _large_overlay(a: np.ndarray, b: np.ndarray) -> float:
    """One pair with many edges: only edges whose x ranges meet are paired, a block at a time."""
    b = b[np.argsort(np.minimum(b[:, 0], b[:, 2]), kind="stable")]
    b_left, b_right = np.minimum(b[:, 0], b[:, 2]), np.maximum(b[:, 0], b[:, 2])
    longest = (b_right - b_left).max()
    total = 0.0
    a = a[np.argsort(np.minimum(a[:, 0], a[:, 2]), kind="stable")]
    a_left, a_right = np.minimum(a[:, 0], a[:, 2]), np.maximum(a[:, 0], a[:, 2])
    first = np.searchsorted(b_left, a_left - longest, side="left")
    last = np.searchsorted(b_left, a_right, side="right")
    counts = np.maximum(last - first, 0)
    at = 0
    while at < len(a):
        end = at + max(1, int(np.searchsorted(np.cumsum(counts[at:]), _CHUNK, side="right")))
        n = counts[at:end]
        ia = np.repeat(np.arange(at, end), n)
        ib = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:end], n)
        total += float(_common_area_below(a[ia], b[ib]).sum())
        at = end
    return total


@F.arrow_udf(T.DoubleType())
def common_area(edges_a: pa.Array, edges_b: pa.Array) -> pa.Array:
    """Common area of two polygons, from ``geometry.oriented_edges`` of each."""
    return pa.array(overlay_areas(edges_a, edges_b))


# Results are often filtered. Declared so, a filter on them is not turned into a second run of the Python step.
common_area = common_area.asNondeterministic()


# ---------------------------------------------------------------- boundary contact


def _row_extremes(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest coordinate of each row's edges; infinite where there are none."""
    low, high = np.full(len(counts), np.inf), np.full(len(counts), -np.inf)
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        low[some] = np.minimum.reduceat(values.min(axis=1), starts)
        high[some] = np.maximum.reduceat(values.max(axis=1), starts)
    return low, high


def _near(points: np.ndarray, segments: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Which points lie on their segment, for aligned rows."""
    d = segments[:, 2:] - segments[:, :2]
    rel = points - segments[:, :2]
    length = (d**2).sum(axis=1)
    t = np.clip((rel * d).sum(axis=1) / np.where(length == 0, 1.0, length), 0.0, 1.0)
    return np.hypot(*(rel - t[:, None] * d).T) <= tolerance


def boundary_contacts(edges_a: Sequence[np.ndarray | None] | pa.Array, edges_b: Sequence[np.ndarray | None] | pa.Array) -> np.ndarray:
    """Whether a corner of one boundary lies on the other, per row.

    For polygons without common area that is the same as touching.
    """
    a, na = _edge_rows(edges_a)
    b, nb = _edge_rows(edges_b)
    low_a, high_a = _row_extremes(a, na)
    low_b, high_b = _row_extremes(b, nb)
    low, high = np.minimum(low_a, low_b), np.maximum(high_a, high_b)
    with np.errstate(invalid="ignore"):
        tolerance = 1e-10 * (high - low) + 4e-16 * np.maximum(np.abs(low), np.abs(high))
    start_a, start_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    out = np.zeros(len(na), bool)
    sizes = na * nb
    lo = 0
    while lo < len(na):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), _CHUNK, side="right")))
        # A row of many edges is taken in blocks of its first boundary.
        step = max(1, _CHUNK // max(1, int(nb[lo]))) if hi == lo + 1 else int(na[lo:hi].max(initial=1))
        for block in range(0, max(1, int(na[lo:hi].max(initial=0))), max(1, step)):
            part = np.clip(na - block, 0, step)
            ia, ib, owner = _rows_of_pairs(part, nb, start_a + block, start_b, lo, hi)
            if not len(owner):
                continue
            tol = tolerance[owner]
            hit = _near(a[ia, :2], b[ib], tol) | _near(b[ib, :2], a[ia], tol)
            out[owner[hit]] = True
        lo = hi
    return out


@F.arrow_udf(T.BooleanType())
def boundaries_touch(edges_a: pa.Array, edges_b: pa.Array) -> pa.Array:
    """Contact of two boundaries given as flat edges; null where either is missing."""
    known = pc.and_(edges_a.is_valid(), edges_b.is_valid()).to_numpy(zero_copy_only=False)
    return pa.array(boundary_contacts(edges_a, edges_b), mask=~known)


boundaries_touch = boundaries_touch.asNondeterministic()


# ---------------------------------------------------------------- single geometries

_NUMBERS = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_INNER = re.compile(r"\(([^()]*)\)")
# Dimension of each WKT type.
_DIMENSIONS = {
    "POINT": 0,
    "MULTIPOINT": 0,
    "LINESTRING": 1,
    "MULTILINESTRING": 1,
    "POLYGON": 2,
    "MULTIPOLYGON": 2,
}


class Shape:
    """Points, open paths or closed rings of one WKT text."""

    def __init__(self, wkt: str):
        head = re.match(r"\s*([A-Za-z]+)", wkt)
        kind = head.group(1).upper() if head else ""
        if kind not in _DIMENSIONS:
            raise ValueError(f"not a geometry: {wkt[:60]!r}")
        self.kind, self.dim = kind, _DIMENSIONS[kind]
        body = wkt[head.end() :]
        if self.dim == 0:
            groups = [body]
        else:
            groups = _INNER.findall(body)
        paths = [np.array([float(v) for v in _NUMBERS.findall(g)]).reshape(-1, 2) for g in groups]
        self.paths = [p for p in paths if len(p)]
        self.points = np.concatenate(self.paths) if self.paths else np.zeros((0, 2))
        if len(self.points):
            self.low, self.high = self.points.min(axis=0), self.points.max(axis=0)
        if self.dim == 0:
            self.segments = np.concatenate([self.points, self.points], axis=1)
        else:
            self.segments = (
                np.concatenate([np.concatenate([p[:-1], p[1:]], axis=1) for p in self.paths])
                if self.paths
                else np.zeros((0, 4))
            )
            keep = np.any(self.segments[:, :2] != self.segments[:, 2:], axis=1)
            self.segments = self.segments[keep]

    @cached_property
    def oriented(self) -> np.ndarray:
        """Edges of a polygon with shells counter-clockwise and holes clockwise."""
        return _shape_edges(self)[0]

    @property
    def empty(self) -> bool:
        return len(self.points) == 0

    def ends(self) -> np.ndarray:
        """End points of the paths, those that occur an odd number of times."""
        ends = np.concatenate([np.stack([p[0], p[-1]]) for p in self.paths])
        unique, counts = np.unique(ends, axis=0, return_counts=True)
        return unique[counts % 2 == 1]


def _inside(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Even-odd test against all rings at once."""
    x, y = points[:, :1], points[:, 1:]
    x0, y0, x1, y1 = segments.T
    straddles = (y0 > y) != (y1 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x0 + (y - y0) * (x1 - x0) / (y1 - y0)
    return (straddles & (x < at)).sum(axis=1) % 2 == 1


def _net_area(edges: np.ndarray) -> float:
    """Area within oriented edges."""
    e = edges.reshape(-1, 4)
    if not len(e):
        return 0.0
    y = e[:, 1::2] - e[0, 1]
    return max(float(((e[:, 0] - e[:, 2]) * y.sum(axis=1)).sum()) / 2, 0.0)


def _shape_edges(shape: Shape) -> list[np.ndarray]:
    """Edges oriented by nesting depth: rings inside an odd number of other rings are holes."""
    rows = []
    for k, ring in enumerate(shape.paths):
        d = ring - ring[0]
        signed = float((d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]).sum()) / 2
        others = [p for i, p in enumerate(shape.paths) if i != k]
        probe = (ring[:1] + ring[1:2]) / 2
        depth = sum(bool(_inside(probe, np.concatenate([o[:-1], o[1:]], axis=1))[0]) for o in others)
        way = ring[::-1] if (signed < 0) == (depth % 2 == 0) else ring
        edges = np.concatenate([way[:-1], way[1:]], axis=1)
        rows.append(edges[edges[:, 0] != edges[:, 2]])
    return [np.concatenate(rows).ravel() if rows else _NO_EDGES]


def boxes_apart(a: Shape, b: Shape) -> bool:
    return bool((a.low > b.high).any() or (b.low > a.high).any())


def relate_all(a: Sequence[Shape], b: Sequence[Shape], relation: str) -> np.ndarray:
    """One named relation of each pair of shapes."""
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation: {relation}")
    out = np.full(len(a), relation == "disjoint")
    near = np.array([not (x.empty or y.empty or boxes_apart(x, y)) for x, y in zip(a, b)], bool)
    rows = np.flatnonzero(near)
    if len(rows):
        left, right = [a[k] for k in rows], [b[k] for k in rows]
        edges = [[x.oriented if x.dim == 2 else _NO_EDGES for x in side] for side in (left, right)]
        areas = [np.array([_net_area(e) for e in side]) for side in edges]
        common = overlay_areas(*edges)
        mine, theirs = relations.Side(left), relations.Side(right)
        out[rows] = relations.holds(relations.matrices(mine, theirs, (*areas, common)), mine.dim, theirs.dim, relation)
    return out


def relate(a: Shape, b: Shape, relation: str) -> bool:
    """One named relation between two shapes."""
    return bool(relate_all([a], [b], relation)[0])


def distances_of(a: Sequence[Shape], b: Sequence[Shape]) -> np.ndarray:
    """Shortest distance of each pair of shapes; NaN where one is empty."""
    out = np.full(len(a), np.nan)
    rows = np.flatnonzero([not (x.empty or y.empty) for x, y in zip(a, b)])
    if len(rows):
        out[rows] = relations.distances(relations.Side([a[k] for k in rows]), relations.Side([b[k] for k in rows]))
    return out


#: Coordinates of the pairs that are taken at once: a few tens of megabytes.
_BATCH_POINTS = 500_000


_COLLECTION = re.compile(r"\s*GEOMETRYCOLLECTION\b\s*", re.I)


def parts_of(wkt: str) -> list[Shape]:
    """The shape of a WKT text, or those of the members of a geometry collection, nested ones too."""
    head = _COLLECTION.match(wkt)
    if not head:
        return [Shape(wkt)]
    body = wkt[head.end() :].strip()
    if body.upper() == "EMPTY":
        return [Shape("POINT EMPTY")]
    if not (body.startswith("(") and body.endswith(")")):
        raise ValueError(f"not a geometry: {wkt[:60]!r}")
    members, depth, start = [], 0, 1
    for at, sign in enumerate(body):
        depth += (sign == "(") - (sign == ")")
        if depth == 1 and sign == "," or depth == 0:
            members.append(body[start:at])
            start = at + 1
    return [part for member in members for part in parts_of(member)]


def _by_batch(a: pd.Series, b: pd.Series, fn, join: np.ufunc | None) -> pd.Series:
    """``fn`` of two lists of shapes over all rows that have both; equal texts are parsed once. Batches have a bounded number of points.

    Members of collections are taken one by one, and ``join`` makes one answer of theirs; without it a collection of several fails the query.
    """
    out = pd.Series([None] * len(a), dtype=object)
    rows = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    texts = {t: parts_of(t) for t in pd.unique(pd.concat([a.iloc[rows], b.iloc[rows]], ignore_index=True))}
    pairs = [[(x, y) for x in texts[s] for y in texts[t]] for s, t in zip(a.iloc[rows], b.iloc[rows])]
    if join is None and any(len(p) > 1 for p in pairs):
        raise ValueError("only intersects, disjoint and distances are defined for geometry collections")
    ends = np.cumsum([sum(len(x.points) + len(y.points) for x, y in p) for p in pairs])
    at = 0
    while at < len(rows):
        base = ends[at - 1] if at else 0
        end = max(int(np.searchsorted(ends, base + _BATCH_POINTS, side="right")), at + 1)
        flat = [pair for p in pairs[at:end] for pair in p]
        found = fn([x for x, _ in flat], [y for _, y in flat])
        if join is not None:
            sizes = np.array([len(p) for p in pairs[at:end]])
            found = join.reduceat(found, np.cumsum(sizes) - sizes)
        out.iloc[rows[at:end]] = found.tolist()
        at = end
    return out


#: How answers for the members of collections make one.
_JOINED = {"intersects": np.logical_or, "disjoint": np.logical_and}


def relation_udf(relation: str):
    """Arrow-batched test of one relation between two WKT columns."""
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation: {relation}")

    @F.pandas_udf(T.BooleanType())
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return _by_batch(a, b, lambda x, y: relate_all(x, y, relation), _JOINED.get(relation))

    return test.asNondeterministic()


@F.pandas_udf(T.DoubleType())
def planar_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Shortest distance between two WKT geometries, collections too, in coordinate units; zero when they meet."""
    return _by_batch(a, b, distances_of, np.fmin).replace({np.nan: None})


# ---------------------------------------------------------------- geodesic distance

# The WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def geodesic_inverse(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Metres along the ellipsoid (Vincenty 1975), vectorised.

    Nearly antipodal pairs, where the iteration does not settle, are cut at a waypoint on the way and summed
    after minimising over the waypoint's position.
    """
    out, settled = _vincenty(lon1, lat1, lon2, lat2)
    for i in np.nonzero(~settled)[0]:
        out[i] = _near_antipodal(lon1[i], lat1[i], lon2[i], lat2[i])
    return out


def _vincenty(lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray]:
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat1))), np.arctan((1 - WGS84_F) * np.tan(np.radians(lat2)))
    away = np.radians((lon2 - lon1 + 540.0) % 360.0 - 180.0)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = away.copy()
    done = np.zeros(len(lam), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            s_sigma = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            c_sigma = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(s_sigma, c_sigma)
            s_alpha = np.where(s_sigma == 0, 0.0, cu1 * cu2 * sl / s_sigma)
            c2_alpha = 1 - s_alpha**2
            c_2m = np.where(c2_alpha <= 1e-15, 0.0, c_sigma - 2 * su1 * su2 / c2_alpha)
            c = WGS84_F / 16 * c2_alpha * (4 + WGS84_F * (4 - 3 * c2_alpha))
            new = away + (1 - c) * WGS84_F * s_alpha * (
                sigma + c * s_sigma * (c_2m + c * c_sigma * (2 * c_2m**2 - 1))
            )
            done = (np.abs(new - lam) < 1e-13) & (np.abs(new) <= np.pi)
            lam = new
            if done.all():
                break
    u_sq = c2_alpha * (WGS84_A**2 - b**2) / b**2
    big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
    big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
    delta = big_b * s_sigma * (
        c_2m
        + big_b / 4 * (c_sigma * (2 * c_2m**2 - 1) - big_b / 6 * c_2m * (4 * s_sigma**2 - 3) * (4 * c_2m**2 - 3))
    )
    return b * big_a * (sigma - delta), done


def _near_antipodal(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """The shortest way crosses the middle meridian somewhere; search for the latitude where it does."""
    middle = lon1 + ((lon2 - lon1) % 360.0) / 2
    best = np.inf
    for lon in (middle, middle + 180.0):
        low, high = -90.0, 90.0
        for _ in range(12):
            lats = np.linspace(low, high, 181)
            n = len(lats)
            first, ok1 = _vincenty(np.full(n, lon1), np.full(n, lat1), np.full(n, lon), lats)
            second, ok2 = _vincenty(np.full(n, lon), lats, np.full(n, lon2), np.full(n, lat2))
            total = np.where(ok1 & ok2, first + second, np.inf)
            k = int(np.argmin(total))
            best = min(best, float(total[k]))
            step = (high - low) / 180
            low, high = max(-90.0, lats[k] - step), min(90.0, lats[k] + step)
    return best


@F.pandas_udf(T.DoubleType())
def geodesic_distance(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    known = lon1.notna() & lat1.notna() & lon2.notna() & lat2.notna()
    out = pd.Series(np.nan, index=lon1.index)
    if known.any():
        args = [s[known].to_numpy(float) for s in (lon1, lat1, lon2, lat2)]
        out[known] = geodesic_inverse(*args)
    return out.where(known, None)


def geodesic_distance_wkt(a: Column, b: Column) -> Column:
    """Metres on the WGS84 ellipsoid between two WKT points; any other geometry fails the query."""

    def coordinates(c: Column) -> tuple[Column, Column]:
        number = r"([-+0-9.eE]+)"
        pattern = rf"(?i)^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
        refuse = F.raise_error(F.concat(F.lit("geodesic distance needs points, got: "), F.substring(c, 1, 60)))
        is_point = c.isNull() | c.rlike(pattern)
        return tuple(
            F.when(is_point, F.regexp_extract(c, pattern, i).try_cast("double")).otherwise(refuse.cast("double"))
            for i in (1, 2)
        )

    return geodesic_distance(*coordinates(a), *coordinates(b))


def register(spark: SparkSession) -> None:
    """Make the Python-backed functions callable from SQL."""
    ship_package(spark)
    for relation in RELATIONS:
        spark.udf.register(f"geo_{relation}", relation_udf(relation))
    spark.udf.register("geo_distance", planar_distance)
    spark.udf.register("geo_geodesic", geodesic_distance)

