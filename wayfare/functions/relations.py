"""Relations and distances of whole batches of geometry pairs.

A batch is a set of flat arrays: points and segments of all left and all right geometries, each row with the number of its pair.
Candidates come from one tree per pair (``forest``), and what the parts of two geometries say about each other is settled row by row in numpy
and summed up by pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from wayfare.functions.forest import Forest, cross_at, nearest, point_to_segment, segment_boxes


class Side:
    """Points, segments and path ends of one geometry of every pair."""

    def __init__(self, shapes: Sequence):
        self.count = len(shapes)
        self.dim = np.array([s.dim for s in shapes], np.int64)
        self.points, self.point_pair = _flat([s.points for s in shapes], 2)
        self.segments, self.segment_pair = _flat([s.segments for s in shapes], 4)
        self.ends, self.end_pair = _flat([s.ends() if s.dim == 1 and len(s.points) else np.zeros((0, 2)) for s in shapes], 2)
        #: One point of every path.
        self.heads, self.head_pair = _flat([np.stack([p[0] for p in s.paths]) if s.paths else np.zeros((0, 2)) for s in shapes], 2)
        self._forest = self._end_forest = None

    @property
    def forest(self) -> Forest:
        if self._forest is None:
            self._forest = Forest(segment_boxes(self.segments), self.segment_pair, self.count)
        return self._forest

    @property
    def end_forest(self) -> Forest:
        if self._end_forest is None:
            self._end_forest = Forest(np.concatenate([self.ends, self.ends], axis=1), self.end_pair, self.count)
        return self._end_forest


def _flat(arrays: Sequence[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate([np.zeros((0, width)), *arrays])
    return values, np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])


def _around(points: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return np.concatenate([points - margin[:, None], points + margin[:, None]], axis=1)


def locate(points: np.ndarray, pair: np.ndarray, side: Side, tol: np.ndarray) -> np.ndarray:
    """1 interior, 0 boundary, -1 exterior of the pair's geometry, for each point; ``tol`` is by pair."""
    on, inside, at_end = np.zeros(len(points), bool), np.zeros(len(points), np.int64), np.zeros(len(points), bool)
    for rows, found in side.forest.meeting(_around(points, tol[pair]), pair):
        on[rows[point_to_segment(points[rows], side.segments[found]) <= tol[pair[rows]]]] = True
    flat = np.flatnonzero(~on & (side.dim[pair] == 2))
    rays = np.concatenate([points[flat], np.full((len(flat), 1), np.inf), points[flat, 1:]], axis=1)
    for rows, found in side.forest.meeting(rays, pair[flat]):
        x, y = points[flat[rows]].T
        x0, y0, x1, y1 = side.segments[found].T
        straddles = (y0 > y) != (y1 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            right = straddles & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
        inside += np.bincount(flat[rows], weights=right, minlength=len(points)).astype(np.int64)
    for rows, found in side.end_forest.meeting(_around(points, tol[pair]), pair):
        at_end[rows[np.hypot(*(points[rows] - side.ends[found]).T) <= tol[pair[rows]]]] = True
    dim = side.dim[pair]
    area = np.where(on, 0, np.where(inside % 2 == 1, 1, -1))
    line = np.where(on, np.where(at_end, 0, 1), -1)
    return np.where(dim == 2, area, np.where(dim == 1, line, np.where(on, 1, -1)))


def _crossings(a: Side, b: Side, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a``'s segments and how far along them segments of ``b`` cross."""
    segment, along = [np.zeros(0, np.int64)], [np.zeros(0)]
    for rows, found in b.forest.meeting(segment_boxes(a.segments, tol[a.segment_pair]), a.segment_pair):
        hit, t = cross_at(a.segments[rows], b.segments[found], tol[a.segment_pair[rows]])
        segment.append(rows[hit])
        along.append(t[hit])
    return np.concatenate(segment), np.concatenate(along)


def _middles(a: Side, b: Side, cuts: tuple[np.ndarray, np.ndarray], tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, pair) of the pieces that ``a``'s segments fall into when cut by ``b``."""
    d = a.segments[:, 2:] - a.segments[:, :2]
    length = np.hypot(*d.T)
    segment, along = [cuts[0], np.arange(len(d)), np.arange(len(d))], [cuts[1], np.zeros(len(d)), np.ones(len(d))]
    ends, pair = np.concatenate([b.segments[:, :2], b.segments[:, 2:]]), np.tile(b.segment_pair, 2)
    for rows, found in a.forest.meeting(_around(ends, tol[pair]), pair):
        rel = ends[rows] - a.segments[found, :2]
        t = (rel * d[found]).sum(axis=1) / np.where(length[found] == 0, 1.0, length[found] ** 2)
        near = np.hypot(*(rel - t[:, None] * d[found]).T) <= tol[pair[rows]]
        inner = near & (t > 0) & (t < 1)
        segment.append(found[inner])
        along.append(t[inner])
    seg, at = np.concatenate(segment), np.clip(np.concatenate(along), 0.0, 1.0)
    order = np.lexsort((at, seg))
    seg, at = seg[order], at[order]
    keep = (seg[1:] == seg[:-1]) & ((at[1:] - at[:-1]) * length[seg[:-1]] > tol[a.segment_pair[seg[:-1]]])
    seg, middle = seg[:-1][keep], ((at[1:] + at[:-1]) / 2)[keep]
    return a.segments[seg, :2] + middle[:, None] * d[seg], a.segment_pair[seg]


class Matrix:
    """Which interiors, boundaries and exteriors meet, by pair, and the dimension of the interiors' meeting (-1: none)."""

    def __init__(self, pairs: int):
        self.inner = np.full(pairs, -1)
        self.cells = {name: np.zeros(pairs, bool) for name in ("IB", "BI", "BB", "IE", "EI", "BE", "EB")}

    def mark(self, name: str, pairs: np.ndarray, dimension: int = 0) -> None:
        if name == "II":
            self.inner[pairs] = np.maximum(self.inner[pairs], dimension)
        elif name != "EE":
            self.cells[name][pairs] = True


_LETTERS = ((1, "I"), (0, "B"), (-1, "E"))


def _half(a: Side, b: Side, tol: np.ndarray, m: Matrix, key: str) -> None:
    """What the parts of ``a`` say about the matrix; ``key`` orders the two letters."""
    solid, other = a.dim[a.point_pair] == 0, b.dim
    found = locate(a.points[solid], a.point_pair[solid], b, tol)
    for code, letter in _LETTERS:
        m.mark(key.format("I", letter), a.point_pair[solid][found == code], 0)

    cuts = _crossings(a, b, tol)
    middles, pair = _middles(a, b, cuts, tol)
    drawn = a.dim[pair] > 0
    middles, pair = middles[drawn], pair[drawn]
    found = locate(middles, pair, b, tol)
    # A finite set of points never fills a piece.
    found = np.where(other[pair] == 0, -1, found)
    for code, letter in _LETTERS:
        hit = found == code
        m.mark(key.format("I", letter), pair[hit & (a.dim[pair] == 1)], 1)
        m.mark(key.format("B", letter), pair[hit & (a.dim[pair] == 2)], 1)

    crossing = a.segments[cuts[0], :2] + cuts[1][:, None] * (a.segments[cuts[0], 2:] - a.segments[cuts[0], :2])
    corners = np.concatenate([crossing, a.points, b.points])
    pair = np.concatenate([a.segment_pair[cuts[0]], a.point_pair, b.point_pair])
    drawn = a.dim[pair] > 0
    corners, pair = corners[drawn], pair[drawn]
    in_a, in_b = locate(corners, pair, a, tol), locate(corners, pair, b, tol)
    for code_a, letter_a in _LETTERS[:2]:
        for code_b, letter_b in _LETTERS:
            hit = (in_a == code_a) & (in_b == code_b)
            if letter_a == "I" and letter_b == "E":
                hit &= a.dim[pair] == 1
            m.mark(key.format(letter_a, letter_b), pair[hit], 0)


def matrices(a: Side, b: Side, areas: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Matrix:
    """``areas``: of the left and the right geometries, and what they have in common."""
    low, high = np.full((a.count, 2), np.inf), np.full((a.count, 2), -np.inf)
    for side in (a, b):
        np.minimum.at(low, side.point_pair, side.points)
        np.maximum.at(high, side.point_pair, side.points)
    tol = 1e-10 * np.maximum((high - low).max(axis=1), 1e-300) + 4e-16 * np.maximum(np.abs(low), np.abs(high)).max(axis=1)
    m = Matrix(a.count)
    _half(a, b, tol, m, "{0}{1}")
    _half(b, a, tol, m, "{1}{0}")
    solid = (a.dim == 2) & (b.dim == 2)
    of_a, of_b, common = areas
    least = 1e-9 * np.minimum(of_a, of_b)
    m.inner = np.where(solid & (common > least), 2, m.inner)
    m.cells["IE"] = np.where(solid, of_a - common > least, m.cells["IE"] | (a.dim == 2))
    m.cells["EI"] = np.where(solid, of_b - common > least, m.cells["EI"] | (b.dim == 2))
    return m


def holds(m: Matrix, a_dim: np.ndarray, b_dim: np.ndarray, relation: str) -> np.ndarray:
    """One named relation, by pair."""
    c, inner = m.cells, m.inner >= 0
    meet = inner | c["IB"] | c["BI"] | c["BB"]
    if relation == "disjoint":
        return ~meet
    if relation == "intersects":
        return meet
    if relation == "contains":
        return inner & ~c["EI"] & ~c["EB"]
    if relation == "within":
        return inner & ~c["IE"] & ~c["BE"]
    if relation == "covers":
        return meet & ~c["EI"] & ~c["EB"]
    if relation == "touches":
        return ~inner & meet
    if relation == "overlaps":
        return (a_dim == b_dim) & (m.inner == a_dim) & c["IE"] & c["EI"]
    if relation == "crosses":
        same = (a_dim == 1) & (m.inner == 0)
        return np.where(a_dim == b_dim, same, inner & np.where(a_dim < b_dim, c["IE"], c["EI"]))
    raise ValueError(f"unknown relation: {relation}")


def distances(a: Side, b: Side) -> np.ndarray:
    """Shortest distances by pair: 0 where segments cross or a path of one lies inside the other."""
    out = nearest(a.segments, a.segment_pair, b.segments, b.segment_pair, a.count)
    for inner, outer in ((a, b), (b, a)):
        asked = (outer.dim[inner.head_pair] == 2) & (out[inner.head_pair] > 0)
        within = locate(inner.heads[asked], inner.head_pair[asked], outer, np.zeros(a.count)) >= 0
        out[inner.head_pair[asked][within]] = 0.0
    return out
