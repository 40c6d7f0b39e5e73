"""Packed trees over the segments of many geometries at once, one tree for each geometry pair of a batch.

Every row (segment or point) belongs to a numbered group, the pair it is part of. A tree's nodes hold rows of one group only, so searches and
branch-and-bound run for a whole batch of pairs together, in numpy, without looping over them, and a pair of two very large geometries takes
the same steps as many small ones. Intermediate results are cut into blocks of about ``CHUNK`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

FAN, CHUNK = 16, 1_000_000


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for the numbers from ``low`` to ``high`` (exclusive) of each row."""
    count = np.maximum(high - low, 0)
    rows = np.repeat(np.arange(len(low)), count)
    return rows, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[rows]


class Forest:
    """Boxes (x0, y0, x1, y1) by group; ``levels[0]`` are the boxes in packed order, further levels the nodes above them."""

    def __init__(self, box: np.ndarray, group: np.ndarray, groups: int):
        size = np.bincount(group, minlength=groups)
        by_x = np.lexsort((box[:, 0] + box[:, 2], group))
        first = np.cumsum(size) - size
        rank = np.arange(len(box)) - first[group[by_x]]
        width = FAN * np.ceil(np.sqrt(np.maximum(size, 1) / FAN)).astype(np.int64)
        slab = rank // width[group[by_x]]
        self.order = by_x[np.lexsort((box[by_x, 1] + box[by_x, 3], slab, group[by_x]))]
        self.levels, self.first, self.size = [box[self.order]], [first], [size]
        while self.size[-1].max(initial=0) > 1:
            below, start, count = self.levels[-1], self.first[-1], self.size[-1]
            nodes = -(-count // FAN)
            rows, step = ranges(np.zeros(groups, np.int64), nodes)
            at = start[rows] + step * FAN
            self.levels.append(np.concatenate([np.minimum.reduceat(below[:, :2], at), np.maximum.reduceat(below[:, 2:], at)], axis=1))
            self.first.append(np.cumsum(nodes) - nodes)
            self.size.append(nodes)

    def children(self, level: int, node: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, node below) of each node's children."""
        start = self.first[level - 1][group] + (node - self.first[level][group]) * FAN
        return ranges(start, np.minimum(start + FAN, self.first[level - 1][group] + self.size[level - 1][group]))

    def meeting(self, box: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (row of ``box``, row of the forest) whose boxes meet, borders included, within a group."""
        top = len(self.levels) - 1
        rows, nodes = ranges(self.first[top][group], self.first[top][group] + self.size[top][group])
        stack = [(top, rows, nodes)]
        while stack:
            level, rows, nodes = stack.pop()
            if len(rows) > CHUNK:
                half = len(rows) // 2
                stack += [(level, rows[half:], nodes[half:]), (level, rows[:half], nodes[:half])]
                continue
            theirs, mine = self.levels[level][nodes], box[rows]
            met = (mine[:, :2] <= theirs[:, 2:]).all(axis=1) & (theirs[:, :2] <= mine[:, 2:]).all(axis=1)
            rows, nodes = rows[met], nodes[met]
            if not len(rows):
                continue
            if level:
                again, below = self.children(level, nodes, group[rows])
                stack.append((level - 1, rows[again], below))
            else:
                yield rows, self.order[nodes]


def segment_boxes(segments: np.ndarray, margin: np.ndarray | float = 0.0) -> np.ndarray:
    m = np.broadcast_to(np.asarray(margin, np.float64), (len(segments),))[:, None]
    return np.concatenate([np.minimum(segments[:, :2], segments[:, 2:]) - m, np.maximum(segments[:, :2], segments[:, 2:]) + m], axis=1)


def point_to_segment(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Distance of each point to the segment in the same row."""
    d = segments[:, 2:] - segments[:, :2]
    rel = points - segments[:, :2]
    length = (d**2).sum(axis=1)
    t = np.clip((rel * d).sum(axis=1) / np.where(length == 0, 1.0, length), 0.0, 1.0)
    return np.hypot(*(rel - t[:, None] * d).T)


def cross_at(a: np.ndarray, b: np.ndarray, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments of the same row that are not parallel meet: whether they do, and how far along ``a``."""
    d1, d2, start = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2], b[:, :2] - a[:, :2]
    denominator = d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]
    long1, long2 = np.hypot(*d1.T), np.hypot(*d2.T)
    parallel = np.abs(denominator) <= 1e-12 * np.where(long1 * long2 == 0, 1.0, long1 * long2)
    safe = np.where(parallel, 1.0, denominator)
    t = (start[:, 0] * d2[:, 1] - start[:, 1] * d2[:, 0]) / safe
    u = (start[:, 0] * d1[:, 1] - start[:, 1] * d1[:, 0]) / safe
    slack1, slack2 = tol / np.maximum(long1, 1e-300), tol / np.maximum(long2, 1e-300)
    return ~parallel & (t >= -slack1) & (t <= 1 + slack1) & (u >= -slack2) & (u <= 1 + slack2), t


def nearest(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, groups: int) -> np.ndarray:
    """Shortest distance between two sets of segments by group, infinite where a set is empty.

    Branch and bound over both trees: node pairs whose boxes lie farther apart than the shortest distance known so far are dropped, and
    pairs that may be closest are opened first.
    """
    left, right = Forest(segment_boxes(a), a_group, groups), Forest(segment_boxes(b), b_group, groups)
    best = np.full(groups, np.inf)
    both = np.flatnonzero((left.size[0] > 0) & (right.size[0] > 0))
    stack = [(len(left.levels) - 1, len(right.levels) - 1, both, left.first[-1][both], right.first[-1][both])]
    while stack:
        i, j, group, p, q = stack.pop()
        mine, theirs = left.levels[i][p], right.levels[j][q]
        apart = np.maximum(np.maximum(mine[:, :2] - theirs[:, 2:], theirs[:, :2] - mine[:, 2:]), 0.0)
        least = np.hypot(*apart.T)
        if i == j == 0:
            s, t = a[left.order[p]], b[right.order[q]]
            gap = np.minimum(np.minimum(point_to_segment(s[:, :2], t), point_to_segment(s[:, 2:], t)), np.minimum(point_to_segment(t[:, :2], s), point_to_segment(t[:, 2:], s)))
            crossing, _ = cross_at(s, t, np.zeros(len(s)))
            np.minimum.at(best, group, np.where(crossing, 0.0, gap))
            continue
        # Two boxes are joined by a way no longer than the diagonal of the box around both.
        most = np.hypot(*(np.maximum(mine[:, 2:], theirs[:, 2:]) - np.minimum(mine[:, :2], theirs[:, :2])).T)
        np.minimum.at(best, group, most)
        keep = np.flatnonzero(least <= best[group])
        keep = keep[np.argsort(least[keep], kind="stable")]
        open_left = i > 0 and (i >= j)
        blocks = [keep[k : k + CHUNK // FAN] for k in range(0, len(keep), CHUNK // FAN)]
        for block in reversed(blocks):
            g, x, y = group[block], p[block], q[block]
            if open_left:
                rows, below = left.children(i, x, g)
                stack.append((i - 1, j, g[rows], below, y[rows]))
            else:
                rows, below = right.children(j, y, g)
                stack.append((i, j - 1, g[rows], x[rows], below))
    return best
