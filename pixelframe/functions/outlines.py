"""Objects of a mask and their outlines: labels by runs of rows, borders followed point by point, hulls, calipers, fitted ellipses."""

from __future__ import annotations

import math

import numpy as np

#: Steps to the eight neighbours, counter-clockwise as seen: right, up right, up, up left, left, down left, down, down right.
STEPS = [(1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)]


def label(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """For each pixel of the mask the number (y * width + x) of its component's first pixel; -1 elsewhere.

    Rows are cut into runs, and runs that touch those of the row below are united, so the work grows with the runs."""
    h, w = mask.shape
    # A gap behind each row keeps runs of neighbouring rows apart.
    wide = w + 2
    edge = np.diff(np.pad(mask, ((0, 0), (0, 2))).ravel().astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    near = int(diagonal)
    low, high = np.searchsorted(last, first + wide - near), np.searchsorted(first, last + wide + near, "right")
    many = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(first)), many)
    lower = np.repeat(low, many) + np.arange(len(upper)) - np.repeat(np.cumsum(many) - many, many)
    parent = list(range(len(first)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in zip(upper.tolist(), lower.tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(k) for k in range(len(parent))], np.int64)
    names = first[roots] // wide * w + first[roots] % wide if len(roots) else roots
    out = np.full(h * w, -1, np.int64)
    out[np.flatnonzero(mask)] = np.repeat(names, last - first + 1)
    return out.reshape(h, w)


def border(mask: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    """The (x, y) points of the outer border of the component whose first pixel is ``start``, counter-clockwise as seen, from
    there on. Where the component is one pixel thin, points come once for each way."""
    inside = np.pad(mask, 1).tolist()
    at = lambda x, y: inside[y + 1][x + 1]
    x, y = start
    # The first neighbour clockwise from the left is where the walk will come back from.
    back = next((d for d in (4, 3, 2, 1, 0, 7, 6, 5) if at(x + STEPS[d][0], y + STEPS[d][1])), None)
    if back is None:
        return np.array([start])
    end, points, d = (x + STEPS[back][0], y + STEPS[back][1]), [], back
    while True:
        points.append((x, y))
        d = next(k % 8 for k in range(d + 1, d + 9) if at(x + STEPS[k % 8][0], y + STEPS[k % 8][1]))
        to = x + STEPS[d][0], y + STEPS[d][1]
        if to == start and (x, y) == end:
            return np.array(points)
        (x, y), d = to, (d + 4) % 8


def corners(points: np.ndarray) -> np.ndarray:
    """The points of a border at which its direction changes, and the first: straight stretches keep their ends alone."""
    step = np.roll(points, -1, 0) - points
    kept = (step != np.roll(step, 1, 0)).any(1)
    kept[0] = True
    return points[kept]


def area(points: np.ndarray) -> float:
    """The area within a closed line of (x, y) points."""
    x, y = points.T.astype(float)
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def row_ends(mask: np.ndarray) -> np.ndarray:
    """(x, y) of the first and the last pixel of each row: no other pixel can be a corner of the hull."""
    rows = np.flatnonzero(mask.any(1))
    part = mask[rows]
    first, last = part.argmax(1), mask.shape[1] - 1 - part[:, ::-1].argmax(1)
    return np.unique(np.concatenate([np.stack([first, rows], 1), np.stack([last, rows], 1)]), axis=0)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (x, y) points, by a sweep from left to right and back."""
    ranked = sorted(map(tuple, points.tolist()))
    if len(ranked) < 3:
        return np.array(ranked)

    def side(rows: list) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(side(ranked) + side(ranked[::-1]))


def farthest(points: np.ndarray) -> tuple[tuple[int, int], tuple[int, int]]:
    """The two corners of a convex hull that are farthest apart: calipers go round once, for each edge to the corner that is
    farthest from it."""
    n = len(points)
    p = [tuple(map(int, q)) for q in points]
    if n < 3:
        return p[0], p[-1]
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    apart = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    best, k = (-1, p[0], p[0]), 1
    for i in range(n):
        a, b = p[i], p[(i + 1) % n]
        while abs(cross(a, b, p[(k + 1) % n])) > abs(cross(a, b, p[k])):
            k = (k + 1) % n
        # With parallel edges the next corner is as far from this edge.
        for q in (p[k], p[(k + 1) % n]):
            best = max(best, (apart(a, q), a, q), (apart(b, q), b, q), key=lambda x: x[0])
    return best[1], best[2]


def ellipse(points: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """Centre x and y, longer and shorter axis (whole lengths) and the longer one's angle in degrees of the ellipse of least
    squared algebraic distances to (x, y) points; None where they fix none: fewer than five, or all on one line."""
    points = np.unique(points, axis=0).astype(float)
    if len(points) < 5:
        return None
    middle = points.mean(0)
    size = np.abs(points - middle).max() or 1.0
    x, y = ((points - middle) / size).T
    # Squares and products on one side, the rest on the other: the rest follows from them.
    square, rest = np.stack([x * x, x * y, y * y], 1), np.stack([x, y, np.ones(len(x))], 1)
    s1, s2, s3 = square.T @ square, square.T @ rest, rest.T @ rest
    if np.linalg.cond(s3) > 1e10:
        return None
    follow = -np.linalg.solve(s3, s2.T)
    m = s1 + s2 @ follow
    # Among all conics those with 4ac - b^2 = 1 are ellipses.
    _, vectors = np.linalg.eig(np.stack([m[2] / 2, -m[1], m[0] / 2]))
    vectors = vectors.real
    fits = np.flatnonzero(4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 1e-12)
    if not len(fits):
        return None
    a, b, c = vectors[:, fits[0]]
    d, e, f = follow @ vectors[:, fits[0]]
    x0, y0 = np.linalg.solve([[2 * a, b], [b, 2 * c]], [-d, -e])
    level = a * x0 * x0 + b * x0 * y0 + c * y0 * y0 - f
    spread, axes = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]) / level)
    if spread.min() <= 0:
        return None
    longer, shorter = 2 / np.sqrt(spread)
    angle = math.degrees(math.atan2(axes[1, 0], axes[0, 0])) % 180
    return float(middle[0] + x0 * size), float(middle[1] + y0 * size), float(longer * size), float(shorter * size), angle
