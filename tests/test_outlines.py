"""Labels, borders, hulls, calipers and fitted ellipses against brute force and against curves that are known."""

import math
import time

import numpy as np
import pytest

from pixelframe.functions import outlines
from pixelframe.functions.kernels import components


def flooded(mask, diagonal):
    h, w = mask.shape
    out = np.full((h, w), -1)
    for y in range(h):
        for x in range(w):
            if mask[y, x] and out[y, x] < 0:
                todo, out[y, x] = [(y, x)], y * w + x
                while todo:
                    b, a = todo.pop()
                    for dx, dy in outlines.STEPS if diagonal else outlines.STEPS[::2]:
                        j, i = b + dy, a + dx
                        if 0 <= j < h and 0 <= i < w and mask[j, i] and out[j, i] < 0:
                            out[j, i] = y * w + x
                            todo.append((j, i))
    return out


MASKS = [np.random.default_rng(k).random(shape) < share for k, (shape, share) in enumerate([((9, 13), 0.5), ((1, 20), 0.6), ((20, 1), 0.6), ((17, 17), 0.3), ((30, 31), 0.7), ((5, 5), 0.0), ((5, 6), 1.0), ((40, 40), 0.59), *(((25, 25), 0.35),) * 6])]


@pytest.mark.parametrize("diagonal", [True, False])
def test_labels_against_a_flood(diagonal):
    for mask in MASKS:
        assert np.array_equal(outlines.label(mask, diagonal), flooded(mask, diagonal))


def test_labels_of_noise_take_one_pass():
    mask = np.random.default_rng(9).random((512, 512)) < 0.5
    began = time.time()
    outlines.label(mask)
    assert time.time() - began < 2


def test_borders_against_definitions():
    """A border has the pixels with a side outside, step by step, back to its start; its area is that of whole and half cells."""
    seen = 0
    for mask in MASKS:
        labels, areas = components(mask)
        w = mask.shape[1]
        for name, area in areas.items():
            own = np.pad(labels == name, 1)
            points = outlines.border(own[1:-1, 1:-1], (name % w, name // w))
            edge = own & ~np.pad(own[:-2, 1:-1] & own[2:, 1:-1] & own[1:-1, :-2] & own[1:-1, 2:], 1)
            assert {tuple(p) for p in points.tolist()} == {(x - 1, y - 1) for y, x in np.argwhere(edge).tolist()}
            assert tuple(points[0]) == (name % w, name // w)
            steps = np.abs(np.roll(points, -1, 0) - points).max(1)
            assert (steps == 1).all() or len(points) == 1
            assert outlines.area(points) == area
            few = outlines.corners(points)
            assert outlines.area(few) == area and len(few) <= len(points)
            x, y = points.T.astype(float)
            assert ((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) <= 0  # counter-clockwise as seen, y going down
            seen += len(points) > 4
    assert seen > 20


def test_corners_of_a_rectangle_are_four():
    mask = np.zeros((9, 12), bool)
    mask[2:7, 3:11] = True
    assert outlines.corners(outlines.border(mask, (3, 2))).tolist() == [[3, 2], [3, 6], [10, 6], [10, 2]]


def test_hulls_of_row_ends_and_calipers_against_all_pairs():
    for k in range(60):
        random = np.random.default_rng(k)
        mask = random.random(random.integers(1, 12, 2)) < random.choice([0.2, 0.6, 1.0])
        if not mask.any():
            continue
        points = np.argwhere(mask)[:, ::-1]
        hull = outlines.hull(outlines.row_ends(mask))
        assert np.array_equal(hull, outlines.hull(points))
        a, b = outlines.farthest(hull)
        assert math.dist(a, b) == pytest.approx(max(math.dist(p, q) for p in points for q in points))


@pytest.mark.parametrize("angle", [0, 20, 45, 90, 133, 179])
def test_ellipses_are_found_again(angle):
    t, turn = np.linspace(0, 2 * np.pi, 60, endpoint=False), math.radians(angle)
    x, y = 30 * np.cos(t), 11 * np.sin(t)
    points = np.stack([200 + x * np.cos(turn) - y * np.sin(turn), 90 + x * np.sin(turn) + y * np.cos(turn)], 1)
    x0, y0, longer, shorter, found = outlines.ellipse(points)
    assert (x0, y0, longer, shorter) == pytest.approx((200, 90, 60, 22), abs=1e-4) and min(abs(found - angle), 180 - abs(found - angle)) < 1e-3
    noisy = outlines.ellipse(points + np.random.default_rng(angle).normal(0, 0.3, points.shape))
    assert noisy[:4] == pytest.approx((200, 90, 60, 22), abs=1)


def test_ellipses_that_nothing_fixes():
    assert outlines.ellipse(np.array([[0, 0], [1, 0], [0, 1], [1, 1]])) is None
    assert outlines.ellipse(np.stack([np.arange(9), 2 * np.arange(9)], 1)) is None
    assert outlines.ellipse(np.repeat([[3, 3], [4, 4]], 9, axis=0)) is None
