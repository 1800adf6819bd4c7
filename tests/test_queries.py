import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.functions import kernels
from pixelframe.operators import drawplan, features, pixels
from pixelframe.queries import FIXED, ORACLE, QUERIES
from pixelframe.sources.images import embeddings_as_images


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(FIXED))
def test_function_equals_sql(name, same_as_sql):
    same_as_sql(*FIXED[name])


@pytest.fixture(scope="module")
def held(spark, tables):
    return {r.image_id: (r["class"], np.frombuffer(r.data, np.uint8).reshape(8, 8, 3)) for r in embeddings_as_images(spark, tables).collect()}


def digest(image):
    return hashlib.sha256(np.ascontiguousarray(image, np.uint8).tobytes()).hexdigest()


def test_composed_copies_against_one_loop(spark, tables, held):
    plan, expected = list(drawplan.draws(2, 42)), set()
    for key, (kind, image) in held.items():
        for k, (_, seed, methods, steps) in enumerate(plan):
            expected.add((kind, f"v{key}.png", f"v{key}_{'_'.join(methods)}_{k}.png", digest(kernels.compose(image, steps, seed))))
    got = [(r["class"], r.name, r.output, r.sha256) for r in QUERIES["compose_augment"](spark, tables).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_balanced_copies_against_one_loop(spark, tables, held):
    classes, expected = {}, set()
    for key, (kind, image) in held.items():
        classes.setdefault(kind, {})[f"v{key}.png"] = image
    target = max(map(len, classes.values()))
    for kind, files in classes.items():
        kept, seen = [], set()
        for name in sorted(files):
            if digest(files[name]) not in seen:
                kept.append(name)
            seen.add(digest(files[name]))
        plan, need = drawplan.draws(10**6, 42), max(0, target - len(kept))
        for i, name in enumerate(kept):
            for k in range(need // len(kept) + (i < need % len(kept))):
                _, seed, methods, steps = next(plan)
                expected.add((kind, name, f"{name[:-4]}_{'_'.join(methods)}_{k}.png", digest(kernels.compose(files[name], steps, seed))))
    got = [(r["class"], r.name, r.output, r.sha256) for r in QUERIES["balance_images"](spark, tables).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_transforms_against_one_loop(spark, tables, held):
    """The images that other queries, held against SQL, make pixel by pixel, and charts and drawings by their definitions."""
    got = {(r.image_id, r.transform): r.sha256 for r in QUERIES["transform_all"](spark, tables).collect()}

    def whole(rows):
        found = {}
        for r in rows.collect():
            found.setdefault(r.image_id, np.zeros((8, 8, 3), np.uint8))[r.y, r.x] = (r.b, r.g, r.r)
        return {key: digest(image) for key, image in found.items()}

    expected = {(key, "original"): digest(image) for key, (_, image) in held.items()}
    for name, query in {"blur": "gaussian_blur", "mask": "masked_image", "roi": "roi_overlay", "pseudolandmarks": "landmark_overlay"}.items():
        expected |= {(key, name): sha for key, sha in whole(QUERIES[query](spark, tables)).items()}
    drawn = {key for key, name in got if name == "histogram"}
    few = sorted(drawn)[::20]  # charts are slow to draw point by point
    shares = {}
    for r in QUERIES["channel_histogram"](spark, tables).where(F.col("image_id").isin(few)).collect():
        shares.setdefault(r.image_id, {}).setdefault(r.channel, np.zeros(256))[r.intensity] = r.pct / 100
    colours = dict(zip(pixels.CHANNELS, kernels.CURVES, strict=True))
    for key, curves in shares.items():
        chart, most = np.full((400, 700, 3), 255, np.uint8), max(c.max() for c in curves.values())
        chart[380, 20:680] = chart[20:380, 20] = 0
        for channel, colour in colours.items():
            points = [(20 + k * 660 // 255, 380 - round(curves[channel][k] / most * 360)) for k in range(256)]
            for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
                for step in range((n := max(abs(x1 - x0), abs(y1 - y0))) + 1):
                    chart[round(y0 + (y1 - y0) * step / n) if n else y0, round(x0 + (x1 - x0) * step / n) if n else x0] = colour
        expected[key, "histogram"] = digest(chart)
    assert {k: v for k, v in got.items() if k[1] != "analyze" and (k[1] != "histogram" or k[0] in few)} == expected
    assert {key for key, name in got if name == "analyze"} == drawn == {key for key, name in got if name == "roi"}


def test_analysis_by_its_parts(spark, tables, held):
    """The largest object's border, box, hull and longest way in their colours, from rows of other queries; all else stays."""
    big = {}
    for r in QUERIES["largest_leaf"](spark, tables).collect():
        big.setdefault(r.image_id, set()).add((r.x, r.y))
    got = {r.image_id: np.frombuffer(r.data, np.uint8).reshape(8, 8, 3) for r in features.transform_all(embeddings_as_images(spark, tables), ("analyze",)).where("transform = 'analyze'").collect()}
    assert got.keys() == big.keys()
    for key, on in big.items():
        xs, ys = [x for x, _ in on], [y for _, y in on]
        frame = {(x, y) for x in range(min(xs), max(xs) + 1) for y in range(min(ys), max(ys) + 1) if x in (min(xs), max(xs)) or y in (min(ys), max(ys))}
        edge = {(x, y) for x, y in on if any((x + dx, y + dy) not in on for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))}
        for y in range(8):
            for x in range(8):
                colour = tuple(got[key][y, x].tolist())
                # Hull and way across run within the box, over the object and its bays.
                if colour == (255, 0, 0):
                    assert (x, y) in edge
                elif colour not in ((255, 0, 255), (0, 165, 255)):
                    assert (x, y) not in edge | frame and colour == tuple(held[key][1][y, x].tolist())
                else:
                    assert min(xs) <= x <= max(xs) and min(ys) <= y <= max(ys)
        assert any(tuple(c) == (0, 165, 255) for c in got[key].reshape(-1, 3).tolist())


def test_shapes_against_definitions(spark, tables, held):
    """Hull, longest way, perimeter and ellipse by their definitions, over all pairs and pixels."""
    rows = {r.image_id: r for r in QUERIES["shape_traits"](spark, tables).collect()}
    for key, (_, image) in held.items():
        mask = kernels.largest(kernels.leaf_mask(image))
        assert (mask is None) == (key not in rows)
        if mask is None:
            continue
        points, row = np.argwhere(mask)[:, ::-1], rows[key]
        assert row.area == len(points) and row.longest_path == pytest.approx(max(np.hypot(*(a - b)) for a in points for b in points))
        on = {tuple(p) for p in points.tolist()}
        assert row.perimeter == sum(any((x + dx, y + dy) not in on for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))) for x, y in on)
        # A pixel is a corner or on the edge of the hull if all others lie on one side of a line through it.
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        edges = [(a, b) for a in points for b in points if tuple(a) != tuple(b) and all(cross(a, b, c) >= 0 for c in points)]
        ends = {}
        for a, b in edges:  # of edges on one line the longest
            if tuple(a) not in ends or np.hypot(*(b - a)) > np.hypot(*(ends[tuple(a)] - a)):
                ends[tuple(a)] = b
        full = [(np.array(a), b) for a, b in ends.items() if not any(tuple(b) == tuple(d) and np.hypot(*(d - c)) > np.hypot(*(b - np.array(a))) for c, d in ((np.array(c), d) for c, d in ends.items()))]
        area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in full)) / 2
        assert row.hull_area == pytest.approx(area)
        spread = np.cov(points.T, bias=True) if len(points) > 1 else np.zeros((2, 2))
        small, large = np.linalg.eigvalsh(spread)
        assert row.ellipse_major == pytest.approx(4 * np.sqrt(max(0, large)), abs=1e-6) and row.ellipse_minor == pytest.approx(4 * np.sqrt(max(0, small)), abs=1e-6)
