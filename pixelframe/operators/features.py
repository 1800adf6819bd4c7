"""Masks and features of images: each image is decoded, masked and labelled once, whatever is asked of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.functions import kernels, outlines, sheets
from pixelframe.functions.kernels import Leaf
from pixelframe.operators import pixels

#: Transforms in their order.
TRANSFORMS = ("blur", "mask", "roi", "analyze", "pseudolandmarks", "histogram")
SIZES = "area long, x int, y int, width int, height int, sum_x long, sum_y long, centre_x double, centre_y double, in_frame boolean"
TRAITS = SIZES + (
    ", hull_area double, hull_corners int, solidity double, perimeter long, longest_path double, ellipse_major double, ellipse_minor double, ellipse_angle double, "
    "eccentricity double, fit_x double, fit_y double, fit_major double, fit_minor double, fit_angle double"
)


def _masks(images: DataFrame, of) -> DataFrame:
    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        if (mask := of(image)) is not None:
            yield {"height": row["height"], "width": row["width"], "data": (mask * np.uint8(255)).astype(np.uint8).tobytes()}

    return kernels.map_images(images, work, "height int, width int, data binary")


def leaf_masks(images: DataFrame) -> DataFrame:
    """Masks (one byte a pixel, 0 or 255) of leaf pixels, opened and closed."""
    return _masks(images, kernels.leaf_mask)


def largest_masks(images: DataFrame) -> DataFrame:
    """Masks of the largest object, filled; images without an object have none."""
    return _masks(images, largest_mask)


def objects(images: DataFrame) -> DataFrame:
    """``image_id, class, object, pixels, area``: the objects of each leaf mask, named by their first pixel."""

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        labels, areas = Leaf(image).objects
        counts = np.bincount(labels[labels >= 0], minlength=1)
        yield from ({"object": name, "pixels": int(counts[name]), "area": area} for name, area in areas.items())

    return kernels.map_images(images, work, "object int, pixels long, area double")


def contours(images: DataFrame, whole: bool = False) -> DataFrame:
    """``image_id, class, object, nth, x, y``: the outer border of each object, its holes filled, in order from its first pixel
    on, counter-clockwise as seen; of straight stretches the ends alone, or with ``whole`` every point."""

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        labels, areas = Leaf(image).objects
        for name in areas:
            points = outlines.border(labels == name, (name % row["width"], name // row["width"]))
            for nth, (x, y) in enumerate((points if whole else outlines.corners(points)).tolist()):
                yield {"object": name, "nth": nth, "x": x, "y": y}

    return kernels.map_images(images, work, "object int, nth int, x int, y int")


def masked_image(leaf: Leaf) -> np.ndarray:
    return np.where(leaf.mask[..., None], leaf.image, 0)


def largest_mask(image: np.ndarray) -> np.ndarray | None:
    return Leaf(image).largest


def landmark_image(leaf: Leaf) -> np.ndarray | None:
    return None if leaf.largest is None else kernels.draw_landmarks(leaf.image, kernels.landmarks(leaf.largest))


def analyzed_image(leaf: Leaf) -> np.ndarray | None:
    """The largest object's outline, hull, box and longest way across drawn over the image."""
    mask = leaf.largest
    if mask is None:
        return None
    padded, out = np.pad(mask, 1), leaf.image.copy()
    inner = padded[1:-1, :-2] & padded[1:-1, 2:] & padded[:-2, 1:-1] & padded[2:, 1:-1]
    x, y, w, h = kernels.box(mask)
    out[y : y + h, [x, x + w - 1]] = (255, 0, 255)
    out[[y, y + h - 1], x : x + w] = (255, 0, 255)
    out[mask & ~inner] = (255, 0, 0)
    corners = outlines.hull(outlines.row_ends(mask))
    for start, end in zip(corners, np.roll(corners, -1, 0), strict=True):
        kernels.line(out, start, end, (255, 0, 255))
    kernels.line(out, *outlines.farthest(corners), (0, 165, 255))
    return out


def histogram_image(leaf: Leaf) -> np.ndarray | None:
    """The chart of the largest object's channels; it has a size of its own."""
    return None if leaf.largest is None else kernels.histogram_chart(leaf.image, leaf.largest)


def sizes(images: DataFrame) -> DataFrame:
    """Pixels, box and centre of the largest object of each image."""

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        if (leaf := Leaf(image)).largest is not None:
            yield kernels.size_traits(leaf)

    return kernels.map_images(images, work, SIZES)


def traits(images: DataFrame) -> DataFrame:
    """Measures of the largest object of each image."""

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        if (leaf := Leaf(image)).largest is not None:
            yield kernels.shape_traits(leaf)

    return kernels.map_images(images, work, TRAITS)


def landmark_points(images: DataFrame, bands: int = kernels.BANDS) -> DataFrame:
    """``side, band, x, y`` of the largest object of each image."""

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        if (mask := largest_mask(image)) is not None:
            yield from ({"side": s, "band": k, "x": x, "y": y} for s, k, x, y in kernels.landmarks(mask, bands))

    return kernels.map_images(images, work, "side string, band int, x int, y int")


def landmark_bands(images: DataFrame, bands: int = kernels.BANDS) -> DataFrame:
    """``image_id, class, band, left_x, right_x, centre_x, centre_y``: the same, a row for each band."""

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        if (mask := largest_mask(image)) is not None:
            points = kernels.landmarks(mask, bands)
            for (_, band, left, y), (_, _, right, _), (_, _, centre, _) in zip(points[::3], points[1::3], points[2::3], strict=True):
                yield {"band": band, "left_x": left, "right_x": right, "centre_x": centre, "centre_y": y}

    return kernels.map_images(images, work, "band int, left_x int, right_x int, centre_x long, centre_y long")


def histograms(images: DataFrame) -> DataFrame:
    """``image_id, channel, intensity, pct``: of the pixels of the largest object, in nine channels, for each of 256 values.

    A task counts an image's pixels itself and sends one row of counts, which are told apart afterwards: nothing is shuffled."""

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        if (mask := largest_mask(image)) is not None:
            yield {"total": int(mask.sum()), "counts": kernels.channel_counts(image, mask).ravel()}

    counted = kernels.map_images(images, work, "total long, counts array<long>")
    each = counted.select("image_id", "total", F.posexplode("counts").alias("at", "n"))
    names = F.array(*map(F.lit, pixels.CHANNELS))
    return each.select("image_id", F.get(names, F.expr("at div 256").cast("int")).alias("channel"), F.expr("at % 256").alias("intensity"), (F.col("n") / F.col("total") * 100).alias("pct"))


#: What each transform makes of an image; None where there is no object.
IMAGES = {
    "mask": masked_image, "roi": kernels.roi, "analyze": analyzed_image, "pseudolandmarks": landmark_image, "histogram": histogram_image,
}


def transformed(image: np.ndarray, transforms: tuple[str, ...] = TRANSFORMS, strength: int = 9) -> Iterator[tuple[str, np.ndarray]]:
    """The transforms that the image has, by name, the original first."""
    leaf = Leaf(image)
    yield "original", image
    for name in (t for t in TRANSFORMS if t in transforms):
        out = kernels.blur(image, strength) if name == "blur" else IMAGES[name](leaf)
        if out is not None:
            yield name, np.ascontiguousarray(out, np.uint8)


def transform_all(images: DataFrame, transforms: tuple[str, ...] = TRANSFORMS, strength: int = 9) -> DataFrame:
    """``transform, height, width, data`` of each image, the original first. For histograms as tables see histograms()."""

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        for name, out in transformed(image, transforms, strength):
            yield {"transform": name, "height": out.shape[0], "width": out.shape[1], "data": out.tobytes()}

    return kernels.map_images(images, work, "transform string, height int, width int, data binary")


def contact_sheets(images: DataFrame, transforms: tuple[str, ...] = TRANSFORMS, strength: int = 9, columns: int = 4, cell: int = 256, gap: int = 8) -> DataFrame:
    """``height, width, data`` of one sheet for each image: the original and its transforms in their order, side by side."""

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        out = sheets.sheet([part for _, part in transformed(image, transforms, strength)], columns, cell, gap)
        yield {"height": out.shape[0], "width": out.shape[1], "data": out.tobytes()}

    return kernels.map_images(images, work, "height int, width int, data binary")
