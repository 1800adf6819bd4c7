"""Numpy kernels on one image (height, width, 3 bytes: blue, green, red), and the tasks that run them in Arrow batches.

Sampling is bilinear in 64-bit floats, outside is white, values are rounded half up."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.outlines import border, ellipse, farthest, hull, label, row_ends

WHITE = 255.0
#: Bytes of what a task makes that it sends on together.
SENT = 16 << 20


def flip(image: np.ndarray) -> np.ndarray:
    return image[:, ::-1]


def _sample(image: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """Bilinear values at (sx, sy); neighbours outside the image are white."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(sx), np.floor(sy)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    x0, y0 = np.clip(x0, -2, w + 1).astype(int), np.clip(y0, -2, h + 1).astype(int)

    def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        return np.where(inside[..., None], image[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)].astype(float), WHITE)

    value = (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x0 + 1)) + fy * ((1 - fx) * at(y0 + 1, x0) + fx * at(y0 + 1, x0 + 1))
    return np.floor(value + 0.5).astype(np.uint8)


def _warp(image: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Each output pixel takes the value where the inverse map puts it."""
    y, x = np.indices(image.shape[:2]).astype(float)
    m = inverse
    below = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    return _sample(image, (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / below, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / below)


def rotation(h: int, w: int, angle: float) -> np.ndarray:
    """Inverse map of a turn by ``angle`` degrees, counter-clockwise, about the middle."""
    a, b = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    cx, cy = w / 2, h / 2
    return np.linalg.inv(np.array([[a, b, (1 - a) * cx - b * cy], [-b, a, b * cx + (1 - a) * cy], [0, 0, 1]]))


def shearing(kx: float, ky: float) -> np.ndarray:
    return np.linalg.inv(np.array([[1, kx, 0], [ky, 1, 0], [0, 0, 1]]))


def skewing(h: int, w: int, skx: float, sky: float) -> np.ndarray:
    there, back = np.array([[1, 0, -w / 2], [0, 1, -h / 2], [0, 0, 1]]), np.array([[1, 0, w / 2], [0, 1, h / 2], [0, 0, 1]])
    return np.linalg.inv(back @ np.array([[1, 0, 0], [0, 1, 0], [skx / w, sky / h, 1]]) @ there)


def rotate(image: np.ndarray, angle: float = 25.0) -> np.ndarray:
    return _warp(image, rotation(*image.shape[:2], angle))


def shear(image: np.ndarray, kx: float, ky: float) -> np.ndarray:
    return _warp(image, shearing(kx, ky))


def skew(image: np.ndarray, skx: float = 0.001, sky: float = 0.008) -> np.ndarray:
    return _warp(image, skewing(*image.shape[:2], skx, sky))


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear between pixel centres; beyond the outermost centres the edge goes on."""
    ih, iw = image.shape[:2]
    sy = np.clip((np.arange(h) + 0.5) * (ih / h) - 0.5, 0, ih - 1)
    sx = np.clip((np.arange(w) + 0.5) * (iw / w) - 0.5, 0, iw - 1)
    return _sample(image, np.broadcast_to(sx, (h, w)), np.broadcast_to(sy[:, None], (h, w)))


def crop(image: np.ndarray, scale: float = 0.5, random: np.random.RandomState | None = None, top: int | None = None, left: int | None = None) -> np.ndarray:
    """A part of ``scale`` of each side, brought back to full size; where it is comes from ``random`` if not given."""
    h, w = image.shape[:2]
    ch, cw = int(h * scale), int(w * scale)
    random = random or np.random.RandomState(0)
    top = int(random.randint(0, h - ch + 1)) if top is None else top
    left = int(random.randint(0, w - cw + 1)) if left is None else left
    return resize(image[top : top + ch, left : left + cw], h, w)


def distortion(image: np.ndarray, k: float = 0.3) -> np.ndarray:
    h, w = image.shape[:2]
    cx, cy = w / 2, h / 2
    y, x = np.indices((h, w)).astype(float)
    pull = k * (((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (cx * cx + cy * cy))
    return _sample(image, x + (x - cx) * pull, y + (y - cy) * pull)


def gauss(strength: int) -> np.ndarray:
    if strength < 1 or strength % 2 == 0:
        raise ValueError("the strength of a blur must be positive and odd")
    sigma = 0.3 * ((strength - 1) * 0.5 - 1) + 0.8
    x = np.arange(strength) - strength // 2
    weights = np.exp(-(x * x) / (2 * sigma * sigma))
    return weights / weights.sum()


def blur(image: np.ndarray, strength: int = 9) -> np.ndarray:
    """Gaussian blur; the edge is a mirror that does not repeat the outermost pixels."""
    weights, r = gauss(strength), strength // 2

    def pass_over(values: np.ndarray) -> np.ndarray:
        n = len(values)
        at = np.arange(-r, n + r)
        at = np.abs(at % (2 * n - 2) if n > 1 else at * 0)
        padded = values[np.where(at >= n, 2 * n - 2 - at, at)]
        total = weights[0] * padded[:n]
        for k in range(1, strength):
            total = total + weights[k] * padded[k : k + n]
        return total

    across = pass_over(image.astype(float).swapaxes(0, 1)).swapaxes(0, 1)
    return np.floor(pass_over(across) + 0.5).astype(np.uint8)


def _divided(top: int) -> np.ndarray:
    """Fixed-point quotients of ``top`` by 1 to 255."""
    return np.array([0, *(int(np.rint(top / v)) for v in range(1, 256))], np.int64)


_BY_VALUE, _BY_RANGE = _divided(255 << 12), np.array([0, *(int(np.rint((180 << 12) / (6.0 * v))) for v in range(1, 256))], np.int64)


def hsv(image: np.ndarray) -> np.ndarray:
    b, g, r = (image[..., k].astype(np.int64) for k in range(3))
    v = np.maximum(np.maximum(b, g), r)
    d = v - np.minimum(np.minimum(b, g), r)
    s = (d * _BY_VALUE[v] + 2048) >> 12
    h = np.where(v == r, g - b, np.where(v == g, b - r + 2 * d, r - g + 4 * d))
    h = (h * _BY_RANGE[d] + 2048) >> 12
    return np.stack([np.where(h < 0, h + 180, h), s, v], -1)


def leaf(image: np.ndarray) -> np.ndarray:
    """Pixels of a leaf's colour."""
    h, s, v = np.moveaxis(hsv(image), -1, 0)
    return (v > 25) & (s > 25) & (h <= 95)


PLUS = [(0, -1), (-1, 0), (0, 0), (1, 0), (0, 1)]
ELLIPSE = [(0, -2), (0, 2), *((dx, dy) for dy in (-1, 0, 1) for dx in range(-2, 3))]


def _moved(mask: np.ndarray, offsets: list[tuple[int, int]], outside: bool) -> Iterator[np.ndarray]:
    h, w = mask.shape
    r = max(max(abs(dx), abs(dy)) for dx, dy in offsets)
    padded = np.pad(mask, r, constant_values=outside)
    for dx, dy in offsets:
        yield padded[r + dy : r + dy + h, r + dx : r + dx + w]


def erode(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_and.reduce(list(_moved(mask, offsets, True)))


def dilate(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce(list(_moved(mask, offsets, False)))


def leaf_mask(image: np.ndarray) -> np.ndarray:
    """The leaf's pixels, opened by a plus of 3 and closed by an ellipse of 5; outside pixels do not count."""
    opened = dilate(erode(leaf(image), PLUS), PLUS)
    return erode(dilate(opened, ELLIPSE), ELLIPSE)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    outside = label(np.pad(~mask, 1, constant_values=True), diagonal=False)
    return outside[1:-1, 1:-1] != 0


def components(mask: np.ndarray) -> tuple[np.ndarray, dict[int, float]]:
    """Labels of the components with their holes filled, and the area of each outline through pixel centres."""
    labels = label(fill_holes(mask))
    corners = [labels[:-1, :-1], labels[:-1, 1:], labels[1:, :-1], labels[1:, 1:]] if min(mask.shape) > 1 else []
    areas = dict.fromkeys(np.unique(labels[labels >= 0]).tolist(), 0.0)
    if corners:
        cell = np.max(corners, axis=0)
        n = sum((c == cell).astype(int) for c in corners)
        for of in (3, 4):
            found, counts = np.unique(cell[(n == of) & (cell >= 0)], return_counts=True)
            for name, count in zip(found.tolist(), counts.tolist(), strict=True):
                areas[name] += count * (0.5 if of == 3 else 1.0)
    return labels, areas


class Leaf:
    """What jobs ask of one image: its mask, objects and largest object, each computed once, when it is first asked for."""

    def __init__(self, image: np.ndarray) -> None:
        self.image = image

    @cached_property
    def mask(self) -> np.ndarray:
        return leaf_mask(self.image)

    @cached_property
    def objects(self) -> tuple[np.ndarray, dict[int, float]]:
        return components(self.mask)

    @cached_property
    def name(self) -> int | None:
        return largest_of(self.objects[1])

    @cached_property
    def largest(self) -> np.ndarray | None:
        return None if self.name is None else self.objects[0] == self.name

    @cached_property
    def outline(self) -> np.ndarray:
        """The largest object's border."""
        return border(self.largest, (self.name % self.mask.shape[1], self.name // self.mask.shape[1]))


def largest_of(areas: dict[int, float]) -> int | None:
    """The object of the largest outline; of equals the one that begins first. None without any."""
    return max(areas, key=lambda k: (areas[k], -k)) if areas else None


def largest(mask: np.ndarray) -> np.ndarray | None:
    """The component of the largest outline, its holes filled."""
    labels, areas = components(mask)
    name = largest_of(areas)
    return None if name is None else labels == name


def box(mask: np.ndarray) -> tuple[int, int, int, int]:
    """x, y, width and height of what the mask spans."""
    y, x = np.nonzero(mask)
    return int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)


def roi(leaf: Leaf) -> np.ndarray | None:
    """The objects that meet the box of the largest in green, and the box in blue, three pixels thick."""
    if leaf.largest is None:
        return None
    x, y, w, h = box(leaf.largest)
    labels, _ = leaf.objects
    met = np.unique(labels[y : y + h, x : x + w])
    out = leaf.image.copy()
    out[np.isin(labels, met[met >= 0])] = (0, 255, 0)
    rows, cols = np.indices(labels.shape)
    near = (rows >= y - 1) & (rows <= y + h) & (cols >= x - 1) & (cols <= x + w)
    inner = (rows > y + 1) & (rows < y + h - 2) & (cols > x + 1) & (cols < x + w - 2)
    out[near & ~inner] = (255, 0, 0)
    return out


def size_traits(leaf: Leaf) -> dict[str, float]:
    """Pixels, box and centre of the largest object."""
    mask = leaf.largest
    y, x = np.nonzero(mask)
    left, top, w, h = int(x.min()), int(y[0]), int(x.max() - x.min() + 1), int(y[-1] - y[0] + 1)
    return {
        "area": len(x), "x": left, "y": top, "width": w, "height": h, "sum_x": int(x.sum()), "sum_y": int(y.sum()), "centre_x": float(x.mean()), "centre_y": float(y.mean()),
        "in_frame": bool(left > 0 and top > 0 and left + w < mask.shape[1] and top + h < mask.shape[0]),
    }


def shape_traits(leaf: Leaf) -> dict[str, float | None]:
    """Measures of the largest object: size, hull, outline, longest way across, the ellipse of its spread, and the ellipse
    fitted to its border (null where there is none)."""
    mask, found = leaf.largest, size_traits(leaf)
    y, x = np.nonzero(mask)
    around = hull(row_ends(mask))
    turned = np.roll(around, -1, 0)
    hull_area = abs(float((around[:, 0] * turned[:, 1] - around[:, 1] * turned[:, 0]).sum())) / 2
    padded = np.pad(mask, 1)
    inner = padded[1:-1, :-2] & padded[1:-1, 2:] & padded[:-2, 1:-1] & padded[2:, 1:-1]
    mx, my = found["centre_x"], found["centre_y"]
    sxx, syy, sxy = float(((x - mx) ** 2).mean()), float(((y - my) ** 2).mean()), float(((x - mx) * (y - my)).mean())
    mid, off = (sxx + syy) / 2, math.hypot((sxx - syy) / 2, sxy)
    major, minor = 4 * math.sqrt(mid + off), 4 * math.sqrt(max(0.0, mid - off))
    fit = ellipse(leaf.outline) or (None,) * 5
    return found | {
        "hull_area": hull_area, "hull_corners": len(around), "solidity": leaf.objects[1][leaf.name] / hull_area if hull_area else 1.0, "perimeter": int((mask & ~inner).sum()),
        "longest_path": math.dist(*farthest(around)), "ellipse_major": major, "ellipse_minor": minor, "ellipse_angle": math.degrees(0.5 * math.atan2(2 * sxy, sxx - syy)),
        "eccentricity": math.sqrt(max(0.0, 1 - (minor / major) ** 2)) if major else 0.0, **dict(zip(("fit_x", "fit_y", "fit_major", "fit_minor", "fit_angle"), fit, strict=True)),
    }


#: Bands of an object from top to bottom for landmarks, and the colours of left, right and centre points.
BANDS = 20
LANDMARKS = {"left": (255, 0, 0), "right": (255, 0, 255), "centre": (0, 79, 255)}


def landmarks(mask: np.ndarray, bands: int = BANDS) -> list[tuple[str, int, int, int]]:
    """(side, band, x, y): the leftmost and rightmost pixel and the mean of each band of equal height with pixels."""
    y, x = np.nonzero(mask)
    top, height = int(y.min()), int(y.max() - y.min() + 1)
    band = (y - top) * bands // height
    out = []
    for k in np.unique(band).tolist():
        bx, by = x[band == k], y[band == k]
        middle = int(by.sum() // len(by))
        out += [("left", k, int(bx.min()), middle), ("right", k, int(bx.max()), middle), ("centre", k, int(bx.sum() // len(bx)), middle)]
    return out


def draw_landmarks(image: np.ndarray, points: list[tuple[str, int, int, int]], radius: int = 5) -> np.ndarray:
    out = image.copy()
    rows, cols = np.indices(image.shape[:2])
    for side, colour in LANDMARKS.items():
        for _, _, x, y in (p for p in points if p[0] == side):
            out[(cols - x) ** 2 + (rows - y) ** 2 <= radius * radius] = colour
    return out


def lab(image: np.ndarray) -> np.ndarray:
    """L, a and b of the CIE space under D65 as bytes, as in operators.pixels.with_lab()."""
    b, g, r = (np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4) for c in np.moveaxis(image / 255.0, -1, 0))
    x, y, z = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456, 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    fx, fy, fz = (np.where(t > 0.008856, np.maximum(t, 1e-9) ** (1 / 3), 7.787 * t + 16 / 116) for t in (x, y, z))
    light = np.where(y > 0.008856, 116 * fy - 16, 903.3 * y)
    return np.clip(np.floor(np.stack([light * 255 / 100, 500 * (fx - fy) + 128, 200 * (fy - fz) + 128], -1) + 0.5), 0, 255).astype(np.int64)


def line(image: np.ndarray, start: tuple[int, int], end: tuple[int, int], colour: tuple[int, int, int]) -> None:
    """Draws a straight line from (x, y) to (x, y) into the image."""
    polylines(image, np.array([start[0], end[0]]), np.array([[start[1], end[1]]]), [colour])


def polylines(image: np.ndarray, x: np.ndarray, y: np.ndarray, colours: list[tuple[int, int, int]]) -> None:
    """Draws straight lines from each point to the next into the image: a row of ``y`` and a colour for each curve, later
    ones over earlier ones."""
    dx, dy = np.tile(np.diff(x), len(y)), np.diff(y, axis=1).ravel()
    n = np.maximum(np.abs(dx), np.abs(dy)) + 1
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    steps = np.maximum(n - 1, 1)
    starts = (np.tile(x[:-1], len(y)), y[:, :-1].ravel())
    across, down = (np.rint(at * (d / steps)[of] + p[of]).astype(int) for d, p in zip((dx, dy), starts, strict=True))
    inside = (across >= 0) & (across < image.shape[1]) & (down >= 0) & (down < image.shape[0])
    image[down[inside], across[inside]] = np.array(colours, np.uint8)[of[inside] // (len(x) - 1)]


#: Colours (blue, green, red) of the curves of a histogram: b, g, r, L, a, b, hue, saturation, value.
CURVES = [(255, 0, 0), (0, 128, 0), (0, 0, 255), (105, 105, 105), (255, 0, 255), (0, 255, 255), (226, 43, 138), (255, 255, 0), (0, 165, 255)]


def channel_counts(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """How many pixels of the mask have each of 256 values, in nine channels (9, 256): b, g, r, L, a, b, hue, saturation, value."""
    held = image[mask][None]
    values = np.concatenate([held, lab(held), hsv(held)], -1)[0].astype(np.int64)
    return np.bincount((values + 256 * np.arange(9)).ravel(), minlength=2304).reshape(9, 256)


def histogram_chart(image: np.ndarray, mask: np.ndarray, height: int = 400, width: int = 700) -> np.ndarray:
    """Curves of the nine channels' shares of the mask's pixels, by value from 0 at the left to 255 at the right."""
    shares = channel_counts(image, mask) / max(1, int(mask.sum()))
    out, most = np.full((height, width, 3), 255, np.uint8), shares.max() or 1.0
    out[height - 20, 20 : width - 20] = out[20 : height - 20, 20] = 0
    x, y = 20 + np.arange(256) * (width - 40) // 255, height - 20 - np.rint(shares / most * (height - 40)).astype(int)
    polylines(out, x, y, CURVES)
    return out


def png(image: np.ndarray) -> bytes:
    """The image as a PNG file."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image[..., ::-1].reshape(h, -1)], 1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def bmp(image: np.ndarray) -> bytes:
    """The image as a BMP file of 24 bits."""
    h, w = image.shape[:2]
    rows = np.pad(image[::-1].reshape(h, -1), ((0, 0), (0, -3 * w % 4))).tobytes()
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


KERNELS: dict[str, Callable[..., np.ndarray]] = {"Flip": flip, "Rotate": rotate, "Shear": shear, "Skew": skew, "Crop": crop, "Distortion": distortion}


def compose(image: np.ndarray, steps: list[tuple[str, dict[str, float]]], crop_seed: int, known: dict[str, Callable[..., np.ndarray]] | None = None) -> np.ndarray:
    """The steps of a drawn plan in their order; crops share one stream of places."""
    random, known = np.random.RandomState(crop_seed), KERNELS if known is None else known
    for name, values in steps:
        image = known[name](image, random=random, **values) if known[name] is crop else known[name](image, **values)
    return image


def register(name: str, kernel: Callable[..., np.ndarray]) -> None:
    """Makes a kernel of one's own known to plans that are made afterwards: they take it to the tasks with them."""
    KERNELS[name] = kernel


def decoded(data: bytes, h: int, w: int) -> np.ndarray:
    """Rows of pixels; none of an image that could not be decoded (its height is -1)."""
    if h < 0:
        return np.zeros((0, 0, 3), np.uint8)
    return np.frombuffer(data, np.uint8).reshape(h, w, 3)


def _weight(row: dict) -> int:
    """About the bytes that a row takes while it waits to be sent on: an array its own, a list a pointer and an object each."""
    return 64 + sum(v.nbytes if isinstance(v, np.ndarray) else 40 * len(v) if isinstance(v, list) else len(v) if isinstance(v, bytes | str) else 8 for v in row.values())


def map_images(images: DataFrame, work: Callable[[np.ndarray, dict], Iterator[dict]], schema: str, carry: tuple[str, ...] = ("image_id", "class"), extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``work`` makes of each image (and its ``extra`` columns), with the columns to ``carry``. A task looks at
    one image at a time and sends on what it has made by bytes."""
    own = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                for out in work(decoded(row["data"], row["height"], row["width"]), row):
                    rows.append({c: row[c] for c in carry} | out)
                    size += _weight(out)
                    if size >= SENT:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = f"{own}, {schema}" if own else schema
    kinds = to_arrow_schema(_parse_datatype_string(out))
    return images.select(*carry, "height", "width", "data", *extra).mapInArrow(run, out)


def map_kernel(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray | None], carry: tuple[str, ...] = ("image_id", "class")) -> DataFrame:
    """Images that a kernel makes of images; where it gives None there is no row."""

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        if (out := kernel(image)) is not None:
            yield {"height": out.shape[0], "width": out.shape[1], "data": np.ascontiguousarray(out, np.uint8).tobytes()}

    return map_images(images, work, "height int, width int, data binary", carry)


def three_channels(data: Column, channels: Column) -> Column:
    """Grey or four-channel pixels as three channels."""

    @F.pandas_udf("binary")
    def convert(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(raw: bytes, n: int) -> bytes:
            if n < 1:  # a file that could not be decoded: told by the reader
                return raw
            pixels = np.frombuffer(raw, np.uint8).reshape(-1, n)
            return (np.repeat(pixels, 3, 1) if n == 1 else pixels[:, :3]).tobytes()

        return pd.Series([one(d, int(n)) for d, n in zip(data, channels, strict=True)])

    return convert(data, channels)
