"""Images as a relation of pixels, ``image_id, class, y, x, b, g, r``, for what column expressions can compute."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions import kernels

#: Pixels in a batch.
_PIXELS = 1 << 18


def pixels(images: DataFrame, mask_of: Callable[[np.ndarray], np.ndarray | None] | None = None, sized: bool = False) -> DataFrame:
    """A row for each pixel, made image by image in numpy; nothing is shuffled. With ``mask_of``, which gives an image's
    mask or None for none, there is also ``on``, and images without a mask have no rows; with ``sized`` also ``width``."""
    kind = {c: images.schema[c].dataType.simpleString() for c in ("image_id", "class")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h, w, data = (batch.column(c)[k].as_py() for c in ("height", "width", "data"))
                mask = mask_of(kernels.decoded(data, h, w)) if mask_of else None
                if mask_of and mask is None:
                    continue
                values = np.frombuffer(data, np.uint8).reshape(-1, 3)
                for begin in range(0, h * w, _PIXELS):
                    at = np.arange(begin, min(begin + _PIXELS, h * w))
                    same, part = pa.array(np.full(len(at), k)), values[at].astype(np.int32)
                    out = [batch.column("image_id").take(same), batch.column("class").take(same), pa.array((at // w).astype(np.int32)), pa.array((at % w).astype(np.int32)), *(pa.array(part[:, c]) for c in range(3))]
                    names = ["image_id", "class", "y", "x", "b", "g", "r"]
                    if mask_of:
                        out, names = [*out, pa.array(mask.ravel()[at] > 0)], [*names, "on"]
                    if sized:
                        out, names = [*out, pa.array(np.full(len(at), w, np.int32))], [*names, "width"]
                    yield pa.RecordBatch.from_arrays(out, names)

    rows = images.select("image_id", "class", "height", "width", "data")
    return rows.mapInArrow(run, f"image_id {kind['image_id']}, class {kind['class']}, y int, x int, b int, g int, r int" + ", on boolean" * bool(mask_of) + ", width int" * sized)


def _table(values: np.ndarray, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values.tolist())), at)


def with_hsv(rows: DataFrame) -> DataFrame:
    """``h`` (0 to 179), ``s`` and ``v`` in whole numbers."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    v, d = F.greatest(b, g, r), F.greatest(b, g, r) - F.least(b, g, r)
    rows = rows.withColumns({"v": v, "__d": d})
    v, d = F.col("v"), F.col("__d")
    turn = F.when(v == r, g - b).when(v == g, b - r + 2 * d).otherwise(r - g + 4 * d)
    h = F.floor((turn * _table(kernels._BY_RANGE, d) + 2048) / 4096.0).cast("int")
    s = F.floor((d * _table(kernels._BY_VALUE, v) + 2048) / 4096.0).cast("int")
    return rows.withColumns({"h": F.when(h < 0, h + 180).otherwise(h), "s": s}).drop("__d")


def with_lab(rows: DataFrame) -> DataFrame:
    """``l``, ``a_`` and ``b_`` of the CIE space under D65, each as a byte: L times 255 / 100, a and b plus 128."""
    line = lambda c: F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    b, g, r = (line(F.col(c)) for c in "bgr")
    x, y, z = (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456, 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    rows = rows.withColumns({"__x": x, "__y": y, "__z": z})
    x, y, z = F.col("__x"), F.col("__y"), F.col("__z")
    whole = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c + 0.5))).cast("int")
    light = F.when(y > 0.008856, 116 * f(y) - 16).otherwise(903.3 * y)
    return rows.withColumns({"l": whole(light * 255 / 100), "a_": whole(500 * (f(x) - f(y)) + 128), "b_": whole(200 * (f(y) - f(z)) + 128)}).drop("__x", "__y", "__z")


def is_leaf() -> Column:
    return (F.col("v") > 25) & (F.col("s") > 25) & (F.col("h") <= 95)


def masked(rows: DataFrame, on: Column) -> DataFrame:
    """Pixels outside the mask in black."""
    return rows.withColumns({c: F.when(on, F.col(c)).otherwise(0) for c in "bgr"})


def flipped(rows: DataFrame) -> DataFrame:
    """Mirrored left to right: a projection of pixels with the ``width`` of their image."""
    return rows.withColumn("x", F.col("width") - 1 - F.col("x"))


#: Channel names of a histogram, and their columns.
CHANNELS = {"blue": "b", "green": "g", "red": "r", "lightness": "l", "green-magenta": "a_", "blue-yellow": "b_", "hue": "h", "saturation": "s", "value": "v"}
