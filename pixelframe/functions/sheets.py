"""Contact sheets: images made smaller by area and laid out in a grid."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(64)
def _shares(size: int, to: int) -> np.ndarray:
    """(to, size): how much of each old pixel falls to each new one; rows add up to 1."""
    edges = np.arange(to + 1) * (size / to)
    cell = np.arange(size)
    held = np.minimum(edges[1:, None], cell + 1) - np.maximum(edges[:-1, None], cell)
    return np.clip(held, 0, None) * (to / size)


def shrink(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """The image at a size of at most its own; a new pixel is the mean of the area that it covers."""
    # Rows first, as one product of two matrices that lie in memory as they are: no copy of the image is turned about.
    rows = _shares(image.shape[0], h) @ image.reshape(image.shape[0], -1).astype(float)
    mean = _shares(image.shape[1], w) @ rows.reshape(h, *image.shape[1:])
    return np.floor(mean + 0.5 - 1e-9).clip(0, 255).astype(np.uint8)


def fitted(image: np.ndarray, cell: int) -> np.ndarray:
    """The image within a square of ``cell`` pixels, its sides in proportion; a smaller one as it is."""
    h, w = image.shape[:2]
    most = max(h, w)
    return image if most <= cell else shrink(image, max(1, h * cell // most), max(1, w * cell // most))


def sheet(images: list[np.ndarray], columns: int = 4, cell: int = 256, gap: int = 8, ground: int = 255) -> np.ndarray:
    """The images from left to right and from top to bottom, each in the middle of its square."""
    if columns < 1 or cell < 1 or gap < 0:
        raise ValueError("a sheet has one column or more, cells of one pixel or more, and no negative gaps")
    columns = max(1, min(columns, len(images)))
    rows = max(1, -(-len(images) // columns))
    out = np.full((rows * (cell + gap) + gap, columns * (cell + gap) + gap, 3), ground, np.uint8)
    for nth, image in enumerate(images):
        part = fitted(image, cell)
        h, w = part.shape[:2]
        top, left = (gap + at * (cell + gap) + (cell - size) // 2 for at, size in zip(divmod(nth, columns), (h, w), strict=True))
        out[top : top + h, left : left + w] = part
    return out
