"""File names: extension, stem, class and output names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that each job reads, in lower case.
DISTRIBUTION = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff")
AUGMENTATION = (".jpg", ".jpeg", ".png", ".bmp")
TRANSFORMATION = (".jpg", ".jpeg", ".png")


def suffix(name: Column) -> Column:
    """From the last dot on; empty without one. A leading dot alone begins no suffix."""
    return F.regexp_extract(name, r"[^/]([.][^./]+)$", 1)


def stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(suffix(name)))


def is_image(name: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(suffix(name)).isin(*extensions)


def folder(path: Column) -> Column:
    """The name of the folder that a file is in."""
    return F.element_at(F.split(path, "/"), -2)


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def augmented(name: Column, methods: Column, index: Column) -> Column:
    """``image_Rotate_Shear_3.jpg``: methods in their order, then the copy's number."""
    return F.concat(stem(name), F.lit("_"), F.array_join(methods, "_"), F.lit("_"), index.cast("string"), suffix(name))


def transformed(name: Column, what: Column) -> Column:
    """``image_blur.jpg``."""
    return F.concat(stem(name), F.lit("_"), what, suffix(name))
