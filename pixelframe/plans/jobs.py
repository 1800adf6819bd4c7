"""Whole jobs over folders of labelled images, as DataFrames; nothing is written unless a target is given."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pixelframe.functions import kernels, names
from pixelframe.operators import balance, drawplan, features
from pixelframe.operators import distribution as stats
from pixelframe.sources import images as sources
from pixelframe.sources import sinks
from pixelframe.sources.shared import settle

#: Copies of an image that one row of a task makes.
PART = 64


def class_distribution(spark: SparkSession, path: str) -> DataFrame:
    """``class, n, pct`` of a folder of class folders, or of a folder that holds images itself."""
    direct = sources.scan_files(spark, path, names.DISTRIBUTION, below=0)
    if not direct.isEmpty():
        return stats.distribution(direct, sources.qualified(spark, path).rpartition("/")[2], direct)
    files = sources.scan_files(spark, path, names.DISTRIBUTION, below=1)
    return stats.shares(stats.class_counts(files, classes=sources.classes_of(spark, path)))


def plan_outputs(
    files: DataFrame, target: int | None = None, seed: int | None = 42, methods: str | list[str] | None = None, n: int | None = None, basis: str = "raw",
    pool: list[drawplan.Method] | None = None, deduped: DataFrame | None = None,
) -> DataFrame:
    """``class, name, k, ordinal, output, methods, steps, crop_seed``: all copies to make.

    With ``n`` every file gets so many; else each class is filled up to ``target``, or to the largest class. (class,
    name) tells files apart. Methods are drawn from ``pool``, and their kernels are those of kernels.register().
    ``deduped`` is what balance.dedup() gives for the files, if it is there already."""
    spark, fixed = files.sparkSession, drawplan.lookup(methods, pool)
    if n is not None:
        outputs, most = balance.variants(files, n), n
    else:
        # Contents are read and hashed once, whatever is asked of the result.
        deduped = settle(balance.dedup(files), "deduped") if deduped is None else deduped
        needs = balance.need(deduped, target, basis)
        outputs, most = balance.fan_out(balance.round_robin(deduped, needs)), needs.agg(F.max("need")).first()[0] or 0
    return balance.named(outputs, drawplan.draw_plan(spark, most, seed, fixed, pool))


def make(outputs: DataFrame, images: DataFrame, pool: list[drawplan.Method] | None = None) -> DataFrame:
    """``class, name, output, methods, height, width, data``: the planned copies. An image meets its plan in parts of
    ``PART`` copies, so its bytes are sent once for many of them. One that could not be decoded (its height is -1) and is to
    be copied fails the job."""
    known = kernels.KERNELS | {m.name: m.kernel for m in pool or [] if m.kernel}
    parts = outputs.groupBy("class", "name", F.expr(f"ordinal div {PART}").alias("part")).agg(F.collect_list(F.struct("output", "methods", "steps", "crop_seed")).alias("plan"))

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        if row["height"] < 0:
            raise ValueError(f"cannot decode {row['class']}/{row['name']}")
        for p in row["plan"]:
            steps = [(s["name"], dict(s["values"])) for s in p["steps"]]
            out = np.ascontiguousarray(kernels.compose(image, steps, p["crop_seed"], known), np.uint8)
            yield {"output": p["output"], "methods": p["methods"], "height": out.shape[0], "width": out.shape[1], "data": out.tobytes()}

    return kernels.map_images(images.join(parts, ["class", "name"]), work, "output string, methods array<string>, height int, width int, data binary", ("class", "name"), ("plan",))


def augment(
    spark: SparkSession, path: str, dst: str | None = None, n: int = 6, target: int = 0, balanced: bool = False, seed: int | None = 42,
    methods: str | list[str] | None = None, copy_raw: bool = False, pool: list[drawplan.Method] | None = None, skip: bool = False, rejects: str | None = None, quality: int = 95,
) -> DataFrame:
    """Copies of one image file (``n``), of a folder that holds images (up to ``target``, which must be positive), or of
    the folders of images right below one (up to ``target``, or to the largest class if it is 0 or with ``balanced``).
    Images deeper below count for nothing. Written to ``dst`` if that is given: one image's copies there, others in a
    folder for each class; copies keep the suffix, and where it can't be written, .png follows it.

    A file that is to be copied and can't be decoded fails the job. With ``skip`` such files are left out before anything is
    planned: the others fill their class, and no raw copy of them is made; the table ``rejects`` (a path) then has their
    ``path, class, name, reason``."""
    if dst is not None:
        sinks.apart(sources.qualified(spark, path), sources.qualified(spark, dst))
    one = sources.is_file(spark, path)
    below, files = None, sources.scan_files(spark, path)
    if not one:
        below, files = 0, sources.scan_files(spark, path, below=0)
        if files.isEmpty():
            below, files = 1, sources.scan_files(spark, path, below=1)
            if files.isEmpty():
                raise ValueError(f"no images and no folders with images in {path}")
        elif target <= 0:
            raise ValueError("a class folder needs a positive target")
    if skip:
        bad = _rejects(sources.rejected(spark, path, names.AUGMENTATION, below), rejects)
        files = files.join(bad.select("path"), "path", "left_anti")
    kept = files
    if one:
        outputs = plan_outputs(files, seed=seed, methods=methods, n=n, pool=pool)
    else:
        to = None if below == 1 and (balanced or target <= 0) else target
        deduped = settle(balance.dedup(files), "deduped")
        outputs = plan_outputs(files, to, seed, methods, pool=pool, deduped=deduped)
        kept = files.join(deduped.where("is_kept").select("class", "name"), ["class", "name"], "left_semi")
    outputs = settle(outputs, "planned")
    place = lambda name: name if one else F.concat("class", F.lit("/"), name)
    if dst is not None:
        places = outputs.select(place(sinks.writable(F.col("output"))).alias("output"))
        sinks.distinct(places.unionByName(kept.select(place(F.col("name")).alias("output"))) if copy_raw else places)
    made = make(outputs, sources.scan_images(spark, path, names.AUGMENTATION, below=below, bad=True), pool)
    made = made.withColumns({"kind": F.lit("augmented"), "content": F.lit(None).cast("binary"), "source": F.lit(None).cast("string")})
    if copy_raw:
        empty = {"methods": F.lit(None).cast("array<string>"), "height": F.lit(None).cast("int"), "width": F.lit(None).cast("int"), "data": F.lit(None).cast("binary")}
        made = made.unionByName(kept.select("class", "name", "content", F.col("path").alias("source")).withColumns({"output": F.col("name"), "kind": F.lit("raw"), **empty}))
    if dst is not None:
        name = F.when(F.col("kind") == "raw", F.col("output")).otherwise(sinks.writable(F.col("output")))
        return sinks.write_files(made.withColumn("output", place(name)), sources.qualified(spark, dst), quality=quality)
    return made


def _rejects(bad: DataFrame, path: str | None) -> DataFrame:
    """``bad`` as a table: at ``path``, or for this job alone."""
    if path is None:
        return settle(bad, "rejects")
    bad.write.parquet(path)
    return bad.sparkSession.read.schema(bad.schema).parquet(path)


def transform(
    spark: SparkSession, src: str, transforms: tuple[str, ...] | None = None, dst: str | None = None, strength: int = 9, file: str | None = None, rejects: str | None = None,
    seen: Observation | None = None, quality: int = 95,
) -> DataFrame:
    """The transforms (all by default) of the images below ``src``, or of one file: ``src`` itself, or ``file``, whole or
    below ``src``. Written to ``dst`` (if that is a file, to its folder) in a folder for each transform: one file's there,
    others in folders as below ``src``; histograms are .png files. Files that can't be decoded are left out: ``seen`` observes
    how many were ``read`` and ``rejected``, and the table ``rejects`` (a path) has their ``path, class, name, reason``."""
    kernels.gauss(strength)
    chosen = tuple(t for t in features.TRANSFORMS if not transforms or t in transforms)
    if unknown := set(transforms or ()) - set(features.TRANSFORMS):
        raise ValueError(f"unknown transforms: {', '.join(sorted(unknown))}")
    src = sources.qualified(spark, src)
    if file is not None:
        at = file if file.startswith("/") or ":/" in file else f"{src}/{file}"
    else:
        at = src
    one = sources.is_file(spark, at)
    if file is not None and not one:
        raise ValueError(f"{at} is no file")
    if rejects is not None:
        _rejects(sources.rejected(spark, at), rejects)
    made = features.transform_all(sources.scan_images(spark, at, seen=seen), chosen, strength).where("transform <> 'original'")
    if dst is None:
        return made
    dst = sources.qualified(spark, dst)
    if sources.exists(spark, dst) and sources.is_file(spark, dst):
        dst = dst.rpartition("/")[0]
    if not one:
        sinks.apart(src, dst)

    def output(path: str) -> Column:
        relative = names.base(F.col(path)) if one else F.substr(path, F.lit(len(src) + 2))
        name = F.when(F.col("transform") == "histogram", F.concat(names.stem(relative), F.lit("_histogram.png"))).otherwise(sinks.writable(names.transformed(relative, F.col("transform"))))
        return F.concat("transform", F.lit("/"), name).alias("output")

    listed = sources.scan_files(spark, at, names.TRANSFORMATION).select("path", F.explode(F.array(*map(F.lit, chosen))).alias("transform"))
    sinks.distinct(listed.select(output("path")))
    return sinks.write_files(made.withColumn("output", output("image_id")), dst, quality=quality)


def preview(
    spark: SparkSession, src: str, dst: str | None = None, transforms: tuple[str, ...] = features.TRANSFORMS, strength: int = 9, columns: int = 4, cell: int = 256,
) -> DataFrame:
    """A sheet for each image below ``src``, or for one file: the original and its transforms. Written to ``dst`` as
    ``<stem>_preview.png``, in folders as below ``src``, if that is given."""
    kernels.gauss(strength)
    src = sources.qualified(spark, src)
    one = sources.is_file(spark, src)
    made = features.contact_sheets(sources.scan_images(spark, src), transforms, strength, columns, cell)
    if dst is None:
        return made
    dst = sources.qualified(spark, dst)
    if not one:
        sinks.apart(src, dst)
    relative = lambda path: names.base(F.col(path)) if one else F.substr(path, F.lit(len(src) + 2))
    output = lambda path: F.concat(names.stem(relative(path)), F.lit("_preview.png")).alias("output")
    sinks.distinct(sources.scan_files(spark, src, names.TRANSFORMATION).select(output("path")))
    return sinks.write_files(made.withColumn("output", output("image_id")), dst)
