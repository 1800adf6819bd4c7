"""Image rows: ``image_id, class, height, width, data``, with pixels as blue, green, red bytes row by row.

Files are listed with their content only where it is asked for: Spark prunes what a job does not read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pixelframe.functions import names, payloads
from pixelframe.sources.shared import discard, settle

#: Fixed values of the generated test image: an 8 by 8 grid of cells and the colours (blue, green, red) of its codes.
PATTERN = [
    [3, 0, 0, 1, 1, 0, 0, 0],
    [0, 0, 1, 1, 1, 1, 0, 0],
    [0, 1, 1, 2, 1, 1, 1, 0],
    [1, 1, 2, 2, 2, 1, 1, 1],
    [1, 1, 1, 2, 1, 1, 1, 0],
    [0, 1, 1, 2, 1, 1, 0, 0],
    [0, 0, 1, 2, 1, 0, 0, 0],
    [0, 0, 0, 4, 0, 0, 0, 0],
]
BACKGROUND, CHECKER, GRID = (248, 248, 248), (235, 230, 222), (200, 198, 192)
PALETTE = {1: (78, 184, 106), 2: (32, 96, 45), 3: (48, 64, 208), 4: (48, 90, 138)}


def qualified(spark: SparkSession, path: str) -> str:
    """The whole path as Spark names files: with its scheme, relative ones from the working folder, no slash at the end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def is_file(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def _escaped(path: str) -> str:
    """A path in which signs of patterns stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def scan_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = names.AUGMENTATION, below: int | None = None) -> DataFrame:
    """``path, class, name, length, content`` of the image files below a folder, or of one file. With ``below`` only those
    so many folders below it: 0 for its own files, 1 for those of its class folders."""
    root = qualified(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(below != 0).lower()).load(_escaped(root))
    files = files.select(_plain(F.col("path")).alias("path"), "length", "content")
    files = files.select("path", names.folder(F.col("path")).alias("class"), names.base(F.col("path")).alias("name"), "length", "content")
    files = files.where(names.is_image(F.col("name"), extensions))
    return files if below is None else files.where(F.size(F.split(F.substr("path", F.lit(len(root) + 2)), "/")) == below + 1)


def scan_images(
    spark: SparkSession, path: str, extensions: tuple[str, ...] = names.TRANSFORMATION, strict: bool = False, below: int | None = None, turn: bool = True,
    bad: bool = False, seen: Observation | None = None,
) -> DataFrame:
    """Decoded images of the files below a folder (see scan_files()). Files that can't be decoded are left out, or with
    ``strict`` fail the job, or with ``bad`` stay, with a height of -1; ``seen`` observes how many were ``read`` and
    ``rejected``.

    Grey images get three equal channels, a fourth channel is dropped. What a file says of its orientation is applied, unless
    ``turn`` is off: for that the marks of JPEG files are read first."""
    root = qualified(spark, path)
    image = spark.read.format("image").option("recursiveFileLookup", str(below != 0).lower()).load(_escaped(root)).select("image.*")
    origin = _plain(F.url_decode(F.replace(F.col("origin"), F.lit("+"), F.lit("%2B"))))
    rows = image.select(origin.alias("image_id"), names.folder(origin).alias("class"), names.base(origin).alias("name"), "height", "width", "nChannels", "data")
    rows = rows.where(names.is_image(F.col("name"), extensions))
    if below is not None:
        rows = rows.where(F.size(F.split(F.substr("image_id", F.lit(len(root) + 2)), "/")) == below + 1)
    good = F.col("height") >= 0
    if seen is not None:
        rows = rows.observe(seen, F.count("*").alias("read"), F.count_if(~good).alias("rejected"))
    if strict:
        rows = rows.withColumn("height", F.when(good, F.col("height")).otherwise(F.raise_error(F.concat(F.lit("cannot decode "), F.col("image_id")))))
    elif not bad:
        rows = rows.where(good)
    from pixelframe.functions.kernels import three_channels

    data = F.when(F.col("nChannels") == 3, F.col("data")).otherwise(three_channels(F.col("data"), F.col("nChannels")))
    rows = rows.select("image_id", "class", "name", "height", "width", data.alias("data"))
    if not turn:
        return rows
    marked = catalogue(spark, path, tuple(e for e in extensions if e in (".jpg", ".jpeg")), below).where("orientation > 1").select(F.col("path").alias("image_id"), "orientation")
    return _upright(rows, settle(marked, "turned"))


#: Turned files whose list is sent to all tasks, at some 200 bytes each.
_TURNED = 100_000


def _upright(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """The images, those of ``marked`` (image_id, orientation) turned. With none there is nothing to do."""
    n = marked.count()
    if not n:
        discard(marked)
        return rows
    from pixelframe.functions.kernels import map_images

    def work(image: np.ndarray, row: dict) -> Iterator[dict]:
        out = payloads.upright(image, row["orientation"] or 1) if row["height"] > 0 else image
        yield {"height": out.shape[0], "width": out.shape[1], "data": np.ascontiguousarray(out).tobytes()} if row["height"] > 0 else {k: row[k] for k in ("height", "width", "data")}

    joined = rows.join(F.broadcast(marked) if n <= _TURNED else marked, "image_id", "left")
    return map_images(joined, work, "height int, width int, data binary", ("image_id", "class", "name"), ("orientation",))


_TOLD = "kind string, width int, height int, orientation int, reason string"


def told(rows: DataFrame, content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """What the payloads in a column say of themselves (see payloads.probe()), with the columns to ``keep``. A task looks at
    one payload at a time."""
    kinds = pa.schema([("kind", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("orientation", pa.int32()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.RecordBatch.from_pylist([payloads.probe(value.as_py())._asdict() for value in batch.column(len(keep))], kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found.columns], [*keep, *kinds.names])

    own = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(*keep, F.col(content).cast("binary")).mapInArrow(run, own + _TOLD)


def catalogue(spark: SparkSession, path: str, extensions: tuple[str, ...] = names.AUGMENTATION, below: int | None = None) -> DataFrame:
    """``path, class, name, length, kind, width, height, orientation, reason`` of image files, by their bytes, not decoded."""
    return told(scan_files(spark, path, extensions, below), "content", ("path", "class", "name", "length"))


def rejected(spark: SparkSession, path: str, extensions: tuple[str, ...] = names.TRANSFORMATION, below: int | None = None) -> DataFrame:
    """``path, class, name, reason`` of the files that can't be decoded."""
    bad = scan_images(spark, path, extensions, below=below, turn=False, bad=True).where("height < 0").select(F.col("image_id").alias("path"))
    reason = F.coalesce("reason", F.lit("cannot be decoded"))
    return catalogue(spark, path, extensions, below).join(bad, "path", "left_semi").select("path", "class", "name", reason.alias("reason"))


def classes_of(spark: SparkSession, path: str) -> DataFrame:
    """``class``: every folder right below ``path``, also those without files, listed by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    return spark.createDataFrame([(s.getPath().getName(),) for s in found if s.isDirectory()], "class string")


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``class, name, content``: documents, with their language as class and file names made from their numbers."""
    endings = [".jpg", ".JPG", ".jpeg", ".png", ".PNG", ".bmp", ".gif", ".tiff", ".tif", ".txt"]
    ending = F.element_at(F.array(*map(F.lit, endings)), (F.col("doc_id") % 10 + 1).cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("lang").alias("class"), F.concat(F.lit("image ("), F.col("doc_id").cast("string"), F.lit(")"), ending).alias("name"), F.col("text").alias("content"))


def embeddings_as_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rows of 8 by 8 pixels from vectors of 64 values; the label is the class."""
    at = F.sequence(F.lit(0), F.lit(63))
    channel = lambda p, o: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.get("embedding", (p + o) % 64).cast("double") + 0.4) * 320)))
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    pixels = F.transform(at, lambda p: F.concat(two(channel(p, 0)), two(channel(p, 21)), two(channel(p, 42))))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(F.col("vec_id").alias("image_id"), F.col("label").alias("class"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.array_join(pixels, "")).alias("data"))


def test_image(spark: SparkSession, size: int = 400) -> DataFrame:
    """``y, x, b, g, r`` of a generated leaf with a checkerboard behind it and grid lines over it."""
    cell = size // 8
    p = F.col("id")
    rows = spark.range(size * size).select((p / size).cast("int").alias("y"), (p % size).cast("int").alias("x"))
    i, j = (F.col("x") / cell).cast("int"), (F.col("y") / cell).cast("int")
    code = F.when((i < 8) & (j < 8), F.get(F.array(*(F.lit(v) for row in PATTERN for v in row)), j * 8 + i)).otherwise(0)
    lines = sorted({min(k * cell, size - 1) for k in range(9)})
    line = F.col("x").isin(*lines) | F.col("y").isin(*lines)
    checker = (i < 8) & (j < 8) & ((i + j) % 2 == 0)

    def channel(k: int):
        value = F.when(line, GRID[k])
        for number, colour in PALETTE.items():
            value = value.when(code == number, colour[k])
        return value.when(checker, CHECKER[k]).otherwise(BACKGROUND[k])

    return rows.select("y", "x", *(channel(k).alias(name) for k, name in enumerate("bgr")))
