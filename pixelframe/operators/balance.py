"""Balancing of classes: duplicates go, and every class is filled up to a target by copies in turn.

The plan is relational: file contents meet only in a hash, and images are joined after the copies are planned.
Ordinals inside a class come from counts by range of names, so that a class may be as large as it likes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.functions import names
from pixelframe.sources.shared import settle


def dedup(files: DataFrame, extensions: tuple[str, ...] = names.AUGMENTATION) -> DataFrame:
    """``class, name, sha256, is_kept``: of equal contents in a class the first by name is kept."""
    hashed = files.where(names.is_image(F.col("name"), extensions)).select("class", "name", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    # Aggregated before the join: many copies of one content are one row.
    first = hashed.groupBy("class", "sha256").agg(F.min("name").alias("__first"))
    return hashed.join(first, ["class", "sha256"]).withColumn("is_kept", F.col("name") == F.col("__first")).drop("__first")


def need(deduped: DataFrame, target: int | None = None, basis: str = "raw") -> DataFrame:
    """``class, raw, kept, target, need``. Without a target it is the largest class, counted before the duplicates go
    (``raw``) or after (``kept``)."""
    if basis not in ("raw", "kept"):
        raise ValueError("basis must be raw or kept")
    counts = deduped.groupBy("class").agg(F.count("*").alias("raw"), F.count_if("is_kept").alias("kept"))
    most = F.max(basis).over(Window.partitionBy()) if target is None else F.lit(target).cast("long")
    return counts.withColumn("target", most).withColumn("need", F.greatest(F.col("target") - F.col("kept"), F.lit(0)))


def ordered(rows: DataFrame, by: str = "class", name: str = "name") -> DataFrame:
    """``i``: the place of each row in its class by name, from 0.

    Rows are dealt by ranges of (class, name) and numbered within a range; what lies before a range in its class is
    added. So no class is sorted by one task, however large."""
    ranged = settle(rows.repartitionByRange(by, name).withColumn("__range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(by, "__range").agg(F.count("*").alias("__size"))  # a row for each class and range
    before = F.sum("__size").over(Window.partitionBy(by).orderBy("__range")) - F.col("__size")
    sizes = sizes.select(by, "__range", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(by, "__range").orderBy(name)).cast("long") - 1
    return ranged.withColumn("__place", place).join(sizes, [by, "__range"]).withColumn("i", F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")


def round_robin(deduped: DataFrame, needs: DataFrame) -> DataFrame:
    """``class, name, i, copies, first``: each kept file's copies and the ordinal of the first of them."""
    kept = ordered(deduped.where("is_kept").select("class", "name"))
    rows = kept.join(F.broadcast(needs.where("kept > 0").select("class", "kept", "need")), "class")  # a row for each class
    per, rest = F.expr("need div kept"), F.expr("need % kept")
    return rows.select("class", "name", "i", (per + (F.col("i") < rest).cast("long")).alias("copies"), (F.col("i") * per + F.least("i", rest)).alias("first"))


def fan_out(copies: DataFrame) -> DataFrame:
    """``class, name, k, ordinal``: a row for each copy; k counts within the file, the ordinal within the class."""
    rows = copies.where("copies > 0").select("class", "name", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("k"))
    return rows.select("class", "name", "k", (F.col("first") + F.col("k")).alias("ordinal"))


def variants(files: DataFrame, n: int = 6) -> DataFrame:
    """The same for n copies of every file: the ordinal is the copy's number."""
    rows = files.select("class", "name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("k")) if n > 0 else files.select("class", "name", F.lit(0).cast("long").alias("k")).limit(0)
    return rows.withColumn("ordinal", F.col("k"))


def named(outputs: DataFrame, draws: DataFrame) -> DataFrame:
    """With the drawn methods and the output's name. ``draws`` has a row for each ordinal, whichever the class."""
    return outputs.join(draws, "ordinal").withColumn("output", names.augmented(F.col("name"), F.col("methods"), F.col("k")))
