"""Images as they arrive: transforms of image rows, and duplicates among files, told from all that came before.

Balancing needs counts of all and is not streamed; running counts of classes are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pixelframe.functions import names
from pixelframe.operators import features

SCHEMA = "image_id string, class string, height int, width int, data binary"
_FILES = "path string, modificationTime timestamp, length long, content binary"
_TOLD = "class string, sha256 string, path string, name string, is_kept boolean"


def arriving(spark: SparkSession, path: str, schema: str = SCHEMA, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def transform_stream(spark: SparkSession, src: str, dst: str, checkpoint: str, transforms: tuple[str, ...] = features.TRANSFORMS, schema: str = SCHEMA) -> StreamingQuery:
    """Appends the transforms of new images to parquet at ``dst``; what has arrived is done once, then the query ends."""
    made = features.transform_all(arriving(spark, src, schema), transforms)
    return made.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", dst).partitionBy("transform").trigger(availableNow=True).start()


def arriving_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = names.AUGMENTATION, files_at_once: int = 10_000) -> DataFrame:
    """``path, class, name, content`` of the image files of the folders right below ``path``."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_at_once).load(f"{path.rstrip('/')}/*")
    files = files.select("path", names.folder(F.col("path")).alias("class"), names.base(F.col("path")).alias("name"), "content")
    return files.where(names.is_image(F.col("name"), extensions))


def first_wins(files: DataFrame) -> DataFrame:
    """``class, sha256, path, name, is_kept``: of equal contents in a class the first to arrive is kept, of those that arrive
    together the first by name. Contents meet in their hashes; the state has a row for each different content of a class, so
    long streams want a state store on disk (RocksDB). Many copies go by part by part."""

    def tell(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        for part in parts:
            part = (part if best is None else pd.concat([best, part])).sort_values(["name", "path"])
            best = part.head(1)
            yield part.iloc[1:].assign(is_kept=False)
        yield best.assign(is_kept=not state.exists)
        state.update((best["path"].iloc[0],) if not state.exists else state.get)

    hashed = files.select("class", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "path", "name")
    return hashed.groupBy("class", "sha256").applyInPandasWithState(tell, _TOLD, "first string", "append", GroupStateTimeout.NoTimeout)


def dedup_stream(spark: SparkSession, src: str, dst: str, checkpoint: str, extensions: tuple[str, ...] = names.AUGMENTATION, files_at_once: int = 10_000) -> StreamingQuery:
    """Tells the files that have arrived below ``src`` since the last run, then ends: their rows stand in ``dst``/files, and
    counts in ``dst``/counts, in a folder for each batch. A batch that is run again writes the same folders anew."""

    def keep(batch: DataFrame, nth: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dst}/files/batch={nth}")
        told = spark.read.schema(batch.schema).parquet(f"{dst}/files/batch={nth}")
        told.groupBy("class").agg(F.count("*").alias("raw"), F.count_if("is_kept").alias("kept")).write.mode("overwrite").parquet(f"{dst}/counts/batch={nth}")

    told = first_wins(arriving_files(spark, src, extensions, files_at_once))
    return told.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(spark: SparkSession, dst: str) -> DataFrame:
    """``class, raw, kept``: what dedup_stream() has counted so far."""
    return spark.read.schema("class string, raw long, kept long, batch long").parquet(f"{dst}/counts").groupBy("class").agg(F.sum("raw").alias("raw"), F.sum("kept").alias("kept"))
