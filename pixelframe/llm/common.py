"""What the operators share: reading tables, Arrow batches, tables in the shared folder."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a step takes together. Texts are read whole, and what is made of them takes many times their size.
BATCH_ROWS = 256
#: Bytes of rows that Spark sends to Python at once, where the session has Spark's own 64 MB. Both sides hold a batch, and the
#: JVM grows its buffers by copying them, so that large ones stay with an executor as memory that nothing returns.
BATCH_BYTES = 4 << 20
_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_DROP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """One output batch for ``BATCH_ROWS`` input rows. ``work`` may be a class: it is then made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work() if isinstance(work, type) else work
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = step(batch.slice(at, BATCH_ROWS))
                if out is not None and out.num_rows:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Has Spark send ``BATCH_BYTES`` at a time, unless the session has a limit of its own. No result depends on it."""
    if spark.conf.get(_BYTES_CONF) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(_BYTES_CONF, str(BATCH_BYTES))


def spare(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a temporary one, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pixelframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session's Python process ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM has gone already: the cluster's own cleaner takes the folder
        pass


def cut(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: no lineage, and no work is done twice."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        for path in {str(name).rpartition("/")[0] for name in df.inputFiles()}:
            _remove(df.sparkSession, path)


def free(spark: SparkSession, *tables: DataFrame) -> None:
    """Discards tables and lets Spark drop the shuffle files of what is no longer referred to."""
    discard(*tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark drops a query's shuffle files as the query ends; what free() lets go may go later. For queries on tables
    that cut() wrote: others may be read again from those files."""
    was = spark.conf.get(_DROP_CONF, "false")
    spark.conf.set(_DROP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_CONF, was)
