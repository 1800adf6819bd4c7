"""Writing images: as parquet by class, or as PNG, BMP and JPEG files that appear together once all are written."""

from __future__ import annotations

import os
import posixpath
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from pixelframe.functions import kernels, names
from pixelframe.functions.jpeg import jpeg

#: Who makes the bytes of a file, by its suffix.
ENCODERS = {".png": kernels.png, ".bmp": kernels.bmp, ".jpg": jpeg, ".jpeg": jpeg}


def write_parquet(images: DataFrame, path: str) -> None:
    """Image rows in a folder for each class."""
    images.write.partitionBy("class").parquet(path)


def writable(name: Column) -> Column:
    """The name of a new image: with a suffix that can't be written, .png is added, so that names stay apart."""
    return F.when(names.is_image(name, tuple(ENCODERS)), name).otherwise(F.concat(name, F.lit(".png")))


def apart(src: str, dst: str) -> None:
    """Raises where a target lies in its source, or holds it: a later run would read what this one wrote."""
    a, b = src.rstrip("/") + "/", dst.rstrip("/") + "/"
    if a.startswith(b) or b.startswith(a):
        raise ValueError(f"{src} and {dst} overlap")


def distinct(outputs: DataFrame, place: str = "output") -> None:
    """Raises where two outputs have one place. Only places are shuffled, before any image is made."""
    twice = outputs.groupBy(place).agg(F.count("*").alias("n")).where("n > 1").select(place).limit(5).collect()
    if twice:
        raise ValueError(f"two outputs at {', '.join(sorted(row[0] for row in twice))}")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", uri))


_LISTED = pa.schema([("attempt", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("modified", pa.float64()), ("rights", pa.int32())])


@dataclass
class Written(WriterCommitMessage):
    """The list of the files of one attempt of a task."""

    listed: str


class FileWriter(DataSourceArrowWriter):
    """A task writes its files to a folder of its own attempt, and a list of them. Which attempts count is told by commit()
    alone, so attempts that failed or were run twice leave nothing behind, and the driver gets one path for each task."""

    def __init__(self, options: dict[str, str]) -> None:
        self.attempts, self.root = options["attempts"], options["root"]
        self.place, self.quality = options["place"], int(options.get("quality", "95"))
        store, base = _store(self.attempts)
        store.create_dir(base)

    def _bytes(self, row: dict) -> bytes:
        if row.get("content") is not None:
            return row["content"]
        ending = posixpath.splitext(row[self.place])[1].lower()
        if ending not in ENCODERS:
            raise ValueError(f"cannot write {row[self.place]}: only {', '.join(ENCODERS)}")
        image = kernels.decoded(row["data"], row["height"], row["width"])
        return jpeg(image, self.quality) if ENCODERS[ending] is jpeg else ENCODERS[ending](image)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = _store(self.attempts)
        own, n = f"{base}/{uuid.uuid4().hex}", 0
        store.create_dir(own, recursive=False)  # a job that was aborted has no folder to write to any more
        with store.open_output_stream(f"{own}/listed", compression=None) as out, pq.ParquetWriter(out, _LISTED) as listed:
            for batch in batches:
                rows = []
                for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                    data, at = self._bytes(row), f"{own}/{n}"
                    with store.open_output_stream(at, compression=None) as file:
                        file.write(data)
                    modified, rights = _stamp(row.get("source"))
                    rows.append({"attempt": at, "path": row[self.place], "bytes": len(data), "modified": modified, "rights": rights})
                    n += 1
                listed.write_table(pa.Table.from_pylist(rows, _LISTED))
        return Written(f"{own}/listed")

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.attempts)
        with store.open_output_stream(f"{base}/committed.new", compression=None) as out:
            pq.write_table(pa.table({"listed": [m.listed for m in messages if m]}, pa.schema([("listed", pa.string())])), out)
        store.move(f"{base}/committed.new", f"{base}/committed")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = _store(self.attempts)
        for wait in (0, 0.1, 0.5, 2):  # tasks that are being stopped may add a file meanwhile
            time.sleep(wait)
            try:
                if store.get_file_info(base).type != fs.FileType.NotFound:
                    store.delete_dir(base)
                return
            except OSError:
                continue


class FileSink(DataSource):
    """``pixelframe_files``: rows of images or of whole contents, as files."""

    @classmethod
    def name(cls) -> str:
        return "pixelframe_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options))


def _stamp(source: str | None) -> tuple[float | None, int | None]:
    """When a file was changed and who may read it, where the machine's own file system tells."""
    at = re.sub("^file:/+", "/", source or "")
    if not at.startswith("/"):
        return None, None
    found = os.stat(at)
    return found.st_mtime, found.st_mode & 0o7777


def write_files(images: DataFrame, root: str, place: str = "output", quality: int = 95) -> DataFrame:
    """Writes each row to ``root``/``place`` by its suffix and gives ``path`` and ``bytes`` of what was written.

    ``content``, where there is such a column and it is not null, is copied as it is, with the time and the rights of the
    file that a column ``source`` names. Nothing stands at the target before everything is written: then tasks move the
    files of the attempts that count. A move that is run again finds its file moved, so a lost executor does no harm, and
    resume() goes on where a driver was lost."""
    spark = images.sparkSession
    spark.dataSource.register(FileSink)
    attempts = f"{root.rstrip('/')}/_attempts-{uuid.uuid4().hex}"
    columns = [place, "height", "width", "data", *(c for c in ("content", "source") if c in images.columns)]
    images.select(*columns).write.format("pixelframe_files").mode("append").options(root=root, attempts=attempts, place=place, quality=quality).save()
    return resume(spark, root, attempts)


def resume(spark: SparkSession, root: str, attempts: str) -> DataFrame:
    """Moves what was committed below ``attempts`` to its places, and gives ``path`` and ``bytes``."""
    from pixelframe.sources.shared import remove, settle

    uri = re.sub("^(file:)?/+", "file:///", attempts)
    done = settle(_moved(spark.read.parquet(f"{uri}/committed"), root), "written")
    remove(spark, uri)
    return done


def _moved(lists: DataFrame, root: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = _store(root)
        made = set()
        for listed in (path for batch in batches for path in batch.column(0).to_pylist()):
            for part in pq.ParquetFile(store.open_input_file(listed)).iter_batches(1000):
                rows = part.to_pylist()
                for row in rows:
                    row["path"] = to = f"{base}/{row['path']}"
                    folder = to.rpartition("/")[0]
                    if folder not in made:
                        store.create_dir(folder)
                        made.add(folder)
                    if store.get_file_info(row["attempt"]).type == fs.FileType.File:
                        store.move(row["attempt"], to)
                    elif store.get_file_info(to).size != row["bytes"]:
                        raise ValueError(f"neither {row['attempt']} nor {to} is there")
                    if row["modified"] is not None and isinstance(store, fs.LocalFileSystem):
                        os.chmod(to, row["rights"])
                        os.utime(to, (row["modified"], row["modified"]))
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "bytes": row["bytes"]} for row in rows], pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    # A list is one task's files; lists are dealt out, so that moves run everywhere.
    parts = max(1, lists.count())
    return lists.repartition(min(parts, 10_000)).mapInArrow(run, "path string, bytes long")
