"""Operator 7: WARC archives, written and read as a chunked record table.

Writing: payloads are cut into rows of (record, chunk number), at most ``CHUNK`` bytes in each, which follow one another
in a partition; each task streams them into one ``.warc.gz`` file, a gzip member for each record, and carries the digest
along. Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest identifier is a
response and the others revisit it.
Reading: a record comes as the same kind of rows, with the digest of the payload up to there. Python holds a few chunks
at a time and never a whole record (the table's own reader gives a payload as one value). A record's last chunk
carries its full digest.

Files lie in the folder that spark.checkpoint.dir names and are opened through pyarrow's file systems. A task that
runs again writes a file of a new name, and only files that the finished tasks name are read.

Cases: null and empty payloads are records of no bytes, with one chunk; repeated rows are records of their own,
and those of equal identifiers and payloads are alike, all responses or all revisits; null identifiers and
addresses are written as empty, a null identifier is never a response that others revisit unless it is alone with
its payload; other columns are ignored, whatever their names; an empty table gives no file and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, new_folder, table

CHUNK = 1 << 18
LEAST = 0
_READ = 1 << 16


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def assign(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST) -> DataFrame:
    """``page_id``, ``url``, ``html``, ``digest`` (SHA-1, hexadecimal) and ``refers_to``, null for a response."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.encode(payload, "UTF-8"), F.lit(b"")).alias("html"))
    # Different payloads of one SHA-1 can be made; of one SHA-1 and SHA-256 they can't.
    same = ["digest", "strong"]
    rows = rows.withColumns({"digest": F.sha1("html"), "strong": F.unhex(F.sha2("html", 256))})
    # Of a payload only its digests and count are shuffled, aggregated before; what repeats is joined back.
    shared = rows.where(F.octet_length("html") >= least_bytes).groupBy(*same).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(shared, same, "left")
    return rows.select("page_id", "url", "html", "digest", F.when(F.octet_length("html") < least_bytes, None).when((F.col("page_id") < F.col("last")) | F.col("page_id").isNull(), F.col("last")).alias("refers_to"))


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """What assign() gives as ``page_id, url, digest, refers_to, bytes, chunk, last, payload``: the chunks of a record in
    their order, one after another. A revisit has one chunk of no bytes. Nothing is shuffled."""
    rows = records.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit(b"")))
    chunks = F.greatest(F.ceil(F.octet_length("html") / chunk_bytes), F.lit(1)).cast("int")
    rows = rows.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select("page_id", "url", "digest", "refers_to", "bytes", "chunk", (F.col("chunk") == F.col("chunks") - 1).alias("last"), F.expr(f"substring(html, chunk * {chunk_bytes} + 1, {chunk_bytes})").alias("payload"))


def write(records: DataFrame, folder: str, compress: int = 1, chunk_bytes: int = CHUNK) -> DataFrame:
    """Writes what assign() gives; returns ``file`` and ``records`` of each file, once all are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        out, record, name, n = None, None, f"{at}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for k in range(batch.num_rows):
                *head, last, payload = (column[k] for column in batch.columns)
                if out is None:
                    store.create_dir(at)
                    out = store.open_output_stream(name, compression=None)
                if record is None:
                    record = _Record(out, *(x.as_py() for x in head[:5]), compress)
                record.add(payload.as_buffer())
                if last.as_py():
                    record.end()
                    record, n = None, n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return cut(chunk_rows(records, chunk_bytes).mapInArrow(run, "file string, records long"), "warc-files")


class _Record:
    """A gzip member that is being written, and the digest of what it has of its payload so far."""

    def __init__(self, out, page: int | None, url: str | None, digest: str, refers: int | None, size: int, compress: int) -> None:
        self.out, self.packer, self.digest, self.declared, self.own = out, zlib.compressobj(compress, zlib.DEFLATED, 31), hashlib.sha1(), digest, refers is None
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        head = [
            "WARC/1.1", f"WARC-Type: {'response' if self.own else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {''.join((url or '').split())}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Length: {size}",
        ]
        if not self.own:
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers}"]
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + size * self.own}"]
        out.write(self.packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http))

    def add(self, chunk) -> None:
        self.digest.update(chunk)
        self.out.write(self.packer.compress(chunk))

    def end(self) -> None:
        if self.own and self.digest.hexdigest() != self.declared:
            raise ValueError("the chunks of a record are not those of its payload")
        self.out.write(self.packer.compress(b"\r\n\r\n") + self.packer.flush())


class _Bytes:
    """The bytes of a file of gzip members, unpacked as they are asked for."""

    def __init__(self, stream) -> None:
        self.stream, self.unpack, self.left, self.ahead = stream, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.unpack.eof:
                self.ahead, self.unpack = self.unpack.unused_data or self.ahead, zlib.decompressobj(31)
            packed = self.unpack.unconsumed_tail or self.ahead or self.stream.read(_READ)
            self.ahead = b""
            if not packed:
                return False
            if got := self.unpack.decompress(packed, _READ):
                self.left += got
                return True

    def line(self) -> bytes:
        while b"\r\n" not in self.left:
            if not self._more():
                return b""
        line, _, self.left = self.left.partition(b"\r\n")
        return line

    def upto(self, size: int) -> bytes:
        while len(self.left) < size and self._more():
            pass
        got, self.left = self.left[:size], self.left[size:]
        return got


def records_of(stream, chunk_bytes: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of the records of one file, in their order."""
    data, number = _Bytes(stream), 0
    while True:
        line = data.line()
        if not line:
            if not data.left and not data._more():
                return
            continue
        head = {}
        while line := data.line():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        length = int(head["content-length"])
        while line := data.line():  # the HTTP head is part of the block, not of the payload
            length -= len(line) + 2
        length -= 2
        digest, done, chunk = hashlib.sha1(), 0, 0
        while True:
            payload = data.upto(min(chunk_bytes, length - done))
            digest.update(payload)
            done += len(payload)
            yield {"record": number, "chunk": chunk, "payload": payload, "bytes_so_far": done, "digest_so_far": base64.b32encode(digest.digest()).decode(), "last": done >= length or not payload, "head": head}
            chunk += 1
            if done >= length or not payload:
                break
        number += 1


CHUNKS = (
    "page_id long, record_type string, refers_to long, declared_bytes long, declared_digest string, file string, record long, chunk long, "
    "payload binary, bytes_so_far long, digest_so_far string, last boolean"
)


def read(files: DataFrame, folder: str, payloads: bool = True, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunk table (see CHUNKS) of the files named in ``files``; without ``payloads`` that column is null."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("file", pa.string()),
        ("record", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        number = lambda x: int(x) if x else None
        held, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(name, compression=None) as stream:
                    for row in records_of(stream, chunk_bytes):
                        head = row.pop("head")
                        size += len(row["payload"])
                        row["payload"] = row["payload"] if payloads else None
                        held.append(row | {"file": name, "page_id": number(head["x-page-id"]), "record_type": head["warc-type"], "refers_to": number(head.get("x-refers-to-page-id")), "declared_bytes": int(head["x-payload-length"]), "declared_digest": head["warc-payload-digest"].removeprefix("sha1:")})
                        if len(held) >= 512 or size >= 1 << 24:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(run, CHUNKS)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST) -> DataFrame:
    """Writes all rows and reads them back: a row for each record. A response's size and digest are those of the
    chunks that were read; a mismatch with what its header declares is an error. A revisit has no payload of its
    own, and its header carries the size and digest of the full payload."""
    folder = new_folder(pages.sparkSession, "warc")
    files = write(assign(pages, key, url, payload, least_bytes), folder)
    chunks = read(files, folder, payloads=False).where("last")
    own = F.col("record_type") == "response"
    wrong = own & ((F.col("digest_so_far") != F.col("declared_digest")) | (F.col("bytes_so_far") != F.col("declared_bytes")))
    digest = F.when(wrong, F.raise_error(F.concat(F.lit("damaged record in "), F.col("file")))).otherwise(F.when(own, F.col("digest_so_far")).otherwise(F.col("declared_digest")))
    return chunks.select("page_id", F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))
