"""Operator 1: SentencePiece encoding with the place of every piece in the original text, and decoding.

A text is normalised by longest-prefix look-ups in the model's compiled character map. Each normalised byte
keeps the original byte from which it came, so any piece, cut from the normalised text, leads back to a span of
original bytes. Segmentation of the normalised text and decode(ids) are those of the sentencepiece library.

Cases: null and empty texts have no pieces and decode to the empty text; repeated rows and null identifiers pass
through, a row for each; other columns are ignored, whatever their names; an empty table gives an empty result.
A text is held whole by one task, as the library asks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pixelframe.llm.common import map_arrow, table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"


def _fields(message: bytes):
    """Field number and value of each field of a protobuf message."""
    at, end = 0, len(message)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, message[at : at + size]
            at += size


def _varint(value: int) -> bytes:
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


class CharacterMap:
    """The compiled character map: a double-array trie from UTF-8 strings to their normalised forms."""

    def __init__(self, compiled: bytes) -> None:
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.forms = compiled[4 + size :]

    def longest(self, text: bytes, start: int) -> tuple[int, bytes]:
        """Length of the longest mapped prefix of text[start:], 0 if there is none, and its normalised form."""
        units, node, best, form_at = self.units, 0, 0, 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for at in range(start, len(text)):
            node ^= text[at]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[at]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best, form_at = at + 1 - start, units[node] & 0x7FFFFFFF
        return best, self.forms[form_at : self.forms.index(b"\0", form_at)] if best else b""


class Normalizer:
    """Normalises a text; ``align[i]`` is the original byte at which the source of normalised byte i starts."""

    def __init__(self, spec: dict) -> None:
        self.map = CharacterMap(spec[2]) if len(spec.get(2, b"")) > 4 else None
        self.dummy_prefix = bool(spec.get(3, 1))
        self.strip = bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int64)
        return self._mapped(text.encode()) if self.map or self.strip else self._plain(text)

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        """With an empty map every character stays, and the alignment follows from where spaces are."""
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.arange(len(raw))
        at[raw & 0xC0 == 0x80] = 0
        at = np.maximum.accumulate(at)
        space = SPACE if self.escape else " "
        if self.escape:
            at = np.repeat(at, np.where(raw == 32, 3, 1))
            text = text.replace(" ", SPACE)
        front = len(space.encode()) * self.dummy_prefix
        return space * self.dummy_prefix + text, np.concatenate([np.zeros(front, np.int64), at, [len(raw)]])

    def _mapped(self, text: bytes) -> tuple[str, np.ndarray]:
        space = SPACE.encode() if self.escape else b" "
        out, align, at = [], [], 0

        def prefix() -> tuple[bytes, int]:
            size, form = self.map.longest(text, at) if self.map else (0, b"")
            if size:
                return form, size
            size = 1
            while at + size < len(text) and text[at + size] & 0xC0 == 0x80:
                size += 1
            return text[at : at + size], size

        while self.strip and at < len(text):
            form, size = prefix()
            if form != b" ":
                break
            at += size
        if at == len(text):
            return "", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out.append(space)
            align += [at] * len(space)
        after_space = self.strip
        while at < len(text):
            form, size = prefix()
            if after_space:
                form = form.lstrip(b" ")
            if form:
                shown = form.replace(b" ", space)
                out.append(shown)
                align += [at] * len(shown)
                after_space = form.endswith(b" ")
            at += size
            after_space = after_space and self.strip
        joined, end = b"".join(out), at
        while self.strip and joined.endswith(space):
            joined = joined[: -len(space)]
            end = align[len(joined)]
        return joined.decode(), np.array([*align[: len(joined)], end], np.int64)


class PieceCodec:
    """Encodes and decodes with a model's bytes. Ids and spans are those of the sentencepiece library."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        fields = list(_fields(model))
        spec = {k: v for number, value in fields if number == 3 for k, v in _fields(value)}
        pieces = [dict(_fields(value)) for number, value in fields if number == 1]
        self.normalize = Normalizer(spec)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # The same model for texts that are normalised already.
        bare = _field(1, b"identity") + _field(2, b"") + b"".join(_field(n, 0) for n in (3, 4, 5))
        rest = b"".join(_field(n, v) for n, v in fields if n not in (2, 3))
        trainer = b"".join(_field(2, v) for n, v in fields if n == 2)
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=rest + trainer + _field(3, bare))
        kinds = [piece.get(3, 1) for piece in pieces]
        self.width = np.array([1 if kind == 6 else len(piece[1]) for kind, piece in zip(kinds, pieces, strict=True)], np.int64)
        self.unknown = -1 if 6 in kinds else kinds.index(2)

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and the first and the past-the-last original byte of each piece."""
        norm, align = self.normalize(text or "")
        ids = self.segmenter.encode(norm) if norm else []
        if not ids:
            none = np.zeros(0, np.int64)
            return [], none, none
        width = self.width[np.array(ids)]
        if self.unknown in ids:  # an unknown piece is as wide as what it stands for
            width = np.array([len(p.surface.encode()) for p in self.segmenter.encode(norm, return_type="proto").pieces], np.int64)
        ends = np.cumsum(width)
        return ids, align[ends - width], align[ends]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read where the query is built and sent to the executors (about 0.5 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as file:
        return file.read()


_codecs: dict[bytes, PieceCodec] = {}


def _codec(model: bytes) -> PieceCodec:
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


#: What encode() can return for a row, by column.
COLUMNS = {
    "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "bytes_covered": "long",
    "ids": "array<int>", "begins": "array<long>", "ends": "array<long>", "decoded": "string",
}


def encode(df: DataFrame, model: bytes, columns: tuple[str, ...] = ("ids", "begins", "ends", "decoded"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ``columns`` asked for (see COLUMNS) of each row's text. Only those leave the Python task."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, made = _codec(shared.value), {name: [] for name in columns}
        for value in batch.column(1).to_pylist():
            ids, begins, ends = codec.encode(value)
            for name, out in made.items():
                if name == "n_tokens":
                    out.append(len(ids))
                elif name == "ids_sha256":
                    out.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                elif name == "decoded_sha256":
                    out.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                elif name == "bytes_covered":
                    out.append(int((ends - begins).sum()))
                else:
                    out.append({"ids": ids, "begins": begins, "ends": ends}[name] if name != "decoded" else codec.decode(ids))
        types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out, types[COLUMNS[name]]) for name, out in made.items())], [key, *columns])

    return map_arrow(df.select(key, text), f"`{key}` {kind}, " + ", ".join(f"{name} {COLUMNS[name]}" for name in columns), work)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_bytes(), ("n_tokens", "ids_sha256", "decoded_sha256", "bytes_covered"))
