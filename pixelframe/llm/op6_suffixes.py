"""Operator 6: exact substring dedup by distributed prefix doubling.

Bytes are removed that a string of ``threshold`` bytes covers which also starts anywhere else. Positions are ranked
by what follows them, in rounds that double the length: each round pairs a position's rank with the rank of what stands
at the offset reached so far, Spark sorts the pairs together, a pair's name is the new rank, and positions whose pair is
unique drop out, until the length is past the threshold.

1. Not every position is ranked. Each string of ``threshold`` bytes has one anchor: the place of the least 8-byte hash
   in its first quarter, which its content alone decides. Only anchors (about one position in fifty) take part in the
   rounds, by the three quarters that follow them, in four blocks: lengths are one block, two and four. If an anchor's
   rank is unique, so are all strings of that anchor.
2. Anchors that remain are paired with the name of all that their strings cover. Is such a pair not unique, then all its
   strings are repeated, and they are settled together.
3. The strings of the anchors that are left, at the edges of repeated passages, are ranked one by one by the pair of
   names of their halves. One anchor of each settled name takes part, so that they meet what has been settled.

Ranks are names, equal or not, and hashes instead of sorted numbers, so a round costs one sort instead of two. Those that
decide have 128 bits. Nothing is grouped without being counted first, and the joins with the counts are plain
equi-joins, which Spark splits where a name is frequent.

With ``words`` the positions are those of words (runs of anything but ASCII white space) and ``threshold`` counts words:
texts are then read as rows of 64-bit hashes of their words, and what goes are the bytes from the first to the last word.

Cases: null and empty texts have no bytes; texts shorter than the threshold lose nothing; rows of equal texts are
copies of each other, whatever their keys, and lose all if they are long enough; null keys are allowed; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, free, map_arrow, table

THRESHOLD = 400
#: Bytes of text that are looked at together.
_PORTION = 1 << 21
_ROW = ["key", "tag"]
#: Bytes of a word's hash.
_WORD = 8


def _slide_min(values: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        values, n = np.minimum(values[:-n], values[n:]), 2 * n
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def word_codes(text: bytes) -> bytes:
    """The hashes of a text's words, one after another."""
    return np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64).tobytes()


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Where each word begins and ends."""
    return [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", text)]


def anchors(texts: list[bytes], threshold: int, unit: int = 1) -> list[np.ndarray]:
    """For each text rows (anchor, first start, last start) of the strings of ``threshold`` units in it."""
    width = threshold // 4
    none = np.zeros((0, 3), np.int64)
    if not any(len(text) >= threshold * unit for text in texts):
        return [none for _ in texts]
    if unit == _WORD:
        value = np.frombuffer(b"".join(texts), np.uint64)
        value = value[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ value[1:]  # of two words, as single ones are too often alike
    else:
        value = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        for n in (1, 2, 4):
            value = (value[:-n] << np.uint64(8 * n)) | value[n:]
    value *= np.uint64(0x9E3779B97F4A7C15)
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    value = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=np.uint64)
    least = (_slide_min(value, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    out, begin = [], 0
    for text in texts:
        n = len(text) // unit - threshold + 1
        if n > 0:
            of = least[begin : begin + n] - begin
            first = np.flatnonzero(np.diff(of, prepend=-1))
            out.append(np.stack([of[first], first, np.append(first[1:], n) - 1], 1))
        else:
            out.append(none)
        begin += len(text) // unit
    return out


def _portions(texts: list[bytes]) -> Iterator[slice]:
    begin = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > _PORTION:
            yield slice(begin, at)
            begin, size = at, 0
        size += len(text)
    yield slice(begin, len(texts))


def _units(texts: pa.Array, unit: int) -> list[bytes]:
    return [word_codes(text) for text in texts.to_pylist()] if unit == _WORD else texts.to_pylist()


#: Blocks of what follows an anchor, by the name of each; rounds rank one, two and four of them.
_BLOCKS = ("n0", "n1", "n2", "n3")
_ANCHORS = ", ".join(f"{n} long" for n in _BLOCKS) + ", whole long, key long, tag int, lo int, hi int"


def _anchor_rows(threshold: int, unit: int, first_only: bool = False):
    """Rows of _ANCHORS, or the first block's names alone."""
    tail = threshold - threshold // 4 + 1
    edges = [unit * (tail * k // len(_BLOCKS)) for k in range(len(_BLOCKS) + 1)]
    blocks = list(zip(edges[:-1], edges[1:], strict=True))[: 1 if first_only else None]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, name = _units(batch.column(batch.num_columns - 1), unit), xxhash.xxh3_64_intdigest
        names, whole, found = [[] for _ in blocks], [], []
        for part in _portions(texts):
            for row, (text, places) in enumerate(zip(texts[part], anchors(texts[part], threshold, unit), strict=True), part.start):
                view, at = memoryview(text), [q * unit for q in places[:, 0].tolist()]
                for out, (begin, end) in zip(names, blocks, strict=True):
                    out += [name(view[q + begin : q + end]) for q in at]
                if not first_only:
                    whole += [name(view[lo * unit : (hi + threshold) * unit], q - lo) for q, lo, hi in places.tolist()]
                    found.append(np.column_stack([np.full(len(places), row), places[:, 1:]]))
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        if first_only:
            return pa.RecordBatch.from_arrays([signed(names[0])], ["n0"])
        at = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        rows = pa.array(at[:, 0])
        columns = [*map(signed, names), signed(whole), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at[:, 1].astype(np.int32)), pa.array(at[:, 2].astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, [*_BLOCKS, "whole", "key", "tag", "lo", "hi"])

    return work


def _string_rows(threshold: int, unit: int):
    half = threshold // 2

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        name, out, rows = xxhash.xxh3_64_intdigest, [], []
        for row, (text, ranges) in enumerate(zip(_units(batch.column(2), unit), batch.column(3).to_pylist(), strict=True)):
            view = memoryview(text)
            for r in ranges:
                for p in range(r["lo"], r["hi"] + 1):
                    out.append((name(view[p * unit : (p + half) * unit]), name(view[(p + half) * unit : (p + threshold) * unit]), p))
            rows += [row] * (len(out) - len(rows))
        left, right, at = (np.array(out, np.uint64).reshape(-1, 3).T).copy()
        taken = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(at.astype(np.int32))], ["left", "right", "key", "tag", "at"])

    return work


def _twice(rows: DataFrame, *name: str) -> DataFrame:
    """The names that more than one row has; a table, so that Spark can split a join with it where a name is frequent."""
    return cut(rows.groupBy(*name).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"), "names")


def _rounds(keyed: DataFrame, threshold: int, unit: int = 1) -> DataFrame:
    """``key, tag, ranges``: for each text with repeated strings, the first and last starts of runs of them."""
    spark = keyed.sparkSession
    # Round 1: one block. Texts are read twice, which is less than writing an anchor table that hardly anything is left of.
    names = map_arrow(keyed.select("bytes"), "n0 long", _anchor_rows(threshold, unit, True))
    second = cut(map_arrow(keyed, _ANCHORS, _anchor_rows(threshold, unit)).join(_twice(names, "n0"), "n0"), "ranks")
    free(spark)
    # Rounds 2 and 3: the rank so far, and that of as much again behind it.
    for more in (("n1",), ("n2", "n3")):
        before = second.withColumn("n0", F.xxhash64("n0", *more)).drop(*more)
        second = cut(before.join(_twice(before, "n0"), "n0"), "ranks")
        free(spark, before)
    second = second.withColumnRenamed("n0", "short")

    marked = cut(second.join(_twice(second, "short", "whole").withColumn("settled", F.lit(True)), ["short", "whole"], "left"), "marked")
    free(spark, second)
    settled, left = marked.where("settled"), marked.where("settled is null")
    # Where a settled anchor may meet one that is left, one anchor of its name stands for all.
    one_each = settled.groupBy("short", "whole").agg(F.min(F.struct("key", "tag", "lo", "hi")).alias("spot"))
    one_each = one_each.join(left.select("short").distinct(), "short", "left_semi")
    ask = left.select("key", "tag", "lo", "hi").unionByName(one_each.select("spot.*"))
    asked = ask.groupBy(*_ROW).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    third = cut(map_arrow(keyed.join(asked, _ROW).select("key", "tag", "bytes", "ranges"), "left long, right long, key long, tag int, at int", _string_rows(threshold, unit)), "strings")
    free(spark)
    strings = cut(third.join(_twice(third, "left", "right"), ["left", "right"]).select("key", "tag", F.col("at").alias("lo"), F.col("at").alias("hi")), "repeated")
    free(spark, third)
    return settled.select("key", "tag", "lo", "hi").unionByName(strings).groupBy(*_ROW).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def _removed(size: int, ranges: list[dict] | None, threshold: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] + threshold) for r in ranges or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return [(lo, min(hi, size)) for lo, hi in out]


#: What dedup() can return for a row, by column; ``kept_text`` leaves out what is left of characters cut in two.
COLUMNS = {
    "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "kept_text": pa.string(),
    "spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])),
}
_TYPES = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "binary", "kept_text": "string", "spans": "array<struct<begin:long,end:long>>"}


def dedup(docs: DataFrame, columns: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "spans", "kept"), threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), words: bool = False) -> DataFrame:
    """``key``, the columns to ``carry``, and the ``columns`` asked for (see COLUMNS) of every row."""
    if threshold < 40:
        raise ValueError("threshold must be at least 40 bytes or words")
    own = [key, *carry]
    named = [F.xxhash64(F.col(key), F.col(text)).alias("key"), F.hash(F.col(text), F.col(key)).alias("tag"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("bytes")]
    found = _rounds(docs.select(*named), threshold, _WORD if words else 1)
    rows = docs.select(*named, F.struct(*own).alias("own")).join(found, _ROW, "left").select("own", "bytes", "ranges")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own) + ", " + ", ".join(f"`{c}` {_TYPES[c]}" for c in columns)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = {c: [] for c in columns}
        for raw, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if words and ranges:
                at = word_spans(raw)
                spans = [(at[lo][0], at[hi - 1][1]) for lo, hi in _removed(len(at), ranges, threshold)]
            else:
                spans = _removed(len(raw), ranges, threshold)
            kept = b"".join(raw[a:b] for a, b in zip([0, *(hi for _, hi in spans)], [*(lo for lo, _ in spans), len(raw)], strict=True))
            row = {"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans), "kept": kept}
            for c, out in made.items():
                if c == "kept_sha256":
                    out.append(hashlib.sha256(kept).hexdigest())
                elif c == "kept_text":
                    out.append(kept.decode(errors="ignore"))
                elif c == "spans":
                    out.append([{"begin": lo, "end": hi} for lo, hi in spans])
                else:
                    out.append(row[c])
        return pa.RecordBatch.from_arrays([*batch.column(0).flatten(), *(pa.array(out, COLUMNS[c]) for c, out in made.items())], [*own, *columns])

    return map_arrow(rows, schema, work)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, and the text that is left (without what remains of characters cut in two)."""
    return dedup(table(spark, sf_dir, "documents"), ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"))
