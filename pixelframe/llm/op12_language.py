"""Operator 12: language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 letters, with the marks of a word's begin and end), the
most frequent first. A document's most frequent n-grams are compared with it: an n-gram counts by how many places it is
out, or, if the profile lacks it, by ``top`` places. The language of the smallest sum is told; of equals the first by name.
The score is what is left of 1 after the sum's share in the largest possible one.

Profiles are learnt from all labelled rows that may be learnt from: tasks count n-grams by language, counts are summed in a
shuffle keyed by language and n-gram, so a language that holds most rows has no task of its own, and the first ``top`` of
each language are taken before they meet. They are sent to all tasks: ``top`` rows for each of at most ``most_languages``
languages; more are an error that says so. Texts are counted in numpy, a batch at a time, long ones in pieces: n-grams are
told apart by their letters, packed into a number, not by hashes.

Cases: null texts and texts without a letter are ``und`` with score 0; if nothing can be learnt, so are all; rows of a null
language are predicted, not learnt from; a null key is not held out; repeated rows each get a row; texts of any length are
taken whole; ties of frequency are settled by the n-gram's letters; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import BATCH_ROWS, map_arrow, table

#: N-grams of a profile, and of a document.
TOP = 400
MOST_LANGUAGES = 2000
#: Letters that are counted together, and counts that a task holds before it sends them on.
_LETTERS, _HELD = 1 << 20, 1 << 19
#: A letter's code takes so many bits: letters have code points below 2 ** 18. 1 marks a word's begin and end, 0 is nothing.
_BITS = np.uint64(18)


@lru_cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(code).isalpha() for code in range(0x110000)), bool, 0x110000)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all letters in lower case with a mark before, between and behind the words of each text, and their texts' places."""
    raw = [np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32) for text in texts]
    flat, rows = np.concatenate(raw), np.repeat(np.arange(len(raw), dtype=np.uint64), [len(x) for x in raw])
    letter = _is_letter()[flat]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first sign behind a word
    kept[0], kept[1:] = True, kept[1:] | (rows[1:] != rows[:-1])  # the first sign of a text
    return np.where(letter, flat, 1).astype(np.uint64)[kept], rows[kept]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    return keys[begins], np.add.reduceat(counts, begins)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text, n-gram and count, by text and n-gram, of each n-gram in each of at most 1024 texts."""
    codes, rows = _codes(texts) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(codes), _LETTERS):
        back = min(at, 2)  # n-grams that end in this piece may begin in the one before
        c, r = codes[at - back : at + _LETTERS], rows[at - back : at + _LETTERS]
        row = r << np.uint64(3) * _BITS
        two, three = c[:-1] << _BITS | c[1:], c[:-2] << np.uint64(2) * _BITS | c[1:-1] << _BITS | c[2:]
        # A mark alone says nothing, and no n-gram goes over a mark or into the next text.
        new = np.arange(len(c)) >= back
        at_one, at_two, at_three = new & (c != 1), new[1:] & (r[1:] == r[:-1]), new[2:] & (r[2:] == r[:-2]) & (c[1:-1] != 1)
        one, two, three = (row | c)[at_one], (row[1:] | two)[at_two], (row[2:] | three)[at_three]
        part = np.unique(np.concatenate([one, two, three]), return_counts=True)
        keys, counts = part if not len(keys) else _summed(np.concatenate([keys, part[0]]), np.concatenate([counts, part[1]]))
    gram = keys & np.uint64((1 << 54) - 1)
    return (keys >> np.uint64(54)).astype(np.int64), gram.astype(np.int64), counts.astype(np.int64)


def held_out(key: str = "doc_id") -> Column:
    """Rows never learnt from: the remainder of crc32(key as text) by 4 is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(rows: DataFrame) -> DataFrame:
    """``lang, gram, n`` of all rows of ``lang, text``."""
    kinds = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            names = np.array(batch.column(0).to_pylist(), object)
            row, grams, counts = counted(batch.column(1).to_pylist())
            for name in set(names):
                mine = (names == name)[row]
                held.setdefault(name, []).append((grams[mine], counts[mine]))
            size += len(grams)
            if size > _HELD:
                held = {name: [_summed(*map(np.concatenate, zip(*parts, strict=True)))] for name, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > _HELD // 2:
                    yield from _rows(held, kinds)
                    held, size = {}, 0
        yield from _rows(held, kinds)

    said = rows.select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    parts = said.where("lang is not null").mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _rows(held: dict[str, list[tuple[np.ndarray, np.ndarray]]], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    for name, parts in held.items():
        grams, counts = _summed(*map(np.concatenate, zip(*parts, strict=True)))
        if len(grams):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams), pa.array(counts)], schema=kinds)


class Profiles:
    """Ranks of n-grams by language: for each n-gram the languages that have it."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int) -> None:
        """From (language, n-gram, rank from 0)."""
        self.top, self.names = top, sorted({name for name, _, _ in rows})
        number = {name: k for k, name in enumerate(self.names)}
        rows = sorted(rows, key=lambda row: row[1])
        self.lang, self.rank = (np.array(x, np.int64) for x in ([number[r[0]] for r in rows], [r[2] for r in rows]))
        self.grams, self.begins = np.unique(np.array([r[1] for r in rows], np.int64), return_index=True)
        self.ends = np.append(self.begins[1:], len(rows))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        row, grams, counts = counted([text or "" for text in texts])
        # By text, then the most frequent first; n-grams are in order already.
        order = np.argsort(row << 40 | (1 << 40) - 1 - np.minimum(counts, (1 << 40) - 1), kind="stable")
        row, grams = row[order], grams[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.top
        row, grams, place = row[kept], grams[kept], place[kept]
        most = np.bincount(row, minlength=len(texts)) * self.top
        near = np.zeros((len(texts), max(1, len(self.names))), np.int64)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            known = self.grams[at] == grams
            row, place, at = row[known], place[known], at[known]
            # Each known n-gram meets the languages that have it.
            many = self.ends[at] - self.begins[at]
            each = np.repeat(np.arange(len(at)), many)
            entry = self.begins[at][each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
            np.add.at(near, (row[each], self.lang[entry]), self.top - np.abs(place[each] - self.rank[entry]))
        best = near.argmax(1)
        return [(self.names[b], float(near[k, b] / m)) if m and self.names else ("und", 0.0) for k, (b, m) in enumerate(zip(best, most, strict=True))]


def learn(rows: DataFrame, top: int = TOP, most_languages: int = MOST_LANGUAGES) -> Profiles:
    """Profiles of the languages of all rows of ``lang, text``."""
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = gram_counts(rows).withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < top)
    found = ranked.select("lang", "gram", "rank").limit(top * most_languages + 1).collect()
    if len(found) > top * most_languages:
        raise ValueError(f"more than {most_languages} languages: their profiles are too large to be sent to all tasks")
    return Profiles([tuple(row) for row in found], top)


def identify(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns to ``carry``, ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    columns = [key, *carry]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", lang_pred string, score double"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = shared.value.predict(batch.column(len(columns)).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([name for name, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64())], [*columns, "lang_pred", "score"])

    return map_arrow(docs.select(*columns, F.col(text).alias("__said")), schema, work)


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), learn(docs.where(~held_out()).select("lang", "text")), carry=("held_out",))
