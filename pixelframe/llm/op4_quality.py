"""Operator 4: quality classifier.

Logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates, scored as a sparse
dot product. A token is a run of letters, of digits or of other signs; features are its unigrams and bigrams,
hashed to ``2 ** bits`` places, each with weight 1 / sqrt(features of the text). Only the text is an input.

Training takes at most ``sample`` labelled rows (those whose hashed key comes first), dealt to ``shards`` tasks,
each of which runs its own updates; the models are averaged. Scoring reads every text whole.

Cases: null and empty texts have no feature and get the score of the bias alone; repeated and unlabelled rows are
scored like others; labels that are null are not learnt from; with no labels at all every score is 0.5; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import map_arrow, table

BITS = 18
#: The most labelled rows that a model is fitted on.
SAMPLE = 20_000
SHARDS = 8
PASSES = 4
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Hashes of tokens that a task remembers; beyond it the memory starts anew.
_KEPT = 300_000


class Features:
    """Places of a text's hashed unigrams and bigrams."""

    def __init__(self, bits: int) -> None:
        self.mask, self.kept = np.uint64((1 << bits) - 1), {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens, kept = TOKEN.findall(text or ""), self.kept
        try:
            codes = [kept[x] for x in tokens]
        except KeyError:
            if len(kept) > _KEPT:
                kept.clear()
            kept.update((x, zlib.crc32(x.encode())) for x in set(tokens))
            codes = [kept[x] for x in tokens]
        one = np.array(codes, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ np.uint64(0xA5A5A5A55A5A5A5A)) * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:]
        return ((np.concatenate([one, two]) >> np.uint64(29)) & self.mask).astype(np.int64)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for logistic loss; the last place is the bias."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (_sigmoid(float(w @ x)) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(
    rows: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", bits: int = BITS,
    shards: int = SHARDS, passes: int = PASSES, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1,
) -> np.ndarray:
    """Weights learnt from a bounded number of labelled rows: ``2 ** bits`` places and the bias, averaged over the shards."""
    rows = rows.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.xxhash64(key, text).alias("at"))
    rows = rows.withColumn("shard", F.pmod("at", F.lit(shards)))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        model, features = Ftrl(bits, alpha, beta, l1, l2), Features(bits)
        rows = rows.sort_values(["at", "text", "label"], na_position="first")
        seen = []
        for value, answer in zip(rows["text"], rows["label"], strict=True):
            at, counts = np.unique(features(value), return_counts=True)
            scale = 1 / np.sqrt(max(1, counts.sum()))
            seen.append((np.append(at, 1 << bits), np.append(counts * scale, 1.0), int(answer == 1)))
        for _ in range(passes):
            for example in seen:
                model.learn(*example)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at] * len(rows), "rows": len(rows)})

    learnt = rows.groupBy("shard").applyInPandas(fit, "at long, w double, rows long")
    weights = np.zeros((1 << bits) + 1)
    totals = learnt.groupBy("at").agg(F.sum("w").alias("w"), F.sum("rows").alias("rows")).toPandas()  # 2 ** bits + 1 rows at most
    if len(totals):
        weights[totals["at"]] = totals["w"] / totals["rows"].max()  # the bias is in every shard's model
    return weights


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns to ``carry``, and score and predicted of every row."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    columns = [key, *carry]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", score double, predicted int"

    class Score:
        def __init__(self) -> None:
            self.features, self.w = Features(bits), shared.value.astype(float)

        def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for value in batch.column(len(columns)).to_pylist():
                at = self.features(value)
                out.append(_sigmoid(self.w[-1] + self.w[at].sum() / np.sqrt(max(1, len(at)))))
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())], [*columns, "score", "predicted"])

    return map_arrow(docs.select(*columns, F.col(text).alias("__scored")), schema, Score)


def held_out(key: str = "doc_id") -> Column:
    """Rows never learnt from: the remainder of crc32(key as text) by 3 is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The quality model of a corpus: learnt from at most ``sample`` labelled rows that are not held out."""
    rows = labels.where(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Broadcast: ``sample`` rows of two numbers at most.
    known = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return train(known)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text", held_out().alias("held_out")), model(docs, table(spark, sf_dir, "labels")), carry=("held_out",))
    return scored.select("doc_id", "held_out", "score", "predicted")
