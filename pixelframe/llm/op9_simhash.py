"""Operator 9: SimHash near-duplicates by a self-join of a binary trie.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 hashes have it. Equal fingerprints
collapse to one row, so copies cost nothing more. Distinct fingerprints form a binary trie, of which node pairs are
walked together: a pair's differing bits add up on the way down, and it is dropped when they pass the budget.

The upper trie is walked by Spark, a few bits a round, as equi-joins of node pairs with the nodes' sizes. A pair of
nodes with few fingerprints meets as one row with the fingerprints of both, within which a task walks on. A node with many is walked further, so a
crowded part of the trie is spread over tasks. Tasks return a spanning forest of the links that they find, which
keeps components whole; the components are then those of alternating large-star and small-star rounds.

Cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle are
one shingle; repeated rows each get a row; a null identifier is never a component's identifier unless all of its
are null; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, map_arrow, spare, table

SHINGLE = 3
BUDGET = 2
SEED = 42
#: Fingerprints under a trie node that one task takes; nodes with more are walked by Spark.
NODE = 8192
#: Bits that a round of Spark walks down.
STEP = 3
#: Node pairs that a task holds at once, and hashes whose bits it counts together.
_HELD, _COUNTED = 200_000, 255 * 64


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of rows of hashes the bits that are set in over half of them, as one row of big-endian words."""
    rows, width = hashes.reshape(len(hashes), -1), 8 * hashes.reshape(len(hashes), -1).shape[1]
    counts = np.zeros(8 * width, np.int64)
    for at in range(0, len(rows), _COUNTED):
        bits = np.unpackbits(rows[at : at + _COUNTED].astype(">u8").view(np.uint8), axis=1)
        whole = len(bits) // 255 * 255  # so many fit into a sum of one byte
        counts += bits[:whole].reshape(-1, 255, 8 * width).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole:].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(rows)).view(">u8").astype(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text."""
    words = text.encode().lower().split() if text else []  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return int(majority(np.array([xxhash.xxh64_intdigest(x, SEED) for x in joined], np.uint64))[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """``doc_id``, ``bits``, the fingerprint as a signed long, and ``row``, a long that the caller may want to keep."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64)), batch.column(2)], ["doc_id", "bits", "row"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("doc_id"), F.col(text), (F.lit(None).cast("long") if row is None else row).alias("row")), f"doc_id {kind}, bits long, row long", work)


class Forest:
    """Labels of joined rows; a label is the smallest row reachable so far."""

    def __init__(self, size: int) -> None:
        self.label = np.arange(size)

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.label[left], self.label[right]
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def close_pairs(a: np.ndarray, b: np.ndarray, depth: int, errors: int, budget: int, same: bool, few_pairs: int = 64):
    """Row numbers in sorted unsigned a and b of fingerprints within the budget, in portions. Both lie below trie
    nodes at ``depth`` that differ in ``errors`` bits; with ``same`` they are one array, whose pairs come once.
    Below nodes with ``few_pairs`` at most all are compared."""
    whole = np.array([[0, len(a), 0, len(b), errors]], np.int64)
    stack = [(depth, whole)] if len(a) and len(b) else []
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > _HELD:
            stack += [(depth, pairs[at : at + _HELD]) for at in range(0, len(pairs), _HELD)]
            continue
        al, ah, bl, bh, e = pairs.T
        few = ((ah - al) * (bh - bl) <= few_pairs) | (depth == 64)
        yield from _compared(a, b, pairs[few], budget, same)
        al, ah, bl, bh, e = pairs[~few].T
        if not len(al):
            continue
        am, bm = _middle(a, al, ah, depth), _middle(b, bl, bh, depth)
        below = [np.stack(x, 1) for x in ((al, am, bl, bm, e), (am, ah, bm, bh, e), (al, am, bm, bh, e + 1))]
        other = ~((al == bl) & (ah == bh)) if same else np.ones(len(al), bool)
        below.append(np.stack((am, ah, bl, bm, e + 1), 1)[other])
        pairs = np.concatenate(below)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= budget)]
        if len(pairs):
            stack.append((depth + 1, pairs))


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where in each node's range the half with the next bit set begins."""
    bit = np.uint64(1 << (63 - depth))
    first = values[low]
    return np.clip(np.searchsorted(values, (first & ~(bit | (bit - np.uint64(1)))) | bit), low, high)


def _compared(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, budget: int, same: bool):
    """The close ones among all pairs of rows under pairs of small nodes."""
    sizes = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    for part in np.array_split(np.arange(len(pairs)), max(1, int(sizes.sum()) >> 22)):
        al, ah, bl, bh, _ = pairs[part].T
        n = sizes[part]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(bh - bl, n)
        i, j = np.repeat(al, n) + inside // width, np.repeat(bl, n) + inside % width
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]


def _prefix(bits: Column, depth: int) -> Column:
    return F.shiftrightunsigned(bits, 64 - depth) if depth else F.lit(0).cast("long")


def links(distinct: DataFrame, budget: int = BUDGET, node: int = NODE) -> DataFrame:
    """A spanning forest (``a`` > ``b``, as unsigned) of all links between distinct fingerprints ``bits``."""
    total = distinct.count()
    spark = distinct.sparkSession
    pairs = spark.createDataFrame([(0, 0, 0, total, total)], "u long, v long, errors int, nu long, nv long")
    depth, ready = 0, []
    while True:
        small = (F.col("nu") <= node) & (F.col("nv") <= node)
        ready.append(pairs.where(small | F.lit(depth == 64)).select("u", "v", "errors", F.lit(depth).alias("depth")))
        wide = pairs.where(~small)
        if depth == 64 or wide.isEmpty():
            break
        step = min(STEP, 64 - depth)
        depth += step
        below = distinct.groupBy(_prefix(F.col("bits"), depth).alias("child")).agg(F.count("*").alias("n"))
        left = below.select(F.col("child").alias("cu"), F.col("n").alias("cn"), F.shiftrightunsigned("child", step).alias("u"))
        flips = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("off")) for m in range(1 << step)))
        mates = wide.join(left, "u").select("u", "v", "errors", "cu", "cn", F.inline(flips)).withColumn("errors", F.col("errors") + F.col("off")).where(F.col("errors") <= budget)
        low = F.lit((1 << step) - 1).cast("long")
        mates = mates.withColumn("child", F.shiftleft("v", step).bitwiseOR(F.col("cu").bitwiseAND(low).bitwiseXOR(F.col("mask"))))
        # Within a node each pair of its children comes once: order them by their last bits, for all are below it.
        once = (F.col("u") != F.col("v")) | (F.col("cu").bitwiseAND(low) <= F.col("child").bitwiseAND(low))
        mates = mates.where(once).join(below, "child")
        pairs = cut(mates.select(F.col("cu").alias("u"), F.col("child").alias("v"), "errors", F.col("cn").alias("nu"), F.col("n").alias("nv")), "trie")
    leaves, depths = ready[0], range(0, depth + 1)
    for more in ready[1:]:
        leaves = leaves.unionByName(more)
    leaves = leaves.withColumn("same", F.col("u") == F.col("v"))
    # Each node that a pair names becomes one row with its fingerprints (at most ``node``, or one at the last bit).
    named = leaves.select("depth", F.explode(F.array("u", "v")).alias("at")).distinct()
    used = [d for d in depths if d == depth or d % STEP == 0]
    below = distinct.select("bits", F.inline(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(F.col("bits"), d).alias("at")) for d in used))))
    nodes = cut(below.join(named, ["depth", "at"]).groupBy("depth", "at").agg(F.collect_list("bits").alias("held")), "nodes")
    side = lambda at, held: nodes.select("depth", F.col("at").alias(at), F.col("held").alias(held))
    pairs = leaves.join(side("u", "left"), ["depth", "u"]).join(side("v", "right"), ["depth", "v"]).select("depth", "errors", "same", "left", "right")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                depth, errors, same = (batch.column(c)[k].as_py() for c in range(3))
                a, b = (np.sort(batch.column(c)[k].values.to_numpy().view(np.uint64)) for c in (3, 4))
                whole, shift = (a, 0) if same else (np.concatenate([a, b]), len(a))
                forest = Forest(len(whole))
                for i, j in close_pairs(a, a if same else b, depth, errors, budget, same):
                    forest.join(i, j + shift)
                linked = np.flatnonzero(forest.label != np.arange(len(whole)))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(whole[linked].view(np.int64)), pa.array(whole[forest.label[linked]].view(np.int64))], ["a", "b"])

    return pairs.mapInArrow(walk, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node with an edge (``a``, ``b``).

    Large-star and small-star rounds in turn until the edges stay as they are: then each leads to a root."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    said = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        large = cut(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct(F.col("a"), F.col("least").alias("b"))))).where("a <> b").distinct()
        edges = cut(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == said:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        said = now


def _roots(marked: DataFrame, budget: int) -> DataFrame:
    """``bits``, ``least``, the smallest identifier with them, and ``root``, the smallest bits reachable."""
    distinct = cut(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    linked = components(links(distinct.select("bits"), budget))
    return distinct.join(linked.withColumnRenamed("node", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id``, the smallest identifier reachable, for each row."""
    marked = cut(fingerprints(docs, key, text, shingle), "fingerprints")
    named = _roots(marked, budget)
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(firsts, "root").select("bits", "component_id")
    return marked.join(of, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of each component, whole: that of the smallest identifier, nulls last. Rows alike in all columns are one."""
    row = F.xxhash64(*(F.col(c) for c in docs.columns))
    marked = cut(fingerprints(docs, key, text, shingle, row), "fingerprints")
    named = cut(_roots(marked, budget).select("bits", "root"), "roots")
    first = marked.join(named, "bits").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    own = spare(docs, "__row")
    chosen = first.select(F.col("first.row").alias(own)).distinct()
    return docs.withColumn(own, row).join(chosen, own, "left_semi").dropDuplicates([own, key]).drop(own)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
