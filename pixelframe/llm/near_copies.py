"""Operator 9 by similarity: groups of texts whose sets of five-word shingles have a Jaccard similarity from 0.8.

Texts with equal sets collapse to one node. A node's fingerprint is a SimHash of ``WORDS`` times 64 bits. At similarity
0.8 some 15 % of the bits differ, too many for one trie: node pairs would hardly be pruned. So several tries are walked,
each over the bits in an order of its own. The first ``bits`` levels allow no error, which is an equi-join on a prefix;
below them pairs walk down together with the whole budget. The number of levels follows the number of nodes, so that
some ``CROWD`` unrelated ones share a prefix, and the number of tries follows from the levels: a pair of similarity 0.8
has no common prefix with a probability of ``MISSED``, and passes the budget of differing bits with some 0.005; more
similar pairs are missed less. Pairs within the budget are verified by the exact similarity of their texts.

First each node meets the closest other node of each trie; then the closest of each group that it isn't connected with;
then all close pairs that are still not connected are verified, so no link that was found between two groups is left
out. A prefix that many nodes share is cut into pieces of a bounded size, by group: pieces of one and the same group need
not meet, and so a large group costs in proportion to its size.

Cases: null and empty texts are one node; texts of fewer words than a shingle are one shingle; repeated rows are one
node; null identifiers are allowed; other columns are carried, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, discard, free, map_arrow, spare
from pixelframe.llm.op9_simhash import close_pairs, components, majority

SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits in a fingerprint, and in the part of it that goes through the first round; unrelated nodes that share
#: a prefix; pairs of the least similarity without one.
WORDS, PART, CROWD, MISSED = 32, 8, 1024, 0.005
#: Nodes of one prefix that a task holds together, and pairs below two trie nodes that are not worth a walk.
PIECE, FEW = 4096, 1 << 16
#: Pairs whose bits a task compares at once.
_HELD = 1 << 15
_STEPS = np.random.default_rng(43).integers(0, 1 << 63, WORDS, np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    words = text.encode().lower().split() if text else []  # of bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x) for x in joined], np.uint64))


def fingerprint(held: np.ndarray) -> bytes:
    """The SimHash of a set, in the machine's byte order."""
    if not len(held):
        return bytes(8 * WORDS)
    mixed = (held[:, None] ^ _STEPS) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return majority(mixed ^ (mixed >> np.uint64(29))).tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def differing(similar: float = SIMILARITY) -> float:
    """The share of a fingerprint's bits that differ between sets of such a similarity, on average."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def _budget(bits: int) -> int:
    """Differing bits among so many: three standard deviations above the average in one word, 2.6 in more."""
    p = differing()
    return math.ceil(bits * p + (3 if bits <= 64 else 2.6) * math.sqrt(bits * p * (1 - p)))


def tries(nodes: int) -> tuple[int, int]:
    """The levels without an error and the number of tries for so many nodes."""
    levels = max(4, math.ceil(math.log2(max(2, nodes) / CROWD)))
    return levels, math.ceil(math.log(MISSED) / math.log(1 - (1 - differing()) ** levels))


def _marks(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingles(x) for x in batch.column(0).to_pylist()]
    node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(node), pa.array(map(fingerprint, sets), pa.binary())], ["id", "row", "node", "bits"])


def _places(levels: int, number: int) -> np.ndarray:
    """For each trie the bits of its first levels; all lie in the part of a fingerprint that goes through every round."""
    order = np.random.default_rng(44)
    return np.stack([order.choice(64 * PART, levels, replace=False) for _ in range(number)])


def _prefixes(places: np.ndarray):
    """Rows (prefix, node, bits): a node under its prefix in each trie."""
    number, levels = places.shape
    powers = np.int64(1) << np.arange(levels)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fields = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 8 * WORDS)
        bits = np.unpackbits(fields, axis=1).astype(np.int64)
        prefix = np.concatenate([(bits[:, at] @ powers) * number + nth for nth, at in enumerate(places)])
        row = pa.array(np.tile(np.arange(len(fields)), number))
        part = pa.array([x[: 8 * PART] for x in batch.column(1).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(prefix), batch.column(0).take(row), part.take(row)], ["prefix", "node", "bits"])

    return work


def _pieces(spread: DataFrame) -> DataFrame:
    """``prefix, part, held, root, one``: the nodes of a prefix in pieces; ``one`` tells that all are of one root."""
    totals = cut(spread.groupBy("prefix").agg(F.count("*").alias("__all")).where(F.col("__all") > PIECE), "crowded")
    parts = lambda n: F.ceil(2 * F.col(n) / PIECE)
    part = F.pmod(F.xxhash64("root"), parts("__all"))
    rows = spread.join(totals, "prefix", "left")
    if not totals.isEmpty():
        crowds = spread.join(totals, "prefix").groupBy("prefix", "root").agg(F.count("*").alias("__own")).where(F.col("__own") > PIECE // 2)
        rows = rows.join(cut(crowds, "crowds"), ["prefix", "root"], "left")
        part = F.when(F.col("__own").isNotNull(), F.xxhash64("root", F.pmod(F.xxhash64("node"), parts("__own")))).otherwise(part)
    rows = rows.select("prefix", F.coalesce(part, F.lit(0)).alias("part"), "root", F.struct("node", "root", "bits").alias("held"))
    pieces = cut(rows.groupBy("prefix", "part").agg(F.collect_list("held").alias("held"), F.min("root").alias("root"), (F.min("root") == F.max("root")).alias("one")), "pieces")
    free(spread.sparkSession)
    return pieces


def _meetings(pieces: DataFrame, first: bool) -> DataFrame:
    """``prefix``, ``held`` and ``other`` (null: itself) of the pieces to compare: all that may hold two groups, or with
    ``first`` each piece and the first of its prefix."""
    alone = pieces.where("not one").select("prefix", "held", F.lit(None).cast(pieces.schema["held"].dataType).alias("other"))
    many = cut(pieces.groupBy("prefix").agg(F.count("*").alias("__n"), F.min("part").alias("__first")).where("__n > 1"), "split")
    if many.isEmpty():
        return alone
    left = pieces.join(many, "prefix")
    right = left.select("prefix", F.col("part").alias("p2"), F.col("held").alias("other"), F.col("root").alias("r2"), F.col("one").alias("o2"))
    met = left.join(right, "prefix").where("part < p2 and not (one and o2 and root = r2)")
    return alone.unionByName((met.where("part = __first") if first else met).select("prefix", "held", "other"))


def _columns(lists: pa.ListArray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each list begins and ends, and the nodes, roots and bits of all."""
    flat = lists.flatten()
    bits = flat.field("bits").cast(pa.binary(8 * words))
    raw = np.frombuffer(bits.buffers()[1], np.uint64).reshape(-1, words)[bits.offset : bits.offset + len(bits)] if len(bits) else np.zeros((0, words), np.uint64)
    sizes = np.array(lists.value_lengths().fill_null(0))
    return np.concatenate([[0], np.cumsum(sizes)]), flat.field("node").to_numpy(), flat.field("root").to_numpy(), raw


def _close(kind: str, places: np.ndarray):
    """Pairs (a > b) of nodes of different roots within the budget: of each node the ``closest``, the closest of
    ``each`` root, or ``all``. A pair is given by the first trie only in which its nodes share a prefix: in that one it was
    compared, or something closer was given, or the prefix is in pieces, of which the last round compares all."""
    words = PART if kind == "closest" else WORDS
    first, every = _budget(64), _budget(64 * words)

    def closest(root: np.ndarray, to: np.ndarray, by: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Of each ``to`` the closest, of each root with ``each``."""
        group = root[by] if kind == "each" else np.zeros(len(by), np.int64)
        order = np.lexsort((far, group, to))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (to[order][1:] != to[order][:-1]) | (group[order][1:] != group[order][:-1])
        return np.stack((to, by, far))[:, order[fresh]]

    def given(node: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray, before: int) -> Iterator[pa.RecordBatch]:
        """The pairs that share no prefix in the tries before this one, once each."""
        differ = np.unpackbits((bits[i, :PART] ^ bits[j, :PART]).view(np.uint8), axis=1)
        fresh = np.ones(len(i), bool)
        for at in places[:before]:
            fresh &= differ[:, at].any(1)
        pairs = np.unique(np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j])], 1)[fresh], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def portions(found, ra: np.ndarray, rb: np.ndarray):
        """The pairs of different roots, some at a time."""
        for i, j in found:
            apart = ra[i] != rb[j]
            i, j = i[apart], j[apart]
            for at in range(0, len(i), _HELD):
                yield i[at : at + _HELD], j[at : at + _HELD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nth = batch.column(0).to_numpy() % len(places)
            (la, *left), (ra, *right) = _columns(batch.column(1), words), _columns(batch.column(2), words)
            for k in range(batch.num_rows):
                mine, other = slice(la[k], la[k + 1]), slice(ra[k], ra[k + 1])
                same = ra[k] == ra[k + 1]
                node, root, bits = (np.concatenate([x[mine], y[other]]) for x, y in zip(left, right, strict=True))
                a = np.argsort(bits[: la[k + 1] - la[k], 0])
                b = a if same else len(a) + np.argsort(bits[len(a) :, 0])
                found = []
                for i, j in portions(close_pairs(bits[a, 0], bits[b, 0], 0, 0, first, same, FEW), root[a], root[b]):
                    i, j = a[i], b[j]
                    far = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
                    i, j, far = (x[far <= every] for x in (i, j, far))
                    if kind == "all":
                        yield from given(node, bits, i, j, nth[k])
                    else:
                        found.append(closest(root, *(np.concatenate(x) for x in ((i, j), (j, i), (far, far)))))
                if found:
                    i, j, _ = closest(root, *np.concatenate(found, axis=1))
                    for at in range(0, len(i), _HELD):
                        yield from given(node, bits, i[at : at + _HELD], j[at : at + _HELD], nth[k])

    return run


def _verify(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets: dict[int, np.ndarray] = {}

    def held(node: int, text: str | None) -> np.ndarray:
        if node not in sets:
            sets[node] = shingles(text)
        return sets[node]

    a, b, left, right = (column.to_pylist() for column in batch.columns)
    near = [similarity(held(i, x), held(j, y)) >= SIMILARITY for i, j, x, y in zip(a, b, left, right, strict=True)]
    return batch.filter(pa.array(near, pa.bool_())).select([0, 1])


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()


def _links(pairs: DataFrame, marked: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) that are similar; ``docs`` has ``__row`` and ``__text``."""
    rows = marked.join(_nodes_of(pairs), "node").groupBy("node").agg(F.min("row").alias("__row"))
    texts = cut(docs.join(rows, "__row").select("node", "__text").dropDuplicates(["node"]), "texts")
    side = lambda node, text: texts.select(F.col("node").alias(node), F.col("__text").alias(text))
    met = pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right")
    return cut(map_arrow(met, "a long, b long", _verify), "links")


def groups(marked: DataFrame, docs: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node that has a similar one."""
    spark = marked.sparkSession
    nodes = cut(marked.groupBy("node").agg(F.first("bits").alias("bits")), "nodes")
    places = _places(*tries(nodes.count()))
    spread = cut(map_arrow(nodes, "prefix long, node long, bits binary", _prefixes(places)), "prefixes")
    linked = tried = None
    for kind in ("closest", "each", "all"):
        pieces = _pieces(spread.withColumn("root", F.col("node")) if linked is None else spread.join(components(linked), "node", "left").withColumn("root", F.coalesce("root", "node")))
        pairs = _meetings(pieces, kind == "closest").mapInArrow(_close(kind, places), "a long, b long").distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "candidates")
        if tried is None:
            # A node that is close to no other, in whole prefixes, is so in all rounds.
            active = _nodes_of(pairs).unionByName(pieces.join(pieces.groupBy("prefix").count().where("count > 1"), "prefix").select(F.explode("held.node").alias("node")))
            whole = cut(nodes.join(active.distinct(), "node", "left_semi"), "active")
            before, spread = spread, cut(spread.select("prefix", "node").join(whole, "node"), "prefixes")
            discard(before, nodes, whole)
        free(spark, pieces)
        links = _links(pairs, marked, docs)
        linked = links if linked is None else linked.unionByName(links)
        tried = pairs if tried is None else tried.unionByName(pairs)
        free(spark)
    return components(linked)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, whole: that of the smallest identifier, nulls last. Rows alike in all columns are one."""
    row, kind = F.xxhash64(*(F.col(c) for c in docs.columns)), docs.schema[key].dataType.simpleString()
    marked = cut(map_arrow(docs.select(F.col(text), F.col(key), row), f"id {kind}, row long, node long, bits binary", _marks), "marks")
    named = cut(groups(marked, docs.select(row.alias("__row"), F.col(text).alias("__text"))), "groups")
    of = marked.join(named, "node", "left").select("id", "row", F.coalesce("root", "node").alias("root"))
    own = spare(docs, "__row")
    chosen = of.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select(F.col("first.row").alias(own)).distinct()
    return docs.withColumn(own, row).join(chosen, own, "left_semi").dropDuplicates([own, key]).drop(own)
