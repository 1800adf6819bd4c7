"""Operator 2: exact top-k search by inner product, with a KD-tree in each shard.

Space is cut into cells by median splits along the widest side, found from a bounded sample of the vectors; every vector is
then put into its cell, and a cell that holds more than a shard may is dealt to several shards by a hash. The sample
decides how even the cells are, never what is found. A shard's tree splits at medians in the same way, and each node has a
tight bounding box, from which follows the most that a query can score below it. A tree is built once and written as one
row of arrays.

A query walks a tree best first and leaves out nodes that can't reach its kth score. It starts in the shard where its
own vector lies, its home, to which it alone is sent; the kth score found there goes with it to all others. Queries then
come to the shards in broadcast blocks of ``BLOCK_BYTES`` at most, neighbours together: shards of a cell whose box no
query of the block can gain from are not read, and a tree whose own box holds nothing for a query is not walked. Ties go
to the smaller identifier, so a cell, tree or node is left out only if it scores less.

Equal vectors score alike: a vector keeps its k + 1 smallest identifiers (one may be the query's own), so copies
are stored once and lose nothing. Queries of one home come to it in portions of at most some ``SHARD``, so that many equal
ones are no burden to a task.

Cases: null vectors and those that hold null or non-finite components take no part, nor do rows without an
identifier; repeated rows count once; different vectors of one identifier are each a candidate, and as queries share one
list of results, in which neither stands; a component or a score that does not fit 64 bits is an error that says so; shorter
vectors count as ending in zeros; with fewer than k candidates all are returned; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, discard, new_folder, table

K = 5
#: Distinct vectors in a shard, and bytes of the queries (8 for a component) in a broadcast: what a task holds.
SHARD = 8192
BLOCK_BYTES = 32 << 20
LEAF = 64
#: Bytes of the sample (8 for a component) from which cells are made, vectors of it in a cell, and cells at most.
SAMPLE_BYTES, SAMPLED, CELLS = 32 << 20, 64, 1024
FOUND = "query_id long, vec_id long, score long"
_PLACE = "cell int, shard int"
_TREE = "cell int, shard int, points binary, ids array<array<long>>, nodes binary, boxes binary, low array<long>, high array<long>"


def _most(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The most that each query can score in each box."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _kind(points: np.ndarray, queries: np.ndarray) -> type:
    """The type in which their products are exact: floats while sums stay below 2**53, else Python's numbers."""
    points, queries = (float(np.abs(x.astype(float)).max(initial=0)) * n for x, n in ((points, points.shape[1]), (queries, 1)))
    return np.float64 if points * queries < 2**53 else object


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """A row for each vector, ended with zeros or cut off at ``width``."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out, row = np.zeros((len(vectors), width), np.int64), np.repeat(np.arange(len(vectors)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = place < width
    out[row[kept], place[kept]] = vectors.flatten().to_numpy(zero_copy_only=False)[kept]
    return out


class Tree:
    """A KD-tree over rows in its own order. A node has its rows (begin, end), its first child (0: a leaf) and its box."""

    def __init__(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray, child: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.points, self.begin, self.end, self.child, self.low, self.high = points, begin, end, child, low, high

    @classmethod
    def built(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree, and the order in which it holds the points."""
        order = np.arange(len(points))
        nodes, low, high, todo = [[0, len(points), 0]], [None], [None], [0]
        while todo:
            node = todo.pop()
            begin, end, _ = nodes[node]
            rows = order[begin:end]
            low[node], high[node] = points[rows].min(0), points[rows].max(0)
            side = high[node].astype(float) - low[node].astype(float)
            if end - begin <= leaf or not side.any():
                continue
            half = (end - begin) // 2
            order[begin:end] = rows[np.argpartition(points[rows, side.argmax()], half)]
            nodes[node][2] = len(nodes)
            for a, b in ((begin, begin + half), (begin + half, end)):
                todo.append(len(nodes))
                nodes.append([a, b, 0])
                low.append(None)
                high.append(None)
        return cls(points[order], *np.array(nodes).T, np.array(low), np.array(high)), order

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int, ids: list[list[int]], k: int, kth: int | None) -> list[tuple[int, int]]:
        """The best (score, -identifier) pairs, at most k, of those that score kth or more."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if kth is not None and -most < kth:
                break
            if first := self.child[node]:
                for below in (first, first + 1):
                    if kth is None or bounds[below] >= kth:
                        heapq.heappush(heap, (-bounds[below], below))
                continue
            begin, end = self.begin[node], self.end[node]
            scores = self.points[begin:end] @ query
            for at in np.argsort(-scores, kind="stable"):
                score = int(scores[at])
                if kth is not None and score < kth:
                    break
                for candidate in ids[begin + at]:
                    if candidate == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -candidate))
                    elif (score, -candidate) > best[0]:
                        heapq.heapreplace(best, (score, -candidate))
                if len(best) == k and (kth is None or best[0][0] > kth):
                    kth = best[0][0]
        return best


class Cells:
    """Cells of space: median splits of a sample. ``parts`` and ``first``: how many shards a cell has, and its first one."""

    def __init__(self, sample: np.ndarray, number: int) -> None:
        self.width, self.side, self.value, self.child, self.cell = sample.shape[1], [0], [0], [0], [0]
        todo, leaves = [(0, np.arange(len(sample)), number)], 0
        while todo:  # the lower half first, so neighbouring cells have neighbouring numbers
            node, rows, number = todo.pop()
            held = sample[rows]
            side = held.max(0).astype(float) - held.min(0) if len(held) else np.zeros(1)
            if number < 2 or not side.any():
                self.cell[node], leaves = leaves, leaves + 1
                continue
            at = int(side.argmax())
            value = np.sort(held[:, at])[len(held) // 2]
            if value == held[:, at].min():
                value = held[held[:, at] > value, at].min()
            upper = held[:, at] >= value
            self.side[node], self.value[node], self.child[node] = at, value, len(self.side)
            todo += [(len(self.side) + 1, rows[upper], number // 2), (len(self.side), rows[~upper], number - number // 2)]
            for column in (self.side, self.value, self.child, self.cell):
                column += [0, 0]
        self.side, self.value, self.child, self.cell = (np.array(x, np.int64) for x in (self.side, self.value, self.child, self.cell))
        self.number = leaves
        self.parts, self.first = np.ones(leaves, np.int64), np.arange(leaves)

    def sized(self, counts: dict[int, int], shard: int) -> None:
        self.parts = np.array([max(1, -(-counts.get(cell, 0) // shard)) for cell in range(self.number)], np.int64)
        self.first = np.cumsum(self.parts) - self.parts

    def of(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        while len(rows):
            rows = rows[self.child[node[rows]] > 0]
            at = node[rows]
            node[rows] = self.child[at] + (points[rows, self.side[at]] >= self.value[at])
        return self.cell[node]

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Appends ``cell`` and ``shard`` to rows that begin with ``v`` and its hash."""
        for batch in batches:
            cell = self.of(_matrix(batch.column(0), self.width))
            shard = self.first[cell] + batch.column(1).to_numpy() % self.parts[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(shard.astype(np.int32))], [*batch.schema.names, "cell", "shard"])


def _cut_by(df: DataFrame, name: str, by: str) -> DataFrame:
    """As cut(), with a folder for each value of a column, so that what is not asked for is not read."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plant(width: int, leaf: int):
    """Trees from rows (cell, shard, the vectors, the identifiers of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, order = Tree.built(_matrix(batch.column(2)[row].values, width), leaf)
                ids = batch.column(3)[row].values.take(pa.array(order)).to_pylist()
                arrays = tree.points, np.stack([tree.begin, tree.end, tree.child]), np.stack([tree.low, tree.high])
                points, nodes, boxes = (pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in arrays)
                low, high = (pa.array([x[0]], pa.list_(pa.int64())) for x in (tree.low, tree.high))
                columns = [*batch.select([0, 1]).slice(row, 1).columns, points, pa.array([ids], pa.list_(pa.list_(pa.int64()))), nodes, boxes, low, high]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "shard", "points", "ids", "nodes", "boxes", "low", "high"])

    return run


def _walk(batch: pa.RecordBatch, row: int, width: int, asked: dict[str, np.ndarray], k: int, leave: int | None) -> Iterator[pa.RecordBatch]:
    """What queries (id, v, home, kth, known) of other homes than ``leave`` find in the tree of a row (points, ids, nodes, boxes)."""
    points, nodes, boxes = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in (0, 2, 3))
    points, (low, high) = points.reshape(-1, width), boxes.reshape(2, -1, width)
    kind = _kind(points, asked["v"])
    tree, ids = Tree(points.astype(kind), *nodes.reshape(3, -1), low.astype(kind), high.astype(kind)), None
    for at in range(0, len(asked["id"]), 256):
        part = {name: x[at : at + 256] for name, x in asked.items()}
        queries = part["v"].astype(kind)
        gains = ~part["known"] | (_most(queries, tree.low[:1], tree.high[:1])[:, 0] >= part["kth"]).astype(bool)
        gains &= part["home"] != leave if leave is not None else True
        if not gains.any():
            continue
        if ids is None:
            ids = batch.column(1)[row].as_py()
        queries, part = queries[gains], {name: x[gains] for name, x in part.items()}
        found = [
            (own, -negative, score)
            for own, query, bounds, kth, known in zip(part["id"].tolist(), queries, _most(queries, tree.low, tree.high), part["kth"].tolist(), part["known"], strict=True)
            for score, negative in tree.search(query, bounds, own, ids, k, kth if known else None)
        ]
        if any(not -(1 << 63) <= score < 1 << 63 for _, _, score in found):
            raise ValueError("a score does not fit 64 bits: the vectors need a smaller scale")
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])


def _asked(rows: pa.Table | pa.StructArray, width: int) -> dict[str, np.ndarray]:
    """Arrays of queries (query_id, v, shard, kth)."""
    if isinstance(rows, pa.StructArray):
        rows = pa.Table.from_arrays(rows.flatten(), names=[f.name for f in rows.type])
    key, v, home, kth = (rows.column(name).combine_chunks() for name in ("query_id", "v", "shard", "kth"))
    if isinstance(v, pa.ChunkedArray):  # of no rows
        v = pa.array([], v.type)
    return {"id": key.to_numpy(), "v": _matrix(v, width), "home": home.to_numpy(), "kth": kth.fill_null(0).to_numpy(), "known": kth.is_valid().to_numpy(zero_copy_only=False)}


def _reached(asked: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray) -> list[int]:
    """The cells in whose box some query may still gain."""
    kind, held = _kind(np.concatenate([low, high]), asked["v"]), np.zeros(len(low), bool)
    low, high = low.astype(kind), high.astype(kind)
    for at in range(0, len(asked["id"]), 1024):
        part = {name: x[at : at + 1024] for name, x in asked.items()}
        if not part["known"].all():
            return list(range(len(low)))
        held |= (_most(part["v"].astype(kind), low, high) >= part["kth"][:, None]).astype(bool).any(0)
    return np.flatnonzero(held).tolist()


def _blocks(counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """For each cell its first block and the number of its blocks: small cells share one, large ones have several."""
    out, block, full = [], 0, 0
    for cell, count in sorted(counts.items()):
        if full and full + count > most:
            block, full = block + 1, 0
        number = -(-count // most)
        out.append((cell, block, number))
        block, full = (block + number, 0) if number > 1 else (block, full + count)
    return out


def top_k(
    vectors: DataFrame, asked: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
    shard: int = SHARD, block_bytes: int = BLOCK_BYTES, leaf: int = LEAF, most_cells: int = CELLS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows for each row for which ``asked`` (of vec_id) holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    fits = F.forall("v", lambda x: F.abs(x * scale) < F.lit(2.0**63))
    whole = F.transform("v", lambda x: F.floor(x * scale))
    rows = rows.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit("a component does not fit 64 bits: the vectors need a smaller scale"))).alias("v"))
    ranked = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    held = cut(ranked.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "vectors")
    n, width = held.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)

    number = 1
    while number * shard < n and number < min(most_cells, SAMPLE_BYTES // (16 * width)):
        number *= 2
    share = min(1.0, min(number * SAMPLED, SAMPLE_BYTES // (8 * width)) / max(1, n))
    hashed = F.pmod(F.xxhash64("v"), F.lit(1 << 40)).alias("hash")
    sample = held.where(hashed < int(share * (1 << 40))).select("v").toArrow().column(0).combine_chunks() if number > 1 else None
    cells = Cells(np.zeros((0, width), np.int64) if sample is None else _matrix(sample, width), number)
    placed = f"v array<long>, hash long, ids array<long>, {_PLACE}"
    put = lambda: held.select("v", hashed, "ids").mapInArrow(cells.place, placed)
    cells.sized({0: n} if cells.number == 1 else {r.cell: r["count"] for r in put().groupBy("cell").count().collect()}, shard)
    grown = put().groupBy("cell", "shard").agg(F.collect_list(F.struct("v", "ids")).alias("held")).select("cell", "shard", "held.v", "held.ids").mapInArrow(_plant(width, leaf), _TREE)
    trees = _cut_by(grown, "shards", "cell")
    discard(held)

    queries = rows.where(asked).select("v", hashed, F.col("vec_id").alias("query_id")).distinct().mapInArrow(cells.place, f"v array<long>, hash long, query_id long, {_PLACE}")
    queries = cut(queries.select("query_id", "v", "cell", "shard"), "queries")
    portions = queries.groupBy("shard").agg(F.ceil(F.count("*") / shard).alias("portions"))
    one = F.struct("query_id", "v", "shard", F.lit(None).cast("long").alias("kth"))
    homes = queries.join(portions, "shard").groupBy("shard", F.pmod(F.xxhash64("query_id"), "portions").alias("portion")).agg(F.collect_list(one).alias("asked"))
    asked_trees = trees.join(portions, "shard").withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)))

    def visit_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _walk(batch, row, width, _asked(batch.column(4)[row].values, width), k, None)

    found = cut(asked_trees.join(homes, ["shard", "portion"]).select("points", "ids", "nodes", "boxes", "asked").mapInArrow(visit_home, FOUND), "found")
    if int(cells.parts.sum()) > 1:
        boxes = trees.select("cell", F.posexplode(F.arrays_zip("low", "high"))).groupBy("cell", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
        low, high = np.zeros((2, cells.number, width), np.int64)
        for r in boxes.toLocalIterator():
            low[r.cell, r.pos], high[r.cell, r.pos] = r.low, r.high
        reached = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).drop("n")
        many = queries.groupBy("cell").count().collect()
        plan = _blocks({r.cell: r["count"] for r in many}, max(1, block_bytes // (8 * width)))
        planned = queries.join(F.broadcast(spark.createDataFrame(plan, "cell int, first long, number long")), "cell").join(reached, "query_id", "left")
        block = (F.col("first") + F.pmod(F.xxhash64("query_id"), "number")).alias("block")
        onward = _cut_by(planned.select("query_id", "v", "shard", "kth", block).repartition("block"), "onward", "block")
        for nth in range(max((first + number for _, first, number in plan), default=0)):
            block = _asked(onward.where(F.col("block") == nth).select("query_id", "v", "shard", "kth").toArrow(), width)
            near, sent = _reached(block, low, high), spark.sparkContext.broadcast(block)

            def visit(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in range(batch.num_rows):
                        yield from _walk(batch, row, width, sent.value, k, batch.column(4)[row].as_py())

            met = trees.where(F.col("cell").isin(near)).select("points", "ids", "nodes", "boxes", "shard")
            found = found.unionByName(cut(met.mapInArrow(visit, FOUND), "found"))
            sent.unpersist()
        discard(onward)
    discard(trees, queries)
    # Two vectors of one identifier may find the same row: it stands once for each score, the best first.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
