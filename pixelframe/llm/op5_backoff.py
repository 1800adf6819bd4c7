"""Operator 5: language-model scores by stupid backoff, each row under the model of all others.

A row's own words are no evidence for it, so its n-grams are counted out: an n-gram that only this row holds is unknown to
the model. A word scores ln(c(gram) / c(gram without its last word)) for the longest known n-gram (of up to ``order`` words)
that ends in it, plus ln(``backoff``) for each order given up, c being what all other rows hold; a single word scores
ln(c(word) / words of all other rows), and an unknown one as if it stood there once. Scores are whole millionths of a nat, so
sums do not depend on their order.

Texts are tokenised once, into blocks of a few MB of text: their words as numbers into a list of the block's different words.
Then, order by order, a block's n-grams are exploded as hashes, each once with its number in the block, in lists by ranges of
the hashes (buckets). A shuffle by bucket brings the lists of all blocks together, and each is answered by a list that has, in
the same order, what the whole corpus holds; what one order leaves behind is dropped before the next begins. Answers meet their
block again by its number, and there the row's own n-grams are counted out. So a block sends a frequent gram once, whatever its
number of places, and a count needs no key to find its n-gram again. Nothing is broadcast or collected but the number of all
words, by which the number of buckets grows, so that a task holds a bucket of bounded size.

Words and n-grams are told apart by 64-bit hashes, which are not verified: among 10 ** 9 different ones some 0.03 pairs are
expected to share a hash, among 10 ** 12 some 27,000.

Words are runs of anything but ASCII white space, A-Z in lower case.

Cases: null and empty texts have no words and no score (null); repeated rows are evidence for each other and each get a row;
a null key is allowed; other columns are ignored, whatever their names; an empty table gives an empty result; a corpus of one
row knows nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, discard, free, shuffles_dropped, small_batches, table

ORDER, BACKOFF = 3, 0.4
_MICRO = 1_000_000
#: An order is taken whole, in one slice of its hashes (nothing but a test of the order of steps reads this).
SLICES = 1
#: Slices of the blocks in the last step: the same at every size.
BLOCK_SLICES = 2
#: Bytes of text in a block (a row counts as 64 more, so there are 65,536 at most), where no single text is longer.
BLOCK_BYTES, ROW_BYTES = 4 << 20, 64
#: Places of n-grams for which there is a bucket, and the fewest buckets.
BUCKET_WORDS, LEAST_BUCKETS = 1 << 21, 64
#: Rows of blocks and of answers that Parquet files hold, and readers take, together: their lists are long.
_FEW, _SOME = ({"parquet.block.row.count.limit": str(rows)} for rows in (4, 128))
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _bytes(words: pa.StringArray) -> list[bytes]:
    """What to_pylist() of binary values gives, in a tenth of its time."""
    _, offsets, data = words.buffers()
    if not len(words) or data is None:
        return [b""] * len(words)
    ends, data = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a new value begins, in any of the arrays."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[:1] = True
    for values in sorted_by:
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _lists(values: np.ndarray | pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values) if isinstance(values, np.ndarray) else values)


def _flat(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy()


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; hashes of the different words; and each word's place among those."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten().dictionary_encode()
    names, codes = _bytes(words.dictionary), words.indices.to_numpy()
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, names)), ">u8").astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    if b"" in names:  # before or after white space
        there = codes != names.index(b"")
        row, codes = row[there], codes[there]
    return np.bincount(row, minlength=len(texts)).astype(np.int32), hashes, codes.astype(np.int32)


def blocks(docs: DataFrame) -> DataFrame:
    """``block, n_words, keys, sizes, names, codes`` of rows of a key and a text, in the order in which they are read."""
    kind = docs.schema[0].dataType.simpleString()

    def pack(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, texts = (pa.concat_arrays([batch.column(k) for batch in held]) for k in (0, 1))
        sizes, names, codes = _tokens(texts)
        lists = [_lists(values, np.array([0, len(values)])) for values in (keys, sizes, names.view(np.int64), codes)]
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(codes)]), *lists], ["block", "n_words", "keys", "sizes", "names", "codes"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, begun, now, held = TaskContext.get().partitionId() << 33, 0, 0, []
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + ROW_BYTES
            of = (begun + np.cumsum(size) - size) // BLOCK_BYTES
            begun += int(size.sum())
            starts = _runs(of).tolist()
            for start, end in zip(starts, [*starts[1:], len(of)]):
                if held and of[start] != now:
                    yield pack(first + now, held)
                    held = []
                now = int(of[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield pack(first + now, held)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(gather, f"block long, n_words long, keys array<{kind}>, sizes array<int>, names array<long>, codes array<int>")


class Grams:
    """The n-grams of a block: ``row`` and ``place`` of each word, and by order the hash of the n-gram that ends there."""

    def __init__(self, sizes: np.ndarray, names: np.ndarray, codes: np.ndarray, order: int) -> None:
        self.sizes = sizes.astype(np.int64)
        self.row = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) <= 1 << 16 else np.int64), sizes)
        self.place = np.arange(len(codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, sizes)
        first = names.view(np.uint64)[codes]
        self.hashes = [first]
        for n in range(1, order):
            longer = np.zeros_like(first)
            longer[1:] = self.hashes[-1][:-1] * _STEPS[0] + first[1:] * _STEPS[1] + np.uint64(n)
            longer = (longer ^ (longer >> np.uint64(31))) * _STEPS[2]
            self.hashes.append(longer ^ (longer >> np.uint64(29)))

    def sorted(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that an n-gram ends in, by its hash; the hashes; and where each different one begins."""
        at = np.flatnonzero(self.place >= n - 1)
        gram = self.hashes[n - 1][at]
        by = np.argsort(gram)
        gram = gram[by]
        return at[by], gram, _runs(gram)

    def others(self, n: int, totals: np.ndarray) -> np.ndarray:
        """By word, what other rows hold of the n-gram that ends there; ``totals`` has what all rows hold, by hash."""
        at, gram, starts = self.sorted(n)
        if len(totals) != len(starts):
            raise ValueError(f"{len(totals)} answers for {len(starts)} n-grams")
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(gram))))
        by = np.argsort(self.row[at], kind="stable")
        at, of = at[by], of[by]
        own = np.diff(np.append(_runs(self.row[at], of), len(of)))
        out = np.zeros(len(self.row), np.int64)
        out[at] = totals[of] - np.repeat(own, own)
        return out


def exploded(read: DataFrame, n: int, buckets: int) -> DataFrame:
    """``bucket, block, grams, counts`` of the n-grams of blocks: each once for a block, by hash, with its number in it."""
    shift = np.uint64(65 - buckets.bit_length())

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, names, codes = (batch.column(c)[k].values.to_numpy() for c in (1, 2, 3))
                _, gram, starts = Grams(sizes, names, codes, n).sorted(n)
                counts, gram = np.diff(np.append(starts, len(gram))).astype(np.int32), gram[starts]
                bucket = (gram >> shift).astype(np.int32)
                firsts = _runs(bucket)
                ends = np.append(firsts, len(gram))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[firsts]), pa.repeat(batch.column(0)[k], len(firsts)), _lists(gram.view(np.int64), ends), _lists(counts, ends),
                ], ["bucket", "block", "grams", "counts"])

    return read.select("block", "sizes", "names", "codes").mapInArrow(explode, "bucket int, block long, grams array<long>, counts array<int>")


def _answer(lists: pa.Table) -> pa.Table:
    """For the lists of one bucket, as many lists of what all blocks hold together."""
    gram, counts = _flat(lists["grams"]), _flat(lists["counts"])
    by = np.argsort(gram)
    starts = _runs(gram[by])
    sums = np.add.reduceat(counts[by], starts, dtype=np.int64)
    totals = np.empty(len(gram), np.int64)
    totals[by] = np.repeat(sums, np.diff(np.append(starts, len(gram))))
    ends = np.append(0, np.cumsum(pc.list_value_length(lists["grams"]).to_numpy()))
    return pa.table([lists["block"], lists["bucket"], _lists(totals, ends)], ["block", "bucket", "totals"])


def known(docs: DataFrame, order: int) -> tuple[DataFrame, list[DataFrame], int]:
    """The blocks of rows of a key and a text; by order ``block, bucket, totals, n``: what all rows hold of a block's n-grams;
    and the number of all words."""
    spark, out = docs.sparkSession, []
    read = cut(blocks(docs), "blocks", _FEW)
    free(spark)  # what earlier queries and the reading of ``docs`` left, before the large shuffles
    words = read.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, 1 << (words // BUCKET_WORDS).bit_length())
    for n in range(1, order + 1):
        lists = exploded(read, n, buckets)
        totals = lists.groupBy("bucket").applyInArrow(_answer, "block long, bucket int, totals array<long>")
        with shuffles_dropped(spark):
            out.append(cut(totals.withColumn("n", F.lit(n)), "totals", _SOME))
        free(spark)
    return read, out, words


def _micro(ratio: np.ndarray) -> np.ndarray:
    return np.floor(np.log(ratio) * _MICRO + 0.5).astype(np.int64)


def micros(grams: Grams, totals: list[np.ndarray], words: int, lost: int) -> np.ndarray:
    """Score of each row of a block in millionths of a nat. ``totals`` has by order what all rows hold, of all ``words``."""
    order = len(totals)
    others = (words - grams.sizes)[grams.row]
    longest = np.minimum(grams.place + 1, order)
    # From the shortest to the longest: what is known last stands.
    total, steps, before = _micro(1 / (words - grams.sizes + 1))[grams.row], longest.copy(), others
    for n in range(1, order + 1):
        counts = grams.others(n, totals[n - 1])
        at = np.flatnonzero(counts)
        total[at], steps[at] = _micro(counts[at] / before[at - 1 if n > 1 else at]), longest[at] - n
        before = counts
    ends = np.cumsum(grams.sizes)
    sums = np.append(0, np.cumsum(total + lost * steps))
    return sums[ends] - sums[ends - grams.sizes]


def _scorer(order: int, words: int, lost: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block and the answers to it, the list of the scores of its texts."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, names, codes = (_flat(block[name]) for name in ("sizes", "names", "codes"))
        answers = answers.sort_by("bucket")
        totals = [_flat(answers.filter(pc.equal(answers["n"], n))["totals"]) for n in range(1, order + 1)]
        micro = micros(Grams(sizes, names, codes, order), totals, words, lost)
        return pa.table([block["block"], _lists(micro, np.array([0, len(micro)]))], ["block", "micro"])

    return run


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, micro, score`` of every row under the model of all others: the sum in millionths of a nat, and its
    mean for a word in nats."""
    if order < 1 or not 0 < backoff <= 1:
        raise ValueError("the order must be positive, and backoff above 0 and at most 1")
    lost, spark = math.floor(math.log(backoff) * _MICRO + 0.5), docs.sparkSession
    out = None
    read, found, words = known(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), order)
    answers = found[0]
    for totals in found[1:]:
        answers = answers.unionByName(totals)
    for part in range(BLOCK_SLICES):
        left, right = (df.where(F.pmod(F.xxhash64("block"), F.lit(BLOCK_SLICES)) == part) for df in (read, answers))
        both = left.select("block", "sizes", "names", "codes").groupBy("block").cogroup(right.groupBy("block"))
        micro = both.applyInArrow(_scorer(order, words, lost), "block long, micro array<long>")
        # Keys stay out of the groups: what a grouped function returns must have its types to the letter.
        rows = left.select("block", "keys", "sizes").join(micro, "block").select(F.inline(F.arrays_zip("keys", "sizes", "micro")))
        with shuffles_dropped(spark):
            scored = cut(rows.select(F.col("keys").alias("doc_id"), F.col("sizes").cast("long").alias("n_words"), "micro"), "scored")
        free(spark)
        out = scored if out is None else out.unionByName(scored)
    discard(read, *found)
    return out.withColumn("score", F.when(F.col("n_words") > 0, F.col("micro") / _MICRO / F.col("n_words")))


def op5_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document under the model of all n-grams of all others."""
    return score(table(spark, sf_dir, "documents"))


def _oracle(order: int = ORDER, backoff: float = BACKOFF) -> str:
    """The recursion as it stands, word by word."""
    lost = math.floor(math.log(backoff) * _MICRO + 0.5)
    micro = lambda x: f"floor(ln({x}) * {_MICRO} + 0.5)::BIGINT"
    w = "string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')"
    gram = lambda n: "concat_ws(' ', " + ", ".join(f"w{k}" for k in range(n - 1, -1, -1)) + ")"
    lags = "".join(f", lag(x, {k}) OVER (PARTITION BY r ORDER BY i) AS w{k}" for k in range(1, order))
    orders = range(1, order + 1)
    grams = ", ".join(f"c{n} AS (SELECT g, count(*) AS c FROM (SELECT {gram(n)} AS g FROM p WHERE i >= {n}) GROUP BY 1), o{n} AS (SELECT r, g, count(*) AS o FROM (SELECT r, {gram(n)} AS g FROM p WHERE i >= {n}) GROUP BY 1, 2)" for n in orders)
    left = ", ".join(f"c{n}.c - o{n}.o AS k{n}" for n in orders)
    joins = " ".join(f"LEFT JOIN c{n} ON p.i >= {n} AND c{n}.g = {gram(n)} LEFT JOIN o{n} ON p.i >= {n} AND o{n}.r = p.r AND o{n}.g = {gram(n)}" for n in orders)
    before = "".join(f", lag(k{n - 1}) OVER (PARTITION BY r ORDER BY i) AS b{n}" for n in range(2, order + 1))
    cases = " ".join(f"WHEN k{n} > 0 THEN {micro(f'k{n} / b{n}')} + {lost} * (least(i, {order}) - {n})" for n in range(order, 1, -1))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter({w}, lambda x: x <> '') AS w FROM documents),
u AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS (SELECT r, i, x AS w0{lags} FROM u),
{grams},
k AS (SELECT p.r, p.i, {left} FROM p {joins}),
q AS (SELECT k.*{before}, (SELECT count(*) FROM p) - len(d.w) AS others FROM k JOIN d USING (r)),
s AS (SELECT r, sum(CASE {cases} WHEN k1 > 0 THEN {micro('k1 / others')} + {lost} * (least(i, {order}) - 1) ELSE {micro('1 / (others + 1)')} + {lost} * least(i, {order}) END)::BIGINT AS micro FROM q GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(micro, 0)::BIGINT AS micro, CASE WHEN len(w) > 0 THEN micro::DOUBLE / {_MICRO} / len(w) END AS score
FROM d LEFT JOIN s USING (r)
"""


ORACLE = _oracle()
