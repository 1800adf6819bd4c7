"""Operator 3: benchmark decontamination.

Every window of n consecutive words of a benchmark item is hashed; the set of hashes is broadcast, and tasks slide
windows of the same lengths over the words of each document. A hash that is found is verified word by word. Words
in verified windows are hits, from which spans or whole documents are removed.

The set is broadcast only up to ``broadcast_limit`` windows (its size is counted first). A larger benchmark is met
by joining the windows of documents and items on their hash instead, aggregated to (document, window) before.

Cases: null and empty texts have no words; an item without words has no window and never occurs; items with equal
windows all count; an item without an identifier hits words but is not among the items; repeated documents each get a
row; other columns are ignored, whatever their names; without items nothing is hit; without documents the result is empty.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import map_arrow, table

WINDOW = 13
#: Windows of the benchmark in a broadcast: at some 500 bytes each, 200 MB in a task at most.
BROADCAST_LIMIT = 400_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


class WindowSet:
    """The windows of a benchmark: word numbers, window hashes by length, and the items that hold each window."""

    def __init__(self, items: list[tuple[int, str | None]], window: int) -> None:
        self.number: dict[str, int] = {}
        self.items: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.number.setdefault(word, len(self.number) + 1) for word in words_of(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                self.items.setdefault(tuple(ids[at : at + size]), set()).add(item)
        lengths = sorted({len(key) for key in self.items})
        self.hashes = {size: np.unique(_hashes(list(np.array([k for k in self.items if len(k) == size], np.uint64).T))) for size in lengths}

    def scan(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray, set[int]]]:
        """For each text its words, which of them are hit, and the items with windows in it."""
        number, words = self.number.get, [words_of(text) for text in texts]
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])  # a gap of one keeps windows inside their text
        flat = np.zeros(starts[-1], np.uint64)
        for at, w in zip(starts, words, strict=False):
            flat[at : at + len(w)] = [number(x, 0) for x in w]
        hit, found = np.zeros(len(flat) + 1, np.int64), [set() for _ in texts]
        for size, hashes in self.hashes.items():
            if len(flat) < size:
                continue
            known = np.concatenate([[0], np.cumsum(flat == 0)])
            here = np.flatnonzero(known[size:] == known[:-size])  # windows of known words only
            if not len(here):
                continue
            value = _hashes([flat[here + k] for k in range(size)])
            place = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            for at in here[hashes[place] == value]:
                if items := self.items.get(tuple(flat[at : at + size].tolist())):
                    hit[at] += 1
                    hit[at + size] -= 1
                    found[int(np.searchsorted(starts, at, "right")) - 1] |= items - {None}
        hit = np.cumsum(hit)[:-1] > 0
        return [(w, hit[at : at + len(w)], items) for at, w, items in zip(starts, words, found, strict=False)]


def _hashes(columns: list[np.ndarray]) -> np.ndarray:
    """Polynomial hashes of windows: column k has the k-th word of each."""
    total = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        total = total * _STEP + column
    return total


def _keep(words: np.ndarray, text: str | None) -> str | None:
    """The text without the stretches from the first to the last byte of neighbouring hit words."""
    if text is None or not words.any():
        return text
    out, at, spans = [], 0, [m.span() for m in WORD.finditer(text.translate(LOWER))]
    for k, (begin, end) in enumerate(spans):
        if words[k]:
            if not (k and words[k - 1]):
                out.append(text[at:begin])
            at = end
    return "".join([*out, text[at:]])


def scan(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: int = 20, broadcast_limit: int = BROADCAST_LIMIT, cleaned: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """A row for each document: its key, n_words, n_hit, n_items, items_sha256, contaminated, with ``cleaned`` its
    text without the hit spans, and ``carried``, a struct of the columns to ``carry``. It is contaminated if hit
    words are at least one in ``share``."""
    benchmark = items.select(F.col(item).alias("item"), F.col(item_text).alias("said"))
    size = benchmark.select(F.sum(F.size(F.split(F.coalesce("said", F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    if size > broadcast_limit:
        return _joined(docs, benchmark, window, share, cleaned)
    windows = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(row) for row in benchmark.collect()], window))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        rows = windows.value.scan(texts)
        n_words, n_hit = [len(w) for w, _, _ in rows], [int(hit.sum()) for _, hit, _ in rows]
        digest = [_digest(found) for _, _, found in rows]
        out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for _, _, x in rows], pa.int64()), pa.array(digest), pa.array([h > 0 and share * h >= n for h, n in zip(n_hit, n_words, strict=True)])]
        if cleaned:
            out.append(pa.array([_keep(hit, t) for (_, hit, _), t in zip(rows, texts, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays([*out, *batch.columns[2:]], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *["cleaned"] * cleaned, *batch.schema.names[2:]])

    return map_arrow(docs, _SCHEMA + ", cleaned string" * cleaned + _carried(docs), work)


_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _carried(docs: DataFrame) -> str:
    return f", carried {docs.schema['carried'].dataType.simpleString()}" if "carried" in docs.columns else ""


def _digest(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _joined(docs: DataFrame, items: DataFrame, window: int, share: int, cleaned: bool) -> DataFrame:
    """The same for a benchmark of any size: windows meet in a shuffle, keyed by their own words."""
    words = lambda c: F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({WORD.pattern})"), F.lit(1))
    held_in = lambda at, size: F.slice("words", at + 1, size)
    # Two hashes of 64 bits: they stand for the words in the shuffle.
    key = lambda at, size: [F.xxhash64(held_in(at, size)).alias("window"), F.xxhash64(F.lit(1), size, held_in(at, size)).alias("check")]
    items = items.select("item", words("said").alias("words")).where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(window)))
    items = items.select("item", "size", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at")).select("item", "size", *key(F.col("at"), F.col("size"))).distinct()
    # A document key need not be unique: the row gets a number of its own, from what it holds.
    own = ["row", "tag"]
    docs = docs.withColumns({"row": F.xxhash64("doc_id", "text"), "tag": F.xxhash64("text", "doc_id"), "words": words("text")})
    lengths = [row[0] for row in items.select("size").distinct().collect()]  # at most as many as a window has words
    unique = docs.dropDuplicates(own)
    at = unique.select(*own, "words", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("size")).where(F.size("words") >= F.col("size"))
    at = at.select(*own, "words", "size", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("at")).select(*own, "size", "at", *key(F.col("at"), F.col("size")))
    same = ["window", "check", "size"]
    hits = at.join(items.select(*same).distinct(), same, "left_semi")
    marked = hits.select(*own, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("word")).distinct().groupBy(*own).agg(F.count("*").alias("n_hit"), F.collect_list("word").alias("hit"))
    held = hits.select(*own, *same).distinct().join(items.where("item is not null"), same).select(*own, "item").distinct()
    held = held.groupBy(*own).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ","), 256).alias("items_sha256"))
    out = docs.join(marked, own, "left").join(held, own, "left").withColumn("n_words", F.size("words").cast("long")).withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
    columns = ["doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.lit(_digest(set()))).alias("items_sha256"), "contaminated"]
    carried = ["carried"] if "carried" in docs.columns else []
    if not cleaned:
        return out.select(*columns, *carried)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for text, hit, n in zip(*(batch.column(name).to_pylist() for name in ("text", "hit", "n_words")), strict=True):
            mask = np.zeros(n, bool)
            mask[hit or []] = True
            kept.append(_keep(mask, text))
        names = [name for name in batch.schema.names if name not in ("text", "hit", "carried")]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(kept, pa.string()), *(batch.column(n) for n in carried)], [*names, "cleaned", *carried])

    return map_arrow(out.select(*columns, "text", "hit", *carried), _SCHEMA + ", cleaned string" + _carried(docs), work)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[k : k + least(13, len(w)) - 1] AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, w[k : k + n - 1] AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, n, k, g FROM dw WHERE (n, g) IN (SELECT n, g FROM iw)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h JOIN iw USING (n, g)) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
