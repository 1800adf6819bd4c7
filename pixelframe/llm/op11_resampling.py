"""Operator 11: importance resampling towards a target, in DataFrame functions only.

Features of a text are all runs of 1 to ``order`` consecutive words, hashed to ``buckets`` places by crc32. A place's
gain is the thousandfold logarithm of how much likelier it is in the target than in the corpus, whole numbers, so sums
don't depend on their order. A document's weight is the sum of its features' gains; with Gumbel noise that its key alone
decides, the documents of the highest scores are a draw without replacement in proportion to exp(weight / 1000).

The corpus is read twice, for the counts and for the weights; no n-gram is written or shuffled. Words are exploded with
the words before them, their n-grams' places once more; counts are grouped in the task first, then there is a row for
each place and task, and for each document. Gains are a table of ``buckets`` rows, whatever the corpus: that is the proven
bound of the broadcast. Ranks come from ranges of the score whose sizes are counted, so no task sorts all documents.

Words are runs of what is no ASCII sign, A-Z in lower case.

Cases: null and empty texts have no feature and weight 0; rows that are alike in key and text are weighed together, take
places next to each other and come back as often as they were; different texts of one key are ranked apart, by their
hashes if score and key are equal; a null key gets the noise of an empty one and comes last among ties; other columns
are ignored, whatever their names; without a target, or documents, gains are those of counts of nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import cut, table

BUCKETS, ORDER, SEED = 10_000, 3, 42
#: Documents of fewer words are not drawn; of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
#: Copies of one row that are made together from a count of them.
_TOGETHER = 4096
#: What tells rows of documents apart; rows that are alike are one until the end.
_ROW = ["doc_id", "row", "tag"]


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def places(rows: DataFrame, keep: list[str], order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` of every feature of ``words``, with the columns to ``keep``; ``first`` marks one of each word. A row
    without words is one row without a bucket, marked too."""
    # Columns w0, w1, ...: the words from each place on, so that a row has a word and those that follow it.
    lags = [f"w{k}" for k in range(order)]
    ahead = (F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))).alias(lags[k]) for k in range(order))
    said = rows.select(*keep, F.inline_outer(F.arrays_zip(*ahead)))
    runs = [reduce(lambda a, b: F.concat(a, F.lit(" "), b), map(F.col, lags[:n])) for n in range(1, order + 1)]  # null beyond the end
    each = F.array(*((F.crc32(run.cast("binary")) % buckets).cast("int") for run in runs))
    return said.select(*keep, F.posexplode(each).alias("nth", "bucket")).select(*keep, "bucket", (F.col("nth") == 0).alias("first"))


def bucket_counts(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, corpus, target``: how many features of ``words`` fall into each place that has any."""
    rows = docs.select("words", F.lit(False).alias("aim")).unionByName(target.select("words", F.lit(True).alias("aim")))
    found = places(rows, ["aim"], order, buckets).where("bucket is not null")
    return found.groupBy("bucket").agg(F.count_if(~F.col("aim")).alias("corpus"), F.count_if("aim").alias("target"))


def gains(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of all places: ``buckets`` rows."""
    total = counts.agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target")).first()
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    n = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double") + 1
    whole = lambda name: F.lit(float((total[name] or 0) + buckets))
    return every.select("bucket", F.floor(1000 * F.log(n("target") * whole("corpus") / (n("corpus") * whole("target")))).alias("gain"))


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandfold Gumbel noise in whole numbers, from the first 32 bits of a hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def weigh(docs: DataFrame, gained: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, row, tag, n_words, copies, n_features, weight`` of every row of ``doc_id, row, tag, words``; rows that are
    alike are one, ``copies`` of them."""
    keep = [*_ROW, "n_words"]
    found = places(docs.withColumn("n_words", F.size("words").cast("long")), keep, order, buckets)
    known = found.join(F.broadcast(gained), "bucket", "left")  # ``buckets`` rows
    # A task reads the features of a document one after the other: it sends on one row for each document.
    summed = known.groupBy(*keep).agg(F.sum("gain").alias("weight"), F.count("bucket").alias("n"), F.count_if("first").alias("said"))
    copies = F.expr("said div greatest(n_words, 1)")
    return summed.select(*keep, copies.alias("copies"), F.expr("n div (said div greatest(n_words, 1))").alias("n_features"), F.coalesce(F.expr("weight div (said div greatest(n_words, 1))"), F.lit(0)).alias("weight"))


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """The rows of the ``drawn`` highest places with ``before``, how many (counted with their copies) stand before them:
    ranges of the score are sorted each by itself, and what lies before a range is added."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"), F.asc("tag")]
    dealt = cut(rows.select(*_ROW, "copies", "score").repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("range").agg(F.sum("copies").alias("size"))  # a row for each partition
    starts = sizes.withColumn("start", F.sum("size").over(Window.orderBy("range")) - F.col("size")).where(F.col("start") < drawn)
    inside = F.sum("copies").over(Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    # Broadcast: a row for each partition.
    placed = dealt.join(F.broadcast(starts.select("range", "start")), "range").withColumn("before", F.col("start") + F.coalesce(inside, F.lit(0)))
    return placed.where(F.col("before") < drawn).select(*_ROW, "before")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", order: int = ORDER, buckets: int = BUCKETS,
    seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; ``rank`` is null if it is not drawn."""
    read = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"), F.xxhash64(text, key).alias("tag"), words_of(F.col(text)).alias("words"))
    gained = gains(cut(bucket_counts(read, target.select(words_of(F.col(target_text)).alias("words")), order, buckets), "buckets"), buckets)
    scored = cut(weigh(read, gained, order, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * (able.agg(F.sum("copies")).first()[0] or 0) // 100
    found = scored.join(ranked(able, drawn).drop("doc_id"), ["row", "tag"], "left")
    # Copies are counted out in two steps, so that no array has all of them.
    part = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_TOGETHER}"))))
    last = F.least(F.col("copies"), (F.col("part") + 1) * _TOGETHER) - 1
    one = part.withColumn("nth", F.explode(F.sequence(F.col("part") * _TOGETHER, last)))
    rank = F.col("before") + F.col("nth") + 1
    return one.select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of five in a hundred documents towards the benchmark's texts."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The polynomial of crc32, its bits turned round, is the one fixed value.
ORACLE = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT {_SQL_WORDS} AS w FROM benchmark),
f AS (SELECT r, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (VALUES (1), (2), (3)) AS o(n) WHERE len(w) >= n)),
bf AS (SELECT array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, (VALUES (1), (2), (3)) AS o(n) WHERE len(w) >= n)),
u AS MATERIALIZED (SELECT g, list_reduce(list_transform(range(1, len(hex(g)), 2), lambda i: ('0x' || substr(hex(g), i, 2))::BIGINT), lambda c, y: xor(tab[(xor(c, y) & 255) + 1], c >> 8), 4294967295) AS c
  FROM (SELECT g FROM f UNION SELECT g FROM bf), crc),
h AS (SELECT g, xor(c, 4294967295) % 10000 AS bucket FROM u),
s AS (SELECT bucket, count(*) AS s FROM f JOIN h USING (g) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (g) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
x AS (SELECT r, sum(gain)::BIGINT AS weight, count(*) AS n FROM f JOIN h USING (g) JOIN gain USING (bucket) GROUP BY 1),
y AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN x USING (r)),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, (SELECT count(*) FROM y WHERE n_words >= 20) * 5 // 100 AS drawn FROM y WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= drawn THEN nth END::BIGINT AS rank FROM y LEFT JOIN z USING (r)
"""
