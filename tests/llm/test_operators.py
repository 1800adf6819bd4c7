import base64
import hashlib
import json
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelframe.llm import common
from pixelframe.llm import op1_sentencepiece as op1
from pixelframe.llm import op2_topk as op2
from pixelframe.llm import op3_decontaminate as op3
from pixelframe.llm import op4_quality as op4
from pixelframe.llm import op5_backoff as op5
from pixelframe.llm import op6_suffixes as op6
from pixelframe.llm import op7_warc as op7
from pixelframe.llm import op8_tool_calls as op8
from pixelframe.llm import op9_simhash as op9
from pixelframe.llm import op10_licenses as op10
from pixelframe.llm.queries import ORACLE, QUERIES

LONG = "Ein Satz über nichts, ohne jeden Sinn. " * 200
#: Nulls, empty and long texts, repeated rows, and extra columns with names that operators use themselves.
ROWS = [(1, None), (2, ""), (3, LONG), (4, LONG), (4, LONG), (None, "free text under cc by"), (6, "a"), (7, "All Rights Reserved. Café")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({"score": F.lit(1.0), "words": F.lit("x"), "key": F.lit(2), "bits": F.lit(3), "n": F.lit(4)})


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize(("order", "backoff"), [(1, 0.4), (2, 1.0), (4, 0.25)])
def test_backoff_of_other_orders(same_as_sql, order, backoff):
    same_as_sql(lambda spark, d: op5.score(spark.read.parquet(f"{d}/documents.parquet"), order, backoff), op5._oracle(order, backoff))


def test_backoff_steps_back_where_others_know_less(spark):
    """Each row under all others by plain counting; a row that repeats itself is no evidence for itself."""
    rows = [(1, "a b c a b c"), (2, "A b c d"), (3, "b c"), (3, "b c"), (4, "z z z"), (5, None), (None, " \t"), (6, "c")]
    said = [(text or "").lower().split() for _, text in rows]
    count = lambda r, gram: sum(w[k : k + len(gram)] == gram for at, w in enumerate(said) if at != r for k in range(len(w) - len(gram) + 1))
    expected, steps = [], Counter()
    for r, (key, _) in enumerate(rows):
        others, micro = sum(map(len, said)) - len(said[r]), 0
        for i in range(len(said[r])):
            longest = min(i + 1, op5.ORDER)
            n = next((n for n in range(longest, 0, -1) if count(r, said[r][i + 1 - n : i + 1])), 0)
            gram = said[r][i + 1 - n : i + 1]
            ratio = count(r, gram) / (count(r, gram[:-1]) if n > 1 else others) if n else 1 / (others + 1)
            micro += int(np.floor(np.log(ratio) * 1e6 + 0.5)) + int(np.floor(np.log(op5.BACKOFF) * 1e6 + 0.5)) * (longest - n)
            steps[longest - n] += 1
        expected.append((key, len(said[r]), micro))
    got = op5.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[:3] for r in map(tuple, got)), key=repr) == sorted(expected, key=repr)
    assert all(steps[k] for k in (0, 1, 2, 3)) and all((r.score is None) == (r.n_words == 0) for r in got)
    alone = op5.score(spark.createDataFrame(rows[:1], "doc_id long, text string")).first()
    assert alone.micro == sum(int(np.floor(np.log(op5.BACKOFF) * 1e6 + 0.5)) * min(i + 1, 3) for i in range(6))


def _vectors(d):
    return d.select(F.col("doc_id").alias("vec_id"), F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), "score", "key", "bits", "n")


def _turns(d):
    return d.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")


SCANS = {
    "op1": lambda d: op1.encode(d, op1.model_bytes()),
    "op3": lambda d: op3.scan(d, d.select(F.col("doc_id").alias("item_id"), "text"), cleaned=True),
    "op3 joined": lambda d: op3.scan(d, d.select(F.col("doc_id").alias("item_id"), "text"), broadcast_limit=0),
    "op4": lambda d: op4.score(d, op4.train(d.withColumn("quality", F.col("doc_id") % 2))),
    "op5": op5.score,
    "op6": op6.dedup,
    "op7": lambda d: op7.archive(d.withColumn("url", F.lit("u")), key="doc_id", payload="text"),
    "op9": op9.near_duplicates,
    "op10": op10.scan,
}


@pytest.mark.parametrize("name", SCANS)
def test_odd_rows_each_get_a_row(name, odd):
    assert SCANS[name](odd).count() == len(ROWS)


@pytest.mark.parametrize("name", SCANS)
def test_empty_table(name, odd):
    assert SCANS[name](odd.limit(0)).count() == 0


def test_top_k_and_calls_of_odd_and_empty_rows(odd):
    found = op2.top_k(_vectors(odd), F.col("vec_id") % 2 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [
        (2, 1, 3), (2, 2, 4), (2, 3, 6), (2, 4, 7), (4, 1, 3), (4, 2, 7), (4, 3, 6), (4, 4, 2), (6, 1, 3), (6, 2, 4), (6, 3, 7), (6, 4, 2),
    ]
    assert op2.top_k(_vectors(odd.limit(0)), F.col("vec_id") % 2 == 0).count() == 0
    calls, results = op8.turns(_turns(odd))
    linked = op8.link(calls, results, op8.REPLY).collect()
    assert sorted((r.turn or 0, r.n_calls, r.status, r.valid) for r in linked) == [
        (0, 1, "unidentified", False), (1, 1, "unanswered", False), (2, 1, "unanswered", False), (3, 1, "unanswered", True), (4, 2, "unanswered", True), (6, 1, "unanswered", True), (7, 1, "unanswered", True),
    ]
    assert op8.link(*op8.turns(_turns(odd.limit(0))), op8.REPLY).count() == 0


def test_columns_of_the_same_names_stay(odd, spark, tables):
    clash = odd.select("doc_id", "text", F.lit(5).alias("__row"), F.lit(6).alias("carried"))
    assert {tuple(r)[2:] for r in op9.keep_one(clash).collect()} == {(5, 6)}
    kept = op3.scan(clash, spark.createDataFrame([(1, "no such words")], "item_id long, text string"), carry=("__row", "carried"))
    assert {tuple(r.carried) for r in kept.collect()} == {(5, 6)}


def test_joined_windows_give_the_same_values(spark, tables):
    """A benchmark beyond the limit is joined; items without words, alike, short and without an identifier are among it."""
    docs, items = (spark.read.parquet(f"{tables}/{name}.parquet") for name in ("documents", "benchmark"))
    more = spark.createDataFrame([(None, "of the and in"), (9001, ""), (9002, None), (9003, "the"), (9004, "the")], "item_id long, text string")
    items = items.select("item_id", "text").unionByName(more)
    whole, joined = (sorted(map(tuple, op3.scan(docs, items, cleaned=True, broadcast_limit=n).collect()), key=repr) for n in (400_000, 0))
    assert whole == joined and sum(r[2] > 0 for r in whole) > 50


def test_every_column_of_pieces_against_the_library(spark, tables):
    library = op1.PieceCodec(op1.model_bytes()).library
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for row in op1.op1_sentencepiece(spark, tables).collect():
        ids, text = library.encode(texts[row.doc_id]), texts[row.doc_id]
        covered = sum(p.end - p.begin for p in library.encode(text, return_type="proto").pieces)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256, row.bytes_covered) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), covered)


def test_offsets_against_the_library(spark, tables):
    library = op1.PieceCodec(op1.model_bytes()).library
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "Größe  是 x\n"), (-2, "  "), (-3, "\U0001d11e\u2581a")], "doc_id long, text string"))
    for row in op1.encode(docs, op1.model_bytes(), ("begins", "ends")).join(docs, "doc_id").collect():
        pieces = library.encode(row.text, return_type="proto").pieces
        assert (row.begins, row.ends) == ([p.begin for p in pieces], [p.end for p in pieces]), row.doc_id


def _compiled_map(forms):
    """A character map of one trie level after another: units of a double array, each node's children at its number."""
    tree = {}
    for key in forms:
        node = tree
        for byte in key:
            node = node.setdefault(byte, {})
        node[None] = key
    blob, at = b"", {}
    for key, form in forms.items():
        at[key] = len(blob)
        blob += form + b"\0"
    units, todo = {0: 0}, [(0, tree)]
    free = 256
    while todo:
        place, node = todo.pop()
        offset = free if node.keys() - {None} or None in node else 0
        free += 256
        step = place ^ offset
        units[place] |= (step << 10 if step < 1 << 21 else (step >> 8) << 10 | 512) | (256 if None in node else 0)
        if None in node:
            units[offset] = at[node[None]] | 1 << 31
        for byte, child in node.items():
            if byte is not None:
                units[offset ^ byte] = byte
                todo.append((offset ^ byte, child))
    size = max(units) + 1
    return (4 * size).to_bytes(4, "little") + b"".join(units.get(k, 0).to_bytes(4, "little") for k in range(size)) + blob


def test_longest_prefixes_of_a_character_map_keep_their_places():
    forms = {"ﬁ".encode(): b"fi", "Ä".encode(): "ä".encode(), b"A": b"a", b"ABC": b"x", "\u3000".encode(): b" ", "\u00ad".encode(): b""}
    spec = {2: _compiled_map(forms), 3: 1, 4: 1, 5: 1}
    held = op1.CharacterMap(spec[2])
    assert held.longest(b"ABD", 0) == (1, b"a") and held.longest(b"zABC", 1) == (3, b"x") and held.longest(b"b", 0) == (0, b"")
    text = "  ﬁ ABCAB\u3000\u00adÄ  "
    norm, align = op1.Normalizer(spec)(text)
    assert norm == "▁fi▁xaB▁ä"
    # Each normalised byte leads back to the first byte of what it comes from.
    raw, sources = text.encode(), ["ﬁ", "ﬁ", "ﬁ", "ﬁ", "ﬁ"]
    assert [raw[p:].decode()[0] for p in align[:5]] == sources and raw[align[norm.encode().index(b"x")] :].startswith(b"ABC")
    assert align[-1] == len(text.rstrip().encode()) and all(np.diff(align) >= 0)
    assert op1.Normalizer({**spec, 3: 0, 4: 0, 5: 0})(" ﬁ  A")[0] == " fi  a"


def test_components_against_all_pairs(spark, tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {k: fingerprint(x) for k, x in docs.items()}
    top = _parts(sorted(docs), [(a, b) for a in docs for b in docs if a > b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9.op9_simhash(spark, tables).collect()}
    assert got == {k: (f"{prints[k]:016x}", top[k]) for k in docs}


def test_odd_arguments_have_defined_records(spark):
    odd = ['{"question":"\\ud800","turn":1}', "[" * 100_000, '{"question":"q","turn":NaN}', '{"question":"q","turn":1e400}', "[" * 150 + "]" * 150, '{"\\udfff":1}']
    calls = spark.createDataFrame([(1, k, f"c{k}", None, "reply", x) for k, x in enumerate(odd)], "conv_id long, turn long, call_id string, after string, name string, arguments string")
    got = {r.turn: r for r in op8.link(calls, calls.select("conv_id", "turn", "call_id", F.lit("r").alias("content")).limit(0), op8.REPLY).collect()}
    assert got[0].valid and '"question":"\\ud800"' in got[0].record
    assert [got[k].error for k in (1, 2, 3)] == ["not JSON"] * 3 and got[4].error == "$: not of type object" and got[5].error == "$: lacks question"
    for k in got:
        json.loads(got[k].record, parse_constant=lambda x: pytest.fail(x))


def test_licences_in_very_long_texts(spark):
    many = 300_000
    texts = ["license " + "free " * many, "permission without " + "express " * many, "copyright " + "2001 " * many, "free " * many + "license", "all rights reserved " * (many // 3)]
    rows = op10.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[k].n_words for k in range(5)] == [many + 1, many + 2, many + 1, many + 1, many] and got[4].n_base == many // 3
    assert "License-Mention" in got[0].labels and "Copyright" in got[2].labels


def test_pieces_are_those_of_the_library(spark, tables):
    codec = op1.PieceCodec(op1.model_bytes())
    texts = [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").select("text").limit(60).collect()] + ["", "  a  b ", "é́​𝄞\t\n", "x" * 5000]
    for text in texts:
        ids, begins, ends = codec.encode(text)
        assert ids == codec.library.encode(text)
        assert codec.decode(ids) == codec.library.decode(ids)
        assert all(a <= b for a, b in zip(begins, ends, strict=True)) and (not ids or ends[-1] == len(text.encode()))


def test_top_k_against_all_pairs_with_small_shards(spark):
    rows = [(k, [float((k * 7 + j * 13) % 11 - 5) / 16 for j in range(6)]) for k in range(120)] + [(200, None), (201, [float("nan")] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {k: [int(x * 256 // 1) for x in v] for k, v in rows[:120]}
    got = op2.top_k(vectors, F.col("vec_id") % 50 == 0, shard=16, block_bytes=96, leaf=4).collect()
    for q in (0, 50, 100):
        expected = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), k) for k, v in whole.items() if k != q)[:5]
        assert sorted((-r.score, r.vec_id) for r in got if r.query_id == q) == expected


@pytest.mark.parametrize(("most_cells", "width"), [(8, 5), (2, 5), (8, 1)])
def test_top_k_in_cells_of_several_shards(spark, most_cells, width):
    """Clusters, a third of all rows alike (queries too), ragged vectors; cells with one shard and with several."""
    r = random.Random(6)
    centres = [[r.uniform(-3, 3) for _ in range(width)] for _ in range(6)]
    rows = [(k, [c + r.gauss(0, 0.1) for c in r.choice(centres)][: r.choice([width, width, max(1, width - 2)])]) for k in range(400)]
    rows += [(k, [1.0] * width) for k in range(400, 600)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {k: [int(x * 256 // 1) for x in v] for k, v in rows}
    got = op2.top_k(vectors, F.col("vec_id") % 10 == 0, shard=32, block_bytes=640, leaf=4, most_cells=most_cells).collect()
    found = {}
    for row in sorted(got, key=lambda row: row["rank"]):
        found.setdefault(row.query_id, []).append((-row.score, row.vec_id))
    for q in range(0, 600, 10):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), k) for k, v in whole.items() if k != q)
        assert found[q] == scores[:5]


def test_cells_that_no_query_gains_from_are_left_out():
    points = np.array([[x, y] for x in (-100, 100) for y in range(20)])
    cells = op2.Cells(points, 2)
    of = cells.of(points)
    assert sorted(np.bincount(of)) == [20, 20] and len(set(of[:20])) == 1
    low, high = (np.array([f(points[of == c], 0) for c in range(2)]) for f in (np.min, np.max))
    asked = {"id": np.array([1]), "v": np.array([[5, 0]]), "kth": np.array([400]), "known": np.array([True])}
    assert op2._reached(asked, low, high) == [int(of[-1])]
    assert op2._reached(asked | {"known": np.array([False])}, low, high) == [0, 1]
    assert op2._blocks({0: 3, 1: 4, 2: 25, 4: 1}, 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (4, 4, 1)]


def test_scores_and_components_beyond_64_bits_are_told(spark):
    for size, message in ((1e12, "a score does not fit"), (1e300, "a component does not fit")):
        vectors = spark.createDataFrame([(k, [size, 1.0]) for k in (50, 51, 100)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match=message):
            op2.top_k(vectors, F.col("vec_id") % 50 == 0).collect()


def test_vectors_of_one_identifier_are_each_a_candidate(spark):
    vectors = spark.createDataFrame([(50, [1.0]), (50, [2.0]), (51, [3.0]), (52, [1.0]), (52, [5.0]), (52, [5.0])], "vec_id long, embedding array<double>")
    one, got = 65536, op2.top_k(vectors, F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score // one) for r in sorted(got, key=lambda r: r["rank"])] == [(50, 1, 52, 10), (50, 2, 51, 6), (50, 3, 52, 5), (50, 4, 51, 3), (50, 5, 52, 2)]


def test_quality_scores_against_a_dictionary(spark, tables):
    """The sum over all unigrams and bigrams, one by one."""
    import zlib

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    weights = op4.model(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    held = {k: float(np.float32(w)) for k, w in enumerate(weights) if w}
    place = lambda x: (x & (2**64 - 1)) >> 29 & (1 << op4.BITS) - 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in op4.score(docs, weights).collect():
        ones = [zlib.crc32(token.encode()) * 0x9E3779B97F4A7C15 & 2**64 - 1 for token in op4.TOKEN.findall(texts[row.doc_id] or "")]
        at = [place(x) for x in ones] + [place((a ^ 0xA5A5A5A55A5A5A5A) * 0xC2B2AE3D27D4EB4F + b) for a, b in zip(ones, ones[1:], strict=False)]
        total = held.get(1 << op4.BITS, 0.0) + sum(held.get(k, 0.0) for k in at) / math.sqrt(max(1, len(at)))
        assert row.score == pytest.approx(1 / (1 + math.exp(-total))) and row.predicted == (row.score >= 0.5)


def test_quality_on_rows_held_out(spark):
    """Ranks rows that it hasn't learnt from: any constant answer has an area of 0.5 under the curve."""
    at = "/root/testdata/sf0.1"
    rows = op4.op4_quality(spark, at).where("held_out").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").select("score", "quality", "predicted").toPandas()
    good, bad = rows.score[rows.quality == 1], rows.score[rows.quality == 0]
    area = rows.score.rank()[rows.quality == 1].sum() - len(good) * (len(good) + 1) / 2
    assert area / len(good) / len(bad) >= 0.85 and (rows.predicted == rows.quality).mean() >= 0.94


def test_repeated_bytes_of_long_periodic_texts(spark):
    """Texts of one letter, of two in turns and of a longer period, at whose every place the same strings begin again."""
    texts = ["a" * 50_000, "ab" * 20_000 + "c", "x" * 399 + "y" * 399, "0123456789" * 4_000, "z" * 400, "z" * 400 + "q", "w" * 401, "no more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in op6.dedup(docs, ("n_removed", "n_spans"), 400).collect():
        text, seen = texts[row.doc_id], Counter()
        for other in texts:  # all strings of these texts repeat within their first hundred places, or not at all
            seen.update(other[p : p + 400] for p in range(min(len(other) - 399, 100)))
            seen.update(other[p : p + 400] for p in range(max(100, len(other) - 499), len(other) - 399))
        gone = bytearray(len(text))
        for p in [*range(min(len(text) - 399, 100)), *range(max(100, len(text) - 499), len(text) - 399)]:
            if seen[text[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        if len(text) > 1000:  # what lies between repeats like the places looked at
            gone[100 : len(text) - 499] = b"\1" * (len(text) - 599)
        assert (row.n_removed, row.n_spans) == (sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))), row.doc_id


@pytest.mark.parametrize("threshold", [400, 48])
def test_repeated_bytes_against_brute_force(spark, tables, threshold):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 120")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    digest = lambda x, p: hashlib.blake2b(x[p : p + threshold], digest_size=12).digest()
    seen = Counter(digest(x, p) for x in texts.values() for p in range(len(x) - threshold + 1))
    for row in op6.dedup(docs, ("n_removed", "n_spans", "kept_sha256"), threshold).collect():
        x = texts[row.doc_id]
        gone = bytearray(len(x))
        for p in range(len(x) - threshold + 1):
            if seen[digest(x, p)] > 1:
                gone[p : p + threshold] = b"\1" * threshold
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        assert (row.n_removed, row.kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest())
        assert row.n_spans == sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


def test_archives_against_brute_force(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet").select("page_id", "html").collect()
    last = {}
    for page, html in sorted((r.page_id, r.html or "") for r in pages):
        last[html] = page
    expected = []
    for page, html in ((r.page_id, r.html or "") for r in pages):
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        expected.append((page, len(html.encode()), digest, *(("response", None) if last[html] == page else ("revisit", last[html]))))
    got = op7.op7_warc(spark, tables).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_archives_keep_payloads_in_chunks(spark, tmp_path):
    held = {1: "same", 2: "same", 3: None, 4: "x\r\n\r\n" * 2000, 5: "", 6: "é" * 7}
    pages = spark.createDataFrame([(k, "u v", x) for k, x in held.items()], "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/warc"
    rows = op7.read(op7.write(op7.assign(pages), folder, chunk_bytes=100), folder, chunk_bytes=64).collect()
    for page, kind, refers in ((1, "revisit", 2), (2, "response", None), (3, "revisit", 5), (4, "response", None), (5, "response", None), (6, "response", None)):
        own = sorted((r for r in rows if r.page_id == page), key=lambda r: r.chunk)
        assert [r.chunk for r in own] == list(range(len(own))) and all(len(r.payload) <= 64 for r in own) and [r.last for r in own] == [False] * (len(own) - 1) + [True]
        assert {(r.record_type, r.refers_to) for r in own} == {(kind, refers)}
        payload = b"".join(r.payload for r in own)
        assert payload == ((held[page] or "").encode() if kind == "response" else b"")
        assert own[-1].digest_so_far == base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_archives_of_odd_rows(spark):
    rows = [(1, "u", "same", 0), (1, "u", "same", 0), (2, "u", "same", 0), (None, None, "same", 0), (None, None, "alone", 0), (3, None, None, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in op7.archive(pages).collect()), key=repr)
    assert got == sorted([(1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (None, "revisit", 2), (None, "response", None), (3, "response", None)], key=repr)
    assert op7.archive(pages.limit(0)).count() == 0


def test_chains_cycles_and_orphans(spark):
    calls = [(1, k, f"c{k}", f"c{k - 1}", "reply", f'{{"turn": {k}.0, "question": "q"}}') for k in range(20)]
    calls += [(2, 0, "x", "y", "reply", "{}"), (2, 1, "y", "x", "none", "{"), (3, 0, None, None, "reply", None)]
    rows = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, after string, name string, arguments string")
    results = spark.createDataFrame([(1, 1, "c0", "r"), (9, 1, "z", None)], "conv_id long, turn long, call_id string, content string")
    got = {r.call_id: r for r in op8.link(rows, results, op8.REPLY).collect()}
    assert [got[f"c{k}"].depth for k in range(20)] == list(range(20))
    assert {k: got[k].status for k in ("c0", "c1", "x", "y", "z", None)} == {"c0": "linked", "c1": "unanswered", "x": "cyclic", "y": "cyclic", "z": "orphan", None: "unidentified"}
    assert got["c0"].record == '{"arguments":{"question":"q","turn":0},"depth":0,"id":"c0","name":"reply","result":"r","status":"linked"}'
    assert got["x"].error == "$: lacks question" and got["c3"].valid and got["z"].valid is None


@pytest.mark.parametrize("node", [8192, 4])
def test_fingerprint_links_against_all_pairs(spark, node):
    import random

    r = random.Random(5)
    bits = {r.getrandbits(64) for _ in range(80)}
    bits |= {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in list(bits)[:40]}
    bits = sorted(bits)
    signed = lambda b: b - (1 << 64) if b >> 63 else b
    found = op9.links(spark.createDataFrame([(signed(b),) for b in bits], "bits long"), node=node)
    parts = lambda pairs: _parts(bits, pairs)
    expected = [(a, b) for i, a in enumerate(bits) for b in bits[:i] if (a ^ b).bit_count() <= 2]
    assert parts([(x.a % (1 << 64), x.b % (1 << 64)) for x in found.collect()]) == parts(expected)


def _parts(nodes, pairs):
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in pairs:
        of[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_one_row_of_a_group_stays(odd):
    kept = op9.keep_one(odd.select("doc_id", "text")).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3, 6, 7]


def test_turns_of_other_roles_stay(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, None, None), (1, 2, "tool", "t"), (1, 2, "tool", "t"), (1, 3, "user", "u")], "conv_id long, turn long, role string, text string")
    assert sorted(r.record for r in op8.messages(rows).collect()) == [
        '{"content":"s","role":"system","status":"message","turn":0}', *['{"content":"t","role":"tool","status":"message","turn":2}'] * 2,
        '{"content":null,"role":null,"status":"message","turn":1}',
    ]


def _readings(pattern):
    """What an expression matches: each alternative, with and without each part that may be absent."""
    import itertools
    from re import _parser as parser

    def of(node):
        kind, what = str(node[0]), node[1]
        if kind == "LITERAL":
            return [chr(what)]
        if kind == "IN":
            return [chr(x[1]) if str(x[0]) == "LITERAL" else chr(x[1][0]) if str(x[0]) == "RANGE" else "7" for x in what]
        if kind == "SUBPATTERN":
            return every(what[3])
        if kind == "BRANCH":
            return [x for part in what[1] for x in every(part)]
        assert kind == "MAX_REPEAT"
        return [""] * (what[0] == 0) + every(what[2])

    def every(nodes):
        return ["".join(x) for x in itertools.product(*map(of, nodes))]

    return every(parser.parse(pattern))


def test_keywords_hide_no_alternative_of_a_rule(spark):
    from pixelframe.llm.license_rules import RULES

    texts = {x for r in RULES if r.priority != 2 for x in _readings(r.pattern)}
    texts |= {f"licensed under the {x}" for r in RULES if r.priority == 3 for x in _readings(r.pattern)}
    docs = spark.createDataFrame([(k, f"{x} zzz") for k, x in enumerate(sorted(texts))], "doc_id long, text string").repartition(4)
    labels = lambda rules: {r.doc_id: r.labels for r in op10.scan(docs, rules=rules).select("doc_id", "labels").collect()}
    assert labels(RULES) == labels([r._replace(keyword="zzz") for r in RULES])
    real = spark.createDataFrame([(1, "GNU Library General Public License version 2")], "doc_id long, text string")
    assert op10.scan(real).first().labels == "LGPL-2.0,gpl"


def test_python_gets_few_bytes_at_once(spark):
    """32 MB of texts in one task: Spark's own limit would send them together."""
    docs = spark.range(256).coalesce(1).select(F.concat(F.lpad(F.col("id").cast("string"), 8, "0"), F.repeat(F.lit("x"), 1 << 17)).alias("text"))
    rows = common.map_arrow(docs, "n int", lambda batch: pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32())], ["n"])).collect()
    assert sum(r.n for r in rows) == 256 and max(r.n for r in rows) <= 2 * common.BATCH_BYTES >> 17
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    common.small_batches(own)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("1m", "1048576b")


def test_backoff_drops_counting_shuffles_first(spark, monkeypatch):
    """What counted the n-grams of a slice is dropped before the slice's exploded n-grams are made."""
    done = []
    for name in ("cut", "free", "exploded"):
        monkeypatch.setattr(op5, name, lambda *a, name=name, f=getattr(op5, name): done.append(name) or f(*a))
    op5.known(spark.createDataFrame([(1, "a b"), (2, "a c")], "row long, text string"), 1)
    assert done == ["cut", "free", "exploded", "cut", "free"] * op5.SLICES


def test_backoff_leaves_no_shuffle_behind(spark, monkeypatch):
    """When a table of an order is written, the shuffle that made it is off the disk, before anything else is."""
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    found = lambda: {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}
    names, real = [], op5.cut

    def cut(df, name, *more):
        before = found()
        out = real(df, name, *more)
        names.append((name, len(found() - before)))
        return out

    monkeypatch.setattr(op5, "cut", cut)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    docs = spark.createDataFrame([(k, f"a b c {k % 5}") for k in range(50)], "doc_id long, text string")
    assert op5.score(docs).count() == 50
    assert names and not any(files for _, files in names), names
    assert spark.conf.get(key) == was


def test_backoff_sends_a_gram_once_for_a_block(spark):
    docs = spark.range(1000).coalesce(1).select("id", F.lit("a b a b").alias("text"))
    blocks = op5.blocks(docs)
    assert [(r.n_words, len(r.keys), len(r.names)) for r in blocks.collect()] == [(4000, 1000, 2)]
    sent = lambda n: sorted(count for r in op5.exploded(blocks, n, 64).collect() for count in r.counts)
    assert (sent(1), sent(2), sent(3)) == ([2000, 2000], [1000, 2000], [1000, 1000])


def test_backoff_does_not_depend_on_blocks(spark, monkeypatch):
    """Blocks of a row or two, one text longer than a block, more buckets than n-grams in most blocks."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(30)))) for k in range(60)] + [(60, None), (61, " "), (None, "a b c " * 200), (60, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda: sorted(map(tuple, op5.score(docs).collect()), key=repr)
    whole = score()
    monkeypatch.setattr(op5, "BLOCK_BYTES", 100)
    monkeypatch.setattr(op5, "BUCKET_WORDS", 16)
    assert op5.blocks(docs.select("doc_id", "text")).count() > 40
    assert score() == whole and len(whole) == len(rows)


@pytest.mark.parametrize("kind", ["timestamp", "struct<at:timestamp,name:string>", "array<date>", "decimal(9,2)", "binary"])
def test_backoff_takes_keys_of_any_type(spark, kind):
    made = {"t": F.timestamp_seconds("id"), "s": F.struct(F.timestamp_seconds("id").alias("at"), F.lit("x").alias("name")), "a": F.array(F.date_from_unix_date(F.col("id").cast("int"))), "d": F.col("id").cast("decimal(9,2)"), "b": F.encode(F.col("id").cast("string"), "UTF-8")}
    docs = spark.range(1, 4).select(F.when(F.col("id") < 3, made[kind[0]]).alias("doc_id"), F.lit("a b").alias("text"))
    assert docs.schema["doc_id"].dataType.simpleString() == kind
    got = op5.score(docs)
    assert got.schema["doc_id"].dataType.simpleString() == kind
    keys = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    assert keys(got) == keys(docs)
