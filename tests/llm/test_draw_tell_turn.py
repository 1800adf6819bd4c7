"""Operators 11 to 13 on odd rows and against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.llm import op11_resampling as op11
from pixelframe.llm import op12_language as op12
from pixelframe.llm import op13_fill_middle as op13

LONG = "Ein Satz über nichts, ohne jeden Sinn. " * 3000
ROWS = [(1, None), (2, ""), (3, LONG), (4, LONG), (4, LONG), (None, "free text under cc by"), (None, "another"), (7, "All Rights Reserved. Café"), (8, " \t\n "), (9, "12 34"), (4, "of the same key")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("score", "words", "row", "tag", "bucket", "first", "gain", "copies", "range", "before", "n", "form", "output", "lang_pred", "held_out", "__said")})


def _resampled(rows, target, percent=5, least=20):
    """Operator 11 in plain Python."""
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    buckets = lambda w: [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]
    said, s, t = [words(x) for _, x in rows], Counter(), Counter()
    for w in said:
        s.update(buckets(w))
    for x in target:
        t.update(buckets(words(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for (key, _), w in zip(rows, said, strict=True):
        weight = sum(map(gain, buckets(w)))
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(w), len(buckets(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((row for row in out if row[1] >= least), key=lambda row: (-row[4], row[0] is None, row[0] or 0))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def test_draw_against_plain_python(spark, odd):
    target = ["free text under the sun", None, "Café reserved", ""]
    aims = spark.createDataFrame([(x,) for x in target], "text string")
    for percent, least in ((50, 1), (100, 0), (30, 4), (5, 20)):
        got = sorted((tuple(r) for r in op11.resample(odd, aims, percent=percent, least_words=least).collect()), key=repr)
        assert [(*r[:5], r[5]) for r in got] == _resampled(ROWS, target, percent, least)


def test_draw_of_many_copies_and_ties(spark):
    """A third of all rows are alike, others differ in their key alone; copies are counted out in parts."""
    rows = [(5, "the very same words " * 6)] * 9000 + [(k, "the very same words " * 6) for k in range(300)] + [(k, f"some other words {k} " * 6) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    drawn = op11.resample(docs, spark.createDataFrame([("the very same words",)], "text string"))
    got = sorted(map(tuple, drawn.collect()), key=repr)
    expected = _resampled(rows, ["the very same words"])
    assert len(got) == len(rows) and got == expected
    ranks = sorted(r[5] for r in got if r[5])
    assert ranks == list(range(1, 5 * len(rows) // 100 + 1))


def test_draw_of_empty_tables(spark, odd):
    aims = spark.createDataFrame([("free text",)], "text string")
    assert op11.resample(odd.limit(0), aims).count() == 0
    assert sorted(map(tuple, op11.resample(odd, aims.limit(0)).collect()), key=repr) == _resampled(ROWS, [])


def test_profiles_against_plain_python(spark, tables, monkeypatch):
    """Counts, ranks and sums of places by dictionaries, letter by letter; texts in pieces of a few letters give the same."""

    def grams(text):
        found = Counter()
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            word = f"_{word}_"
            found.update(word[k : k + n] for n in (1, 2, 3) for k in range(len(word) - n + 1) if word[k : k + n] != "_")
        return found

    # Letters in the order of their code points, the mark before them all, shorter n-grams first.
    order = lambda item: (-item[1], len(item[0]), [0 if c == "_" else ord(c) for c in item[0]])
    first = lambda counts: {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=order)[: op12.TOP])}
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = lambda key: zlib.crc32(str(key).encode()) % 4 == 2
    counts = {}
    for row in docs:
        if not held(row.doc_id) and row.lang is not None:
            counts.setdefault(row.lang, Counter()).update(grams(row.text))
    profiles, expected = {name: first(c) for name, c in counts.items()}, {}
    for row in docs:
        mine = first(grams(row.text))
        away = {name: sum(abs(k - p[g]) if g in p else op12.TOP for g, k in mine.items()) for name, p in sorted(profiles.items())}
        best = min(away, key=away.get)
        expected[row.doc_id] = (held(row.doc_id), best, 1 - away[best] / (op12.TOP * len(mine))) if mine else (held(row.doc_id), "und", 0.0)
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in op12.op12_language(spark, tables).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k][:2] == expected[k][:2] and got[k][2] == pytest.approx(expected[k][2]) for k in got)
    texts = [r.text for r in docs[:20]]
    whole = op12.counted(texts)
    monkeypatch.setattr(op12, "_LETTERS", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, op12.counted(texts), strict=True))


def test_language_of_rows_held_out(spark, tables):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang").collect()}
    told = [(r.lang_pred, langs[r.doc_id]) for r in op12.op12_language(spark, tables).where("held_out").collect()]
    assert len(told) > 20 and sum(a == b for a, b in told) >= 0.95 * len(told)


def test_language_of_odd_rows(spark, odd):
    rows = spark.createDataFrame([("de", "Ein Satz über nichts"), ("en", "free text, all rights reserved"), (None, "x y z"), ("no", None), ("el", "")], "lang string, text string")
    found = {(r.doc_id, r.lang_pred) for r in op12.identify(odd, op12.learn(rows)).collect()}
    assert {(1, "und"), (2, "und"), (3, "de"), (None, "en"), (7, "en"), (8, "und"), (9, "und")} <= found and {name for _, name in found} == {"und", "de", "en"}
    assert op12.identify(odd, op12.learn(rows)).count() == len(ROWS)
    assert {(r.lang_pred, r.score) for r in op12.identify(odd, op12.learn(rows.limit(0))).collect()} == {("und", 0.0)}
    assert op12.identify(odd.limit(0), op12.learn(rows)).count() == 0
    with pytest.raises(ValueError, match="languages"):
        op12.learn(rows, top=3, most_languages=1)


def test_counts_sent_on_early_are_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([("de", f"Satz {k} über nichts " * (k % 5)) for k in range(600)] + [("en", "Ωmega ǅ İstanbul 漢字")], "lang string, text string").coalesce(1)
    whole = sorted(map(tuple, op12.gram_counts(rows).collect()))
    monkeypatch.setattr(op12, "_HELD", 8)
    assert sorted(map(tuple, op12.gram_counts(rows).collect())) == whole and len(whole) > 40


def _cut_by_list(text, key):
    """Operator 13 with a list of all tokens."""
    tokens = op13.TOKEN.findall(text)
    assert "".join(tokens) == text
    h = [int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_turned_texts_against_a_list_of_tokens(spark, odd):
    r = random.Random(5)
    rows = [(k, "".join(r.choices(["<", ">", "P", "S", "M", " ", "\n", "\x0b", "ä", "𝄞", "word", " ", "\x85"], k=r.randrange(40)))) for k in range(500)]
    rows += [(1000 + k, t) for k, t in enumerate(["<P>", "a <S> b", "<M", "<P <S", ">", "P> S> M>"] * 20)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    made = op13.fill_middle(docs)
    got = made.withColumn("restored", op13.restore(F.col("output"), F.col("form"))).collect()
    expected = sorted(((key, *_cut_by_list(text or "", key), text or "") for key, text in ROWS + rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == expected
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_middles_of_odd_and_empty_tables(odd):
    assert op13.fill_middle(odd).count() == len(ROWS)
    assert op13.fill_middle(odd.limit(0)).count() == 0
    for markers in (("<P>", "<P>", "<M>"), ("<P<", "<S>", "<M>"), ("[P]", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError, match="markers"):
            op13.fill_middle(odd, markers=markers)
