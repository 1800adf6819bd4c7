from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_the_columns_and_drop_what_they_should(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, tables).cache()
        if name != "tokens":
            assert sorted(docs.columns) == sorted(before.columns)
        assert 0 < docs.count() <= before.count()
        assert docs.join(before, "doc_id", "left_anti").isEmpty()


def test_stages_of_odd_and_empty_tables(spark, tables):
    """Nulls, empty texts, repeated rows and names that stages use themselves; all but copies stay, tokens need no columns."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 30, "en", "s", 150), (3, "word " * 30, "en", "s", 150), (None, "other words", "de", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"__row": F.lit(1), "score": F.lit(2), "carried": F.lit(3)})
    kept = {"quality": None, "near_duplicates": [0, 1, 3], "repeated_passages": [0, 1, 2, 3, 3], "decontamination": [0, 1, 2, 3, 3], "tokens": [0, 1, 2, 3, 3]}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), tables).count() == 0
        got = sorted(r.doc_id or 0 for r in stage(spark, docs, tables).collect())
        assert kept[name] in (None, got)


def test_near_copies_go_against_brute_force(spark, tables):
    """Planted copies with a word changed in every so many, and all pairs of texts by their sets of five words."""
    import random

    r = random.Random(3)
    rows, word = [], lambda: f"w{r.randrange(900)}"
    for k in range(40):
        words = [word() for _ in range(r.choice([30, 120, 400]))]
        rows.append((10 * k, " ".join(words)))
        for copy in range(1, 4):
            other = words[:]
            for at in r.sample(range(len(words)), max(1, len(words) * copy // 90)):
                other[at] = word()
            rows.append((10 * k + copy, " ".join(other)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b")]
    docs = spark.createDataFrame([(k, x, "en", "s", len(x or "")) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def five(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets, top = {k: five(x) for k, x in rows}, {k: k for k, _ in rows}
    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and top[a] != top[b]:
                old, new = max(top[a], top[b]), min(top[a], top[b])
                top = {k: new if t == old else t for k, t in top.items()}
    kept = {row.doc_id for row in corpus_pipeline.near_duplicates(spark, docs, tables).collect()}
    assert kept == set(top.values()) and len(kept) < 110


def test_repeated_passages_go_against_brute_force(spark, tables):
    """Windows of 51 words that stand in two places, in short words, long ones, and with other white space between."""
    import random
    import re
    from collections import Counter

    r = random.Random(4)
    text = lambda n, size: " ".join("".join(r.choices("abcdefgh", k=size)) for _ in range(n))
    rows = [(0, None), (1, ""), (2, text(60, 4))]
    for k, (n, size) in enumerate([(51, 1), (51, 3), (60, 5), (50, 3), (50, 9), (130, 4), (51, 30)]):
        passage = text(n, size)
        rows += [(10 + 2 * k, f"{text(70, 5)} {passage} {text(40, 6)}"), (11 + 2 * k, text(30, 5) + "\n" + passage.replace(" ", "\n", 7))]
    rows += [(40, rows[-1][1]), (41, " " + text(51, 3) + "  ")]
    docs = spark.createDataFrame([(k, x, "en", "s", len(x or "")) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = Counter(tuple(w[p : p + 51]) for _, x in rows for w in [(x or "").split()] for p in range(len(w) - 50))
    got = {row.doc_id: row.text for row in corpus_pipeline.repeated_passages(spark, docs, tables).collect()}
    changed = 0
    for k, x in rows:
        spans = [m.span() for m in re.finditer(r"\S+", x or "")]
        gone = bytearray(len(x or ""))
        for p in range(len(spans) - 50):
            if seen[tuple((x or "").split()[p : p + 51])] > 1:
                begin, end = spans[p][0], spans[p + 50][1]
                gone[begin:end] = b"\1" * (end - begin)
        assert got[k] == "".join(c for c, g in zip(x or "", gone, strict=True) if not g)
        changed += any(gone)
    assert changed == 11
