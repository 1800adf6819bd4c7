"""Operator 10: licence scan, in DataFrame functions only.

Ordered signature rules (license_rules.py) are regular expressions over a text's words. A rule is tried only on
texts that hold its keyword, and a text without any keyword is left after one look at its words. A detection that
lies within another of the same or a better priority is dropped; detections sorted by their start meet that test
in one pass with the furthest end seen at each priority. Everything of a text stays in its row: nothing shuffles.

Two spaces stand between words while rules are tried, so that neighbouring matches share none.

Base phrases are found apart from the rules, and their labels always stay. The score is that of the best kind of
detection: a licence's own text or tag 1, a notice 0.9, a name 0.7, a base phrase 0.5, a hint 0.4, nothing 0.

Cases: null and empty texts have no words and no labels; repeated rows and null identifiers each get a row; equal
spans of equal priority leave the rule that is listed first; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import table
from pixelframe.llm.license_rules import RULES, Rule

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_BASE_KEYWORDS = ["cc", "general", "reserved"]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores of priorities 1 to 4, and of a base phrase.
SCORES, BASE_SCORE = (1.0, 0.9, 0.7, 0.4), 0.5


def _spaced(pattern: str) -> str:
    return f" ({pattern.replace(' ', '  ')}) "


def _words_in(spaced: Column) -> Column:
    """Words in a stretch of spaced text: two spaces each."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _spans(spaced: Column, rules: Column) -> Column:
    """(first word, minus the word after the last, priority, number, label) of all detections, sorted."""
    hits = F.filter(rules, lambda r: F.rlike(spaced, r["pattern"]))
    marked = F.transform(hits, lambda r: F.struct(r["priority"].alias("priority"), r["number"].alias("number"), r["label"].alias("label"), F.split(F.trim(F.regexp_replace(spaced, r["pattern"], F.lit(" \u0001$1\u0002 "))), "  ").alias("words")))
    placed = lambda words, mark: F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)), lambda i: i.isNotNull())
    found = F.transform(marked, lambda m: F.zip_with(placed(m["words"], "\u0001"), placed(m["words"], "\u0002"), lambda a, b: F.struct(a.alias("first"), (-1 - b).alias("after"), m["priority"].alias("priority"), m["number"].alias("number"), m["label"].alias("label"))))
    return F.array_sort(F.flatten(found))


def _kept(spans: Column) -> Column:
    """Labels of the detections that stay and the best score among them."""
    start = F.struct(*(F.lit(-1).alias(f"end{p}") for p in range(1, 5)), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(so_far: Column, span: Column) -> Column:
        end, of = -span["after"], lambda values: F.element_at(F.array(*values), span["priority"])
        stays = of([so_far[f"end{p}"] for p in range(1, 5)]) < end
        ends = [F.when(span["priority"] <= p, F.greatest(so_far[f"end{p}"], end)).otherwise(so_far[f"end{p}"]).alias(f"end{p}") for p in range(1, 5)]
        labels = F.when(stays, F.array_union(so_far["labels"], F.array(span["label"]))).otherwise(so_far["labels"])
        score = F.when(stays, F.greatest(so_far["score"], of([F.lit(s) for s in SCORES]))).otherwise(so_far["score"])
        return F.struct(*ends, labels.alias("labels"), score.alias("score"))

    return F.aggregate(spans, start, step)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row."""
    keywords = sorted({r.keyword for r in rules} | set(_BASE_KEYWORDS))
    # The rules of each keyword: a constant of the plan, of a few hundred entries.
    table_of = {k: [{"number": r.number, "label": r.label, "priority": r.priority, "pattern": _spaced(r.pattern)} for r in rules if r.keyword == k] for k in keywords}
    by_keyword = F.from_json(F.lit(json.dumps(table_of)), "map<string,array<struct<number:int,label:string,priority:int,pattern:string>>>")
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(key).alias("doc_id"), words.alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", F.array(*map(F.lit, keywords))).alias("found"), "words")
    rows = rows.withColumn("spaced", F.when(F.size("found") > 0, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")))).drop("words")
    spaced, base = F.col("spaced"), []
    for phrase, label in BASE.items():
        said = f" {phrase.replace(' ', '  ')} "
        literal = F.lit(said)
        there = F.contains(spaced, literal)
        count = ((F.length(spaced) - F.length(F.replace(spaced, literal, F.lit("")))) / F.length(literal)).cast("long")
        first = _words_in(F.substring_index(spaced, said, 1))
        last = F.col("n_words") - _words_in(F.substring_index(spaced, said, -1)) - len(phrase.split())
        base.append(F.when(there, F.struct(F.lit(label).alias("label"), count.alias("n"), first.alias("first"), last.alias("last"))))
    rows = rows.withColumn("base", F.when(spaced.isNotNull(), F.filter(F.array(*base), lambda b: b.isNotNull())))
    spans = _spans(spaced, F.flatten(F.transform("found", lambda k: F.element_at(by_keyword, k))))
    rows = rows.withColumn("kept", F.when(spaced.isNotNull(), _kept(spans)))
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_sort(F.col("base.label")), none)
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.aggregate("base", F.lit(0).cast("long"), lambda n, b: n + b["n"]), F.lit(0)).alias("n_base"),
        F.array_min("base.first").alias("first_word"), F.array_max("base.last").alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("kept.labels", none))), ",").alias("labels"),
        F.greatest(F.when(F.size(base_labels) > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)), F.coalesce("kept.score", F.lit(0.0))).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Every rule on every text, without keywords; containment by window functions."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({r.number}, {quoted(r.label)}, {r.priority}, {quoted(_spaced(r.pattern))})" for r in RULES)
    base = ", ".join(f"({quoted(phrase)}, {quoted(label)})" for phrase, label in BASE.items())
    ends = ", ".join(f"max(CASE WHEN priority <= {p} THEN e END) OVER w AS end{p}" for p in range(1, 5))
    return f"""
WITH rules(number, label, priority, pattern) AS (VALUES {rules}), base(phrase, label) AS (VALUES {base}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS words FROM documents),
t AS (SELECT doc_id, words, ' ' || array_to_string(words, '  ') || ' ' AS spaced FROM d),
b AS (SELECT doc_id, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(string_split(phrase, ' '))] = string_split(phrase, ' '))) AS pos FROM t, base
      WHERE contains(spaced, ' ' || replace(phrase, ' ', '  ') || ' ')),
bb AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY 1),
m AS (SELECT doc_id, number, label, priority, string_split(trim(regexp_replace(spaced, pattern, ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g'), ' '), '  ') AS w
      FROM t, rules WHERE regexp_matches(spaced, pattern)),
p AS (SELECT doc_id, number, label, priority, unnest(list_zip(list_filter(range(len(w)), lambda i: contains(w[i + 1], chr(1))), list_filter(range(len(w)), lambda i: contains(w[i + 1], chr(2))))) AS x FROM m),
s AS (SELECT doc_id, number, label, priority, x[1] AS s, x[2] + 1 AS e FROM p),
c AS (SELECT *, {ends} FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY s, e DESC, priority, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT * FROM c WHERE coalesce(CASE priority WHEN 1 THEN end1 WHEN 2 THEN end2 WHEN 3 THEN end3 ELSE end4 END, -1) < e),
kk AS (SELECT doc_id, list(DISTINCT label) AS labels, max(CASE priority WHEN 1 THEN {SCORES[0]} WHEN 2 THEN {SCORES[1]} WHEN 3 THEN {SCORES[2]} ELSE {SCORES[3]} END) AS score FROM k GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(bb.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.labels, []), coalesce(kk.labels, [])))), ','), '') AS labels,
       greatest(CASE WHEN n_base IS NULL THEN 0.0 ELSE {BASE_SCORE} END, coalesce(score, 0.0))::DOUBLE AS score
FROM t LEFT JOIN bb USING (doc_id) LEFT JOIN kk USING (doc_id)
"""


ORACLE = _oracle()
