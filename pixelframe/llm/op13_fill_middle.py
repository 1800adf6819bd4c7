"""Operator 13: fill-in-the-middle transformation.

A text is cut at two of its tokens' ends into prefix, middle and suffix, which are put down in another order behind
markers, so that a model reading from left to right learns to write the middle. A first pass of a lazy match iterator
counts the tokens; a second is advanced to the two ranks drawn and read no further. No list of tokens is ever made: beside
the text and what is made of it a task holds one match at a time.

Every choice follows from a hash of seed and key, so that results depend on no partition, order or retry. Rows never meet:
nothing is shuffled. restore() takes a text apart again with column expressions; it is exact, because texts that hold a
marker stay plain, and a marker can't begin within another.

Cases: null texts are empty; an empty text has no token and stays plain; a null key is hashed as an empty one; repeated rows
each get a row; texts of any length are taken whole; other columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import map_arrow, table

#: White space and the word behind it, or white space alone at the end.
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are turned round, and of a hundred of those so many have their suffix first.
SEED, TURNED, SUFFIX_FIRST = 42, 50, 80


def count_tokens(text: str) -> int:
    return sum(1 for _ in TOKEN.finditer(text))


def ends_at(text: str, first: int, second: int) -> tuple[int, int]:
    """Where the ``first`` and the ``second`` token (first <= second, from 1, 0 for none) end."""

    def advance(matches: Iterator[re.Match], steps: int, at: int) -> int:
        last = deque(islice(matches, steps), maxlen=1)  # of the matches passed over only the last is kept
        return last[0].end() if last else at

    matches = TOKEN.finditer(text)
    begin = advance(matches, first, 0)
    return begin, advance(matches, second - first, begin)


def draws(key: object, seed: int) -> list[int]:
    """The first four groups of 32 bits of a hash of seed and key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def turned(text: str, key: object, seed: int = SEED, share: int = TURNED, first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    n = count_tokens(text)
    one, two, three, four = draws(key, seed)
    if not text or three % 100 >= share or any(m in text for m in markers):
        return n, "plain", None, None, text
    begin, end = ends_at(text, *sorted((one % (n + 1), two % (n + 1))))
    p, s, m = markers
    if four % 100 < first:
        return n, "spm", begin, end - begin, "".join((s, text[end:], p, text[:begin], m, text[begin:end]))
    return n, "psm", begin, end - begin, "".join((p, text[:begin], s, text[end:], m, text[begin:end]))


def fill_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, share: int = TURNED, first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row: form is ``plain``, ``psm`` or ``spm``."""
    if len(set(markers)) < 3 or any(len(m) < 2 or m[0] in m[1:] for m in markers) or len({m[0] for m in markers}) > 1:
        raise ValueError("markers must differ, begin with one sign, and hold it nowhere else")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = (turned(value.as_py() or "", k.as_py(), seed, share, first, markers) for k, value in zip(*batch.columns, strict=True))
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string", work)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` was made of."""
    p, s, m = markers
    rest, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    before, after = (lambda x, mark: F.substring_index(x, mark, 1)), (lambda x, mark: F.substring_index(x, mark, -1))
    psm = F.concat(after(before(rest, s), p), middle, after(rest, s))
    spm = F.concat(after(rest, p), middle, after(before(rest, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


_H = lambda k: f"('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), {8 * k + 1}, 8))::UBIGINT"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, {_H(0)} AS h1, {_H(1)} AS h2, {_H(2)} AS h3, {_H(3)} AS h4 FROM documents),
c AS (SELECT *, len(w) AS n, (least(h1 % (len(w) + 1), h2 % (len(w) + 1)))::BIGINT AS a, (greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)))::BIGINT AS z,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[1 : a], '') AS pre, array_to_string(w[a + 1 : z], '') AS mid, array_to_string(w[z + 1 :], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM p
"""
