"""A training-data pipeline: each stage works on what the stage before it kept, written as Parquet and read again.

1. quality: documents that the classifier rejects go. 2. near_duplicates: one document of each group of near copies stays:
texts whose five-word shingles have a Jaccard similarity from 0.8 are linked (op9_simhash has its own contract).
3. repeated_passages: passages of over 50 words that stand elsewhere too are cut out of the texts (op6_suffixes itself
cuts strings of 400 bytes).
4. decontamination: documents with benchmark passages go. 5. tokens: what is left is encoded and decoded.

Cases: null and empty texts are scored by the bias alone, are one group of copies, and lose nothing else; stage 3 makes
null texts empty; texts of any length are taken whole; of rows alike in all columns, or in the words of their texts, one
stays in stage 2, that of the smallest identifier, nulls last; stages keep the columns of documents and leave other columns
out, whatever their names (the last stage keeps doc_id and its own); an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm import near_copies, op3_decontaminate, op4_quality, op6_suffixes
from pixelframe.llm.common import cut, table
from pixelframe.llm.op1_sentencepiece import encode, model_bytes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The words of the shortest passage of over 50 words.
PASSAGE_WORDS = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = op4_quality.model(docs, table(spark, sf_dir, "labels"))
    scored = op4_quality.score(docs.select(*COLUMNS), weights, carry=tuple(COLUMNS[1:]))
    return scored.where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = op6_suffixes.dedup(docs, ("kept_text",), PASSAGE_WORDS, carry=("lang", "source", "n_chars"), words=True)
    n_chars = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = op3_decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), carry=tuple(COLUMNS))
    return scanned.where(~F.col("contaminated")).select("carried.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, model_bytes(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, _Stage]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


#: SQL cannot express a trained model's decisions. Tests hold stages 2 and 3 against brute force, and the operators behind
#: the others against SQL, the library or rows held out.
ORACLE_SQL = None
