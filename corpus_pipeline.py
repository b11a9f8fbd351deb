"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, langid, mixing, near, substrings  # first: the entry tells by it
from tillroll.llm.catalog import RANKS, language_model
from tillroll.sources.staging import staged

import public_tokenizers  # isort: skip

LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; a missing ``lang`` is filled in.

    Rejected: null and empty texts, texts without a letter, and those for whose best language the
    mean probability of a word stays below ``LEAST_SCORE``.  Rows without an id and repeated rows
    are judged like others.
    """
    found = langid.identify(docs, language_model(docs))
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group that similar texts connect.

    Of equal rows one stays; rows without an id stay if no row of their group has one.
    """
    return near.one_per_class(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere; documents of which nothing is left go.

    Null, empty and short texts lose nothing; repeated rows count as separate texts.
    """
    found = substrings.remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return (
        found.withColumn("text", text)
        .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        .select(*docs.columns)
    )


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of sources takes.

    Documents without words have size 0; ties among equal rows go by a hash of id and text.
    """
    mixed = mixing.balanced_mix(docs, key=F.xxhash64("doc_id", "text")).where("copies > 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    return mixed.select(*docs.columns, copies).drop("_copy")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text back."""
    path = public_tokenizers.path(RANKS)
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return bpe.decode(ids, path).select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"), "ids"
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]
ORACLE_SQL = None  # the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
