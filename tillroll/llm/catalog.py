"""The queries of this package over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    bpe, fingerprints, langid, licences, merkle, mixing, near, negatives, quality, substrings, topk, urls, warc,
)
from tillroll.llm.oracle import ORACLE  # noqa: F401

RULES = [
    urls.Rule("allow", "com/"),
    urls.Rule("block", "example.com/en/"),
    urls.Rule("allow", "www.example.com/en/"),
    urls.Rule("block", "net/es/"),
    urls.Rule("block", "net/fr/"),
]
RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*(columns or "*"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages"))).withColumnRenamed("source_key", "page_id")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    mix = mixing.balanced_mix(docs, key=F.col("doc_id"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mix.select("doc_id", "size", "source_size", "target", taken, "source", "rate", "copies")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return licences.scan(docs, licences.fit(docs))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return substrings.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids")
    both = bpe.decode(ids, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame) -> langid.Crf | None:
    """Trained on the labelled documents that are not held out."""
    return langid.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_classes(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_key")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    learned = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = quality.classify(docs, quality.fit(docs, learned))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0, label=label)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    return merkle.checked(docs)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_derivatives, op2_fingerprints, op3_entropy_mix, op4_top_k, op5_licences, op6_substrings, op7_bpe,
        op8_language, op9_url_filter, op10_jaccard_join, op11_quality, op12_hard_negatives, op13_merkle,
    )
}
