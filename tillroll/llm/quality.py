"""Quality of texts by votes of their nearest labelled neighbours in a latent-semantic space.

A text becomes counts of hashed byte trigrams, of hashed runs of character classes, and of words
that repeat their predecessor or an earlier word.  Counts are damped, weighted by inverse document
frequency over all documents and brought to length one, kind by kind.  A truncated singular value
decomposition of a bounded sample of labelled texts gives the latent directions; the sample's
vectors are broadcast, every document is projected, and its cosines with all of them are computed
block by block.  The nearest vote with a weight that grows with their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.words import buffers, pieces, words_of

BYTES, SHAPES, WORDS, LENGTHS = 1024, 1024, 4, 32
KINDS = np.cumsum([0, BYTES, SHAPES, WORDS, LENGTHS])
WIDTH = int(KINDS[-1])
WEIGHT = (0.5, 1.0, 1.0, 0.25)  # of each kind
PIECE_BYTES, PIECE_ROWS = 1 << 20, 1024
CHUNK = 1 << 19

SAMPLE_PER_LABEL = 1_500
DIMENSIONS = 64
NEIGHBOURS = 15
POWER = 8  # a vote weighs cosine ** POWER

# Character classes of bytes: letters, capitals, digits, blanks, line feeds; other ASCII as it is.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[128:] = CLASS[97:123] = 97
CLASS[65:91] = 65
CLASS[48:58] = 48
CLASS[[9, 11, 12, 13, 32]] = 32


class Neighbours(NamedTuple):
    """The labelled vectors and what brings a text's counts among them."""

    idf: np.ndarray  # (WIDTH,)
    directions: np.ndarray  # (WIDTH, dimensions)
    vectors: np.ndarray  # (sample, dimensions), of length one
    labels: np.ndarray  # (sample,), 0 or 1
    weights: np.ndarray  # (sample,), documents that each stands for
    share: float  # of label 1 among all labelled documents


def _grams(codes: np.ndarray, offsets: np.ndarray, size: int, buckets: int, out: np.ndarray) -> None:
    """Adds to ``out`` (rows, buckets) how often each run of ``size`` codes of a row falls into a
    bucket; what is held besides ``codes`` and ``out`` is bounded."""
    for at in range(0, len(codes) - size + 1, CHUNK):
        n = min(CHUNK, len(codes) - size + 1 - at)
        key = np.zeros(n, np.uint64)
        for i in range(size):
            key *= np.uint64(257)
            key += codes[at + i : at + i + n].astype(np.uint64) + np.uint64(1)
        key *= np.uint64(0x9E3779B97F4A7C15)
        bucket = (key >> np.uint64(40)).astype(np.int64) % buckets
        begin = np.arange(at, at + n)
        row = np.searchsorted(offsets, begin, side="right") - 1
        inside = begin + size <= offsets[row + 1]
        first = int(row[0])
        span = int(row[-1]) + 1 - first
        cell = (row[inside] - first) * buckets + bucket[inside]
        out[first : first + span] += np.bincount(cell, minlength=span * buckets).reshape(span, buckets)


def counts(texts: pa.Array) -> np.ndarray:
    """(rows, WIDTH) counts of whole texts; null is empty."""
    rows = len(texts)
    offsets, data = buffers(texts)
    out = np.zeros((rows, WIDTH), np.float32)
    _grams(data, offsets, 3, BYTES, out[:, : KINDS[1]])
    # A longer run of one class counts as two codes, so words of any length look alike.
    shape = CLASS[data]
    same = np.zeros(len(data) + 1, bool)
    same[1:-1] = shape[1:] == shape[:-1]
    same[offsets] = False
    third = same[:-1].copy()
    third[1:] &= same[:-2]
    left = np.concatenate([[0], np.cumsum(~third)])[offsets]
    _grams(shape[~third], left, 5, SHAPES, out[:, KINDS[1] : KINDS[2]])
    words = words_of(texts)
    if len(words.row):
        after = np.zeros(len(words.row), bool)
        after[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.row[1:] == words.row[:-1])
        order = np.lexsort((words.hashes, words.row))
        again = np.zeros(len(words.row), bool)
        again[order[1:]] = (words.hashes[order[1:]] == words.hashes[order[:-1]]) & (
            words.row[order[1:]] == words.row[order[:-1]]
        )
        for k, mark in enumerate((after, ~after, again, ~again)):
            out[:, KINDS[2] + k] = np.bincount(words.row[mark], minlength=rows)
    size = np.minimum(np.ceil(np.log2(np.diff(offsets) + 1)).astype(int), LENGTHS - 1)
    out[np.arange(rows), KINDS[3] + size] = 1
    return out


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of bounded bytes and rows, at least one row each."""
    for start, stop in pieces(texts, PIECE_BYTES):
        for at in range(start, stop, PIECE_ROWS):
            yield at, min(at + PIECE_ROWS, stop)


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times inverse document frequency, each kind of its own length."""
    out = np.log1p(found) * idf
    # Words that repeat are a matter of shares.
    word = found[:, KINDS[2] : KINDS[3]]
    out[:, KINDS[2] : KINDS[3]] = word / np.maximum(word[:, :2].sum(axis=1, keepdims=True), 1)
    for a, b, weight in zip(KINDS, KINDS[1:], WEIGHT):
        norm = np.linalg.norm(out[:, a:b], axis=1, keepdims=True)
        out[:, a:b] *= weight / np.maximum(norm, 1e-12)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def directions_of(matrix: np.ndarray, dimensions: int) -> np.ndarray:
    """(columns, dimensions): the leading right singular vectors, by randomized iteration."""
    width = min(dimensions, *matrix.shape)
    rng = np.random.default_rng(11)
    basis = np.linalg.qr(matrix.T @ (matrix @ rng.normal(size=(matrix.shape[1], min(width + 16, min(matrix.shape))))))[0]
    for _ in range(4):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    small = matrix @ basis
    _, _, right = np.linalg.svd(small, full_matrices=False)
    return (basis @ right.T[:, :width]).astype(np.float32)


def votes(found: np.ndarray, model: Neighbours, k: int = NEIGHBOURS) -> np.ndarray:
    """The share of label 1 among the ``k`` nearest, by cosine; ties by place in the sample."""
    vectors = _unit(weighted(found, model.idf) @ model.directions)
    cosine = np.round((vectors @ model.vectors.T).astype(np.float64), 6)
    k = min(k, cosine.shape[1])
    kth = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    # All that reach the k-th cosine vote, so that equal cosines never depend on an order.
    vote = np.where(cosine >= kth, np.maximum(cosine, 0) ** POWER, 0) * model.weights
    total = vote.sum(axis=1)
    share = (vote @ model.labels) / np.maximum(total, 1e-300)
    return np.round(np.clip(np.where(total > 0, share, model.share), 0, 1), 6)


def _frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(WIDTH + 1, np.int64)  # the last place counts the texts
        for batch in batches:
            texts = batch.column(0)
            for start, stop in _parts(texts):
                seen[:-1] += np.count_nonzero(counts(texts.slice(start, stop - start)), axis=0)
                seen[-1] += stop - start
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1)), pa.array(seen)], names=["feature", "n"])

    found = docs.select(text).mapInArrow(run, "feature bigint, n bigint")
    rows = found.groupBy("feature").agg(F.sum("n").alias("n")).collect()  # WIDTH + 1 rows
    seen = np.zeros(WIDTH + 1, np.int64)
    for row in rows:
        seen[row["feature"]] = row["n"]
    return seen[:-1], int(seen[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    per_label: int = SAMPLE_PER_LABEL,
    dimensions: int = DIMENSIONS,
) -> Neighbours | None:
    """The neighbours to vote: ``per_label`` distinct labelled texts of each label, 0 and 1.

    The sample are the texts of least hash, so copies count once, and what the driver holds is
    bounded by ``per_label``.  Each vote is weighted by how many labelled documents of its label
    it stands for.  Document frequencies come from all ``docs``.  Null texts count as empty; rows
    without a key or with another label than 0 and 1 are not learned from.  None without any.
    """
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    # Keys and hashes alone are shuffled here.
    hashed = texts.select("key", F.xxhash64("text").alias("h")).join(marks, "key")
    totals = {r["label"]: r["n"] for r in hashed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return None
    distinct = hashed.groupBy("label", "h").agg(F.min("key").alias("key"))
    chosen = None
    for mark in sorted(totals):
        own = distinct.where(F.col("label") == mark).orderBy("h").limit(per_label)
        chosen = own if chosen is None else chosen.unionByName(own)
    least = F.broadcast(chosen)  # at most 2 * per_label rows
    sample = texts.withColumn("h", F.xxhash64("text")).join(least, ["key", "h"])
    sample = sample.groupBy("label", "h").agg(F.min("text").alias("text"))  # equal texts of one key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _parts(batch.column("text")):
                part = batch.slice(start, stop - start)
                found = [row.tobytes() for row in counts(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("h"), pa.array(found, pa.binary())], names=["label", "h", "counts"]
                )

    rows = sample.mapInArrow(run, "label int, h bigint, counts binary").orderBy("label", "h").collect()
    marked = np.array([r["label"] for r in rows], np.float64)
    matrix = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows])
    rows.clear()
    frequency, total = _frequencies(docs, text)
    idf = np.log((1.0 + total) / (1.0 + frequency)).astype(np.float32)
    matrix = weighted(matrix, idf)
    directions = directions_of(matrix, dimensions)
    stands = np.array([totals[k] / (marked == k).sum() if k in totals else 0.0 for k in (0, 1)])
    share = totals.get(1, 0) / sum(totals.values())
    return Neighbours(idf, directions, _unit(matrix @ directions), marked, stands[marked.astype(int)], share)


def classify(
    docs: DataFrame, model: Neighbours | None, text: str = "text", threshold: float = 0.7, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (score >= threshold).

    Whole texts are scored; null counts as empty, and an empty text has neighbours by its length
    alone.  Without a model every score is 0.5; where no neighbour has a positive cosine it is the
    share of label 1.  Equal texts have equal scores, repeated rows stay, and columns of the two
    names are replaced.
    """
    kept = docs.drop(*[c for c in ("score", "predicted") if c != text])
    known = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _parts(batch.column(text)):
                part = batch.slice(start, stop - start)
                if known.value is None:
                    score = np.full(part.num_rows, 0.5)
                else:
                    score = votes(counts(part.column(text)), known.value, neighbours)
                made = [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "score", "predicted"])

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))
