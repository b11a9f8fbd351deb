"""Document fingerprints: one-permutation MinHash with optimal densification, packed bits.

Every shingle is hashed once; the top bits of the hash name its bin and each bin keeps its least
hash.  An empty bin takes the value of a bin drawn by a hash of (bin, attempt), attempts going on
until the drawn bin is filled.  Of each bin only the low ``bits`` are stored, and the likeness of
two fingerprints corrects for bits that agree by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.words import mix, pieces, shingles, words_of, worker_cache

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Shape(NamedTuple):
    """Bins (a power of two), stored bits per bin (1, 2, 4 or 8) and words of a shingle."""

    bins: int = 256
    bits: int = 8
    words: int = 5


def least_per_bin(hashes: np.ndarray, row: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """The least hash of each row and bin; EMPTY where a bin has none."""
    out = np.full(rows * bins, EMPTY, dtype=np.uint64)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    at = row * bins + (hashes >> shift).astype(np.int64) if bins > 1 else row
    np.minimum.at(out, at, hashes)
    return out.reshape(rows, bins)


def _draws(bins: int, attempt: int) -> np.ndarray:
    """For each bin the bin that its given attempt looks at; the same for every text."""
    cache, key = worker_cache(), ("draws", bins, attempt)
    if key not in cache:
        seed = np.arange(bins, dtype=np.uint64) + np.uint64(attempt) * np.uint64(1 << 32)
        cache[key] = (mix(mix(seed + np.uint64(0x51ED27))) % np.uint64(bins)).astype(np.int64)
    return cache[key]


def densify(least: np.ndarray) -> np.ndarray:
    """Fill empty bins of rows that have at least one filled bin."""
    bins = least.shape[1]
    out = least.copy()
    row, bin_ = np.nonzero((least == EMPTY) & (least != EMPTY).any(axis=1)[:, None])
    attempt = 0
    while len(row):
        drawn = least[row, _draws(bins, attempt)[bin_]]
        found = drawn != EMPTY
        out[row[found], bin_[found]] = drawn[found]
        row, bin_ = row[~found], bin_[~found]
        attempt += 1
    return out


def packed(texts: pa.Array, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints, one row of bytes per text, and which texts have a word at all."""
    hashes, row = shingles(words_of(texts), shape.words)
    full = densify(least_per_bin(mix(hashes), row, len(texts), shape.bins))
    some = full[:, 0] != EMPTY
    low = (mix(full) & np.uint64((1 << shape.bits) - 1)).astype(np.uint8)
    low[~some] = 0
    split = (low[:, :, None] >> np.arange(shape.bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(split.reshape(len(texts), -1), axis=1), some


def likeness(a: np.ndarray, b: np.ndarray, some_a, some_b, shape: Shape) -> np.ndarray:
    """Estimated Jaccard similarity of paired fingerprints, 0 to 1.

    Two texts without words are alike (1), one of them and any other are not (0).
    """
    per = 8 // shape.bits
    apart = a ^ b
    agree = np.zeros(len(a), dtype=np.int64)
    for i in range(per):
        agree += (((apart >> (i * shape.bits)) & ((1 << shape.bits) - 1)) == 0).sum(axis=1)
    chance = 0.5**shape.bits
    raw = np.clip((agree / shape.bins - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, raw, np.where(some_a == some_b, 1.0, 0.0))


def _hex(rows: np.ndarray, some: np.ndarray) -> list[str]:
    return [r.tobytes().hex() if s else "" for r, s in zip(rows, some)]


def fingerprint(
    docs: DataFrame, text: str = "text", out: str = "fingerprint", shape: Shape = Shape()
) -> DataFrame:
    """``docs`` and the packed fingerprint of each whole text, as lowercase hex, in ``out``.

    Null texts and texts without words have an empty fingerprint.  Texts shorter than a shingle
    have one shingle of all their words.  An older column ``out`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in pieces(batch.column(text)):
                part = batch.slice(start, stop - start)
                marks = pa.array(_hex(*packed(part.column(text), shape)), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, marks], names=[*part.schema.names, out]
                )

    docs = docs.drop(out)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def similarity(df: DataFrame, a: str, b: str, out: str = "similarity", shape: Shape = Shape()) -> DataFrame:
    """``df`` and the likeness of two fingerprint columns; null where either is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = shape.bins * shape.bits // 8
        for batch in batches:
            sides = []
            for name in (a, b):
                marks = batch.column(name).to_pylist()
                raw = b"".join(bytes.fromhex(m) if m else bytes(width) for m in marks)
                rows = np.frombuffer(raw, np.uint8).reshape(len(marks), width)
                sides.append((rows, np.array([bool(m) for m in marks], dtype=bool), marks))
            (x, some_x, mx), (y, some_y, my) = sides
            values = likeness(x, y, some_x, some_y, shape)
            gone = np.array([p is None or q is None for p, q in zip(mx, my)], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64(), mask=gone)],
                names=[*batch.schema.names, out],
            )

    df = df.drop(out)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def _bounds(docs: DataFrame, key: str, parts: int) -> list[int]:
    """Least keys of up to ``parts`` ranges of about as many rows; one number per range."""
    cuts = docs.agg(
        F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts).alias("cuts")
    ).first()["cuts"]
    return sorted(set(cuts or []))


def _range_of(key: str, bounds: list[int]):
    """The number of bounds that a key has reached, found by halving."""

    def half(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(key) < F.lit(bounds[middle]), half(low, middle)).otherwise(
            half(middle + 1, high)
        )

    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(half(0, len(bounds)))


def with_next(
    docs: DataFrame,
    work,
    schema: str,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Run ``work(keys, texts, next texts)`` over batches of rows and their successors by key.

    Rows ascend by key (null first, repeated keys by text); the first row follows the last.
    Rows are dealt once, by ranges of the key; the first row of a range also goes to the range
    before it, so nothing but those few rows travels twice.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    bounds = _bounds(rows, "key", max(2, parts))
    ranged = rows.withColumn("part", _range_of("key", bounds))
    # The first row of each range: one key, and among rows of that key the least text.
    firsts = ranged.groupBy("part").agg(F.min(F.struct("key")).alias("least")).orderBy("part").collect()
    if not firsts:
        return spark.createDataFrame([], schema)
    order = [r["part"] for r in firsts]
    to = {p: order[i - 1] for i, p in enumerate(order)}
    least = F.create_map(*[x for r in firsts for x in (F.lit(r["part"]), F.lit(r["least"]["key"]).cast("bigint"))])
    target = F.create_map(*[F.lit(x) for p in order for x in (p, to[p])])
    heads = ranged.where(F.col("key").eqNullSafe(least[F.col("part")])).groupBy("part").agg(
        F.min(F.struct("key", "text")).alias("head")
    )
    guests = heads.select(
        F.col("head.key").alias("key"),
        F.col("head.text").alias("text"),
        target[F.col("part")].alias("part"),
        F.lit(True).alias("guest"),
    )
    dealt = (
        ranged.withColumn("guest", F.lit(False))
        .unionByName(guests)
        .repartition(max(2, parts), "part")
        .sortWithinPartitions("part", "guest", "key", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: it waits for its successor
        for batch in batches:
            for start, stop in pieces(batch.column("text")):
                part = batch.slice(start, stop - start)
                table = pa.Table.from_batches([held, part] if held is not None else [part])
                whole = table.combine_chunks().to_batches()[0]
                held = whole.slice(whole.num_rows - 1)
                keep = np.flatnonzero(~whole.column("guest").to_numpy(zero_copy_only=False)[:-1])
                if len(keep):
                    yield work(
                        whole.column("key").take(pa.array(keep)),
                        whole.column("text").take(pa.array(keep)),
                        whole.column("text").take(pa.array(keep + 1)),
                    )

    return dealt.mapInArrow(run, schema)


def edited_fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Shape = Shape()
) -> DataFrame:
    """Fingerprints of every text and of its edit, whose second half is the next text's beginning.

    The last floor(n / 2) code points give way to the first as many (or all) of the next text by
    key.  Null texts are empty.
    """
    import hashlib

    def work(keys: pa.Array, texts: pa.Array, after: pa.Array) -> pa.RecordBatch:
        own = [t.as_py() or "" for t in texts]
        other = [t.as_py() or "" for t in after]
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, other)]
        marks, some = packed(pa.array(own, pa.large_string()), shape)
        edited_marks, edited_some = packed(pa.array(edited, pa.large_string()), shape)
        next_marks, next_some = packed(pa.array(other[-1:], pa.large_string()), shape)
        # The successor of a row is mostly the row below it, whose marks are there already.
        index = np.arange(1, len(own) + 1)
        below = np.concatenate([marks, next_marks])
        below_some = np.concatenate([some, next_some])
        apart = [i for i in range(len(own) - 1) if other[i] != own[i + 1]]
        if apart:
            marks_apart, some_apart = packed(pa.array([other[i] for i in apart], pa.large_string()), shape)
            below = np.concatenate([below, marks_apart])
            below_some = np.concatenate([below_some, some_apart])
            index[apart] = len(own) + 1 + np.arange(len(apart))
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(_hex(marks, some), pa.string()),
                pa.array(_hex(edited_marks, edited_some), pa.string()),
                pa.array(likeness(marks, edited_marks, some, edited_some, shape), pa.float64()),
                pa.array(likeness(marks, below[index], some, below_some[index], shape), pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return with_next(docs, work, schema, key, text)
