"""Byte-level BPE encoding and decoding with a public rank file.

A text longer than a chunk is cut into overlapping chunks that are pre-tokenised in parallel.
Two neighbouring chunks agree from the first pre-token boundary that both find in their overlap;
the text is cut there and the pieces are encoded on their own.  A text with an overlap in which
the chunks never agree (no word end for a whole overlap) is encoded in one piece, so results are
those of the whole text in every case.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.words import worker_cache

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
UNKNOWN = "�".encode()


def read_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The rank file, broadcast as it is: its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _ranks(raw: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in raw.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def _encoding(raw: bytes, pattern: str):
    import tiktoken

    cache, key = worker_cache(), ("bpe", hashlib.sha256(raw + pattern.encode()).digest())
    if key not in cache:
        cache[key] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=_ranks(raw), special_tokens={}
        )
    return cache[key]


def encode_piece(encoding, pattern: str, text: str) -> np.ndarray:
    """Ids of one piece; beyond the pattern engine's own limits pre-token by pre-token."""
    try:
        return encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    except BaseException as error:  # the native engine panics past its backtracking limit
        if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        import regex

        ids: list[int] = []
        for m in regex.finditer(pattern, text):
            ids += encoding._encode_single_piece(m[0])
        return np.array(ids, dtype=np.int32)


def _id_lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(found) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    values = np.concatenate(found) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), column], names=[*keep, name])


def _encode_rows(df: DataFrame, text: str, out: str, ranks: Broadcast, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        for whole in batches:
            for batch in _slices(whole):
                texts = (x.as_py() or "" for x in batch.column(text))
                yield _with(batch, out, _id_lists([encode_piece(encoding, pattern, x) for x in texts]))

    kept = [f for f in df.schema.fields if f.name != out]
    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def safe_boundaries(pattern: str, text: str, last: bool) -> list[int]:
    """Ends of pre-tokens between a non-blank and an ASCII blank.

    There the pattern reads the same on both sides whatever follows or precedes.  The last two
    pre-tokens of a cut-off chunk may have been cut and are left out.
    """
    import regex

    ends = [m.end() for m in regex.finditer(pattern, text)]
    if not last:
        ends = ends[:-2]
    return [p for p in ends if p < len(text) and text[p] in " \t\n\r" and not text[p - 1].isspace()]


def _chunked(df: DataFrame, key: str, text: str, pattern: str, size: int, overlap: int) -> DataFrame:
    """One row per chunk with the boundaries it finds in the overlap before and after it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in zip(batch.column(key).to_pylist(), batch.column(text)):
                whole = value.as_py()
                for n, start in enumerate(range(0, len(whole), size)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k], pa.string()),
                            pa.array([n], pa.int64()),
                            pa.array([start + size >= len(whole)]),
                            pa.array([whole[start : start + size + overlap]], pa.string()),
                        ],
                        names=["key", "n", "last", "chunk"],
                    )

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 64):
                before, after = [], []
                for n, last, chunk in zip(*(batch.column(c).to_pylist() for c in ("n", "last", "chunk"))):
                    found = safe_boundaries(pattern, chunk, last)
                    before.append([n * size + p for p in found if p < overlap])
                    after.append([n * size + p for p in found if p >= size])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("key", "n", "last", "chunk")),
                        pa.array(before, pa.list_(pa.int64())),
                        pa.array(after, pa.list_(pa.int64())),
                    ],
                    names=["key", "n", "last", "chunk", "before", "after"],
                )

    schema = "key string, n bigint, last boolean, chunk string"
    chunks = df.mapInArrow(cut, schema).repartition("key", "n")
    return chunks.mapInArrow(boundaries, f"{schema}, before array<bigint>, after array<bigint>")


def _encode_long(
    df: DataFrame, key: str, text: str, ranks: Broadcast, pattern: str, size: int, overlap: int
) -> DataFrame:
    """(key, ids) of long texts, by chunks stitched where they agree."""
    chunks = _chunked(df, key, text, pattern, size, overlap)
    by_text = Window.partitionBy("key").orderBy("n")
    cut = F.when(F.col("n") == 0, F.lit(0)).otherwise(
        F.array_min(F.array_intersect(F.lag("after").over(by_text), F.col("before")))
    )
    stitched = chunks.withColumn("cut", cut).select(
        "key",
        "n",
        "chunk",
        "cut",
        "last",
        F.lead("cut").over(by_text).alias("until"),
        F.max(F.col("cut").isNull()).over(Window.partitionBy("key")).alias("apart"),
    )
    # The first chunk counts from 1: substring() takes code points, as the cuts do.
    start = F.col("cut") - F.col("n") * size
    length = F.when(F.col("last"), F.length("chunk")).otherwise(F.col("until") - F.col("cut"))
    pieces = stitched.where("not apart").select(
        "key", "n", F.substring("chunk", (start + 1).cast("int"), length.cast("int")).alias("piece")
    )
    found = _encode_rows(pieces, "piece", "ids", ranks, pattern).select("key", "n", "ids")
    joined = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "ids"))).alias("all"))
    stitched_ids = joined.select("key", F.flatten(F.col("all.ids")).alias("ids"))
    apart = stitched.where("apart").select("key").distinct()
    whole = df.join(apart, df[key] == apart["key"], "left_semi").select(F.col(key).alias("key"), text)
    return stitched_ids.unionByName(_encode_rows(whole, text, "ids", ranks, pattern).select("key", "ids"))


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    out: str = "ids",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``docs`` and the token ids of each whole text in the array column ``out``.

    Null and empty texts have no ids; an older column ``out`` is replaced, other columns of any
    name stay; repeated rows stay repeated.  Equal long texts are encoded once.
    """
    if not 2 <= overlap_chars < chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk")
    ranks = read_ranks(docs.sparkSession, ranks_path)
    docs = docs.drop(out)
    is_long = F.coalesce(F.length(text) > chunk_chars, F.lit(False))
    short = _encode_rows(docs.where(~is_long), text, out, ranks, pattern)
    row, key = "_bpe_row", "_bpe_key"
    long = docs.where(is_long).select(F.struct("*").alias(row), F.sha2(text, 256).alias(key))
    texts = long.groupBy(key).agg(F.any_value(f"{row}.{text}").alias("whole"))
    ids = _encode_long(texts, key, "whole", ranks, pattern, chunk_chars, overlap_chars)
    back = long.join(ids.withColumnRenamed("key", key), key).select(f"{row}.*", F.col("ids").alias(out))
    return short.unionByName(back)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` and the bytes of its ids, joined as they are, in the binary column ``out``.

    A null list has no bytes; an id that the vocabulary lacks stands for U+FFFD.
    """
    ranks = read_ranks(df.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, raw = worker_cache(), ranks.value
        name = ("bytes", hashlib.sha256(raw).digest())
        if name not in cache:
            cache[name] = {rank: token for token, rank in _ranks(raw).items()}
        token = cache[name]
        for whole in batches:
            for batch in _slices(whole):
                bodies = [
                    b"".join([token.get(i, UNKNOWN) for i in (x.as_py() or ())])
                    for x in batch.column(ids)
                ]
                yield _with(batch, out, pa.array(bodies, pa.binary()))

    kept = [f for f in df.schema.fields if f.name != out]
    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.BinaryType())]))
