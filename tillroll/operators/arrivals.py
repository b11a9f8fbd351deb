"""Rows of a delivery that the stored table does not have yet.

Deliveries overlap: the last days come again.  A full comparison would shuffle the whole stored
table; a Bloom filter of the delivery's rows leaves the stored rows that may be among them, and only
those are compared, exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import exprs
from tillroll.sources.staging import staged

BITS_PER_ROW = 16
LARGEST_WORDS = 1 << 23  # 64 MB of filter, the most that is broadcast
SEGMENT = 4096  # words per row of the filter
_BITS = 4  # of each row, all in one word


def new_rows(delivery: DataFrame, stored: DataFrame, words: int | None = None) -> DataFrame:
    """The distinct rows of ``delivery`` that ``stored`` does not hold, in the delivery's columns.

    Missing cells equal each other, as do 0.0 and -0.0.  Copies within the delivery come out once;
    an empty stored table leaves the distinct delivery.  Both tables have the same columns; further
    ones of the stored table are not looked at.  The filter takes ``BITS_PER_ROW`` bits per distinct
    row of the delivery and at most 64 MB: beyond 33 million rows it lets more through, and no row is
    ever lost by it.
    """
    columns = delivery.columns
    once = staged(delivery.dropDuplicates(), "delivery")
    words = words or _words_for(once.count())
    seen = passing(stored.select(*columns), row_filter(once, words), words)
    # One aggregate compares and removes copies, combined before the shuffle: no key can be hot.
    both = once.withColumn("_stored", F.lit(False)).unionByName(seen.withColumn("_stored", F.lit(True)))
    return both.groupBy(*columns).agg(*exprs(_stored="bool_or(_stored)")).where("NOT _stored").select(*columns)


def _words_for(rows: int) -> int:
    wanted = max(SEGMENT, rows * BITS_PER_ROW // 64)
    return min(LARGEST_WORDS, 1 << (wanted - 1).bit_length())


def _hash(df: DataFrame) -> str:
    """Equal rows have equal hashes (``xxhash64`` tells 0.0 from -0.0)."""
    cells = [f"`{c}` + 0" if t in ("double", "float") else f"`{c}`" for c, t in df.dtypes]
    return f"xxhash64({', '.join(cells)})"


def _mask(h: str) -> str:
    # The low bits choose the word; six bits each from higher up choose the bits in it.
    return " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {36 + 6 * i}) & 63 as int))" for i in range(_BITS))


def row_filter(df: DataFrame, words: int) -> DataFrame:
    """A blocked Bloom filter as rows ``(segment, words)`` of ``SEGMENT`` longs; ``words`` a power of two."""
    marked = df.selectExpr(f"{_hash(df)} AS _h").selectExpr(f"_h & {words - 1}L AS word", f"{_mask('_h')} AS mask")
    blank = df.sparkSession.range(words).selectExpr("id AS word", "0L AS mask")
    filled = marked.unionByName(blank).groupBy("word").agg(*exprs(mask="bit_or(mask)"))
    packed = filled.groupBy(F.expr(f"word div {SEGMENT}").alias("segment")).agg(
        *exprs(words="transform(array_sort(collect_list(struct(word, mask))), x -> x.mask)")
    )
    return staged(packed, "filter")


def passing(df: DataFrame, segments: DataFrame, words: int) -> DataFrame:
    """The rows of ``df`` that may be among those the filter of so many words was made of."""
    hashed = df.selectExpr("*", f"{_hash(df)} AS _h").selectExpr("*", f"_h & {words - 1}L AS _word")
    hashed = hashed.selectExpr(*df.columns, f"_word div {SEGMENT} AS _segment", f"_word % {SEGMENT} AS _at", f"{_mask('_h')} AS _mask")
    named = segments.selectExpr("segment AS _segment", "words AS _words")
    joined = hashed.join(F.broadcast(named), "_segment")  # at most 64 MB
    return joined.where("(_words[cast(_at as int)] & _mask) = _mask").select(*df.columns)
