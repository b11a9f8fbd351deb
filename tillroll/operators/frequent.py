"""The most frequent values of columns with very many of them, such as ids.

A full count shuffles one row per distinct value.  Here bounded sketches of frequent items, merged
in two levels, name the values that can be frequent, and only those are counted.  The counts prove
the answer or they don't; a column without proof is counted in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import exprs
from tillroll.sources.staging import staged

TRACKED = 12_288  # items a sketch keeps; three quarters of its slots
SLOTS = 16_384
# A sketch of S slots errs by at most 3.5 / S of its rows and names every value of more than twice that.
NAMED_ABOVE = 7
MERGED_FIRST = 256  # sketches that the second level merges at most, however many partitions there are


def frequent_values(df: DataFrame, columns: Sequence[str], n: int = 10, tracked: int = TRACKED) -> DataFrame:
    """Exactly the ``n`` most frequent values of each column: ``(column_name, rank, value, n, proven)``.

    Ties go to the smaller value, missing values do not count; a column without values has no rows.
    Sketches name up to ``tracked`` values of a column and these are counted exactly.  The n-th of
    them proves the answer if it is above ``NAMED_ABOVE / slots`` of the rows, since the sketch names
    all such values, or if the rows not counted are fewer than it.  Columns without such proof, as
    those whose values are all about as frequent, are counted in full (``proven`` false).  Reads the
    table twice, and once more for the columns without proof; runs when called.
    """
    slots = SLOTS if tracked == TRACKED else 1 << max(3, -(-tracked * 4 // 3) - 1).bit_length()
    cells = _cells(df, columns)
    firsts = cells.selectExpr("*", f"pmod(spark_partition_id(), {MERGED_FIRST}) AS _part").groupBy("column_name", "_part")
    firsts = firsts.agg(*exprs(total="count(1)", likely=f"approx_top_k_accumulate(value, {tracked})"))
    merged = firsts.groupBy("column_name").agg(
        *exprs(total="sum(total)", likely=f"approx_top_k_estimate(approx_top_k_combine(likely, {tracked}), {tracked})")
    )
    merged = staged(merged, "likely")
    likely = merged.selectExpr("column_name", "explode(likely.item) AS value")
    # At most ``tracked`` rows a column.
    counted = staged(_counts(cells.join(F.broadcast(likely), ["column_name", "value"])), "counted")
    best = _ranked(counted, n)
    proof = (
        merged.select("column_name", "total")
        .join(counted.groupBy("column_name").agg(*exprs(covered="sum(n)")), "column_name", "left")
        .join(best.filter(f"rank = {n}").selectExpr("column_name", "n AS last"), "column_name", "left")
        .selectExpr(
            "column_name",
            f"coalesce(last * {slots} > total * {NAMED_ABOVE}, false) "
            "OR total - coalesce(covered, 0) < coalesce(last, 1) AS proven",
        )
    )
    known = {row["column_name"] for row in proof.filter("proven").collect()}  # one row per column
    unproven = [c for c in columns if c not in known]
    found = best.filter(F.col("column_name").isin(*known)).withColumn("proven", F.lit(True))
    if unproven:
        rest = _ranked(_counts(_cells(df, unproven)), n)
        found = found.unionByName(rest.withColumn("proven", F.lit(False)))
    return found


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], list(columns), "column_name", "value").filter("value IS NOT NULL")


def _counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("column_name", "value").agg(*exprs(n="count(1)"))


def _ranked(counts: DataFrame, n: int) -> DataFrame:
    rank = "row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank"
    return counts.selectExpr("column_name", rank, "value", "n").filter(F.col("rank") <= n)
