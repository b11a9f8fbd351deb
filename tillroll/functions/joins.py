"""Joins of a one-row-per-key frame to detail rows, some of whose keys are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import exprs

HOT_PARTS = 10_000
SALTS = 1000


def salted_left_join(
    rows: DataFrame, frame: DataFrame, key: str, size: str, spread: str, parts: int = HOT_PARTS
) -> DataFrame:
    """``rows`` with the columns of ``frame`` except its ``size``, the rows per key.

    The keys may be too many to broadcast, so the join shuffles.  A key with more than one
    part in ``parts`` of all rows is hot: there are fewer than ``parts`` of those, which are
    broadcast, and their rows, like rows without a key, are salted by the columns ``spread``
    past the shuffle join.  Adaptive execution cannot do this here: it leaves a join alone
    whose other side comes straight from an aggregate by the key.
    """
    values = [c for c in frame.columns if c not in (key, size)]
    total = rows.agg(*exprs(n="count(1)")).scalar()
    hot = (
        frame.withColumn("_total", total)
        .filter(f"{size} * {parts} > _total")
        .selectExpr(key, "true AS _hot", *[f"{c} AS _hot_{c}" for c in values])
    )
    salt = f"CASE WHEN _hot OR {key} IS NULL THEN 1 + pmod(xxhash64({spread}), {SALTS}) ELSE 0 END"
    salted = rows.join(F.broadcast(hot), key, "left").selectExpr("*", f"{salt} AS _salt")
    # Always 0, in a form that is not folded: a constant would drop out of the join keys.
    cold = frame.selectExpr(key, *values, f"cast({size} < 0 as bigint) AS _salt")
    return salted.join(cold, [key, "_salt"], "left").selectExpr(
        *rows.columns, *[f"coalesce(_hot_{c}, {c}) AS {c}" for c in values]
    )
