"""Known defects put into a clean order table, for testing a cleaning job at any size.

Which row gets which defect depends only on a whole-number key from 0 to 999 per row, so
the result is the same on every run and partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.text import quoted
from tillroll.schema import CANCELLED, RETURNED

Slice = tuple[int, int]


@dataclass(frozen=True)
class DefectRates:
    """Slices of the key (both ends included), in thousandths of the rows."""

    rating_null: Slice = (0, 29)
    discount_null: Slice = (30, 49)
    region_null: Slice = (50, 64)
    shipping_null: Slice = (65, 74)
    category_upper: Slice = (75, 84)
    category_lower: Slice = (85, 90)
    region_lower: Slice = (91, 94)
    region_trailing_space: Slice = (95, 97)
    duplicated: Slice = (200, 209)
    # Of ten returned or cancelled orders, this many lose their sign.
    negated_tenths: int = 3
    # Region names that replace whatever the row held, by slice.
    region_values: dict[str, Slice] = field(default_factory=dict)
    # False: copies are made last and stay equal.  True: signs flip after copying, by a key
    # of their own, so that a copy may differ from its original.
    negate_after_copying: bool = False


def defect_key(id_column: str = "order_id", salt: str = "defect") -> str:
    """A spread of 0 to 999 over the ids."""
    return f"pmod(xxhash64({id_column}, '{salt}'), 1000)"


def _negated(df: DataFrame, key: str, tenths: int) -> DataFrame:
    flip = f"order_status IN ('{RETURNED}', '{CANCELLED}') AND pmod({key}, 10) < {tenths}"
    return df.selectExpr(
        *[
            f"CASE WHEN {flip} THEN -abs({c}) ELSE {c} END AS {c}"
            if c in ("revenue", "profit")
            else c
            for c in df.columns
        ]
    )


def inject_defects(
    df: DataFrame, key: str = "defect_key", rates: DefectRates = DefectRates()
) -> DataFrame:
    """Empty cells, odd spellings, negative amounts, text dates and repeated rows.

    ``key`` names a column of ``df`` with the row's key; it is not part of the result.
    """

    def within(part: Slice) -> str:
        return f"{key} BETWEEN {part[0]} AND {part[1]}"

    def emptied(c: str, part: Slice) -> str:
        return f"CASE WHEN NOT ({within(part)}) THEN {c} END"

    region = emptied("region", rates.region_null)
    region = (
        f"CASE WHEN {within(rates.region_lower)} THEN lower({region}) "
        f"WHEN {within(rates.region_trailing_space)} THEN concat({region}, ' ') "
        f"ELSE {region} END"
    )
    for name, part in rates.region_values.items():
        region = f"CASE WHEN {within(part)} THEN {quoted(name)} ELSE {region} END"
    dirty = {
        "customer_rating": emptied("customer_rating", rates.rating_null),
        "discount_pct": emptied("discount_pct", rates.discount_null),
        "shipping_type": emptied("shipping_type", rates.shipping_null),
        "region": region,
        "product_category": f"CASE WHEN {within(rates.category_upper)} "
        f"THEN upper(product_category) WHEN {within(rates.category_lower)} "
        "THEN lower(product_category) ELSE product_category END",
        "order_date": "date_format(order_date, 'yyyy-MM-dd')",
    }
    out = df.selectExpr(*[f"{dirty.get(c, c)} AS {c}" for c in df.columns])
    if not rates.negate_after_copying:
        out = _negated(out, key, rates.negated_tenths)
    # One pass: a row of the copied slice is emitted twice.
    out = out.selectExpr(
        "*",
        f"explode(CASE WHEN {within(rates.duplicated)} THEN array(0, 1) ELSE array(0) END) AS _copy",
    )
    if rates.negate_after_copying:
        out = _negated(out, f"({key} * 7 + _copy * 3)", rates.negated_tenths)
    return out.drop(key, "_copy")


def shuffle_rows(df: DataFrame, id_column: str = "order_id") -> DataFrame:
    """Rows in an order that has nothing to do with their ids."""
    return df.orderBy(F.expr(f"xxhash64({id_column}, 'shuffle')"), id_column)
