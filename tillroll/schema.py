"""Column names and types of the flat order table."""

from __future__ import annotations

from pyspark.sql import types as T

# The 17 columns of the raw order table, in file order.
RAW_COLUMNS = [
    "order_id",
    "order_date",
    "customer_id",
    "customer_segment",
    "region",
    "product_category",
    "product_name",
    "quantity",
    "unit_price",
    "discount_pct",
    "revenue",
    "cost",
    "profit",
    "payment_method",
    "shipping_type",
    "order_status",
    "customer_rating",
]

TIME_COLUMNS = ["order_year", "order_month", "order_quarter", "order_day_of_week", "order_week"]

CLEAN_COLUMNS = RAW_COLUMNS + TIME_COLUMNS

LABEL_COLUMNS = [
    "customer_segment",
    "region",
    "product_category",
    "product_name",
    "payment_method",
    "shipping_type",
    "order_status",
]

AMOUNT_COLUMNS = ["unit_price", "discount_pct", "revenue", "cost", "profit", "customer_rating"]

CORRELATED_COLUMNS = [
    "quantity",
    "unit_price",
    "discount_pct",
    "revenue",
    "cost",
    "profit",
    "customer_rating",
]

DESCRIBED_COLUMNS = CORRELATED_COLUMNS + [
    "order_year",
    "order_month",
    "order_quarter",
    "order_week",
]

# A raw file is read as text: what a cell means is decided by the cleaning step.
RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

_CLEAN_TYPES = {
    "order_date": T.DateType(),
    "quantity": T.IntegerType(),
    "order_year": T.IntegerType(),
    "order_month": T.IntegerType(),
    "order_quarter": T.IntegerType(),
    "order_week": T.IntegerType(),
    **{c: T.DoubleType() for c in AMOUNT_COLUMNS},
}

CLEAN_SCHEMA = T.StructType(
    [T.StructField(c, _CLEAN_TYPES.get(c, T.StringType())) for c in CLEAN_COLUMNS]
)

DELIVERED = "Delivered"
RETURNED = "Returned"
CANCELLED = "Cancelled"
