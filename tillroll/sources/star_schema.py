"""The flat order table as a view over a retail star schema.

Only the joins that the wanted columns need are planned: every order line has exactly
one order, customer, part, nation and region, so leaving a dimension out keeps all
rows.  No join is hinted; the sizes that Spark sees decide between broadcast and
shuffle, and adaptive execution splits a hot customer or part.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.cleaning import TIME_FEATURES
from tillroll.schema import RAW_COLUMNS, TIME_COLUMNS

# Declared, so that planning a query does not open the files first.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, "
    "l_linestatus string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_type string",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

_NEEDS_ORDERS = {"order_date", "customer_id", "payment_method", "order_status", *TIME_COLUMNS}
_NEEDS_CUSTOMER = {"customer_segment", "region"}
_NEEDS_PART = {"product_category", "product_name"}

# List price less the discount, and 40 to 70 % of that by part and supplier, in cents.
_REVENUE_CENTS = (
    "cast(floor((round(l_extendedprice * 100) * (100 - round(l_discount * 100) * 3) + 50) "
    "/ 100) as bigint)"
)
_COST_CENTS = (
    "cast(floor(cast(_revenue * (40 + (l_partkey * 7 + l_suppkey) % 31) + 50 as double) "
    "/ 100) as bigint)"
)

COLUMNS = {
    "order_id": "concat('ORD-', cast(l_orderkey as string), '-', cast(l_linenumber as string))",
    "order_date": "cast(o_orderdate as date)",
    "customer_id": "concat('CUST-', cast(o_custkey as string))",
    "customer_segment": "c_mktsegment",
    "region": "r_name",
    "product_category": "p_type",
    "product_name": "p_name",
    "quantity": "cast(l_quantity as int)",
    "unit_price": "l_extendedprice / l_quantity",
    "discount_pct": "round(l_discount * 100) * 3",
    "revenue": "_revenue / 100D",
    "cost": "_cost / 100D",
    "profit": "(_revenue - _cost) / 100D",
    "payment_method": "o_orderpriority",
    "shipping_type": "l_linestatus",
    "order_status": "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'Returned' "
    "WHEN l_returnflag = 'A' AND o_orderstatus = 'P' THEN 'Cancelled' "
    "WHEN l_returnflag = 'A' AND o_orderstatus = 'O' THEN 'Processing' ELSE 'Delivered' END",
    "customer_rating": "cast(10 + (l_orderkey * 13 + l_linenumber * 7) % 41 as double) / 10D",
    "defect_key": "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1000",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Order lines in the clean shape; ``columns`` limits both the output and the joins."""
    wanted = list(columns) if columns is not None else RAW_COLUMNS + TIME_COLUMNS
    needs = set(wanted)
    lines = read_table(spark, sf_dir, "lineitem")
    if needs & _NEEDS_PART:
        part = read_table(spark, sf_dir, "part")
        lines = lines.join(part, F.expr("l_partkey = p_partkey"))
    if needs & (_NEEDS_ORDERS | _NEEDS_CUSTOMER):
        orders = read_table(spark, sf_dir, "orders")
        if needs & _NEEDS_CUSTOMER:
            customer = read_table(spark, sf_dir, "customer")
            if "region" in needs:
                nation = read_table(spark, sf_dir, "nation")
                region = read_table(spark, sf_dir, "region")
                named = nation.join(region, F.expr("n_regionkey = r_regionkey"))
                customer = customer.join(named, F.expr("c_nationkey = n_nationkey"))
            orders = orders.join(customer, F.expr("o_custkey = c_custkey"))
        lines = lines.join(orders, F.expr("l_orderkey = o_orderkey"))

    if needs & {"revenue", "cost", "profit"}:
        lines = lines.selectExpr("*", f"{_REVENUE_CENTS} AS _revenue")
    if needs & {"cost", "profit"}:
        lines = lines.selectExpr("*", f"{_COST_CENTS} AS _cost")
    timed = [c for c in wanted if c in TIME_COLUMNS]
    plain = [c for c in wanted if c not in TIME_COLUMNS]
    if not timed:
        return lines.selectExpr(*[f"{COLUMNS[c]} AS {c}" for c in plain])
    if "order_date" not in plain:
        plain.append("order_date")
    view = lines.selectExpr(*[f"{COLUMNS[c]} AS {c}" for c in plain])
    return view.selectExpr(
        *[f"{TIME_FEATURES[c]} AS {c}" if c in TIME_FEATURES else c for c in wanted]
    )
