"""The data under each dashboard chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import exprs, int_sum
from tillroll.functions.text import dollars, in_millions, in_thousands
from tillroll.operators.profile import with_share
from tillroll.operators.reports import (
    correlation_pairs,
    delivered,
    monthly_trend,
    payment_analysis,
    revenue_by_category,
    revenue_by_region,
    revenue_by_segment,
)

# Heatmap columns.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def monthly_revenue_trend(df: DataFrame, months: int = 3) -> DataFrame:
    """Monthly revenue with its moving average; early months average what there is.

    The window is unpartitioned on purpose: its input is one row per calendar month.
    """
    trailing = f"(ORDER BY order_year, order_month ROWS {months - 1} PRECEDING)"
    total = f"sum(cast(total_revenue as decimal(28, 9))) OVER {trailing}"
    return (
        monthly_trend(df)
        .selectExpr(
            "month_label",
            "total_revenue",
            f"cast({total} as double) / count(1) OVER {trailing} AS revenue_ma{months}",
        )
        .orderBy("month_label")
    )


def category_bars(df: DataFrame) -> DataFrame:
    """Categories by revenue, smallest first, with bar labels."""
    return (
        revenue_by_category(df)
        .selectExpr(
            "product_category",
            "total_revenue",
            "avg_revenue",
            f"{dollars('total_revenue')} AS revenue_label",
        )
        .orderBy("total_revenue", "product_category")
    )


def region_panel(df: DataFrame) -> DataFrame:
    """Revenue, order value and orders per region, with axis labels."""
    return revenue_by_region(df).selectExpr(
        "region",
        "total_revenue",
        f"{in_millions('total_revenue')} AS revenue_label",
        "avg_order_value",
        f"{dollars('avg_order_value')} AS order_value_label",
        "total_orders",
        f"{in_thousands('total_orders')} AS orders_label",
    )


def correlation_lower(df: DataFrame) -> DataFrame:
    """The cells below the diagonal of the correlation matrix."""
    return correlation_pairs(df).filter("ord_a > ord_b").orderBy("ord_a", "ord_b")


def segment_panel(df: DataFrame) -> DataFrame:
    """Pie slices of revenue, order value and orders per segment."""
    return with_share(revenue_by_segment(df), "total_revenue", "share_pct", 1).select(
        "customer_segment", "share_pct", "avg_order_value", "total_orders"
    )


def payment_panel(df: DataFrame) -> DataFrame:
    """Donut slices of orders, and order value, per payment method."""
    return with_share(payment_analysis(df), "total_orders", "share_pct", 1).select(
        "payment_method", "share_pct", "avg_order_value"
    )


def top_products(df: DataFrame, n: int = 15) -> DataFrame:
    """The products with most units sold."""
    return (
        delivered(df)
        .filter("product_name IS NOT NULL")
        .groupBy("product_name")
        .agg(*exprs(units_sold=int_sum("quantity")))
        .orderBy(F.desc("units_sold"), "product_name")
        .limit(n)
    )


def orders_heatmap(df: DataFrame) -> DataFrame:
    """Orders per region and calendar month; months without orders show 0."""
    months = {
        name: f"count(CASE WHEN order_month = {i} THEN order_id END)"
        for i, name in enumerate(MONTH_NAMES, 1)
    }
    return (
        delivered(df)
        .filter("region IS NOT NULL AND order_month IS NOT NULL")
        .groupBy("region")
        .agg(*exprs(**months))
        .orderBy("region")
    )


def run_charts(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "monthly_revenue_trend": monthly_revenue_trend(df),
        "category_bars": category_bars(df),
        "region_panel": region_panel(df),
        "correlation_lower": correlation_lower(df),
        "segment_panel": segment_panel(df),
        "payment_panel": payment_panel(df),
        "top_products": top_products(df),
        "orders_heatmap": orders_heatmap(df),
    }
