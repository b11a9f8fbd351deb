"""Data-quality profile of a table, and share, peak and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import amount_of, exprs, joined, percent, rounded, summed_parts
from tillroll.functions.text import dollars, percent_text
from tillroll.operators.cleaning import CHECKED_COLUMNS
from tillroll.operators.reports import (
    QUARTILES,
    correlation_pairs,
    describe_numbers,
    grouped_once,
    groups_of,
    monthly_trend,
    payment_analysis,
    revenue_by_category,
    revenue_by_region,
    revenue_by_segment,
)
from tillroll.schema import CANCELLED, CORRELATED_COLUMNS, DELIVERED, RETURNED


def raw_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns and rows that repeat an earlier one."""
    return (
        df.groupBy(*df.columns)
        .agg(*exprs(_copies="count(1)"))
        .agg(
            *exprs(
                row_count="coalesce(sum(_copies), 0)",
                column_count=str(len(df.columns)),
                duplicate_rows="coalesce(sum(_copies - 1), 0)",
            )
        )
    )


def _null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = {c: f"count_if(`{c}` IS NULL)" for c in columns}
    return df.agg(*exprs(_rows="count(1)", **counts)).unpivot(
        ["_rows"], columns, "column_name", "nulls"
    )


def null_report(df: DataFrame) -> DataFrame:
    """Columns with empty cells: count and percent, most first."""
    return (
        _null_counts(df, df.columns)
        .filter("nulls > 0")
        .selectExpr("column_name", "nulls", f"{rounded(percent('nulls', '_rows'))} AS pct")
        .orderBy(F.desc("nulls"), "column_name")
    )


def critical_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _null_counts(df, columns or CHECKED_COLUMNS).select("column_name", "nulls")


def column_types(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of every column."""
    cells = [f"{i}, '{c}', '{t}', `{c}`" for i, (c, t) in enumerate(df.dtypes)]
    return df.agg(*exprs(**{c: f"count(`{c}`)" for c in df.columns})).selectExpr(
        f"stack({len(cells)}, {', '.join(cells)}) AS (position, column_name, data_type, non_null)"
    )


def raw_describe(df: DataFrame) -> DataFrame:
    """Count, mean, std, extremes and quartiles of the numeric columns."""
    numeric = [c for c in CORRELATED_COLUMNS if c in df.columns]
    typed = df.selectExpr(*[f"try_cast({c} as double) AS {c}" for c in numeric])
    return describe_numbers(typed, numeric, QUARTILES, shape=False)


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = 10) -> DataFrame:
    """The most frequent values of some columns, ranked within each.

    Spark cuts every partition to ``n`` rows per column before it brings a column together.
    """
    columns = columns or ["product_category", "region", "customer_segment"]
    return (
        df.select(*columns)
        .unpivot([], columns, "column_name", "value")
        .filter("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(*exprs(n="count(1)"))
        .selectExpr(
            "column_name",
            "row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank",
            "value",
            "n",
        )
        .filter(F.col("rank") <= n)
    )


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


# Shares


def with_share(report: DataFrame, measure: str, name: str, digits: int = 2) -> DataFrame:
    """Each row's part of the whole; the whole is a subquery over the same small report."""
    whole = report.agg(F.sum(measure)).scalar()
    return report.withColumn("_whole", whole).selectExpr(
        *report.columns, f"{rounded(percent(measure, '_whole'), digits)} AS {name}"
    )


def market_share(df: DataFrame) -> DataFrame:
    shares = with_share(revenue_by_category(df), "total_revenue", "market_share_pct")
    return shares.select("product_category", "total_revenue", "market_share_pct")


def regional_share(df: DataFrame) -> DataFrame:
    shares = with_share(revenue_by_region(df), "total_revenue", "regional_share_pct")
    return shares.select("region", "total_revenue", "regional_share_pct")


def segment_value_share(df: DataFrame) -> DataFrame:
    shares = with_share(revenue_by_segment(df), "total_revenue", "value_share_pct")
    return shares.select("customer_segment", "total_revenue", "value_share_pct")


def payment_share(df: DataFrame) -> DataFrame:
    shares = with_share(payment_analysis(df), "total_orders", "order_share_pct")
    return shares.select("payment_method", "total_orders", "order_share_pct")


# Strongest correlations, overall rates, peak months, summary


def revenue_correlations(df: DataFrame, n: int = 3) -> DataFrame:
    """The columns most positively correlated with revenue."""
    return (
        correlation_pairs(df)
        .filter("col_a = 'revenue' AND col_b <> 'revenue'")
        .orderBy(F.desc_nulls_last("r"), "ord_b")
        .limit(n)
        .selectExpr("col_b AS column_name", "r")
    )


def overall_rates(df: DataFrame) -> DataFrame:
    return df.agg(
        *exprs(
            total_orders="count(1)",
            returned=f"count_if(order_status = '{RETURNED}')",
            cancelled=f"count_if(order_status = '{CANCELLED}')",
            delivered=f"count_if(order_status = '{DELIVERED}')",
        )
    ).selectExpr(
        "*",
        f"{rounded(percent('returned', 'total_orders'))} AS return_pct",
        f"{rounded(percent('cancelled', 'total_orders'))} AS cancel_pct",
    )


def peak_and_low_month(df: DataFrame) -> DataFrame:
    """Best and worst month by revenue; the earlier one on a tie."""
    found = "struct(month_label, total_revenue)"
    return (
        monthly_trend(df)
        .agg(
            *exprs(
                peak=f"min_by({found}, struct(-total_revenue, month_label))",
                low=f"min_by({found}, struct(total_revenue, month_label))",
            )
        )
        .selectExpr(
            "peak.month_label AS peak_month",
            "peak.total_revenue AS peak_revenue",
            "low.month_label AS low_month",
            "low.total_revenue AS low_revenue",
        )
    )


def summary_metrics(df: DataFrame) -> DataFrame:
    """Ten headline values: ``(metric_no, metric, value_num, value_str)``, from one scan.

    ``value_str`` is the display text; ``value_num`` the number under it, if any.
    """
    groups = grouped_once(df, ["all", "month", "region", "category"])

    def leading(kind: str, order: str):
        report = groups_of(groups, kind, "name")
        return report.agg(*exprs(leader=f"min_by(name, struct({order}, name))")).scalar()

    counts = ("rows", "earning", "returned_rows", "cancelled_rows")
    totals = (
        groups.filter("kind = 'all'")
        # One row, for an empty table too.
        .agg(*exprs(**{c: f"coalesce(sum({c}), 0)" for c in counts}, **summed_parts("revenue", "profit")))
        .selectExpr(
            "rows AS orders",
            f"{amount_of('revenue')} AS revenue",
            f"{rounded(f'try_divide({joined("revenue_units", "revenue_nanos")}, earning)')} AS aov",
            f"{amount_of('profit')} AS profit",
            f"{rounded(percent(amount_of('profit'), amount_of('revenue')), 1)} AS margin",
            f"{rounded(percent('returned_rows', 'rows'))} AS return_pct",
            f"{rounded(percent('cancelled_rows', 'rows'))} AS cancel_pct",
        )
        .withColumns(
            {
                "top_region": leading("region", "-total_revenue"),
                "top_category": leading("category", "-total_revenue"),
                "peak_month": leading("month", "-total_revenue"),
            }
        )
    )
    rows = [
        ("Total Orders", "orders", "format_string('%,d', orders)"),
        ("Total Revenue", "revenue", dollars("revenue", 2)),
        ("Average Order Value", "aov", dollars("aov", 2)),
        ("Total Profit", "profit", dollars("profit", 2)),
        ("Average Profit Margin", "margin", percent_text("margin", 1)),
        ("Return Rate", "return_pct", percent_text("return_pct", 2)),
        ("Cancellation Rate", "cancel_pct", percent_text("cancel_pct", 2)),
        ("Top Region", "null", "top_region"),
        ("Top Category", "null", "top_category"),
        ("Peak Month", "null", "peak_month"),
    ]
    cells = ", ".join(
        f"{i}, '{name}', cast({number} as double), {shown}"
        for i, (name, number, shown) in enumerate(rows, 1)
    )
    return totals.selectExpr(
        f"stack({len(rows)}, {cells}) AS (metric_no, metric, value_num, value_str)"
    )
