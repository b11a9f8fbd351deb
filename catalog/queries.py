"""Every operator as a query over the given star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.numeric import exprs, money_sum, rounded
from tillroll.operators import (
    arrivals,
    charts,
    cleaning,
    cohorts,
    defects,
    frequent,
    insights,
    moments,
    pricing,
    profile,
    reports,
    synth,
)
from tillroll.schema import CORRELATED_COLUMNS, RAW_COLUMNS
from tillroll.sources import by_customer, files
from tillroll.sources.staging import shared_folder, staged
from tillroll.sources.star_schema import read_table, sales

Query = Callable[[SparkSession, str], DataFrame]

# The two named segments of the tables at hand.
HIGH_VALUE, HIGH_VOLUME = "BUILDING", "MACHINERY"
FIRST_DATE, LAST_DATE = "1995-01-01", "2001-12-31"

MONTH = ["order_year", "order_month"]
COHORT = ["customer_id", "order_date", "order_status", "revenue"]
SUMMARISED = [*MONTH, "order_id", "order_status", "region", "product_category", "revenue", "profit"]
ANSWERED = [
    "order_year",
    "order_id",
    "order_status",
    "region",
    "product_category",
    "customer_segment",
    "payment_method",
    "discount_pct",
    "revenue",
    "profit",
]
PRICED = [
    "order_id",
    "product_category",
    "order_status",
    "unit_price",
    "quantity",
    "revenue",
    "profit",
    "discount_pct",
]


FOUND = list(dict.fromkeys([*ANSWERED, *PRICED, *COHORT, "customer_rating"]))


def over_sales(operator: Callable[..., DataFrame], columns: list[str] | None = None, **options):
    """An operator over the sales view, reading no more than the columns it uses."""
    return lambda spark, sf_dir: operator(sales(spark, sf_dir, columns), **options)


def over_table(operator: Callable[..., DataFrame], columns: list[str] | None = None, **options):
    """An operator that reads its input several times: the joined view is written once, and
    the passes read it with their own columns and filters."""
    return lambda spark, sf_dir: operator(
        staged(sales(spark, sf_dir, columns), "sales"), **options
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales with known defects."""
    keyed = sales(spark, sf_dir, [*RAW_COLUMNS, "defect_key"])
    return defects.inject_defects(keyed)


def over_raw(operator: Callable[..., DataFrame], **options):
    return lambda spark, sf_dir: operator(raw_orders(spark, sf_dir), **options)


def over_raw_table(operator: Callable[..., DataFrame], **options):
    """Likewise for several passes over the raw orders."""
    return lambda spark, sf_dir: operator(staged(raw_orders(spark, sf_dir), "raw"), **options)


def after(*steps: Callable[[DataFrame], DataFrame]):
    """Cleaning steps in a row."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def matrix(operator: Callable[..., DataFrame], columns: list[str]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dates = sales(spark, sf_dir, ["order_date"])
        return operator(sales(spark, sf_dir, columns), ages=cohorts.possible_ages(dates))

    return run


def validated(raw: DataFrame) -> DataFrame:
    return cleaning.validate(cleaning.clean(raw), FIRST_DATE, LAST_DATE)


def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic order per order of the table, numbered by its key."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    numbers = orders.agg(F.expr("max(o_orderkey) + 1 AS n")).scalar()
    return synth.orders_for(orders, numbers, "o_orderkey")


# Sources and sinks: what was written is read back.


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV lines, some of them damaged: how many are kept and why others are not."""
    keyed = sales(spark, sf_dir, [*RAW_COLUMNS, "defect_key"])
    cells = keyed.select("defect_key", *[F.col(c).cast("string").alias(c) for c in RAW_COLUMNS])
    line = "to_csv(struct({}))"
    whole, cut = line.format(", ".join(RAW_COLUMNS)), line.format(", ".join(RAW_COLUMNS[:14]))
    damaged = (
        f"CASE WHEN defect_key BETWEEN 300 AND 309 THEN {cut} WHEN defect_key BETWEEN 310 AND 319 "
        f"THEN concat({whole}, ',extra') WHEN defect_key BETWEEN 320 AND 324 THEN concat('\"', {whole}) "
        f"ELSE {whole} END AS value"
    )
    path = fresh_folder(spark, "damaged")
    cells.selectExpr(damaged).write.text(path)
    orders, rejected = files.read_checked_csv(spark, path, header=False)
    kept = cleaning.fix_data_types(orders).agg(*exprs(rows="count(1)", revenue=money_sum("revenue")))
    kept = kept.selectExpr("'kept' AS outcome", "rows", "revenue")
    left = rejected.groupBy("reason").agg(*exprs(rows="count(1)"))
    return kept.unionByName(left.selectExpr("reason AS outcome", "rows", "cast(null as double) AS revenue"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw orders written as CSV and read again."""
    path = fresh_folder(spark, "raw-csv")
    files.write_csv(raw_orders(spark, sf_dir), path)
    return cleaning.fix_data_types(files.read_raw_csv(spark, path))


def month_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in folders by month, the first month then written again with its delivered ones."""
    path = fresh_folder(spark, "months")
    orders = sales(spark, sf_dir, ["order_id", "order_date", "order_status", "revenue"])
    files.write_months(orders, path)
    first = files.read_months(spark, path).agg(F.date_format(F.min("order_date"), "yyyy-MM")).first()[0]
    again = files.read_months(spark, path, first, first).filter("order_status = 'Delivered'")
    files.write_months(staged(again, "first-month"), path)
    return files.read_months(spark, path).groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(
        *exprs(orders="count(1)", revenue=money_sum("revenue"))
    )


def summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary metrics as the CSV that a run leaves, read again."""
    path = fresh_folder(spark, "summary-csv")
    metrics = profile.summary_metrics(sales(spark, sf_dir, SUMMARISED)).orderBy("metric_no")
    files.write_csv(metrics.selectExpr("metric AS Metric", "value_str AS Value"), path)
    return spark.read.schema("Metric string, Value string").option("header", True).csv(path)


def customers_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers per year and segment, from kept monthly sketches and exactly, and if they are near."""
    columns = ["customer_id", "customer_segment", "order_date", "order_status"]
    kept = staged(cohorts.customer_sketches(sales(spark, sf_dir, columns)), "customer-sketches")
    found = cohorts.distinct_customers(kept, ["customer_segment"], year="cast(left(month, 4) as int)")
    exact = reports.delivered(sales(spark, sf_dir, columns)).groupBy(
        F.year("order_date").alias("year"), "customer_segment"
    )
    exact = exact.agg(F.count_distinct("customer_id").alias("customers"))
    near = "abs(estimate - customers) <= 0.05D * customers AS near"
    return found.join(exact, ["year", "customer_segment"]).selectExpr("year", "customer_segment", "customers", near)


def frequent_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent customers and products."""
    columns = ["customer_id", "product_name"]
    found = frequent.frequent_values(staged(sales(spark, sf_dir, columns), "sales"), columns)
    return found.drop("proven")


# The last months of the stored table come again with a delivery.
DELIVERED_FROM, STORED_UNTIL = "2000-01-01", "2000-07-01"


def new_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a delivery of raw orders that the stored ones lack."""
    raw = staged(raw_orders(spark, sf_dir), "raw")
    return arrivals.new_rows(
        raw.filter(f"order_date >= '{DELIVERED_FROM}'"), raw.filter(f"order_date < '{STORED_UNTIL}'")
    )


def correlation_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlation matrix of delivered orders from moments kept per day."""
    rows = reports.delivered(sales(spark, sf_dir, ["order_date", "order_status", *CORRELATED_COLUMNS]))
    kept = staged(moments.pair_moments(rows, moments.all_pairs(CORRELATED_COLUMNS), ["order_date"]), "pairs")
    return moments.correlation_table(moments.merged_pairs(kept), CORRELATED_COLUMNS)


def shape_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, skewness and kurtosis from moments kept per day, merged by month and again."""
    rows = sales(spark, sf_dir, ["order_date", *CORRELATED_COLUMNS])
    kept = staged(moments.shape_moments(rows, CORRELATED_COLUMNS, ["order_date"]), "shapes")
    monthly = kept.selectExpr("date_format(order_date, 'yyyy-MM') AS month", *[c for c in kept.columns if c != "order_date"])
    return moments.shapes(moments.merged_shapes(moments.merged_shapes(monthly, ["month"])))


def price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log quantity on log price per category, a line fitted from moments kept per day."""
    columns = ["order_date", "order_status", "product_category", "unit_price", "quantity"]
    rows = reports.delivered(sales(spark, sf_dir, columns))
    pair = {"price|quantity": ("ln(unit_price)", "ln(quantity)")}
    kept = staged(moments.pair_moments(rows, pair, ["order_date", "product_category"]), "lines")
    fitted = moments.lines(moments.merged_pairs(kept, ["product_category"]))
    return fitted.selectExpr(
        "product_category", "n", f"{rounded('slope', 4)} AS slope", f"{rounded('r2', 4)} AS r_squared"
    )


def by_bucket(operator: Callable[..., DataFrame], columns: list[str]) -> Query:
    """An operator over orders stored in buckets by customer."""
    return lambda spark, sf_dir: operator(by_customer.store_by_customer(sales(spark, sf_dir, columns)))


_category = ["product_category", "order_status", "revenue", "order_id", "quantity", "customer_rating"]
_region = ["region", "order_status", "revenue", "order_id", "profit", "discount_pct"]
_segment = [
    "customer_segment",
    "order_status",
    "revenue",
    "order_id",
    "customer_rating",
    "discount_pct",
]
_payment = ["payment_method", "order_status", "revenue", "order_id", "discount_pct"]
_trend = [*MONTH, "order_status", "revenue", "profit", "order_id"]
_discount = ["discount_pct", "order_status", "revenue", "profit", "order_id"]
_returns = ["product_category", "order_status", "order_id"]
_numbers = ["order_status", *CORRELATED_COLUMNS]
_named_segments = {"high_value": HIGH_VALUE, "high_volume": HIGH_VOLUME}

QUERIES: dict[str, Query] = {
    # Grouped reports and statistics
    "revenue_by_category": over_sales(reports.revenue_by_category, _category),
    "revenue_by_region": over_sales(reports.revenue_by_region, _region),
    "revenue_by_segment": over_sales(reports.revenue_by_segment, _segment),
    "payment_analysis": over_sales(reports.payment_analysis, _payment),
    "monthly_trend": over_sales(reports.monthly_trend, _trend),
    "return_rates": over_sales(reports.return_rate_by_category, _returns),
    "discount_vs_profit": over_sales(reports.discount_vs_profit, _discount),
    "correlation_matrix": over_sales(reports.correlation_matrix, _numbers),
    "summary_stats": over_sales(reports.summary_statistics, reports.DESCRIBED_COLUMNS),
    "summary_stats_date": over_sales(reports.describe_dates, ["order_date"]),
    "categorical_summary": over_sales(reports.categorical_summary),
    "frequent_ids": frequent_ids,
    "correlation_by_day": correlation_by_day,
    "shape_by_day": shape_by_day,
    "price_lines": price_lines,
    # Business questions
    "yearly_growth": over_sales(
        reports.yearly_growth, ["order_year", "order_status", "revenue"]
    ),
    "top_categories": over_sales(reports.top_categories, _category),
    "top_region": over_sales(reports.top_region, _region),
    "segment_insight": over_sales(reports.segment_insight, _segment, **_named_segments),
    "top_payment": over_sales(reports.top_payment, _payment),
    "discount_erosion": over_sales(reports.discount_erosion, _discount),
    "worst_return_category": over_sales(reports.worst_return_category, _returns),
    "business_answers": over_sales(reports.business_answers, ANSWERED, **_named_segments),
    # Data quality and summaries
    "raw_profile": over_raw(profile.raw_profile),
    "null_report": over_raw(profile.null_report),
    "column_types": over_raw(profile.column_types),
    "raw_describe": over_raw(profile.raw_describe),
    "dirty_values": over_raw(profile.top_values),
    "critical_nulls": over_raw(after(cleaning.clean, profile.critical_nulls)),
    "market_share": over_sales(profile.market_share, _category),
    "regional_share": over_sales(profile.regional_share, _region),
    "segment_value_share": over_sales(profile.segment_value_share, _segment),
    "payment_share": over_sales(profile.payment_share, _payment),
    "revenue_corr_top3": over_sales(profile.revenue_correlations, _numbers),
    "overall_rates": over_sales(profile.overall_rates, ["order_status"]),
    "peak_low_month": over_sales(profile.peak_and_low_month, _trend),
    "summary_metrics": over_sales(profile.summary_metrics, SUMMARISED),
    # Chart data
    "monthly_ma3": over_sales(charts.monthly_revenue_trend, _trend),
    "chart_category": over_sales(charts.category_bars, _category),
    "region_panel": over_sales(charts.region_panel, _region),
    "corr_lower": over_sales(charts.correlation_lower, _numbers),
    "segment_share": over_sales(charts.segment_panel, _segment),
    "payment_panel": over_sales(charts.payment_panel, _payment),
    "top_products": over_sales(
        charts.top_products, ["product_name", "order_status", "quantity"]
    ),
    "orders_heatmap": over_sales(
        charts.orders_heatmap, ["region", "order_month", "order_status", "order_id"]
    ),
    # Cohorts
    "first_purchase": over_sales(cohorts.first_purchase, ["customer_id", "order_date"]),
    "cohort_orders": over_sales(
        cohorts.cohort_orders, ["order_id", "customer_id", "order_date", "order_status", "revenue"]
    ),
    "cohort_orders_bucketed": by_bucket(
        by_customer.cohort_orders, ["order_id", "customer_id", "order_date", "order_status", "revenue"]
    ),
    "customer_ltv_bucketed": by_bucket(
        lambda orders: orders.per_customer(cohorts.customer_values), [*COHORT, "order_id", "customer_rating"]
    ),
    "retention_long": over_sales(cohorts.retention_long, COHORT),
    "retention_matrix": matrix(cohorts.retention_table, COHORT),
    "retention_absolute": matrix(cohorts.retention_table_absolute, COHORT),
    "cohort_revenue": matrix(cohorts.cohort_revenue, COHORT),
    "cohort_aov": matrix(cohorts.avg_order_value_by_cohort, COHORT),
    "customer_ltv": over_sales(
        cohorts.customer_lifetime_value, [*COHORT, "order_id", "customer_rating"]
    ),
    "clv_by_segment": over_sales(
        cohorts.clv_by_segment, [*COHORT, "order_id", "customer_rating", "customer_segment"]
    ),
    "cohort_insights": over_table(
        cohorts.cohort_insights, [*COHORT, "order_id", "customer_rating", "customer_segment"]
    ),
    "customers_by_sketch": customers_by_sketch,
    "cohort_overview": over_sales(cohorts.cohort_overview, ["customer_id", "order_date"]),
    "top10_ltv": over_sales(cohorts.top_customers, [*COHORT, "order_id", "customer_rating"]),
    "first10_cohorts": matrix(cohorts.first_cohorts, COHORT),
    # Pricing
    "price_bins": over_table(pricing.price_bins, PRICED),
    "elasticity": over_table(pricing.elasticity_by_category, PRICED),
    "price_scenarios": over_table(pricing.revenue_at_price_points, PRICED),
    "optimal_pricing": over_table(pricing.optimal_pricing, PRICED),
    "pricing_strategies": over_table(pricing.pricing_strategies, PRICED),
    "margin_by_tier": over_table(pricing.margin_by_price_tier, PRICED),
    "scenarios_head": over_table(pricing.scenarios_head, PRICED),
    # Defects, cleaning, synthetic orders
    "inject_defects": raw_orders,
    "dedup": over_raw(cleaning.remove_duplicates),
    "new_arrivals": new_arrivals,
    "fix_types": over_raw(cleaning.fix_data_types),
    "standardize": over_raw(cleaning.standardize_categories),
    "imputation_values": over_raw(
        after(cleaning.deduplicated_and_typed, cleaning.imputation_values)
    ),
    "impute": over_raw(after(cleaning.deduplicated_and_typed, cleaning.handle_missing_values)),
    "zero_negative": over_raw(
        after(cleaning.fix_data_types, cleaning.handle_negative_revenue)
    ),
    "time_features": over_raw(after(cleaning.fix_data_types, cleaning.add_time_features)),
    "cleaning_metrics": over_raw(
        cleaning.cleaning_metrics, first_date=FIRST_DATE, last_date=LAST_DATE
    ),
    "validate": over_raw(validated),
    "clean_sales": over_raw(cleaning.clean),
    "synth_orders": synthetic,
    "shuffled": over_raw(defects.shuffle_rows),
    # Sources and sinks
    "csv_quarantine": csv_quarantine,
    "csv_round_trip": csv_round_trip,
    "month_sink": month_sink,
    "summary_csv": summary_csv,
    "preview": over_sales(profile.preview, RAW_COLUMNS, order_by=["order_date", "order_id"]),
    # Findings
    "insights_table": over_table(
        lambda df, **o: insights.insights_table(*insights.findings(df, **o)), FOUND, **_named_segments
    ),
    "report_lines": over_table(
        lambda df, **o: insights.report_lines(*insights.findings(df, **o)).selectExpr(
            "line_no.ord AS part_no", "line_no.rank AS rank", "line_no.head AS heading", "line_no.pos AS pos", "line"
        ),
        FOUND,
        **_named_segments,
    ),
}
