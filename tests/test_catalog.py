"""Queries against their SQL on the smallest tables; TILLROLL_ALL=1 takes every query."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.compare import connect, difference
from catalog.oracle import ORACLE

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "revenue_by_category",
    "discount_vs_profit",
    "correlation_matrix",
    "summary_stats",
    "business_answers",
    "null_report",
    "market_share",
    "monthly_ma3",
    "cohort_orders",
    "retention_matrix",
    "customer_ltv",
    "clv_by_segment",
    "cohort_insights",
    "optimal_pricing",
    "margin_by_tier",
    "clean_sales",
    "cleaning_metrics",
    "synth_orders",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE) if os.environ.get("TILLROLL_ALL") else SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    assert difference(spark, con, SF_DIR, name) is None


@pytest.mark.parametrize("name", ["cohort_overview", "summary_stats_date", "monthly_trend"])
def test_dates_do_not_depend_on_the_time_zone(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert difference(spark, con, SF_DIR, name) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entry_and_names(spark):
    assert entry(spark).count() == 6
    assert set(oracle_sql()) <= set(queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["revenue_by_region", "market_share", "retention_long", "price_scenarios", "clean_sales", "validate",
     "frequent_ids", "new_arrivals", "correlation_by_day", "price_lines", "cohort_orders_bucketed"]
)
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = plan_of(queries()[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert word not in plan


def test_scan_is_pruned_and_filtered(spark, tmp_path):
    from tillroll.operators import reports
    from tillroll.sources import files
    from tillroll.sources.star_schema import sales

    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    files.write_parquet(sales(spark, SF_DIR), str(tmp_path / "t"))
    df = reports.revenue_by_region(files.read_parquet(spark, str(tmp_path / "t")))
    plan = plan_of(df)
    assert "EqualTo(order_status,Delivered)" in plan
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "order_id",
        "region",
        "discount_pct",
        "revenue",
        "profit",
        "order_status",
    }


def test_only_needed_tables_are_read(spark):
    plan = plan_of(queries()["return_rates"](spark, SF_DIR))
    assert "part.parquet" in plan and "customer.parquet" not in plan and "nation.parquet" not in plan
