"""Time the headline queries and print one JSON line.

The order table is written once from the star schema (``build_table``); the analyses then
read it, as a full run does.  ``clean_raw`` is the whole cleaning of the table with defects.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import HIGH_VALUE, HIGH_VOLUME  # noqa: E402
from tillroll.operators import charts, cohorts, defects, insights, pricing, profile, reports  # noqa: E402
from tillroll.operators.cleaning import clean  # noqa: E402
from tillroll.operators.synth import synthetic_orders  # noqa: E402
from tillroll.plans.session import local_session  # noqa: E402
from tillroll.schema import RAW_COLUMNS, TIME_COLUMNS  # noqa: E402
from tillroll.sources.star_schema import sales  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = {
    "summary_stats": reports.summary_statistics,
    "revenue_by_category": reports.revenue_by_category,
    "revenue_by_region": reports.revenue_by_region,
    "revenue_by_segment": reports.revenue_by_segment,
    "payment_analysis": reports.payment_analysis,
    "discount_vs_profit": reports.discount_vs_profit,
    "return_rates": reports.return_rate_by_category,
    "correlation_matrix": reports.correlation_matrix,
    "monthly_trend": reports.monthly_trend,
    "business_answers": lambda df: reports.business_answers(df, HIGH_VALUE, HIGH_VOLUME),
    "monthly_ma3": charts.monthly_revenue_trend,
    "top_products": charts.top_products,
    "orders_heatmap": charts.orders_heatmap,
    "retention_long": cohorts.retention_long,
    "cohort_revenue": cohorts.cohort_revenue_long,
    "customer_ltv": cohorts.customer_lifetime_value,
    "clv_by_segment": cohorts.clv_by_segment,
    "elasticity": pricing.elasticity_by_category,
    "optimal_pricing": pricing.optimal_pricing,
    "margin_by_tier": pricing.margin_by_price_tier,
    "summary_metrics": profile.summary_metrics,
    "insights_table": lambda df: insights.insights_table(
        *insights.findings(df, HIGH_VALUE, HIGH_VOLUME)
    ),
}


def main() -> None:
    spark = local_session(
        "bench", CPUS, int(CPUS) if CPUS.isdigit() else 8, os.environ.get("BENCH_DRIVER_MEMORY", "8g")
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="run-")
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        started = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - started, 3)

    def finish(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    spark.range(10).selectExpr("sum(id)").collect()
    keyed = sales(spark, SF_DIR, [*RAW_COLUMNS, *TIME_COLUMNS, "defect_key"])
    # The source is one small file: spread its rows so that later reads use every core.
    cores = spark.sparkContext.defaultParallelism
    timed(
        "build_table", lambda: keyed.repartition(cores).write.mode("overwrite").parquet(folder)
    )
    table = spark.read.parquet(folder)
    raw = defects.inject_defects(table.drop(*TIME_COLUMNS))
    timed("clean_raw", lambda: finish(clean(raw)))
    timed("synth_50k", lambda: finish(synthetic_orders(spark, 50_000)))
    table = table.drop("defect_key")
    for name, query in HEADLINE.items():
        timed(name, lambda: finish(query(table)))

    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
