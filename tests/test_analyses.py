import re
from datetime import date

import numpy as np
import pandas as pd
import pytest

from conftest import rows_of
from tillroll.functions.quantiles import counted_values
from tillroll.operators import charts, cohorts, pricing, profile, reports


def test_discount_bucket_edges(spark):
    values = [-1.0, 0.0, 0.5, 5.0, 5.1, 25.0, 30.0, 100.0, 101.0, None]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    got = [r[0] for r in df.selectExpr(reports.discount_bucket_number("d")).collect()]
    assert got == [None, 0, 1, 1, 2, 5, 6, 6, None, None]


def test_discount_report_leaves_out_empty_buckets(orders):
    df = orders(
        {"discount_pct": 30.0, "revenue": 0.0, "profit": 0.0},
        {"discount_pct": 0.0, "revenue": 20.0, "profit": 5.0},
        {"discount_pct": 0.0, "order_status": "Returned"},
    )
    got = rows_of(reports.discount_vs_profit(df))
    assert [(r["discount_bucket"], r["avg_profit_margin"], r["order_count"]) for r in got] == [
        ("0%", 25.0, 1),
        ("26%+", 0.0, 1),
    ]


def test_groups_without_a_label_are_absent_and_ties_sort_by_label(orders):
    df = orders(
        {"region": None}, {"region": "West"}, {"region": "East"}, {"region": "East", "order_status": "Returned"}
    )
    assert [r["region"] for r in rows_of(reports.revenue_by_region(df))] == ["East", "West"]


def test_sum_of_missing_revenue_is_zero(orders):
    (row,) = rows_of(reports.revenue_by_category(orders({"revenue": None})))
    assert row["total_revenue"] == 0.0 and row["avg_revenue"] is None and row["total_orders"] == 1


def test_return_rates_count_every_status(orders):
    df = orders(
        {"product_category": "A"},
        {"product_category": "A", "order_status": "Returned"},
        {"product_category": "A", "order_status": "Cancelled"},
        {"product_category": "B"},
    )
    got = rows_of(reports.return_rate_by_category(df))
    assert [(r["product_category"], r["return_rate_pct"], r["cancelled"]) for r in got] == [
        ("A", 33.33, 1),
        ("B", 0.0, 0),
    ]


def test_constant_column_correlates_with_nothing(orders):
    df = orders(*[{"revenue": float(x), "profit": float(x * x)} for x in range(1, 6)])
    got = {r["column_name"]: r for r in rows_of(reports.correlation_matrix(df))}
    assert got["revenue"]["profit"] == got["profit"]["revenue"] == 0.981
    assert got["revenue"]["revenue"] == 1.0
    assert got["quantity"]["revenue"] is None and got["quantity"]["quantity"] is None
    strongest = rows_of(profile.revenue_correlations(df))
    assert strongest[0] == {"column_name": "profit", "r": 0.981}


def test_summary_matches_pandas(orders):
    values = [3.5, 1.25, 9.0, 4.75, 4.75, 12.0, 100.5, 7.0]
    df = orders(*[{"revenue": v} for v in values])
    got = {
        r["stat"]: r["value"]
        for r in rows_of(reports.summary_statistics(df))
        if r["column_name"] == "revenue"
    }
    series = pd.Series(values)
    want = series.describe(percentiles=[0.05, 0.25, 0.5, 0.75, 0.95])
    want["skew"], want["kurtosis"] = series.skew(), series.kurtosis()
    assert got == want.round(2).to_dict()


def test_moving_average_starts_short(orders):
    df = orders(*[{"order_date": date(2022, m, 1), "revenue": float(m)} for m in (1, 2, 3, 4)])
    got = rows_of(charts.monthly_revenue_trend(df))
    assert [r["revenue_ma3"] for r in got] == [1.0, 1.5, 2.0, 3.0]


def test_peak_month_tie_goes_to_the_earlier(orders):
    df = orders(*[{"order_date": date(2022, m, 1), "revenue": 5.0} for m in (3, 2, 9)])
    (row,) = rows_of(profile.peak_and_low_month(df))
    assert row["peak_month"] == row["low_month"] == "2022-02"


def test_heatmap_has_all_months(orders):
    (row,) = rows_of(charts.orders_heatmap(orders({}, {})))
    assert row["Jan"] == 2 and row["Dec"] == 0 and len(row) == 13


def cohort_sample(orders):
    def order(customer, day, revenue=10.0, status="Delivered", segment="Regular"):
        return {
            "customer_id": customer,
            "order_date": day,
            "revenue": revenue,
            "order_status": status,
            "customer_segment": segment,
        }

    return orders(
        order("a", date(2022, 1, 31), 10.0),
        order("a", date(2022, 2, 1), 20.0),
        order("a", date(2024, 2, 1), 30.5),
        order("b", date(2022, 1, 2), 7.0, status="Returned"),
        order("b", date(2022, 3, 2), 8.0, segment="New"),
        order("c", date(2022, 2, 2), 1.0, status="Cancelled"),
        order(None, date(2021, 1, 1), 99.0),
    )


def test_cohorts_count_all_statuses_but_only_sum_delivered(orders):
    df = cohort_sample(orders)
    cells = {(r["cohort_month"], r["months_since_cohort"]): r for r in rows_of(cohorts.retention_long(df))}
    assert cells["2022-01", 0]["unique_customers"] == 2
    assert cells["2022-01", 1]["retention_rate"] == 50.0
    assert cells["2022-01", 25]["retention_rate"] == 50.0
    assert cells["2022-02", 0]["cohort_size"] == 1 and len(cells) == 5
    revenue = {(r["cohort_month"], r["months_since_cohort"]): r["revenue"] for r in rows_of(cohorts.cohort_revenue_long(df))}
    assert revenue == {("2022-01", 0): 10.0, ("2022-01", 1): 20.0, ("2022-01", 2): 8.0, ("2022-01", 25): 30.0}
    ages = {c for c in cohorts.retention_table(df).columns if c != "cohort_month"}
    assert ages == {"0", "1", "2", "25"}


def test_customer_values(orders):
    got = {r["customer_id"]: r for r in rows_of(cohorts.customer_lifetime_value(cohort_sample(orders)))}
    assert set(got) == {"a", "b"}
    assert got["a"]["total_revenue"] == 60.5 and got["a"]["months_active"] == 26
    assert got["b"]["first_purchase"] == "2022-01" and got["b"]["months_active"] == 1


def test_segment_values_divide_by_all_customers(orders):
    got = {r["customer_segment"]: r for r in rows_of(cohorts.clv_by_segment(cohort_sample(orders)))}
    # Two customers have delivered orders; the order without a customer still counts.
    assert got["Regular"]["total_customers"] == 1
    assert got["Regular"]["avg_clv"] == 79.75 and got["Regular"]["repeat_purchase_rate"] == 2.0
    assert got["New"]["avg_clv"] == 4.0


def test_orders_of_unknown_customers_keep_a_row_without_cohort(orders):
    got = rows_of(cohorts.cohort_orders(cohort_sample(orders)))
    assert len(got) == 7
    assert [r["months_since_cohort"] for r in got if r["customer_id"] is None] == [None]


def test_a_hot_customer_changes_nothing(spark, orders):
    base = [{"customer_id": f"c{i % 40}", "order_date": date(2022, 1 + i % 12, 1 + i % 27)} for i in range(120)]
    hot = [{"customer_id": "hot", "order_date": date(2022, 1 + i % 12, 5)} for i in range(60)]
    df = orders(*base, *hot)
    results = [sorted(map(tuple, cohorts.retention_long(df.repartition(n)).collect())) for n in (1, 7)]
    assert results[0] == results[1]
    pdf = df.toPandas()
    pdf["m"] = [d.year * 12 + d.month for d in pdf["order_date"]]
    pdf["age"] = pdf["m"] - pdf.groupby("customer_id")["m"].transform("min")
    pdf["start"] = pdf["m"] - pdf["age"]
    want = pdf.groupby(["start", "age"])["customer_id"].nunique()
    assert sorted(r[2] for r in results[0]) == sorted(want.tolist())


@pytest.mark.parametrize("parts", [10_000, 5, 1])
def test_hot_customers_bypass_the_shuffle_join(spark, orders, parts):
    """All, one or no customers are hot: the rows are the same."""
    names = [f"c{i % 90}" for i in range(200)] + ["hot"] * 100 + [None] * 30
    days = [date(2022 + i % 2, 1 + i % 12, 1 + i % 28) for i in range(len(names))]
    df = orders(*[{"customer_id": c, "order_date": d} for c, d in zip(names, days)])
    joined = cohorts.cohort_orders(df, hot_parts=parts)
    pdf = df.toPandas()
    first = pdf.groupby("customer_id")["order_date"].transform("min")

    def age(day, start):
        return None if pd.isna(start) else (day.year - start.year) * 12 + day.month - start.month

    want = {(i, age(d, f)) for i, d, f in zip(pdf["order_id"], pdf["order_date"], first)}
    got = [(r["order_id"], r["months_since_cohort"]) for r in joined.collect()]
    assert len(got) == len(names) and set(got) == want


def test_the_salt_is_part_of_the_shuffle(spark, orders):
    df = orders({"customer_id": "a"}, {"customer_id": "b"})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cohorts.cohort_orders(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert re.search(r"hashpartitioning\(customer_id#\d+, _salt#\d+L", plan)


def priced_sample(orders):
    rng = np.random.default_rng(5)
    rows = []
    for category, n in (("A", 60), ("B", 25), ("few", 9), ("flat", 12)):
        for _ in range(n):
            price = 5.0 if category == "flat" else float(np.round(rng.uniform(2, 50), 2))
            quantity = int(rng.integers(1, 6))
            rows.append(
                {
                    "product_category": category,
                    "unit_price": price,
                    "quantity": quantity,
                    "revenue": float(np.round(price * quantity, 2)),
                    "profit": float(np.round(price * quantity * 0.3, 2)),
                }
            )
    rows += [{"product_category": "A", "unit_price": None, "quantity": 4}]
    return orders(*rows)


def brute_force_elasticity(group):
    binned = pd.qcut(group["unit_price"], 5, labels=False, duplicates="drop")
    means = group.groupby(binned)[["unit_price", "quantity"]].mean()
    x, y = np.log(means["unit_price"]), np.log(means["quantity"].astype(float))
    return np.polyfit(x, y, 1)[0], np.corrcoef(x, y)[0, 1] ** 2


def test_elasticity_matches_brute_force(orders):
    df = priced_sample(orders)
    got = {r["category"]: r for r in rows_of(pricing.elasticity_by_category(df))}
    # Too few orders, or one price only: no estimate.
    assert set(got) == {"A", "B"}
    pdf = df.toPandas()
    for name, row in got.items():
        group = pdf[pdf["product_category"] == name]
        slope, r2 = brute_force_elasticity(group)
        assert row["price_elasticity"] == round(slope, 2)
        assert row["r_squared"] == round(r2, 3)
        assert row["avg_price"] == round(group["unit_price"].mean(), 2)
        assert row["avg_quantity_per_order"] == round(group["quantity"].mean(), 2)


def test_category_without_estimate_still_gets_scenarios(orders):
    got = rows_of(pricing.revenue_at_price_points(priced_sample(orders)))
    flat = [r for r in got if r["category"] == "flat"]
    assert [r["price_scenario"] for r in flat] == ["80%", "90%", "100%", "110%", "120%"]
    # Default elasticity -1: revenue times factor * (2 - factor).
    assert flat[0]["revenue_change_pct"] == -4.0 and flat[2]["revenue_change_pct"] == 0.0
    assert not [r for r in got if r["category"] == "few"]


def test_best_scenario_is_chosen_by_number_and_first_on_ties(orders):
    df = priced_sample(orders)
    best = {r["category"]: r for r in rows_of(pricing.optimal_pricing(df))}
    scenarios = rows_of(pricing.revenue_at_price_points(df))
    for name, row in best.items():
        own = [r for r in scenarios if r["category"] == name]
        top = max(own, key=lambda r: (r["revenue_change_pct"], -r["scenario_no"]))
        assert row["optimal_price_scenario"] == top["price_scenario"]
        assert row["potential_revenue_increase"] == f"{top['revenue_change_pct']:.1f}%"
    changes = [r["revenue_change_pct"] for r in rows_of(pricing.optimal_pricing(df))]
    assert changes == sorted(changes, reverse=True)


def test_no_category_qualifies(orders):
    df = orders({}, {})
    assert rows_of(pricing.elasticity_by_category(df)) == []
    assert rows_of(pricing.optimal_pricing(df)) == []


def test_tiers_match_brute_force_and_tolerate_dropped_edges(orders):
    df = priced_sample(orders)
    pdf = df.toPandas()
    group = pdf[pdf["product_category"] == "B"]
    tiers = pd.qcut(group["unit_price"], 3, labels=["Budget", "Mid-Range", "Premium"])
    got = {r["price_tier"]: r for r in rows_of(pricing.margin_by_price_tier(df)) if r["category"] == "B"}
    for tier, rows in group.groupby(tiers, observed=True):
        assert got[tier]["order_count"] == len(rows)
        assert got[tier]["avg_price"] == pytest.approx(rows["unit_price"].mean())
        assert got[tier]["profit_margin_pct"] == pytest.approx(
            rows["profit"].sum() / rows["revenue"].sum() * 100
        )
    # Most prices equal: the lowest two edges fall together and a tier is left out.
    few_prices = orders(*[{"unit_price": p} for p in [1.0] * 8 + [2.0, 3.0]])
    (only,) = rows_of(pricing.margin_by_price_tier(few_prices))
    assert only["price_tier"] == "Budget" and only["order_count"] == 10


def test_any_number_of_categories_takes_one_path(spark, orders):
    """No join is hinted, and a hot price is one row of the counted prices."""
    rows = [{"product_category": f"C{i % 300}", "unit_price": float(1 + i % 11)} for i in range(3600)]
    rows += [{"product_category": "Hot", "unit_price": 9.99}] * 1800
    rows += [{"product_category": "Hot", "unit_price": 9.99 + i * 1e-6} for i in range(300)]
    df = orders(*rows)
    prices = counted_values(pricing.priced_orders(df), "price", ["product_category"])
    assert prices.filter("product_category = 'Hot'").count() == 300  # 1,801 orders share a price
    expected = rows_of(pricing.price_bins(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pricing.price_bins(df)
        assert "Broadcast" not in found._jdf.queryExecution().toString()
        assert rows_of(found) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["category"] for r in expected} == {"Hot", *(f"C{i}" for i in range(300))}


def scans_of(spark, monkeypatch, module, run, path):
    """How often ``path`` is scanned by what ``run`` stages and by its result."""
    plans, plain = [], module.staged

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(module, "staged", watched)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    result = run()
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    monkeypatch.setattr(module, "staged", plain)
    return sum(line.count("FileScan") for plan in plans for line in plan.splitlines() if path in line), result


def test_answers_and_summary_read_the_table_once(spark, orders, tmp_path, monkeypatch):
    rows = [
        {
            "product_category": f"C{i % 5}", "region": ["West", "East", None][i % 3], "payment_method": f"P{i % 4}",
            "customer_segment": ["Premium", "Regular"][i % 2], "discount_pct": float(i % 31), "revenue": i * 1.25,
            "profit": i * 0.25, "order_date": date(2022 + i % 3, 1 + i % 12, 1),
            "order_status": ["Delivered", "Delivered", "Returned", "Cancelled"][i % 4],
        }
        for i in range(400)
    ]
    orders(*rows).write.parquet(str(tmp_path / "orders-once"))
    df = spark.read.parquet(str(tmp_path / "orders-once"))
    for run in (lambda: reports.business_answers(df), lambda: profile.summary_metrics(df)):
        scans, _ = scans_of(spark, monkeypatch, reports, run, "orders-once")
        assert scans == 1
    answers = {r["metric"]: r["value_str"] or r["value_num"] for r in rows_of(reports.business_answers(df))}
    growth, (region,) = rows_of(reports.yearly_growth(df))[0], rows_of(reports.top_region(df))
    (payment,), (worst,) = rows_of(reports.top_payment(df)), rows_of(reports.worst_return_category(df))
    assert answers["growth_pct"] == growth["growth_pct"] and answers["first_revenue"] == growth["first_revenue"]
    assert answers["top_region"] == region["region"] and answers["total_revenue"] == region["total_revenue"]
    assert answers["top_payment"] == payment["payment_method"]
    assert answers["worst_category"] == worst["product_category"]
    assert answers["last_margin"] == rows_of(reports.discount_erosion(df))[0]["last_margin"]
    empty = profile.summary_metrics(df.limit(0)).collect()
    assert len(empty) == 10 and empty[0]["value_num"] == 0.0


def test_statistics_read_the_table_once(spark, orders, tmp_path, monkeypatch):
    rows = [{"unit_price": float(i), "quantity": i % 4, "revenue": i * 1.5} for i in range(50)]
    orders(*rows).write.parquet(str(tmp_path / "orders-once"))
    df = spark.read.parquet(str(tmp_path / "orders-once"))
    scans, found = scans_of(spark, monkeypatch, reports, lambda: reports.summary_statistics(df), "orders-once")
    assert scans == 1
    got = {(r["column_name"], r["stat"]): r["value"] for r in found.collect()}
    expected = df.toPandas()["revenue"]
    assert got["revenue", "std"] == round(expected.std(), 2) and got["revenue", "skew"] == round(expected.skew(), 2)
    assert got["quantity", "kurtosis"] == round(df.toPandas()["quantity"].kurt(), 2)
    assert got["cost", "count"] == 50 and got["cost", "skew"] == 0.0
    blank = reports.describe_numbers(df.selectExpr("cast(null as double) AS x"), ["x"]).collect()
    assert {r["stat"]: r["value"] for r in blank} == {
        "count": 0.0, "mean": None, "std": None, "min": None, "max": None, "skew": None, "kurtosis": None
    }


def moved_for_moments(spark, describe):
    """What ``describe`` returns, and the exchanges that the values go through on their way to its moments."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = describe()
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (first,) = [i for i, line in enumerate(lines) if "partial_sum" in line and "pow(" in line]
    scan = next(i for i, line in enumerate(lines) if i > first and "FileScan" in line)
    return found, [line for line in lines[first:scan] if "Exchange" in line]


def test_no_task_gets_all_values_of_a_column(spark, orders):
    """A price of its own in every row: values are summed where they were read, not shuffled by column."""
    df = orders(*[{"unit_price": 10 + i / 7, "revenue": 1.0} for i in range(300)]).repartition(3)
    found, moved = moved_for_moments(spark, lambda: reports.summary_statistics(df))
    assert moved == []
    got = {(r["column_name"], r["stat"]): r["value"] for r in found.collect()}
    prices = df.toPandas()["unit_price"]
    assert got["unit_price", "std"] == round(prices.std(), 2) and got["unit_price", "kurtosis"] == round(prices.kurt(), 2)
    assert got["unit_price", "skew"] == 0.0 and got["revenue", "std"] == 0.0


def test_no_task_gets_all_raw_values_of_a_column(spark):
    """Likewise for raw cells, of which some are no numbers and one column has none."""
    cells = "CASE WHEN id % 10 = 0 THEN 'n/a' ELSE cast(id / 7 as string) END AS unit_price"
    raw = spark.range(0, 300, 1, 3).selectExpr(cells, "cast(null as string) AS cost")
    found, moved = moved_for_moments(spark, lambda: profile.raw_describe(raw))
    assert moved == []
    got = {(r["column_name"], r["stat"]): r["value"] for r in found.collect()}
    prices = np.array([i / 7 for i in range(300) if i % 10])
    assert got["unit_price", "count"] == 270 and got["unit_price", "std"] == round(prices.std(ddof=1), 2)
    assert got["cost", "count"] == 0 and got["cost", "std"] is None


def test_customers_of_any_months_from_kept_sketches(orders):
    """Sketches of single months, made apart, count the customers of all of them together."""
    def month(m, low, high):
        rows = [{"customer_id": f"C{i}", "order_date": date(2022, m, 1 + i % 28)} for i in range(low, high)]
        return orders(*rows, {"customer_id": None, "order_date": date(2022, m, 1)}, {"order_status": "Returned"})

    kept = cohorts.customer_sketches(month(1, 0, 600)).unionByName(cohorts.customer_sketches(month(2, 300, 900)))
    by_month = {r["month"]: r["estimate"] for r in rows_of(cohorts.distinct_customers(kept, ["month"]))}
    assert all(abs(n - 600) <= 30 for n in by_month.values()) and len(by_month) == 2
    (both,) = rows_of(cohorts.distinct_customers(kept, ["customer_segment"]))
    assert abs(both["estimate"] - 900) <= 45
