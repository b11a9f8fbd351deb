"""Answers from sketches, filters, moments and buckets that are kept, against plain ones."""

import random
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from conftest import rows_of
from tillroll.operators import arrivals, cohorts, moments
from tillroll.operators.frequent import frequent_values
from tillroll.sources.by_customer import cohort_orders, store_by_customer


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def most(values, n):
    found = Counter(v for v in values if v is not None)
    return sorted(found.items(), key=lambda item: (-item[1], item[0]))[:n]


@pytest.mark.parametrize("tracked, proven", [(12_288, {"a": True, "b": True}), (96, {"a": True, "b": False})])
def test_frequent_values_are_exact_with_and_without_proof(spark, tracked, proven):
    rng = random.Random(3)
    # One value a third of all rows, others ever rarer; the second column is as good as even.
    a = [None if rng.random() < 0.05 else f"u{int(rng.paretovariate(1.0)) % 3000}" for _ in range(20_000)]
    b = [f"x{i % 700}" for i in range(20_000)]
    df = spark.createDataFrame(list(zip(a, b)), "a string, b string").repartition(7)
    got = rows_of(frequent_values(df, ["a", "b"], 3, tracked))
    for column, values in (("a", a), ("b", b)):
        found = sorted((r["rank"], r["value"], r["n"]) for r in got if r["column_name"] == column)
        assert [(v, n) for _, v, n in found] == most(values, 3)
        assert {r["proven"] for r in got if r["column_name"] == column} == {proven[column]}


def test_frequent_values_of_few_or_no_values(spark):
    df = spark.createDataFrame([("x", None), ("x", None), ("y", None)], "a string, b int")
    got = [(r["column_name"], r["rank"], r["value"], r["n"]) for r in rows_of(frequent_values(df, ["a", "b"], 5))]
    assert sorted(got) == [("a", 1, "x", 2), ("a", 2, "y", 1)]
    assert frequent_values(df.limit(0), ["a"], 5).count() == 0


ROWS = "i int, d double, s string"


def test_new_rows_are_those_of_a_full_comparison(spark):
    stored = [(i, None if i % 3 else 0.0, "x" * (i % 5) or None) for i in range(3000)] * 2
    delivery = [(i, None if i % 3 else -0.0, "x" * (i % 5) or None) for i in range(2900, 3200)] * 3
    got = arrivals.new_rows(spark.createDataFrame(delivery, ROWS), spark.createDataFrame(stored, ROWS))
    assert sorted(r["i"] for r in rows_of(got)) == list(range(3000, 3200))


def test_missing_cells_in_other_columns_are_other_rows(spark):
    delivery = spark.createDataFrame([(1, None, "1"), (None, 1.0, "1"), (None, None, None)], ROWS)
    stored = spark.createDataFrame([(1, None, "1"), (None, None, None)], ROWS)
    assert [tuple(r) for r in arrivals.new_rows(delivery, stored).collect()] == [(None, 1.0, "1")]
    assert arrivals.new_rows(delivery, stored.limit(0)).count() == 3
    assert arrivals.new_rows(delivery.limit(0), stored).count() == 0


def test_a_full_filter_loses_no_row(spark):
    """Far more rows than the filter has room for: everything passes, the comparison is exact."""
    delivery = spark.range(200_000).selectExpr("id AS i")
    stored = spark.range(100_000, 300_000).selectExpr("id AS i")
    got = arrivals.new_rows(delivery, stored, words=arrivals.SEGMENT).agg({"i": "max", "*": "count"}).first()
    assert set(got) == {99_999, 100_000}


def test_few_stored_rows_pass_the_filter(spark):
    delivery = spark.range(10_000).selectExpr("id AS i")
    words = arrivals._words_for(10_000)
    stored = spark.range(200_000).selectExpr("id AS i")
    passed = arrivals.passing(stored, arrivals.row_filter(delivery, words), words).selectExpr("count_if(i < 10000)", "count(1)")
    held, all_ = passed.first()
    assert held == 10_000 and all_ - held < 190_000 * 0.02


def measured(spark, n=3000):
    rng = np.random.default_rng(5)
    x = rng.gamma(2.0, 3.0, n) + 1e6  # far from zero: sums of powers would lose their digits
    y = 0.5 * x + rng.normal(0, 2, n)
    frame = pd.DataFrame({"day": rng.integers(0, 40, n), "x": x, "y": y, "c": 7.1})
    frame.loc[::17, "y"] = np.nan
    rows = [(int(d), float(a), None if np.isnan(b) else float(b), c) for d, a, b, c in frame.itertuples(index=False)]
    return frame, spark.createDataFrame(rows, "day int, x double, y double, c double")


@pytest.mark.parametrize("split", ["day", "pmod(xxhash64(x), 1000)", "0", "CASE WHEN day < 39 THEN null ELSE day END"])
def test_moments_of_any_split_merge_to_those_of_the_whole(spark, split):
    frame, df = measured(spark)
    df = df.selectExpr("*", f"{split} AS part")
    names = ["x", "y", "c"]
    pairs = moments.merged_pairs(moments.pair_moments(df, moments.all_pairs(names), ["part"]))
    table = {r["column_name"]: r for r in rows_of(moments.correlation_table(pairs, names, 9))}
    assert table["x"]["y"] == pytest.approx(frame["x"].corr(frame["y"]), abs=1e-8)
    assert table["x"]["x"] == 1.0 and table["c"]["x"] is None and table["c"]["c"] is None
    (line,) = [r for r in rows_of(moments.lines(pairs)) if r["pair"] == "x|y"]
    both = frame.dropna()
    slope, intercept = np.polyfit(both["x"] - 1e6, both["y"], 1)
    assert line["slope"] == pytest.approx(slope, rel=1e-7)
    assert line["intercept"] + 1e6 * line["slope"] == pytest.approx(intercept, rel=1e-7)

    kept = moments.shape_moments(df, names, ["part", "day"])
    twice = moments.merged_shapes(moments.merged_shapes(kept, ["part"]))  # merged rows merge again
    for row in rows_of(moments.shapes(twice, 5)):
        values = frame[row["column_name"]].dropna()
        assert row["count"] == len(values) and row["mean"] == pytest.approx(values.mean(), abs=1e-4)
        assert row["std"] == pytest.approx(values.std(), abs=1e-4)
        skew, kurtosis = (0.0, 0.0) if row["column_name"] == "c" else (values.skew(), values.kurt())
        assert row["skew"] == pytest.approx(skew, abs=1e-4) and row["kurtosis"] == pytest.approx(kurtosis, abs=1e-4)


def test_moments_of_nothing_and_of_odd_values(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0), (1, float("inf"), 2.0), (2, None, None)], "p int, x double, y double")
    pairs = moments.pair_moments(df, moments.all_pairs(["x", "y"]), ["p"])
    assert [(r["pair"], r["n"]) for r in rows_of(pairs)] == [("y|y", 2)]
    shapes = moments.merged_shapes(moments.shape_moments(df, ["x", "y"], ["p"]))
    assert [(r["column_name"], r["n"]) for r in rows_of(shapes)] == [("y", 2)]
    assert moments.merged_pairs(pairs.limit(0)).count() == 0


@pytest.fixture
def customers(orders):
    rows = [
        {"customer_id": f"C{i % 40}", "order_date": date(2022, 1, 5) + timedelta(days=i * 3), "revenue": float(i)}
        for i in range(200)
    ]
    rows += [{"customer_id": "HOT", "order_date": date(2022, 3, 1) + timedelta(days=i)} for i in range(100)]
    return orders(*rows, {"customer_id": None})


def test_orders_in_buckets_give_the_same_cohorts_and_values(customers):
    stored = store_by_customer(customers, buckets=4, hot_parts=10)
    assert {r[0] for r in stored.apart.select("customer_id").distinct().collect()} == {"HOT", None}
    names = cohorts.cohort_orders(customers).columns
    got, expected = (sorted(map(str, df.select(*names).collect())) for df in (cohort_orders(stored), cohorts.cohort_orders(customers)))
    assert got == expected
    got = stored.per_customer(cohorts.customer_values)
    assert sorted(map(str, got.collect())) == sorted(map(str, cohorts.customer_values(customers).collect()))


def test_orders_in_buckets_are_not_shuffled(customers):
    stored = store_by_customer(customers, buckets=4, hot_parts=10)
    for df in (cohort_orders(stored._replace(apart=stored.apart.limit(0))), cohorts.customer_values(stored.bucketed)):
        plan = plan_of(df)
        bucketed = plan.split("SelectedBucketsCount: 4 out of 4")
        assert len(bucketed) > 1
    plan = plan_of(cohorts.customer_values(stored.bucketed))
    assert "Exchange" not in plan
    first = "min(order_date) OVER (PARTITION BY customer_id) AS first"
    assert "Exchange" not in plan_of(stored.bucketed.selectExpr("*", first))


def test_each_bucket_is_one_file(customers, spark):
    stored = store_by_customer(customers, buckets=4, hot_parts=10)
    assert len(stored.bucketed.inputFiles()) <= 4
