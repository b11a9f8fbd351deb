import math
import random

import numpy as np
import pandas as pd
import pytest

from tillroll.functions.numeric import (
    exprs,
    fine_avg,
    kurtosis_corrected,
    money_avg,
    money_sum,
    pearson,
    rounded,
    skew_corrected,
)
from tillroll.functions.quantiles import FIFTHS, THIRDS, bin_index, exact_quantiles
from tillroll.functions.text import dollars, in_millions, in_thousands, title_case


def doubles(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def one(df, sql):
    return df.agg(*exprs(v=sql)).first()[0]


def test_rounding_is_half_even(spark):
    df = doubles(spark, 0.125, 2.675, 1.005, -0.001)
    assert [r[0] for r in df.selectExpr(rounded("x")).collect()] == [0.12, 2.68, 1.0, 0.0]


def test_shape_is_bias_corrected(spark):
    df = doubles(spark, 1.0, 2.0, 10.0, 11.0, 12.5, None)
    assert one(df, skew_corrected("x")) == pytest.approx(-0.5028373760596304, abs=1e-12)
    assert one(df, kurtosis_corrected("x")) == pytest.approx(-3.024376493328682, abs=1e-12)
    assert one(doubles(spark, 1.0, 2.0), skew_corrected("x")) is None
    assert one(doubles(spark, 1.0, 2.0, 4.0), kurtosis_corrected("x")) is None
    assert one(doubles(spark, 3.0, 3.0, 3.0, 3.0), skew_corrected("x")) == 0.0
    assert one(doubles(spark, 3.0, 3.0, 3.0, 3.0), kurtosis_corrected("x")) == 0.0


def test_pearson_uses_complete_pairs_and_survives_constants(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (4.0, 9.0, 5.0), (None, 1.0, 5.0), (-7.0, None, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, k double")
    expected = pd.DataFrame(rows, columns=["a", "b", "k"])
    assert one(df, pearson("a", "b")) == pytest.approx(expected["a"].corr(expected["b"]))
    assert one(df, pearson("a", "-b")) == pytest.approx(-expected["a"].corr(expected["b"]))
    assert one(df, pearson("a", "k")) is None
    assert one(df, pearson("k", "b")) is None


def test_sums_do_not_depend_on_partitioning(spark):
    random.seed(3)
    values = [round(random.uniform(-5000, 5000), 2) for _ in range(5000)]
    df = doubles(spark, *values)
    exact = sum(round(v * 100) for v in values) / 100
    for parts in (1, 7):
        shuffled = df.repartition(parts)
        assert one(shuffled, money_sum("x")) == exact
    assert len({one(df.repartition(n), fine_avg("x")) for n in (1, 3, 7)}) == 1
    assert one(df.filter("x IS NULL"), money_sum("x")) == 0.0


@pytest.mark.parametrize(
    "text, expected",
    [
        ("t-shirt", "T-Shirt"),
        ("children's book", "Children'S Book"),
        ("SAME-DAY", "Same-Day"),
        ("cash on delivery", "Cash On Delivery"),
        ("home & GARDEN", "Home & Garden"),
        ("1-URGENT 3rd", "1-Urgent 3Rd"),
        ("élan vital", "Élan Vital"),
        ("two  spaces", "Two  Spaces"),
        ("", ""),
        (None, None),
    ],
)
def test_title_case(spark, text, expected):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.selectExpr(title_case("s")).first()[0] == expected
    assert text is None or text.title() == expected


def test_display_labels(spark):
    df = doubles(spark, 1250000.0)
    assert df.selectExpr(in_millions("x"), in_thousands("x"), dollars("x"), dollars("x / 1000", 2)).first()[
        0:
    ] == ("$1.2M", "1250.0K", "$1,250,000", "$1,250.00")


@pytest.mark.parametrize("probs", [[0.05, 0.25, 0.5, 0.75, 0.95], FIFTHS, THIRDS])
def test_exact_quantiles_match_numpy(spark, probs):
    random.seed(11)
    groups = {
        "spread": [random.lognormvariate(3, 2) for _ in range(999)],
        "hot": [7.0] * 700 + [random.uniform(6.999, 7.001) for _ in range(301)],
        "signed": [random.gauss(0, 1000) for _ in range(500)],
        "tied": [1.0, 1.0, 1.0, 1.0, 2.0, 3.0],
        "single": [42.0],
        "tiny": [random.uniform(0, 1e-6) for _ in range(50)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("spread", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for fits in (200_000, 3):
        got = {r["g"]: r for r in exact_quantiles(df, "v", probs, ["g"], fits=fits).collect()}
        for g, vs in groups.items():
            assert got[g]["quantiles"] == list(np.quantile(vs, probs)), g
            assert got[g]["n_values"] == len(vs)


def test_weighted_quantiles_equal_repeated_rows(spark):
    merged = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 2), ("a", 9.0, 4)], "g string, v double, n int")
    (row,) = exact_quantiles(merged, "v", [0.25, 0.5], ["g"], weight="n").collect()
    assert row["quantiles"] == list(np.quantile([1, 1, 1, 5, 5, 9, 9, 9, 9], [0.25, 0.5]))


def test_approximate_quantiles_are_near(spark):
    df = spark.range(10_000).selectExpr("'g' AS g", "cast(id as double) AS v")
    (row,) = exact_quantiles(df, "v", [0.5], ["g"], approx=True).collect()
    assert math.isclose(row["quantiles"][0], 5000, abs_tol=5)


@pytest.mark.parametrize(
    "values, expected",
    [([1.0, 1.0, 1.0, 1.0, 2.0, 3.0], [0, 0, 0, 0, 1, 2]), ([5.0, 5.0, 5.0], [None] * 3)],
)
def test_bins_drop_repeated_edges(spark, values, expected):
    edges = ", ".join(f"{e!r}D" for e in np.quantile(values, FIFTHS).tolist())
    df = doubles(spark, *values).selectExpr("x", f"{bin_index('x', f'array_distinct(array({edges}))', 6)} AS b")
    assert [r["b"] for r in df.orderBy("x").collect()] == expected
    want = pd.qcut(pd.Series(values), 5, labels=False, duplicates="drop") if expected[0] is not None else None
    assert want is None or want.tolist() == expected


def test_a_crowded_bucket_is_refined_until_it_fits(spark, monkeypatch):
    """Thousands of values within one logarithmic bucket, others far off, groups without a bound:
    no join of the plan is hinted, and no sort gets more than ``fits`` values of a bucket."""
    random.seed(5)
    crowded = [1000 + random.random() * 1e-3 for _ in range(4000)] + [1000.0] * 3000 + [5.0, 9e9, -3.0]
    clustered = [2.0 ** -(k % 40) * (1 + k * 1e-9) for k in range(2000)]
    wide = [1.7e308, -1.7e308, float("inf"), 5e-324, 0.0, -0.0, float("nan"), None]
    rows = [("crowded", v) for v in crowded] + [("clustered", v) for v in clustered] + [("wide", v) for v in wide]
    rows += [(f"g{i}", float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exact_quantiles(df, "v", probs, ["g"], fits=20)
        plan = found._jdf.queryExecution().toString()
        assert "Broadcast" not in plan and plan.count("finer") >= 1
        got = {r["g"]: r for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got["crowded"]["quantiles"] == list(np.quantile(crowded, probs))
    assert got["clustered"]["quantiles"] == list(np.quantile(clustered, probs))
    assert got["wide"]["quantiles"][0] == -1.7e308 and got["wide"]["quantiles"][-1] == float("inf")
    assert got["wide"]["quantiles"][2] in (0.0, 5e-324) and got["wide"]["n_values"] == 6
    assert len(got) == 503 and got["g3"]["quantiles"] == [3.0] * 5


def test_amounts_keep_digits_below_a_cent(spark):
    df = spark.range(1000).selectExpr("10.004D AS a", "0.004D AS b")
    for n in (1, 7):
        part = df.repartition(n)
        assert one(part, money_sum("a")) == 10004.0
        assert one(part, money_sum("b")) == 4.0


def test_odd_amounts_do_not_stop_a_sum(spark):
    cells = "explode(array(double('Infinity'), double('-Infinity'), double('NaN'), 1e300D, 1.5D)) AS x"
    df = spark.range(1).selectExpr(cells)
    assert one(df, money_sum("x")) == 1.5
    large = spark.range(200).selectExpr("1e18D AS x")
    assert one(large, money_sum("x")) == 2e20
    assert one(large, fine_avg("x")) == 1e18


def test_totals_are_the_nearest_double(spark):
    """As exact decimals of the written digits would give, from tiny to large amounts."""
    from decimal import Decimal

    random.seed(9)
    values = [round(random.uniform(-1, 1) * 10**e, d) for e, d in ((3, 2), (5, 9), (8, 4), (12, 2)) for _ in range(300)]
    df = doubles(spark, *values)
    for some in (values[:300], values[300:600], values[600:900], values[900:], values):
        expected = float(sum(Decimal(repr(v)) for v in some))
        assert one(doubles(spark, *some), money_sum("x")) == expected
    assert one(df.repartition(7), money_avg("x")) == float(sum(Decimal(repr(v)) for v in values)) / len(values)
