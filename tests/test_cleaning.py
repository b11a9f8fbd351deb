from datetime import date

import pytest

from conftest import BASE, rows_of
from tillroll.operators import cleaning as c
from tillroll.operators import profile
from tillroll.schema import CLEAN_COLUMNS, RAW_COLUMNS, RAW_TEXT_SCHEMA
from tillroll.sources import files


@pytest.fixture
def raw(spark):
    """Raw text orders from partial rows."""

    def make(*rows):
        full = []
        for i, row in enumerate(rows):
            merged = {**BASE, "order_id": f"ORD-{i}", "order_date": "2022-01-05", **row}
            full.append(tuple(None if merged[k] is None else str(merged[k]) for k in RAW_COLUMNS))
        return spark.createDataFrame(full, RAW_TEXT_SCHEMA)

    return make


def test_types_are_coerced_and_bad_cells_emptied(raw):
    df = raw(
        {"quantity": "3"},
        {"quantity": "2.0", "unit_price": " 12.5 "},
        {"quantity": "2.5", "revenue": "abc", "order_date": "not a date"},
        {"quantity": "many", "cost": "NaN", "order_date": None},
        {"order_date": "2022-1-5"},
        {"order_date": "2022-01-05 00:00:00"},
    )
    got = rows_of(c.fix_data_types(df).orderBy("order_id"))
    assert [r["quantity"] for r in got[:4]] == [3, 2, None, None]
    assert got[1]["unit_price"] == 12.5
    assert got[2]["revenue"] is None and got[2]["order_date"] is None
    assert got[3]["cost"] is None
    assert {r["order_date"] for r in (got[0], got[4], got[5])} == {date(2022, 1, 5)}


def test_date_forms(raw):
    day = date(2022, 1, 5)
    forms = {
        "2022-01-05": day,
        "2022-1-5": day,
        "2022/01/05": day,
        "20220105": day,
        " 2022-01-05\t": day,
        "2022-01-05 23:59": day,
        "2022-01-05T07:08:09": day,
        "2022-01-05T07:08:09.123": day,
        "2022-01-05 garbage": None,
        "2022-01-05x": None,
        "2022-01/05": None,
        "2022-01-05 25:00": None,
        "2022-02-30": None,
        "2022-13-01": None,
        "202215": None,
        "": None,
        None: None,
    }
    df = c.fix_data_types(raw(*[{"order_date": t} for t in forms]))
    got = {r["order_id"]: r["order_date"] for r in rows_of(df)}
    assert [got[f"ORD-{i}"] for i in range(len(forms))] == list(forms.values())


def test_labels_are_trimmed_title_cased_and_nan_emptied(raw):
    df = raw(
        {"region": " sOUTH\t", "product_category": "home & garden", "shipping_type": "same-day"},
        {"region": "nan", "product_category": "BOOKS", "shipping_type": None},
    )
    got = rows_of(c.standardize_categories(df).orderBy("order_id"))
    assert [r["region"] for r in got] == ["South", None]
    assert [r["product_category"] for r in got] == ["Home & Garden", "Books"]
    assert [r["shipping_type"] for r in got] == ["Same-Day", None]


def test_gaps_are_filled_and_critical_rows_dropped(raw):
    df = raw(
        {"customer_rating": "1.0", "region": "East", "shipping_type": "Express"},
        {"customer_rating": "4.0", "region": "West", "shipping_type": None, "discount_pct": None},
        {"customer_rating": None, "region": None, "shipping_type": "Standard"},
        {"customer_rating": "2.0", "region": "West", "revenue": "?"},
        {"customer_rating": "5.0", "region": "East", "order_date": "?"},
    )
    got = rows_of(c.handle_missing_values(c.deduplicated_and_typed(df)).orderBy("order_id"))
    assert [r["order_id"] for r in got] == ["ORD-0", "ORD-1", "ORD-2"]
    # The dropped rows still counted for median 3.0, region East (tie) and Standard.
    assert got[2]["customer_rating"] == 3.0 and got[2]["region"] == "East"
    assert got[1]["shipping_type"] == "Standard" and got[1]["discount_pct"] == 0.0


def test_nothing_to_learn_a_fill_value_from(raw):
    df = raw({"region": None, "customer_rating": None}, {"region": None, "customer_rating": None})
    got = rows_of(c.handle_missing_values(c.deduplicated_and_typed(df)))
    assert len(got) == 2 and got[0]["region"] is None and got[0]["customer_rating"] is None


def test_negative_revenue_zeroes_revenue_and_profit_only(raw):
    df = c.fix_data_types(
        raw({"revenue": "-8.0", "profit": "-3.0"}, {"revenue": "9.0", "profit": "-1.0"})
    )
    got = rows_of(c.handle_negative_revenue(df).orderBy("order_id"))
    assert [(r["revenue"], r["profit"], r["cost"]) for r in got] == [(0.0, 0.0, 6.0), (9.0, -1.0, 6.0)]


def test_time_features(raw):
    df = c.fix_data_types(raw({"order_date": "2022-01-01"}, {"order_date": "2024-12-30"}))
    got = rows_of(c.add_time_features(df).orderBy("order_date"))
    assert [r["order_week"] for r in got] == [52, 1]
    assert [r["order_day_of_week"] for r in got] == ["Saturday", "Monday"]
    assert [r["order_quarter"] for r in got] == [1, 4]


def test_duplicates_go_before_signs_so_flipped_copies_stay(raw):
    same = {"order_id": "ORD-9"}
    df = raw(same, same, {**same, "revenue": "-10.0", "profit": "-4.0"})
    cleaned = c.clean(df)
    assert cleaned.columns == CLEAN_COLUMNS
    assert sorted(r["revenue"] for r in rows_of(cleaned)) == [0.0, 10.0]
    metrics = {(r["step"], r["metric"]): r["value"] for r in rows_of(c.cleaning_metrics(df))}
    assert metrics["load", "rows"] == 3
    assert metrics["remove_duplicates", "removed_rows"] == 1
    assert metrics["remove_duplicates", "removed_pct"] == 33.3
    assert metrics["handle_negative_revenue", "zeroed_rows"] == 1
    assert metrics["save", "rows"] == 2 and metrics["save", "columns"] == 22


def test_the_log_counts_what_each_step_did(spark, raw, tmp_path, monkeypatch):
    """The counts come with the two writes of cleaning itself."""
    df = raw(
        {"revenue": "12d", "region": "WEST"},
        {"order_date": "2022-13-01", "region": " west"},
        {"customer_rating": "abc", "product_category": "nan", "cost": "1e400"},
        {"quantity": "1.5", "region": None, "revenue": "1e18"},
        {"order_id": "ORD-0", "revenue": "-4"},
    )
    df = df.unionByName(df.filter("order_id = 'ORD-0'"))
    df.write.parquet(str(tmp_path / "raw-once"))
    df, log = spark.read.parquet(str(tmp_path / "raw-once")), c.CleaningLog()
    writes, plain = [], c.staged
    monkeypatch.setattr(c, "staged", lambda frame, name: writes.append(name) or plain(frame, name))
    cleaned = c.clean(df, log)
    files.write_parquet(cleaned, str(tmp_path / "clean"))
    assert writes == ["typed", "label-counts"]
    got = {r["metric"]: r["value"] for r in rows_of(log.metrics(spark)) if r["step_no"] not in (1, 9)}
    assert got["emptied_cells"] == 5 and got["emptied_revenue"] == got["emptied_order_date"] == 1
    assert got["emptied_cost"] == got["emptied_customer_rating"] == got["emptied_quantity"] == 1
    assert got["changed_labels"] == 2 and got["emptied_labels"] == 1
    assert got["dropped_rows"] == 2 and got["zeroed_rows"] == 1
    assert got["required_checks"] == 5 and got["required_passed"] == 4  # a category is missing
    assert sorted(r["revenue"] for r in rows_of(files.read_parquet(spark, str(tmp_path / "clean")))) == [0.0, 10.0, 1e18]


def test_validation(orders):
    good = c.validate(orders({}, {"order_id": "ORD-0"}))
    passed = {r["check_name"]: r["passed"] for r in rows_of(good)}
    assert passed.pop("order_id_unique") is False
    assert all(passed.values()) and c.is_valid(good).first()["valid"]
    bad = c.validate(
        orders({"revenue": -1.0}, {"customer_rating": None, "region": None}, {"order_date": date(2025, 1, 1)})
    )
    passed = {r["check_name"]: r["passed"] for r in rows_of(bad)}
    assert passed == {
        "order_id_unique": True,
        "critical_not_null": False,
        "revenue_not_negative": False,
        "rating_in_range": False,
        "first_date_in_range": True,
        "last_date_in_range": False,
    }
    assert not c.is_valid(bad).first()["valid"]


def test_raw_csv_round_trip(spark, raw, tmp_path):
    df = raw({"product_name": 'Say "hi", twice', "region": "NA"}, {"region": "South "}, {"region": None})
    files.write_csv(df, str(tmp_path / "raw"))
    got = rows_of(files.read_raw_csv(spark, str(tmp_path / "raw")).orderBy("order_id"))
    assert [r["region"] for r in got] == [None, "South ", None]
    assert got[0]["product_name"] == 'Say "hi", twice'


def test_clean_csv_round_trip(spark, orders, tmp_path):
    df = orders({}, {"customer_rating": None, "order_date": date(2023, 3, 31)})
    files.write_csv(df, str(tmp_path / "clean"))
    back = files.read_clean_csv(spark, str(tmp_path / "clean"))
    assert sorted(back.collect()) == sorted(df.collect())


def test_profile_of_raw_rows(raw):
    same = {"order_id": "ORD-9", "region": None}
    df = raw(same, same, same, {"shipping_type": None, "region": None})
    assert rows_of(profile.raw_profile(df)) == [
        {"row_count": 4, "column_count": 17, "duplicate_rows": 2}
    ]
    assert rows_of(profile.null_report(df)) == [
        {"column_name": "region", "nulls": 4, "pct": 100.0},
        {"column_name": "shipping_type", "nulls": 1, "pct": 25.0},
    ]


def test_numbers_and_labels_read_as_strictly_as_pandas(spark):
    from tillroll.operators.cleaning import fix_data_types, standardize_categories

    cells = ["12", " 12.5 ", "12d", "12f", "inf", "-Infinity", "nan", "1e3", ".5", "x"]
    columns = ["order_date", "quantity", "unit_price", "discount_pct", "revenue", "cost", "profit", "customer_rating"]
    rows = [("2022-01-05", "1", *[c] * 6) for c in cells]
    read = fix_data_types(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))).collect()
    assert [r["revenue"] for r in read] == [12.0, 12.5, None, None, None, None, None, 1000.0, 0.5, None]
    odd = [("West ",), ("　west",), ("west\x1f",), ("WEST",)]
    labels = standardize_categories(spark.createDataFrame(odd, "region string")).collect()
    assert {r["region"] for r in labels} == {"West"}
