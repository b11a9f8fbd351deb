"""Lines that do not parse, and the table by month."""

from datetime import date

from conftest import rows_of
from tillroll.schema import RAW_COLUMNS
from tillroll.sources import files

GOOD = ",".join(f"c{i}" for i in range(17))


def test_lines_that_are_no_row_are_kept_apart(spark, tmp_path):
    lines = [
        ",".join(RAW_COLUMNS), GOOD, '"a, ""b""",' + ",".join("y" * 16), GOOD.rpartition(",")[0], GOOD + ",x", '"' + GOOD, "",
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("\n".join(lines))
    (tmp_path / "in" / "two.csv").write_text("\n".join([lines[0], GOOD, "NA" + GOOD[2:]]))
    orders, rejected = files.read_checked_csv(spark, str(tmp_path / "in"))
    assert orders.columns == RAW_COLUMNS
    assert sorted((r["order_id"] or "-", r["customer_rating"]) for r in rows_of(orders)) == [
        ("-", "c16"), ('a, "b"', "y"), ("c0", "c16"), ("c0", "c16"),
    ]
    assert sorted((r["file"], r["reason"], r["record"]) for r in rows_of(rejected)) == [
        ("one.csv", "long", GOOD + ",x"),
        ("one.csv", "open quote", '"' + GOOD),
        ("one.csv", "short", GOOD.rpartition(",")[0]),
    ]


def test_quarantine_of_a_load_is_replaced_when_it_runs_again(spark, tmp_path):
    def lines(*records):
        rows = [("f.csv", "short", r) for r in records]
        return spark.createDataFrame(rows, "file string, reason string, record string")

    path = str(tmp_path / "quarantine")
    for load, records in (("d1", "ab"), ("d2", "c"), ("d1", "d")):
        files.quarantine(lines(*records), path, load)
    assert sorted((r["load"], r["record"]) for r in rows_of(files.read_parquet(spark, path))) == [("d1", "d"), ("d2", "c")]


def test_files_without_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text(",".join(RAW_COLUMNS) + "\n")
    orders, rejected = files.read_checked_csv(spark, str(tmp_path / "in"))
    assert orders.count() == 0 and rejected.count() == 0


def test_months_are_replaced_alone_and_read_alone(spark, orders, tmp_path):
    path = str(tmp_path / "months")
    days = [date(2022, 1, 5), date(2022, 1, 6), date(2022, 2, 1), date(2023, 2, 1)]
    files.write_months(orders(*[{"order_date": d} for d in days], {"order_date": days[0], "region": None}), path)
    files.write_months(orders({"order_date": date(2022, 1, 9), "region": "North"}), path)
    found = sorted((r["order_date"], r["region"]) for r in rows_of(files.read_months(spark, path)))
    assert found == [(date(2022, 1, 9), "North"), (days[2], "West"), (days[3], "West")]
    some = files.read_months(spark, path, "2022-02", "2022-12")
    assert [r["order_date"] for r in rows_of(some)] == [days[2]] and "order_period" not in some.columns
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_period" in plan
    read = {f.rsplit("/", 2)[1] for f in files.read_months(spark, path, "2022-01", "2022-01").inputFiles()}
    assert len(read) == 3  # all that the table has; what is opened is decided by the partition filter
    scan = some._jdf.queryExecution().sparkPlan().collectLeaves().head()
    assert scan.selectedPartitions().partitionCount() == 1
