"""Reading and writing order tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.text import quoted
from tillroll.schema import CLEAN_SCHEMA, RAW_COLUMNS, RAW_TEXT_SCHEMA
from tillroll.sources.staging import staged

# Cell texts that stand for a missing value in a raw file.
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]


def missing_to_null(df: DataFrame) -> DataFrame:
    """Turn the missing-value texts of every string column into nulls."""
    tokens = ", ".join(map(quoted, MISSING_TOKENS))
    return df.selectExpr(
        *[
            f"CASE WHEN `{c}` NOT IN ({tokens}) THEN `{c}` END AS `{c}`" if t == "string" else f"`{c}`"
            for c, t in df.dtypes
        ]
    )


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw order file(s): header row, quotes doubled inside quoted cells, all text."""
    raw = (
        spark.read.schema(RAW_TEXT_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return missing_to_null(raw)


RECORD = "_record"


def _reason(record: str) -> str:
    """Why a line did not make a row, by what is left of it outside of quoted cells."""
    rest = f"""regexp_replace({record}, '"([^"]|"")*"', '')"""
    cells = f"1 + length({rest}) - length(replace({rest}, ',', ''))"
    return (
        f"CASE WHEN instr({rest}, '\"') > 0 THEN 'open quote' WHEN {cells} < {len(RAW_COLUMNS)} THEN 'short' "
        f"WHEN {cells} > {len(RAW_COLUMNS)} THEN 'long' ELSE 'unreadable' END"
    )


def read_checked_csv(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Raw orders, and the lines that do not make one: ``(orders, rejected)``.

    A line with fewer or more cells than there are columns, or with a quote that is never closed,
    is kept apart as ``(file, reason, record)`` instead of being filled up or cut.  The files are
    read once: rows and lines are written together, and both results read that table.
    """
    schema = T.StructType([*RAW_TEXT_SCHEMA.fields, T.StructField(RECORD, T.StringType())])
    rows = (
        spark.read.schema(schema)
        .option("header", header)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RECORD)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    rows = staged(rows.withColumn("_file", F.col("_metadata.file_name")), "parsed")
    orders = missing_to_null(rows.filter(f"{RECORD} IS NULL").select(*RAW_COLUMNS))
    rejected = rows.filter(f"{RECORD} IS NOT NULL").selectExpr(
        "_file AS file", f"{_reason(RECORD)} AS reason", f"{RECORD} AS record"
    )
    return orders, rejected


def quarantine(rejected: DataFrame, path: str, load: str) -> None:
    """Adds the rejected lines of one load to the quarantine table; loading it again replaces them."""
    (
        rejected.withColumn("load", F.lit(load))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("load")
        .parquet(path)
    )


MONTH = "order_period"


def write_months(df: DataFrame, path: str) -> None:
    """Orders in one folder per month of ``order_date``; months that are written replace their
    folder, others stay.

    Running a month again is therefore safe.  Rows are rebalanced by month before the write, so a
    small month is one file, and a large one is split into files of about the advisory size.
    """
    (
        df.withColumn(MONTH, F.date_format("order_date", "yyyy-MM"))
        .hint("rebalance", MONTH)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH)
        .parquet(path)
    )


def read_months(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Such a table, or only the months from ``first`` to ``last`` (``2024-05``): others are not opened."""
    df = spark.read.parquet(path).withColumn(MONTH, F.col(MONTH).cast("string"))
    if first is not None:
        df = df.filter(F.col(MONTH) >= first)
    if last is not None:
        df = df.filter(F.col(MONTH) <= last)
    return df.drop(MONTH)


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(CLEAN_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, written in parallel; blanks are kept."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"')
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """The default table format: readers prune columns and push filters into it."""
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(lines: DataFrame, path: str) -> None:
    """One text file from a small frame with columns ``line_no`` and ``line``."""
    lines.orderBy("line_no").coalesce(1).select("line").write.mode("overwrite").text(path)
