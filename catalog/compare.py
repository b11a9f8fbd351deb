"""Run queries in Spark and their SQL in DuckDB and compare the rows exactly.

    python -m catalog.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from catalog.oracle import ORACLE
from catalog.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def _sorted(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(row[i] for i in order) for row in rows), key=_key
    )


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """What differs between the two results, or None."""
    df = QUERIES[name](spark, sf_dir)
    columns, got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    expected_columns, expected = _sorted(names, cursor.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from tillroll.plans.session import local_session

    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            if name in ORACLE:
                found = difference(spark, con, sf_dir, name)
            else:
                found = None if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001 - report every query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{name}: {found or 'equal'} [{time.time() - started:.1f}s]", flush=True)
    print(f"{failed} of {len(names or QUERIES)} differ")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
