"""Cleaning of raw orders: duplicates, types, labels, gaps, signs, date parts, checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.numeric import exprs
from tillroll.functions.text import quoted, title_case
from tillroll.schema import AMOUNT_COLUMNS, LABEL_COLUMNS
from tillroll.sources.staging import staged

# Label spellings that title case leaves apart.
CATEGORY_SPELLINGS = {"Home & garden": "Home & Garden"}

# All that Python's str.strip() takes off.
WHITESPACE = (
    " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$"
# A day, alone or with a time of day; anything behind it makes the cell unreadable.
DATE = (
    "^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{8})"
    "([ T]([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]{1,9})?)?)?$"
)
DAY = "^([0-9]{4})[-/]?([0-9]{1,2})[-/]?([0-9]{1,2})$"

CRITICAL_COLUMNS = ["order_date", "order_id", "revenue"]
CHECKED_COLUMNS = ["order_date", "revenue", "product_category", "region"]

TIME_FEATURES = {
    "order_year": "year(order_date)",
    "order_month": "month(order_date)",
    "order_quarter": "quarter(order_date)",
    "order_day_of_week": "date_format(order_date, 'EEEE')",
    "order_week": "weekofyear(order_date)",
}


class CleaningLog:
    """What each step did, counted while its result is written: no scan is made for it.

    Hand one to ``clean``; ``metrics`` has the counts once the cleaned table was written.  (Tasks
    that ran again after an executor was lost may count their rows twice; the table is right.)
    """

    def __init__(self) -> None:
        self.read, self.once = Observation("read"), Observation("once")
        self.typed, self.filled, self.saved = Observation("typed"), Observation("filled"), Observation("saved")
        self.columns: list[str] = []

    def metrics(
        self, spark: SparkSession, first_date: str = "2022-01-01", last_date: str = "2024-12-31"
    ) -> DataFrame:
        """``(step_no, step, metric, value)`` rows; cells that a step emptied stand column by column."""
        read, once, filled, saved = self.read.get["rows"], self.once.get["rows"], self.filled.get, self.saved.get
        typed = {k: v or 0 for k, v in self.typed.get.items()}
        emptied = [c for c in [*AMOUNT_COLUMNS, "order_date", "quantity"] if f"emptied_{c}" in typed]
        labels = [c for c in LABEL_COLUMNS if f"emptied_{c}" in typed]
        first, last = saved["first_date"], saved["last_date"]
        passed = [
            not saved["empty_cells"],
            not saved["bad_revenue"],
            not saved["bad_rating"],
            first is not None and str(first) >= first_date,
            last is not None and str(last) <= last_date,
        ]
        removed = read - once
        rows = [
            (1, "load", "rows", read),
            (1, "load", "columns", len(self.columns)),
            (2, "remove_duplicates", "removed_rows", removed),
            (2, "remove_duplicates", "removed_pct", round(removed / read * 100, 1) if read else None),
            (3, "fix_data_types", "emptied_cells", sum(typed[f"emptied_{c}"] for c in emptied)),
            *[(3, "fix_data_types", f"emptied_{c}", typed[f"emptied_{c}"]) for c in emptied],
            (4, "standardize_categories", "changed_labels", sum(typed[f"changed_{c}"] for c in labels)),
            (4, "standardize_categories", "emptied_labels", sum(typed[f"emptied_{c}"] for c in labels)),
            (5, "handle_missing_values", "nulls_before", filled["nulls_before"] or 0),
            (5, "handle_missing_values", "nulls_after", filled["nulls_after"] or 0),
            (5, "handle_missing_values", "dropped_rows", filled["dropped_rows"]),
            (6, "handle_negative_revenue", "zeroed_rows", filled["zeroed_rows"]),
            (7, "add_time_features", "columns_added", len(TIME_FEATURES)),
            (8, "validate", "required_checks", len(passed)),
            (8, "validate", "required_passed", sum(passed)),
            (9, "save", "rows", saved["rows"]),
            (9, "save", "columns", len(self.columns) + len(TIME_FEATURES)),
        ]
        rows = [(no, step, name, None if value is None else float(value)) for no, step, name, value in rows]
        return spark.createDataFrame(rows, "step_no int, step string, metric string, value double")


def _replaced(df: DataFrame, **changed: str) -> DataFrame:
    """The same columns, some of them from a new expression."""
    return df.selectExpr(*[f"{changed.get(c, f'`{c}`')} AS `{c}`" for c in df.columns])


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of every set of equal rows.

    A hash aggregate over all columns: copies collapse before the shuffle, so a row
    repeated any number of times costs one row per map task.
    """
    return df.dropDuplicates()


def _number(c: str, text: bool = False) -> str:
    """A double or null: no type suffixes; infinities count as missing."""
    value = f"CASE WHEN {c} RLIKE '{NUMBER}' THEN try_cast({c} as double) END" if text else c
    return f"CASE WHEN abs(try_cast({value} as double)) < double('Infinity') THEN try_cast({value} as double) END"


def _date(c: str) -> str:
    """The day of a text: year, month and day with dashes, slashes or no mark between them.

    A time of day behind a blank or ``T`` is left off; days that no calendar has are null.
    """
    day = f"regexp_extract(trim(BOTH {quoted(WHITESPACE)} FROM {c}), '{DATE}', 1)"
    return f"try_to_date(regexp_replace({day}, '{DAY}', '$1-$2-$3'), 'yyyy-M-d')"


def _typed(df: DataFrame) -> dict[str, str]:
    """How each cell is read that is not a label."""
    kinds = dict(df.dtypes)
    whole = _number("quantity", kinds["quantity"] == "string")
    as_text = kinds["order_date"] == "string"
    return {
        "order_date": _date("order_date") if as_text else "cast(order_date as date)",
        "quantity": f"try_cast(CASE WHEN {whole} = rint({whole}) THEN {whole} END as int)",
        **{c: _number(c, kinds[c] == "string") for c in AMOUNT_COLUMNS},
    }


def fix_data_types(df: DataFrame) -> DataFrame:
    """Dates and numbers; a cell that cannot be read becomes null."""
    return _replaced(df, **_typed(df))


def standardize_categories(
    df: DataFrame, spellings: Mapping[str, str] = CATEGORY_SPELLINGS
) -> DataFrame:
    """Trim and title-case the label columns that are present; a label "nan" means missing."""
    present = [c for c in LABEL_COLUMNS if c in df.columns]
    trimmed = _replaced(df, **{c: f"trim(BOTH {quoted(WHITESPACE)} FROM {c})" for c in present})
    out = _replaced(trimmed, **{c: f"nullif({title_case(c)}, 'Nan')" for c in present})
    if spellings and "product_category" in present:
        out = out.replace(dict(spellings), subset=["product_category"])
    return out


def _fill_values(df: DataFrame) -> dict[str, Column]:
    """Median rating and most frequent region and shipping type, as scalar subqueries.

    The table is read once, into counts per (region, shipping type, rating); the three
    values come from that small table.
    """
    counts = staged(
        df.groupBy("region", "shipping_type", "customer_rating").agg(*exprs(n="count(1)")),
        "label-counts",
    )
    # One row per rating that occurs: the two middle ones are those that first pass their ranks.
    rated = counts.filter("customer_rating IS NOT NULL").groupBy("customer_rating").agg(*exprs(n="sum(n)"))
    rated = rated.selectExpr(
        "customer_rating", "sum(n) OVER (ORDER BY customer_rating) AS upto", "sum(n) OVER () AS total"
    )
    low = "min(customer_rating) FILTER (WHERE upto > (total - 1) div 2)"
    high = "min(customer_rating) FILTER (WHERE upto > total div 2)"
    median = rated.agg(*exprs(median=f"{high} - ({high} - {low}) * 0.5D"))

    def most_frequent(c: str) -> Column:
        # The smallest of the labels that share the highest count.
        by_count = counts.filter(f"{c} IS NOT NULL").groupBy(c).agg(*exprs(n="sum(n)"))
        return by_count.orderBy(F.desc("n"), c).limit(1).select(c).scalar()

    return {
        "customer_rating": median.scalar(),
        "region": most_frequent("region"),
        "shipping_type": most_frequent("shipping_type"),
    }


def imputation_values(df: DataFrame) -> DataFrame:
    """One row: ``median_rating``, ``mode_region``, ``mode_shipping``."""
    fill = _fill_values(df)
    return df.sparkSession.range(1).select(
        fill["customer_rating"].alias("median_rating"),
        fill["region"].alias("mode_region"),
        fill["shipping_type"].alias("mode_shipping"),
    )


def fill_missing(df: DataFrame) -> DataFrame:
    """Median rating, zero discount, most frequent region and shipping type."""
    fill = {**_fill_values(df), "discount_pct": F.lit(0.0)}
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def handle_missing_values(df: DataFrame, log: CleaningLog | None = None) -> DataFrame:
    """Fill the gaps, then drop rows without a date, an id or a revenue."""
    if log is None:
        return fill_missing(df).dropna(subset=CRITICAL_COLUMNS)
    kept = " AND ".join(f"{c} IS NOT NULL" for c in CRITICAL_COLUMNS)
    counted = fill_missing(df.selectExpr("*", f"{null_cells(df.columns)} AS _before"))
    counted = counted.observe(
        log.filled,
        *exprs(
            nulls_before="sum(_before)",
            nulls_after=f"sum(CASE WHEN {kept} THEN {null_cells(df.columns)} END)",
            dropped_rows=f"count_if(NOT ({kept}))",
            zeroed_rows=f"count_if({kept} AND revenue < 0)",
        ),
    )
    return counted.drop("_before").dropna(subset=CRITICAL_COLUMNS)


def handle_negative_revenue(df: DataFrame) -> DataFrame:
    """Zero revenue and profit wherever revenue is below zero; cost stays."""
    zeroed = {c: f"CASE WHEN revenue < 0 THEN 0D ELSE {c} END" for c in ("revenue", "profit")}
    return _replaced(df, **zeroed)


def add_time_features(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c not in TIME_FEATURES]
    return df.selectExpr(
        *[f"`{c}`" for c in kept], *[f"{sql} AS {c}" for c, sql in TIME_FEATURES.items()]
    )


def _observed_types(once: DataFrame, log: CleaningLog) -> DataFrame:
    """Types and labels at once, counting the cells that change or cannot be read."""
    columns = once.columns
    labels = [c for c in LABEL_COLUMNS if c in columns]
    both = once.select("*", F.struct(*columns).alias("_raw"))
    both = standardize_categories(fix_data_types(both))
    read = [c for c in ("order_date", "quantity", *AMOUNT_COLUMNS) if c in columns]
    counts = {f"emptied_{c}": f"count_if(_raw.{c} IS NOT NULL AND {c} IS NULL)" for c in [*read, *labels]}
    counts |= {f"changed_{c}": f"count_if(_raw.{c} <> {c})" for c in labels}
    return both.observe(log.typed, *exprs(**counts)).select(*columns)


def deduplicated_and_typed(raw: DataFrame, log: CleaningLog | None = None) -> DataFrame:
    """The first three steps, staged: the fill values and the filled table both read it,
    and the shuffle of whole rows should run once."""
    if log is None:
        steps = raw.transform(remove_duplicates).transform(fix_data_types).transform(standardize_categories)
        return staged(steps, "typed")
    log.columns = list(raw.columns)
    once = remove_duplicates(raw.observe(log.read, *exprs(rows="count(1)")))
    once = once.observe(log.once, *exprs(rows="count(1)"))
    return staged(_observed_types(once, log), "typed")


def clean_typed(typed: DataFrame, log: CleaningLog | None = None) -> DataFrame:
    """The steps after the staged table."""
    out = (
        typed.transform(handle_missing_values, log)
        .transform(handle_negative_revenue)
        .transform(add_time_features)
    )
    if log is None:
        return out
    return out.observe(
        log.saved,
        *exprs(
            rows="count(1)",
            empty_cells=f"coalesce(sum({null_cells(CHECKED_COLUMNS)}), 0)",
            bad_revenue="count_if(NOT coalesce(revenue >= 0, false))",
            bad_rating="count_if(NOT coalesce(customer_rating BETWEEN 1 AND 5, false))",
            first_date="min(order_date)",
            last_date="max(order_date)",
        ),
    )


def clean(raw: DataFrame, log: CleaningLog | None = None) -> DataFrame:
    """All steps in their fixed order; ``log`` counts what they do while the result is written."""
    return clean_typed(deduplicated_and_typed(raw, log), log)


def null_cells(columns: list[str]) -> str:
    """Number of empty cells of a row."""
    return "(" + " + ".join(f"cast(`{c}` IS NULL as int)" for c in columns) + ")"


def cleaning_metrics(
    raw: DataFrame, first_date: str = "2022-01-01", last_date: str = "2024-12-31"
) -> DataFrame:
    """What each step does to these raw orders, as ``(step_no, step, metric, value)`` rows.

    Cleans without keeping the result; with a table to write, hand ``clean`` a ``CleaningLog``.
    """
    log = CleaningLog()
    clean(raw, log).write.format("noop").mode("overwrite").save()
    return log.metrics(raw.sparkSession, first_date, last_date)


def validate(
    df: DataFrame, first_date: str = "2022-01-01", last_date: str = "2024-12-31"
) -> DataFrame:
    """Checks as ``(check_no, check_name, required, passed)`` rows.

    Uniqueness of order_id is reported but not required.
    """
    copies = df.groupBy("order_id").agg(*exprs(n="count(1)"))
    seen = df.agg(
        *exprs(
            empty_cells=f"coalesce(sum({null_cells(CHECKED_COLUMNS)}), 0)",
            bad_revenue="count_if(NOT coalesce(revenue >= 0, false))",
            bad_rating="count_if(NOT coalesce(customer_rating BETWEEN 1 AND 5, false))",
            first_date="min(order_date)",
            last_date="max(order_date)",
        )
    ).withColumn("most_copies", copies.agg(*exprs(n="max(n)")).scalar())
    checks = [
        ("order_id_unique", "false", "coalesce(most_copies, 0) <= 1"),
        ("critical_not_null", "true", "empty_cells = 0"),
        ("revenue_not_negative", "true", "bad_revenue = 0"),
        ("rating_in_range", "true", "bad_rating = 0"),
        ("first_date_in_range", "true", f"coalesce(first_date >= date'{first_date}', false)"),
        ("last_date_in_range", "true", f"coalesce(last_date <= date'{last_date}', false)"),
    ]
    cells = ", ".join(
        f"{i}, '{name}', {required}, {passed}" for i, (name, required, passed) in enumerate(checks, 1)
    )
    return seen.selectExpr(
        f"stack({len(checks)}, {cells}) AS (check_no, check_name, required, passed)"
    )


def is_valid(checks: DataFrame) -> DataFrame:
    """One row: whether every required check passed."""
    return checks.agg(*exprs(valid="bool_and(passed OR NOT required)"))
