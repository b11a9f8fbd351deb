"""Descriptive statistics and grouped reports over clean orders."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import (
    amount_of,
    exprs,
    fine_avg,
    int_avg,
    joined,
    kurtosis_of_moments,
    micro_sum,
    money_avg,
    money_sum,
    parts,
    pearson,
    percent,
    rounded,
    skew_of_moments,
    units,
    whole_sum,
)
from tillroll.functions.quantiles import counted_values, quantiles_of_counted
from tillroll.functions.text import dollars, lookup, month_label, percent_text
from tillroll.schema import (
    CANCELLED,
    CORRELATED_COLUMNS,
    DELIVERED,
    DESCRIBED_COLUMNS,
    RETURNED,
)
from tillroll.sources.staging import staged

# Upper ends and names of the discount buckets (right-closed, above -1).
DISCOUNT_FLOOR = -1
DISCOUNT_BUCKETS = [
    (0, "0%"),
    (5, "1-5%"),
    (10, "6-10%"),
    (15, "11-15%"),
    (20, "16-20%"),
    (25, "21-25%"),
    (100, "26%+"),
]

SUMMARY_PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]
QUARTILES = [0.25, 0.5, 0.75]

PAIRS_PER_ROW = 7


def delivered(df: DataFrame) -> DataFrame:
    return df.filter(f"order_status = '{DELIVERED}'")


# Summary statistics


def _long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """One ``(column_name, value)`` row per cell."""
    return df.selectExpr(*[f"cast({c} as double) AS {c}" for c in columns]).unpivot(
        [], columns, "column_name", "value"
    )


def _percentile_name(p: float) -> str:
    return f"{p * 100:g}%"


def describe_numbers(
    df: DataFrame,
    columns: list[str] | None = None,
    percentiles: list[float] | None = None,
    shape: bool = True,
    digits: int | None = 2,
    approx: bool = False,
) -> DataFrame:
    """Count, mean, std, extremes and percentiles as ``(column_name, stat_no, stat, value)``.

    ``shape`` adds skewness and kurtosis.  The table is read once, into the distinct values of
    each column and how often they occur; moments and percentiles come from those, written.
    """
    columns = columns or DESCRIBED_COLUMNS
    percentiles = percentiles or SUMMARY_PERCENTILES
    counted = staged(counted_values(_long_form(df, columns), "value", ["column_name"]), "values")
    fraction = "cast(rint((_v - floor(_v)) * 1000000D) as bigint)"
    listed = ", ".join(f"'{c}'" for c in columns)
    named = df.sparkSession.range(1).selectExpr(f"explode(array({listed})) AS column_name")
    base = counted.groupBy("column_name").agg(
        *exprs(
            n="sum(_n)",
            whole="sum(floor(_v) * cast(_n as double))",
            micro=f"sum(CASE WHEN abs(_v) < 1e15 THEN {fraction} * _n ELSE 0 END)",
            low="min(_v)",
            high="max(_v)",
        )
    )
    base = base.selectExpr("*", "(whole + micro / 1000000D) / n AS mean")
    # One mean per column is broadcast: the values stay where they were read and are summed there,
    # where a shuffle by column would bring all values of one to a single task.
    away = counted.join(F.broadcast(base.selectExpr("column_name", "mean")), "column_name")
    powers = away.groupBy("column_name").agg(
        *exprs(**{f"m{k}": f"sum(_n * pow(_v - mean, {k}))" for k in (2, 3, 4)})
    )
    moments = {
        "count": "coalesce(cast(n as double), 0D)",
        "mean": "mean",
        "std": "CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) END",
        "min": "low",
        "max": "high",
    }
    if shape:
        moments |= {
            "skew": skew_of_moments("n", "m2", "m3", "low", "high"),
            "kurtosis": kurtosis_of_moments("n", "m2", "m4", "low", "high"),
        }
    names = [_percentile_name(p) for p in percentiles]
    order = ["count", "mean", "std", "min", *names, "max", "skew", "kurtosis"]

    cells = [f"{order.index(stat)}, '{stat}', {sql}" for stat, sql in moments.items()]
    measured = (
        named.join(base, "column_name", "left")
        .join(powers, "column_name", "left")
        .selectExpr(
            "column_name", f"stack({len(cells)}, {', '.join(cells)}) AS (stat_no, stat, value)"
        )
    )

    quantiles = quantiles_of_counted(counted, percentiles, ["column_name"], approx=approx)
    cells = [f"{order.index(name)}, '{name}', quantiles[{i}]" for i, name in enumerate(names)]
    found = quantiles.selectExpr(
        "column_name", f"stack({len(cells)}, {', '.join(cells)}) AS (stat_no, stat, value)"
    )
    value = "value" if digits is None else rounded("value", digits)
    return measured.unionByName(found).selectExpr(
        "column_name", "stat_no", "stat", f"{value} AS value"
    )


def summary_statistics(df: DataFrame, approx: bool = False) -> DataFrame:
    return describe_numbers(df, approx=approx)


def describe_dates(df: DataFrame, column: str = "order_date") -> DataFrame:
    """Count, mean, extremes and percentiles of a date, as ``(stat_no, stat, value)`` text."""
    days = df.selectExpr(f"'{column}' AS column_name", f"unix_date({column}) AS day")
    days = staged(counted_values(days, "day", ["column_name"]), "days")

    def moment(day: str) -> str:
        # By hand: a timestamp would be shown in the session's time zone.
        second = f"cast(floor(round(({day}) * 86400D, 6)) as bigint)"
        date = f"cast(date_add(date'1970-01-01', cast(floor({second} / 86400D) as int)) as string)"
        clock = [f"pmod({second}, 86400) div 3600", f"pmod({second}, 3600) div 60"]
        clock += [f"pmod({second}, 60)"]
        return f"concat({date}, ' ', format_string('%02d:%02d:%02d', {', '.join(clock)}))"

    names = [_percentile_name(p) for p in SUMMARY_PERCENTILES]
    cells = [f"{3 + i}, '{name}', {moment(f'quantiles[{i}]')}" for i, name in enumerate(names)]
    found = quantiles_of_counted(days, SUMMARY_PERCENTILES, ["column_name"]).selectExpr(
        f"stack({len(cells)}, {', '.join(cells)}) AS (stat_no, stat, value)"
    )
    ends = days.agg(
        *exprs(
            n="coalesce(sum(_n), 0)",
            mean="try_divide(cast(sum(cast(_v as bigint) * _n) as double), sum(_n))",
            low="cast(min(_v) as bigint)",
            high="cast(max(_v) as bigint)",
        )
    ).selectExpr(
        f"stack(4, 0, 'count', cast(n as string), 1, 'mean', {moment('mean')}, 2, 'min', "
        f"{moment('low')}, {3 + len(names)}, 'max', {moment('high')}) AS (stat_no, stat, value)"
    )
    return ends.unionByName(found)


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows per value of every text column: ``(column_name, value, n)``.

    Long form, so that a column with as many values as rows stays spread out.
    """
    columns = columns or [c for c, t in df.dtypes if t == "string"]
    return (
        df.select(*columns)
        .unpivot([], columns, "column_name", "value")
        .filter("value IS NOT NULL")
        .groupBy("column_name", "value")
        .agg(*exprs(n="count(1)"))
        .orderBy("column_name", F.desc("n"), "value")
    )


# Grouped reports


def _report(df: DataFrame, key: str, order_by: str, **measures: str) -> DataFrame:
    """Delivered orders by one label; orders without the label are left out."""
    return (
        delivered(df)
        .filter(f"{key} IS NOT NULL")
        .groupBy(key)
        .agg(*exprs(**measures))
        .orderBy(F.desc(order_by), key)
    )


def revenue_by_category(df: DataFrame) -> DataFrame:
    return _report(
        df,
        "product_category",
        "total_revenue",
        total_revenue=money_sum("revenue"),
        avg_revenue=rounded(money_avg("revenue")),
        total_orders="count(order_id)",
        avg_quantity=rounded(int_avg("quantity")),
        avg_rating=rounded(fine_avg("customer_rating")),
    )


def revenue_by_region(df: DataFrame) -> DataFrame:
    return _report(
        df,
        "region",
        "total_revenue",
        total_revenue=money_sum("revenue"),
        avg_order_value=rounded(money_avg("revenue")),
        total_orders="count(order_id)",
        avg_profit=rounded(money_avg("profit")),
        avg_discount=rounded(fine_avg("discount_pct")),
    )


def revenue_by_segment(df: DataFrame) -> DataFrame:
    return _report(
        df,
        "customer_segment",
        "total_revenue",
        total_revenue=money_sum("revenue"),
        avg_order_value=rounded(money_avg("revenue")),
        total_orders="count(order_id)",
        avg_rating=rounded(fine_avg("customer_rating")),
        avg_discount=rounded(fine_avg("discount_pct")),
    )


def payment_analysis(df: DataFrame) -> DataFrame:
    return _report(
        df,
        "payment_method",
        "avg_order_value",
        total_revenue=money_sum("revenue"),
        avg_order_value=rounded(money_avg("revenue")),
        total_orders="count(order_id)",
        avg_discount=rounded(fine_avg("discount_pct")),
    )


def monthly_trend(df: DataFrame) -> DataFrame:
    return (
        delivered(df)
        .filter("order_year IS NOT NULL AND order_month IS NOT NULL")
        .groupBy("order_year", "order_month")
        .agg(
            *exprs(
                total_revenue=money_sum("revenue"),
                total_profit=money_sum("profit"),
                total_orders="count(order_id)",
                avg_order_value=rounded(money_avg("revenue")),
            )
        )
        .selectExpr("*", f"{month_label('order_year', 'order_month')} AS month_label")
        .orderBy("order_year", "order_month")
    )


def return_rate_by_category(df: DataFrame) -> DataFrame:
    """Returned and cancelled orders per category, over all statuses."""

    def having(status: str) -> str:
        return f"count(CASE WHEN order_status = '{status}' THEN order_id END)"

    return (
        df.filter("product_category IS NOT NULL")
        .groupBy("product_category")
        .agg(
            *exprs(
                total_orders="count(order_id)",
                returned=having(RETURNED),
                cancelled=having(CANCELLED),
            )
        )
        .selectExpr(
            "*",
            f"{rounded(percent('returned', 'total_orders'))} AS return_rate_pct",
            f"{rounded(percent('cancelled', 'total_orders'))} AS cancel_rate_pct",
        )
        .orderBy(F.desc("return_rate_pct"), "product_category")
    )


def discount_bucket_number(discount: str) -> str:
    """Position of the discount's bucket; null outside all buckets."""
    steps = " ".join(f"WHEN {discount} <= {up} THEN {i}" for i, (up, _) in enumerate(DISCOUNT_BUCKETS))
    return f"CASE WHEN {discount} <= {DISCOUNT_FLOOR} THEN null {steps} END"


def discount_vs_profit(df: DataFrame) -> DataFrame:
    """Mean margin and revenue per discount bucket; buckets without orders are absent."""
    names = [name for _, name in DISCOUNT_BUCKETS]
    return (
        delivered(df)
        .selectExpr(
            f"{discount_bucket_number('discount_pct')} AS bucket_no",
            "CASE WHEN revenue > 0 THEN profit / revenue * 100 ELSE 0D END AS margin",
            "revenue",
            "order_id",
        )
        .filter("bucket_no IS NOT NULL")
        .groupBy("bucket_no")
        .agg(
            *exprs(
                avg_profit_margin=rounded(fine_avg("margin")),
                avg_revenue=rounded(money_avg("revenue")),
                order_count="count(order_id)",
            )
        )
        .selectExpr(
            "bucket_no",
            f"{lookup('bucket_no', names)} AS discount_bucket",
            "avg_profit_margin",
            "avg_revenue",
            "order_count",
        )
        .orderBy("bucket_no")
    )


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r of every pair of columns, ``(ord_a, col_a, ord_b, col_b, r)``, in one pass.

    The pairs are dealt to a few rows per order, some pairs each, so that one aggregate
    keeps few enough buffers for generated code.
    """
    columns = columns or CORRELATED_COLUMNS
    position = {c: i for i, c in enumerate(columns)}
    pairs = list(combinations_with_replacement(columns, 2))
    deals = [pairs[i : i + PAIRS_PER_ROW] for i in range(0, len(pairs), PAIRS_PER_ROW)]
    blank = "cast(null as double)"
    rows = []
    for i, deal in enumerate(deals):
        values = [f"cast({c} as double)" for pair in deal for c in pair]
        values += [blank] * (2 * PAIRS_PER_ROW - len(values))
        rows.append(f"{i}, {', '.join(values)}")
    names = ", ".join(f"x{k}, y{k}" for k in range(PAIRS_PER_ROW))
    dealt = (
        delivered(df)
        .selectExpr(f"stack({len(deals)}, {', '.join(rows)}) AS (deal, {names})")
        .groupBy("deal")
        .agg(*exprs(**{f"r{k}": pearson(f"x{k}", f"y{k}") for k in range(PAIRS_PER_ROW)}))
    )
    # A handful of rows: name the pairs and mirror those off the diagonal.
    cells = ", ".join(f"{k}, r{k}" for k in range(PAIRS_PER_ROW))
    found = dealt.selectExpr("deal", f"stack({PAIRS_PER_ROW}, {cells}) AS (k, r)").selectExpr(
        f"deal * {PAIRS_PER_ROW} + k AS pair_no", f"{rounded('r', 3)} AS r"
    )
    one_way = found.filter(f"pair_no < {len(pairs)}").selectExpr(
        f"{lookup('pair_no', [a for a, _ in pairs])} AS col_a",
        f"{lookup('pair_no', [b for _, b in pairs])} AS col_b",
        "r",
    )
    both_ways = one_way.selectExpr(
        "stack(2, col_a, col_b, r, false, col_b, col_a, r, true) AS (col_a, col_b, r, mirrored)"
    ).filter("NOT mirrored OR col_a <> col_b")
    place = " ".join(f"WHEN '{c}' THEN {i}" for c, i in position.items())
    return both_ways.selectExpr(
        f"CASE col_a {place} END AS ord_a", "col_a", f"CASE col_b {place} END AS ord_b", "col_b", "r"
    )


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The square matrix, one row per column in the given order."""
    columns = columns or CORRELATED_COLUMNS
    cells = {c: f"max(CASE WHEN col_b = '{c}' THEN r END)" for c in columns}
    return (
        correlation_pairs(df, columns)
        .groupBy("ord_a", "col_a")
        .agg(*exprs(**cells))
        .orderBy("ord_a")
        .selectExpr("col_a AS column_name", *columns)
    )


# Several groupings in one scan

# What each kind of grouping goes by; a row without one of its labels belongs to no group.
GROUPINGS = {
    "all": [],
    "year": ["order_year"],
    "month": ["order_year", "order_month"],
    "category": ["product_category"],
    "region": ["region"],
    "segment": ["customer_segment"],
    "payment": ["payment_method"],
    "discount": ["bucket_no"],
}


def grouped_once(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Groups of several kinds from one scan, written: ``(kind, label, rows, delivered, ...)``.

    One aggregate over grouping sets.  ``label`` is the group as text (a month as ``2024-05``).
    Amounts are there as parts and can be added on.
    """
    columns = list(dict.fromkeys(c for kind in kinds for c in GROUPINGS[kind]))
    done = f"order_status = '{DELIVERED}'"
    margin = "CASE WHEN revenue > 0 THEN profit / revenue * 100 ELSE 0D END"
    # Only what a measure of one of the kinds reads is asked of the table.
    buckets = f"CASE WHEN {done} THEN {discount_bucket_number('discount_pct')} END AS bucket_no"
    keyed = df.selectExpr(
        *[buckets if c == "bucket_no" else c for c in columns],
        "order_id",
        "order_status",
        f"{done} AS done",
        f"CASE WHEN {done} THEN revenue END AS revenue",
        f"CASE WHEN {done} THEN profit END AS profit",
        f"CASE WHEN {done} THEN {margin} END AS margin",
    )

    def having(status: str) -> str:
        return f"count(CASE WHEN order_status = '{status}' THEN order_id END)"

    measures = {
        "rows": "count(1)",
        "ids": "count(order_id)",
        "delivered": "count_if(done)",
        "orders": "count(CASE WHEN done THEN order_id END)",
        "returned": having(RETURNED),
        "cancelled": having(CANCELLED),
        "returned_rows": f"count_if(order_status = '{RETURNED}')",
        "cancelled_rows": f"count_if(order_status = '{CANCELLED}')",
        "earning": f"count({units('revenue')})",
        **parts(revenue="revenue", profit="profit"),
        "margins": "count(margin)",
        "margin_whole": whole_sum("margin"),
        "margin_micro": micro_sum("margin"),
    }
    sets = [[F.col(c) for c in GROUPINGS[kind]] for kind in kinds]
    grouped = keyed.groupingSets(sets, *columns).agg(
        *[F.grouping(c).alias(f"_{c}") for c in columns], *exprs(**measures)
    )
    own = {
        kind: " AND ".join(f"_{c} = {int(c not in GROUPINGS[kind])}" for c in columns) or "true" for kind in kinds
    }
    texts = {
        kind: month_label("order_year", "order_month") if kind == "month" else f"cast({GROUPINGS[kind][0]} as string)"
        for kind in kinds
        if GROUPINGS[kind]
    }
    named = " ".join(f"WHEN {sql} THEN '{kind}'" for kind, sql in own.items())
    shown = " ".join(f"WHEN {own[kind]} THEN {sql}" for kind, sql in texts.items())
    whole = " ".join(
        f"WHEN {own[kind]} THEN " + (" AND ".join(f"{c} IS NOT NULL" for c in GROUPINGS[kind]) or "true") for kind in kinds
    )
    found = grouped.filter(f"CASE {whole} END").selectExpr(
        f"CASE {named} END AS kind", f"CASE {shown} END AS label" if shown else "cast(null as string) AS label", *measures
    )
    return staged(found, "groups")


def groups_of(groups: DataFrame, kind: str, key: str, kind_of_key: str = "string") -> DataFrame:
    """One kind of ``grouped_once`` as a report of delivered orders, with its usual measures."""
    revenue = amount_of("revenue")
    return groups.filter(f"kind = '{kind}' AND delivered > 0").selectExpr(
        f"cast(label as {kind_of_key}) AS {key}",
        f"{revenue} AS total_revenue",
        f"{rounded(f'try_divide({joined("revenue_units", "revenue_nanos")}, earning)')} AS avg_order_value",
        "orders AS total_orders",
    )


# Business questions


def yearly_growth(df: DataFrame) -> DataFrame:
    """Revenue of the first and the last year and the change in percent."""
    yearly = (
        delivered(df)
        .filter("order_year IS NOT NULL")
        .groupBy("order_year")
        .agg(*exprs(total_revenue=money_sum("revenue")))
    )
    return _growth(yearly)


def _growth(yearly: DataFrame) -> DataFrame:
    growth = "try_divide(last_revenue - first_revenue, first_revenue) * 100"
    return yearly.agg(
        *exprs(
            first_year="min(order_year)",
            first_revenue="min_by(total_revenue, order_year)",
            last_year="max(order_year)",
            last_revenue="max_by(total_revenue, order_year)",
        )
    ).selectExpr("*", f"{rounded(growth, 1)} AS growth_pct")


def top_categories(df: DataFrame, n: int = 2) -> DataFrame:
    """The leading categories by revenue, ranked."""
    return _leading(revenue_by_category(df), n)


def _leading(report: DataFrame, n: int) -> DataFrame:
    best = (
        report.select("product_category", "total_revenue")
        .orderBy(F.desc("total_revenue"), "product_category")
        .limit(n)
    )
    # At most n rows are left: number them in one list.
    listed = "sort_array(collect_list(struct(-total_revenue AS below, product_category)))"
    return (
        best.agg(*exprs(ranked=listed))
        .selectExpr("posexplode(ranked) AS (pos, item)")
        .selectExpr("pos + 1 AS rank", "item.product_category", "-item.below AS total_revenue")
    )


def top_region(df: DataFrame) -> DataFrame:
    return _best(revenue_by_region(df), "region", "total_revenue").select(
        "region", "total_revenue", "avg_order_value"
    )


def _best(report: DataFrame, key: str, measure: str) -> DataFrame:
    return report.orderBy(F.desc(measure), key).limit(1)


def segment_insight(
    df: DataFrame, high_value: str = "Premium", high_volume: str = "Regular"
) -> DataFrame:
    """Order value and order count of two named segments."""
    return _named_segments(revenue_by_segment(df), high_value, high_volume)


def _named_segments(report: DataFrame, high_value: str, high_volume: str) -> DataFrame:
    segment = F.col("customer_segment")
    return report.filter(segment.isin(high_value, high_volume)).select(
        F.when(segment == high_value, "high_value").otherwise("high_volume").alias("role"),
        "customer_segment",
        "avg_order_value",
        "total_orders",
    )


def top_payment(df: DataFrame) -> DataFrame:
    best = _best(payment_analysis(df), "payment_method", "avg_order_value")
    return best.select("payment_method", "avg_order_value")


def discount_erosion(df: DataFrame) -> DataFrame:
    """Margin of the lowest and the highest discount bucket and the drop between them."""
    return _erosion(discount_vs_profit(df))


def _erosion(report: DataFrame) -> DataFrame:
    return report.agg(
        *exprs(
            first_margin="min_by(avg_profit_margin, bucket_no)",
            last_margin="max_by(avg_profit_margin, bucket_no)",
        )
    ).selectExpr("*", f"{rounded('first_margin - last_margin', 1)} AS margin_drop")


def worst_return_category(df: DataFrame) -> DataFrame:
    best = _best(return_rate_by_category(df), "product_category", "return_rate_pct")
    return best.select("product_category", "return_rate_pct")


def _answers(question_no: int, frame: DataFrame, text: dict[str, str], number: dict[str, str]):
    """Rows ``(question_no, metric, value_num, value_str)`` of a one-row frame."""
    cells = [f"'{m}', cast(null as double), {c}" for m, c in text.items()]
    cells += [f"'{m}', cast({c} as double), cast(null as string)" for m, c in number.items()]
    return frame.selectExpr(
        f"{question_no} AS question_no",
        f"stack({len(cells)}, {', '.join(cells)}) AS (metric, value_num, value_str)",
    )


def business_answers(
    df: DataFrame, high_value: str = "Premium", high_volume: str = "Regular"
) -> DataFrame:
    """The computed values behind the seven business questions, as rows.

    All groupings come from one scan; the answers are found in the few groups it leaves.
    """
    groups = grouped_once(df, ["year", "category", "region", "segment", "payment", "discount"])
    categories = groups_of(groups, "category", "product_category")
    years = groups_of(groups, "year", "order_year", "int")
    regions = groups_of(groups, "region", "region")
    payments = groups_of(groups, "payment", "payment_method")
    margin = rounded("try_divide(margin_whole + margin_micro / 1000000D, margins)")
    discounts = groups.filter("kind = 'discount'").selectExpr(
        "cast(label as int) AS bucket_no", f"{margin} AS avg_profit_margin"
    )
    returns = groups.filter("kind = 'category'").selectExpr(
        "label AS product_category", f"{rounded(percent('returned', 'ids'))} AS return_rate_pct"
    )
    ranked = _leading(categories, 2).agg(
        *exprs(
            top="min_by(product_category, rank)",
            top_revenue="max(total_revenue)",
            second="max(CASE WHEN rank = 2 THEN product_category END)",
        )
    )
    segments = _named_segments(
        groups_of(groups, "segment", "customer_segment"), high_value, high_volume
    ).agg(
        *exprs(
            **{
                f"{role}_{c}": f"max(CASE WHEN role = '{role}' THEN {c} END)"
                for role in ("high_value", "high_volume")
                for c in ("customer_segment", "avg_order_value", "total_orders")
            }
        )
    )
    growth = ["first_year", "first_revenue", "last_year", "last_revenue", "growth_pct"]
    answers = [
        _answers(1, _growth(years), {}, {c: c for c in growth}),
        _answers(
            2,
            ranked,
            {"top_category": "top", "second_category": "second"},
            {"top_revenue": "top_revenue"},
        ),
        _answers(
            3,
            _best(regions, "region", "total_revenue"),
            {"top_region": "region"},
            {"total_revenue": "total_revenue", "avg_order_value": "avg_order_value"},
        ),
        _answers(
            4,
            segments,
            {
                "high_value_segment": "high_value_customer_segment",
                "high_volume_segment": "high_volume_customer_segment",
            },
            {
                "high_value_avg_order_value": "high_value_avg_order_value",
                "high_value_orders": "high_value_total_orders",
                "high_volume_orders": "high_volume_total_orders",
            },
        ),
        _answers(
            5,
            _best(payments, "payment_method", "avg_order_value"),
            {"top_payment": "payment_method"},
            {"avg_order_value": "avg_order_value"},
        ),
        _answers(
            6,
            _erosion(discounts),
            {},
            {"first_margin": "first_margin", "last_margin": "last_margin"},
        ),
        _answers(
            7,
            _best(returns, "product_category", "return_rate_pct"),
            {"worst_category": "product_category"},
            {"return_rate_pct": "return_rate_pct"},
        ),
    ]
    out = answers[0]
    for answer in answers[1:]:
        out = out.unionByName(answer)
    return out


def display_answers(answers: DataFrame) -> DataFrame:
    """Business answers with display text: ``(question_no, metric, display)``."""
    return answers.selectExpr(
        "question_no",
        "metric",
        "CASE WHEN value_str IS NOT NULL THEN value_str "
        f"WHEN metric LIKE '%revenue' THEN {dollars('value_num')} "
        f"WHEN metric LIKE '%order_value' THEN {dollars('value_num', 2)} "
        "WHEN metric LIKE '%orders' THEN format_string('%,.0f', value_num) "
        "WHEN metric LIKE '%year' THEN format_string('%.0f', value_num) "
        f"ELSE {percent_text('value_num')} END AS display",
    )


def run_reports(
    df: DataFrame,
    high_value: str = "Premium",
    high_volume: str = "Regular",
    approx: bool = False,
) -> dict[str, DataFrame]:
    """Every report over one clean table, by name; nothing runs until a result is used."""
    return {
        "summary_stats": summary_statistics(df, approx),
        "summary_stats_date": describe_dates(df),
        "categorical_summary": categorical_summary(df),
        "revenue_by_category": revenue_by_category(df),
        "revenue_by_region": revenue_by_region(df),
        "revenue_by_segment": revenue_by_segment(df),
        "payment_analysis": payment_analysis(df),
        "discount_vs_profit": discount_vs_profit(df),
        "return_rates": return_rate_by_category(df),
        "correlation_matrix": correlation_matrix(df),
        "monthly_trend": monthly_trend(df),
        "business_answers": business_answers(df, high_value, high_volume),
    }
