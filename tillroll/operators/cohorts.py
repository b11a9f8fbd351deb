"""Customer cohorts, retention and lifetime value.

Everything per customer starts from counts per (customer, month): a customer who placed
a third of all orders is a few dozen rows once the map side has combined them, so the
window over a customer never meets more rows than there are months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.joins import HOT_PARTS, salted_left_join
from tillroll.functions.numeric import (
    amount_of,
    exprs,
    fine_avg,
    joined,
    money_avg,
    money_sum,
    parts,
    percent,
    rounded,
    summed_parts,
    units,
)
from tillroll.functions.text import dollars, month_label, percent_text
from tillroll.operators.reports import delivered
from tillroll.schema import DELIVERED


def month_index(date: str) -> str:
    return f"(year({date}) * 12 + month({date}) - 1)"


def first_purchase(df: DataFrame) -> DataFrame:
    """First order date of every customer, over all statuses, and its month."""
    return (
        df.filter("customer_id IS NOT NULL")
        .groupBy("customer_id")
        .agg(*exprs(cohort_date="min(order_date)"))
        .selectExpr("*", "date_format(cohort_date, 'yyyy-MM') AS cohort_month")
    )


def cohort_orders(df: DataFrame, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Every order with its cohort month, its own month and the months between.

    The one row-level join here, with hot customers kept out of its shuffle.
    """
    customers = (
        df.filter("customer_id IS NOT NULL")
        .groupBy("customer_id")
        .agg(*exprs(cohort_date="min(order_date)", orders="count(1)"))
    )
    joined = salted_left_join(df, customers, "customer_id", "orders", "order_id", hot_parts)
    return joined.selectExpr(
        *df.columns,
        "date_format(cohort_date, 'yyyy-MM') AS cohort_month",
        "date_format(order_date, 'yyyy-MM') AS order_period",
        f"{month_index('order_date')} - {month_index('cohort_date')} AS months_since_cohort",
    )


def cohort_cells(df: DataFrame) -> DataFrame:
    """One row per (cohort month, age in months): customers, and delivered orders' sums."""
    done = f"order_status = '{DELIVERED}'"
    active = (
        df.filter("customer_id IS NOT NULL AND order_date IS NOT NULL")
        .selectExpr(
            "customer_id",
            f"{month_index('order_date')} AS month",
            f"{done} AS done",
            f"CASE WHEN {done} THEN revenue END AS amount",
        )
        .groupBy("customer_id", "month")
        .agg(*exprs(done="count_if(done)", **parts(amount="amount"), priced=f"count({units('amount')})"))
    )
    return (
        active.selectExpr("*", "min(month) OVER (PARTITION BY customer_id) AS cohort")
        .selectExpr("*", "month - cohort AS months_since_cohort")
        .groupBy("cohort", "months_since_cohort")
        .agg(
            *exprs(
                unique_customers="count(1)",
                delivered_orders="sum(done)",
                **summed_parts("amount"),
                priced_orders="sum(priced)",
            )
        )
        .selectExpr(
            f"{month_label('cast(floor(cohort / 12) as int)', 'cohort % 12 + 1')} AS cohort_month",
            "months_since_cohort",
            "unique_customers",
            "delivered_orders",
            f"{amount_of('amount')} AS delivered_amount",
            "priced_orders",
        )
    )


def possible_ages(df: DataFrame) -> list[int]:
    """Every age that the table's date range allows (a small job)."""
    span = f"max({month_index('order_date')}) - min({month_index('order_date')})"
    (longest,) = df.agg(*exprs(span=f"coalesce({span}, -1)")).first()
    return list(range(longest + 1))


def _matrix(cells: DataFrame, measure: str, ages: Sequence[int] | None) -> DataFrame:
    """Cohorts by age; a cell nobody reached is null.

    Without ``ages`` the columns are the ages that occur, at most one per month, which
    takes a run over the cells to find out; ``possible_ages`` saves that.
    """
    by_cohort = cells.select("cohort_month", "months_since_cohort", measure).groupBy("cohort_month")
    wide = by_cohort.pivot("months_since_cohort", list(ages) if ages is not None else None)
    return wide.agg(F.max(measure)).orderBy("cohort_month")


def retention_long(df: DataFrame) -> DataFrame:
    """Customers, cohort size and rate per cohort and age."""
    at_start = "CASE WHEN months_since_cohort = 0 THEN unique_customers END"
    return (
        cohort_cells(df)
        .selectExpr(
            "cohort_month",
            "months_since_cohort",
            "unique_customers",
            f"max({at_start}) OVER (PARTITION BY cohort_month) AS cohort_size",
        )
        .selectExpr("*", f"{rounded(percent('unique_customers', 'cohort_size'), 1)} AS retention_rate")
    )


def retention_table(df: DataFrame, ages: Sequence[int] | None = None) -> DataFrame:
    return _matrix(retention_long(df), "retention_rate", ages)


def retention_table_absolute(df: DataFrame, ages: Sequence[int] | None = None) -> DataFrame:
    return _matrix(cohort_cells(df), "unique_customers", ages)


def cohort_revenue_long(df: DataFrame) -> DataFrame:
    """Delivered revenue (whole units) and order value per cohort and age."""
    revenue = "delivered_amount"
    return (
        cohort_cells(df)
        .filter("delivered_orders > 0")
        .selectExpr(
            "cohort_month",
            "months_since_cohort",
            f"{rounded(revenue, 0)} AS revenue",
            f"{rounded(f'try_divide({revenue}, priced_orders)')} AS avg_order_value",
        )
    )


def cohort_revenue(df: DataFrame, ages: Sequence[int] | None = None) -> DataFrame:
    return _matrix(cohort_revenue_long(df), "revenue", ages)


def avg_order_value_by_cohort(df: DataFrame, ages: Sequence[int] | None = None) -> DataFrame:
    return _matrix(cohort_revenue_long(df), "avg_order_value", ages)


def customer_values(df: DataFrame) -> DataFrame:
    """Value of every customer with a delivered order.

    One aggregate: the first purchase counts every status, the rest delivered orders.
    """

    def if_delivered(x: str) -> str:
        return f"CASE WHEN order_status = '{DELIVERED}' THEN {x} END"

    month = if_delivered(month_index("order_date"))
    return (
        df.filter("customer_id IS NOT NULL")
        .groupBy("customer_id")
        .agg(
            *exprs(
                _delivered=f"count_if(order_status = '{DELIVERED}')",
                total_revenue=money_sum(if_delivered("revenue")),
                total_orders=f"count({if_delivered('order_id')})",
                avg_order_value=rounded(money_avg(if_delivered("revenue"))),
                months_active=f"max({month}) - min({month}) + 1",
                first_purchase="date_format(min(order_date), 'yyyy-MM')",
                avg_rating=rounded(fine_avg(if_delivered("customer_rating"))),
            )
        )
        .filter("_delivered > 0")
        .drop("_delivered")
    )


def customer_lifetime_value(df: DataFrame) -> DataFrame:
    """Value of every customer with a delivered order, best first."""
    return customer_values(df).orderBy(F.desc("total_revenue"), "customer_id")


def clv_by_segment(df: DataFrame) -> DataFrame:
    """Value per segment; ``avg_clv`` and ``repeat_purchase_rate`` are per customer of the
    whole table, not of the segment."""
    per_customer = (
        delivered(df)
        .groupBy("customer_segment", "customer_id")
        .agg(
            *exprs(
                **parts(amount="revenue"),
                priced=f"count({units('revenue')})",
                orders="count(order_id)",
                rating="sum(cast(rint(customer_rating * 1000000D) as bigint))",
                rated="count(customer_rating)",
            )
        )
    )
    customers = (
        per_customer.filter("customer_id IS NOT NULL")
        .select("customer_id")
        .distinct()
        .agg(*exprs(n="count(1)"))
    )
    revenue = f"coalesce({joined('sum(amount_units)', 'sum(amount_nanos)')}, 0D)"
    return (
        per_customer.filter("customer_segment IS NOT NULL")
        .groupBy("customer_segment")
        .agg(
            *exprs(
                total_customers="count(customer_id)",
                total_revenue=revenue,
                avg_order_value=rounded(f"try_divide({revenue}, sum(priced))"),
                _orders="cast(sum(orders) as double)",
                avg_rating=rounded("try_divide(sum(rating) / 1000000D, sum(rated))"),
            )
        )
        .withColumn("_customers", customers.scalar())
        .selectExpr(
            "customer_segment",
            f"{rounded('try_divide(total_revenue, _customers)')} AS avg_clv",
            "total_customers",
            "total_revenue",
            "avg_order_value",
            f"{rounded('try_divide(_orders, _customers)')} AS repeat_purchase_rate",
            "avg_rating",
        )
        .orderBy("customer_segment")
    )


SKETCH_BITS = 14  # log2 of a sketch's registers: a standard error below one percent


def customer_sketches(df: DataFrame, by: Sequence[str] = ("customer_segment",)) -> DataFrame:
    """A distinct-count sketch of the customers per month and group: ``(month, by, customers)``.

    Delivered orders.  The table is meant to be kept: a new month adds its rows, and any range of
    months is counted from a few kilobytes per row, where a count of distinct ids, which does not
    add up over months, would read every order again.
    """
    rows = delivered(df).filter("customer_id IS NOT NULL AND order_date IS NOT NULL")
    return (
        rows.selectExpr("date_format(order_date, 'yyyy-MM') AS month", *by, "customer_id")
        .groupBy("month", *by)
        .agg(*exprs(customers=f"hll_sketch_agg(customer_id, {SKETCH_BITS})"))
    )


def distinct_customers(sketches: DataFrame, by: Sequence[str], **labels: str) -> DataFrame:
    """Estimated distinct customers per group of kept sketches; ``labels`` name further groupings."""
    keyed = sketches.selectExpr("*", *[f"{sql} AS {name}" for name, sql in labels.items()])
    return keyed.groupBy(*labels, *by).agg(
        *exprs(estimate="hll_sketch_estimate(hll_union_agg(customers))")
    )


def cohort_insights(df: DataFrame) -> DataFrame:
    """Headline values: ``(insight_no, insight, value_num, value_str, display)``."""
    cells = cohort_cells(df)
    at_start = "CASE WHEN months_since_cohort = 0 THEN unique_customers END"
    rate = rounded(percent("unique_customers", "cohort_size"), 1)
    per_cohort = (
        cells.selectExpr("*", f"max({at_start}) OVER (PARTITION BY cohort_month) AS cohort_size")
        .groupBy("cohort_month")
        .agg(
            *exprs(
                revenue=f"sum({rounded('delivered_amount', 0)})",
                delivered="sum(delivered_orders)",
                rate_0=f"max(CASE WHEN months_since_cohort = 0 THEN {rate} END)",
                rate_1=f"max(CASE WHEN months_since_cohort = 1 THEN {rate} END)",
            )
        )
    )
    first_by_revenue = "min_by(cohort_month, struct(-revenue, cohort_month))"

    def mean_rate(c: str) -> str:
        # Rates have one decimal: add them as whole tenths.
        return f"try_divide(sum(cast(rint({c} * 10D) as bigint)) / 10D, count({c}))"

    cohorts = per_cohort.agg(
        *exprs(
            name=f"{first_by_revenue} FILTER (WHERE delivered > 0)",
            revenue="max(revenue) FILTER (WHERE delivered > 0)",
            first=mean_rate("rate_0"),
            second=f"coalesce({mean_rate('rate_1')}, 0D)",
        )
    )
    values = customer_values(df).agg(
        *exprs(mean=rounded(money_avg("total_revenue")), top="max(total_revenue)")
    )
    segment = clv_by_segment(df).agg(
        *exprs(
            name="min_by(customer_segment, struct(-total_revenue, customer_segment))",
            revenue="max(total_revenue)",
        )
    )
    first, second = rounded("first", 1), rounded("second", 1)
    drop = rounded("first - second", 1)

    def rows(frame: DataFrame, *entries: tuple[int, str, str, str, str]) -> DataFrame:
        cells = ", ".join(
            f"{no}, '{name}', cast({number} as double), cast({label} as string), {shown}"
            for no, name, number, label, shown in entries
        )
        names = "(insight_no, insight, value_num, value_str, display)"
        return frame.selectExpr(f"stack({len(entries)}, {cells}) AS {names}")

    best = f"concat(name, ' with ', {dollars('revenue')}, ' total revenue')"
    return (
        rows(
            cohorts,
            (1, "best_cohort", "revenue", "name", best),
            (2, "month_0_retention", first, "null", percent_text(first)),
            (3, "month_1_retention", second, "null", percent_text(second)),
            (4, "retention_drop_m0_to_m1", drop, "null", percent_text(drop)),
        )
        .unionByName(
            rows(
                values,
                (5, "avg_clv", "mean", "null", dollars("mean", 2)),
                (6, "top_customer_clv", "top", "null", dollars("top", 2)),
            )
        )
        .unionByName(
            rows(
                segment,
                (
                    7,
                    "best_segment",
                    "revenue",
                    "name",
                    f"concat(name, ' (', {dollars('revenue')}, ')')",
                ),
            )
        )
    )


def cohort_overview(df: DataFrame) -> DataFrame:
    """Number of customers and the first and last order date."""
    return (
        df.groupBy("customer_id")
        .agg(*exprs(first="min(order_date)", last="max(order_date)"))
        .agg(
            *exprs(
                total_customers="count(customer_id)", first_date="min(first)", last_date="max(last)"
            )
        )
    )


def top_customers(df: DataFrame, n: int = 10) -> DataFrame:
    return customer_lifetime_value(df).limit(n)


def first_cohorts(df: DataFrame, n: int = 10, ages: Sequence[int] | None = None) -> DataFrame:
    """The retention rows of the earliest cohorts."""
    return retention_table(df, ages).limit(n)


def run_cohorts(df: DataFrame, ages: Sequence[int] | None = None) -> dict[str, DataFrame]:
    return {
        "cohort_overview": cohort_overview(df),
        "retention_table": retention_table(df, ages),
        "retention_absolute": retention_table_absolute(df, ages),
        "revenue_table": cohort_revenue(df, ages),
        "aov_table": avg_order_value_by_cohort(df, ages),
        "customer_lifetime_value": customer_lifetime_value(df),
        "clv_by_segment": clv_by_segment(df),
        "cohort_insights": cohort_insights(df),
    }
