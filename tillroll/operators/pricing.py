"""Price elasticity, what-if revenue, pricing advice and margins by price tier.

Bins are cut per category at exact quantiles, found in a written table of the distinct prices
and how often they occur.  The orders are read for that and once more for the bins; everything
after works on a few rows per category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import (
    amount_of,
    exprs,
    int_sum,
    micro_sum,
    parts,
    rounded,
    summed_parts,
    units,
    whole_sum,
)
from tillroll.functions.quantiles import FIFTHS, THIRDS, bin_index, exact_quantiles
from tillroll.functions.text import lookup, percent_text, quoted
from tillroll.operators.reports import delivered
from tillroll.sources.staging import staged

MIN_ORDERS = 10
DEFAULT_ELASTICITY = -1.0

# Price scenarios and tier names.
PRICE_SCENARIOS = [0.80, 0.90, 1.0, 1.10, 1.20]
PRICE_TIERS = ["Budget", "Mid-Range", "Premium"]

# Advice below an elasticity, and above all of them.
STRATEGIES = [
    (-1.5, "⬇️ Lower prices - High elasticity, price cuts increase revenue"),
    (-1.0, "📊 Consider 5-10% price decrease - Moderate elasticity"),
    (-0.5, "💰 Keep current price - Low elasticity, demand insensitive"),
]
HIGHEST_STRATEGY = "⬆️ Raise prices - Very low elasticity, high margin potential"


# Sums per bin that add up to those of the category.
_SUMS = {
    "rows": "count(1)",
    "orders": "count(order_id)",
    "priced": "count(price)",
    "price_whole": whole_sum("price"),
    "price_micro": micro_sum("price"),
    "counted": "count(quantity)",
    "quantity": int_sum("quantity"),
    "earning": f"count({units('revenue')})",
    "profiting": f"count({units('profit')})",
    "discounted": "count(discount_pct)",
    "discount_whole": whole_sum("discount_pct"),
    "discount_micro": micro_sum("discount_pct"),
    **parts(revenue="revenue", profit="profit"),
}


def priced_orders(df: DataFrame) -> DataFrame:
    """Delivered orders of a category, with their ``price``."""
    orders = delivered(df).filter("product_category IS NOT NULL")
    return orders.selectExpr("*", "cast(unit_price as double) + 0D AS price")


def _binned(df: DataFrame, probs: Sequence[float], approx: bool) -> DataFrame:
    """Sums per (category, bin of price), for categories with enough orders.

    Orders without a price have no bin but belong to their category.
    """
    orders = priced_orders(df)
    edges = exact_quantiles(orders, "price", probs, ["product_category"], approx=approx)
    # One written row per category: Spark broadcasts it if it is small, else it splits the
    # partitions of a hot category.
    edges = staged(edges.selectExpr("product_category", "array_distinct(quantiles) AS edges"), "edges")
    return (
        orders.join(edges, "product_category", "left")
        .selectExpr("*", f"{bin_index('price', 'edges', len(probs))} AS bin")
        .groupBy("product_category", "bin")
        .agg(
            *exprs(
                **_SUMS,
                min_price="min(price)",
                max_price="max(price)",
            )
        )
        .selectExpr("*", "sum(rows) OVER (PARTITION BY product_category) AS category_rows")
        .filter(f"category_rows >= {MIN_ORDERS}")
        .withColumnRenamed("product_category", "category")
    )


_MEAN_PRICE = "try_divide(price_whole + price_micro / 1000000D, priced)"
_MEAN_QUANTITY = "try_divide(cast(quantity as double), counted)"


def price_bins(df: DataFrame, approx: bool = False) -> DataFrame:
    """Mean price and quantities per category and fifth of its prices."""
    return (
        _binned(df, FIFTHS, approx)
        .filter("bin IS NOT NULL")
        .selectExpr(
            "category",
            "bin AS price_bin",
            f"{_MEAN_PRICE} AS avg_price",
            "quantity AS total_quantity",
            f"{_MEAN_QUANTITY} AS avg_quantity",
            "orders AS order_count",
        )
        .orderBy("category", "price_bin")
    )


def _categories(df: DataFrame, approx: bool) -> DataFrame:
    """One row per category: its facts, and the fitted ``slope`` and ``r2`` or null.

    The fit is over the logs of the bins' mean price and mean quantity.
    """
    x, y = f"ln({_MEAN_PRICE})", f"ln({_MEAN_QUANTITY})"
    usable = f"bin IS NOT NULL AND {_MEAN_PRICE} > 0 AND {_MEAN_QUANTITY} > 0"
    return (
        _binned(df, FIFTHS, approx)
        .selectExpr(
            "*",
            f"CASE WHEN {usable} THEN {x} END AS x",
            f"CASE WHEN {usable} THEN {y} END AS y",
        )
        .groupBy("category")
        .agg(
            *exprs(
                price_whole="sum(price_whole)",
                price_micro="sum(price_micro)",
                priced="sum(priced)",
                counted="sum(counted)",
                quantity="sum(quantity)",
                **summed_parts("revenue"),
                min_price="min(min_price)",
                max_price="max(max_price)",
                points="count(x)",
                slope="coalesce(nanvl(regr_slope(y, x), 0D), 0D)",
                r2="CASE WHEN regr_syy(y, x) = 0 THEN 0D ELSE regr_r2(y, x) END",
            )
        )
        .selectExpr(
            "category",
            f"{_MEAN_PRICE} AS avg_price",
            f"{_MEAN_QUANTITY} AS avg_quantity",
            "quantity",
            f"{amount_of('revenue')} AS revenue",
            "min_price",
            "max_price",
            "CASE WHEN points >= 2 THEN slope END AS slope",
            "CASE WHEN points >= 2 THEN r2 END AS r2",
        )
    )


def elasticity_by_category(df: DataFrame, approx: bool = False) -> DataFrame:
    """Slope of log quantity on log price over the price bins; most elastic first."""
    return (
        _categories(df, approx)
        .filter("slope IS NOT NULL")
        .selectExpr(
            "category",
            f"{rounded('slope')} AS price_elasticity",
            "CASE WHEN slope < -1 THEN 'Elastic' ELSE 'Inelastic' END AS elasticity_type",
            f"{rounded('r2', 3)} AS r_squared",
            f"{rounded('min_price')} AS min_price",
            f"{rounded('max_price')} AS max_price",
            f"{rounded('avg_price')} AS avg_price",
            f"{rounded('avg_quantity')} AS avg_quantity_per_order",
        )
        .orderBy("price_elasticity", "category")
    )


def _scenarios(categories: DataFrame) -> DataFrame:
    """Every category at every price scenario; demand follows the rounded elasticity."""
    cases = ", ".join(
        f"{i}, {factor!r}D, '{factor * 100:.0f}%'" for i, factor in enumerate(PRICE_SCENARIOS, 1)
    )
    response = f"coalesce({rounded('slope')}, {DEFAULT_ELASTICITY}D)"
    return (
        categories.selectExpr(
            "category",
            "avg_price",
            "quantity",
            "revenue",
            f"{response} AS elasticity",
            f"stack({len(PRICE_SCENARIOS)}, {cases}) AS (scenario_no, factor, price_scenario)",
        )
        .selectExpr(
            "*",
            "avg_price * factor AS simulated",
            "avg_price * factor * (quantity * (1 + elasticity * (factor - 1))) AS expected",
        )
        .selectExpr(
            "category",
            "scenario_no",
            "price_scenario",
            f"{rounded('avg_price')} AS current_price",
            f"{rounded('simulated')} AS simulated_price",
            f"{rounded('expected', 0)} AS expected_revenue",
            f"{rounded('revenue', 0)} AS current_revenue",
            f"{rounded('expected - revenue', 0)} AS revenue_change",
            f"{rounded('try_divide(expected - revenue, revenue) * 100', 1)} AS revenue_change_pct",
            "elasticity",
        )
    )


def revenue_at_price_points(df: DataFrame, approx: bool = False) -> DataFrame:
    """Expected revenue of every category at 80 to 120 % of its mean price."""
    scenarios = _scenarios(_categories(df, approx)).drop("elasticity")
    return scenarios.orderBy("category", "scenario_no")


def optimal_pricing(df: DataFrame, approx: bool = False) -> DataFrame:
    """Best scenario and advice per category, largest gain first."""
    outcome = (
        "struct(price_scenario, current_price, simulated_price, revenue_change_pct, "
        "expected_revenue, elasticity)"
    )
    bands = " ".join(f"WHEN best.elasticity < {b}D THEN {quoted(s)}" for b, s in STRATEGIES)
    return (
        _scenarios(_categories(df, approx).filter("slope IS NOT NULL"))
        .groupBy("category")
        # The earliest scenario wins a tie.
        .agg(*exprs(best=f"max_by({outcome}, struct(revenue_change_pct, -scenario_no))"))
        .selectExpr(
            "category",
            "best.current_price AS current_avg_price",
            "best.elasticity AS price_elasticity",
            "best.price_scenario AS optimal_price_scenario",
            "best.simulated_price AS optimal_price",
            "best.revenue_change_pct AS revenue_change_pct",
            f"{percent_text('best.revenue_change_pct')} AS potential_revenue_increase",
            "cast(best.expected_revenue as bigint) AS expected_new_revenue",
            f"CASE {bands} ELSE {quoted(HIGHEST_STRATEGY)} END AS strategy",
        )
        .orderBy(F.desc("revenue_change_pct"), "category")
    )


def pricing_strategies(df: DataFrame, approx: bool = False) -> DataFrame:
    return optimal_pricing(df, approx).select("category", "strategy")


def margin_by_price_tier(df: DataFrame, approx: bool = False) -> DataFrame:
    """Price, revenue, profit and margin of every category's price thirds."""
    revenue, profit = amount_of("revenue"), amount_of("profit")
    return (
        _binned(df, THIRDS, approx)
        .filter("bin IS NOT NULL")
        .selectExpr(
            "category",
            "bin AS tier_no",
            f"{lookup('bin', PRICE_TIERS)} AS price_tier",
            f"{_MEAN_PRICE} AS avg_price",
            f"try_divide({revenue}, earning) AS avg_revenue",
            f"try_divide({profit}, profiting) AS avg_profit",
            f"CASE WHEN {revenue} > 0 THEN ({profit}) / ({revenue}) * 100 ELSE 0D END"
            " AS profit_margin_pct",
            "orders AS order_count",
            "try_divide(discount_whole + discount_micro / 1000000D, discounted) AS avg_discount",
        )
        .orderBy("category", "tier_no")
    )


def scenarios_head(df: DataFrame, n: int = 10, approx: bool = False) -> DataFrame:
    """The first scenarios of every category."""
    return (
        revenue_at_price_points(df, approx)
        .selectExpr("*", "row_number() OVER (PARTITION BY category ORDER BY scenario_no) AS row_no")
        .filter(F.col("row_no") <= n)
        .select("category", "price_scenario", "revenue_change_pct")
    )


def run_pricing(df: DataFrame, approx: bool = False) -> dict[str, DataFrame]:
    return {
        "elasticity": elasticity_by_category(df, approx),
        "revenue_simulation": revenue_at_price_points(df, approx),
        "optimal_pricing": optimal_pricing(df, approx),
        "margin_by_tier": margin_by_price_tier(df, approx),
    }
