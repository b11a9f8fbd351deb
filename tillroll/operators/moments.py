"""Moments that are kept per day and add up: correlation, slope and shape without a rescan.

A row of moments holds the count, the means and the sums of powers and products of the distances to
them.  Rows of any parts of a table merge into those of the whole by shifting each to the common
mean, and merged rows merge again, so a day's rows are made once, when the day arrives.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame

from tillroll.functions.numeric import exprs, kurtosis_of_moments, rounded, skew_of_moments
from tillroll.operators.reports import PAIRS_PER_ROW

PAIR = ["n", "mean_x", "mean_y", "xx", "yy", "xy", "low_x", "high_x", "low_y", "high_y"]
SINGLE = ["n", "mean", "m2", "m3", "m4", "low", "high"]


def all_pairs(columns: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Every pair of columns, each with itself too, named ``a|b``."""
    return {f"{a}|{b}": (a, b) for a, b in combinations_with_replacement(columns, 2)}


def pair_moments(df: DataFrame, pairs: Mapping[str, tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """``(by, pair, n, mean_x, ...)`` per group and pair of expressions, over rows that have both.

    One pass: the pairs are dealt to a few rows per row of ``df``, so buffers stay few.  NaN and
    infinite values are left out as missing ones are; a pair that no row of a group has is absent.
    """
    names = list(pairs)
    deals = [names[i : i + PAIRS_PER_ROW] for i in range(0, len(names), PAIRS_PER_ROW)]
    rows = []
    for i, deal in enumerate(deals):
        values = [_finite(sql) for name in deal for sql in pairs[name]]
        values += ["cast(null as double)"] * (2 * PAIRS_PER_ROW - len(values))
        rows.append(f"{i}, {', '.join(values)}")
    slots = range(PAIRS_PER_ROW)
    dealt = df.selectExpr(*by, f"stack({len(deals)}, {', '.join(rows)}) AS (_deal, {', '.join(f'x{k}, y{k}' for k in slots)})")
    measured: dict[str, str] = {}
    for k in slots:
        x, y = f"x{k}", f"y{k}"
        both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
        sums = [f"regr_{f}({y}, {x})" for f in ("count", "avgx", "avgy", "sxx", "syy", "sxy")]
        ends = [f"{f}({v}) FILTER (WHERE {both})" for v in (x, y) for f in ("min", "max")]
        measured |= {f"{m}{k}": sql for m, sql in zip(PAIR, sums + ends)}
    grouped = dealt.groupBy(*by, "_deal").agg(*exprs(**measured))
    cells = ", ".join(f"{k}, " + ", ".join(f"{m}{k}" for m in PAIR) for k in slots)
    laid = grouped.selectExpr(*by, "_deal", f"stack({PAIRS_PER_ROW}, {cells}) AS (_slot, {', '.join(PAIR)})")
    name = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    pair = f"CASE _deal * {PAIRS_PER_ROW} + _slot {name} END AS pair"
    return laid.filter("n > 0").selectExpr(*by, pair, *PAIR)


def _finite(sql: str) -> str:
    v = f"cast({sql} as double)"
    return f"CASE WHEN abs({v}) < double('Infinity') THEN {v} END"


def merged_pairs(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``pair_moments`` merged to one per group and pair, in the same columns."""
    keys = [*by, "pair"]
    shifted = _around_mean(moments, keys, {"mean_x": "n * (mean_x - _mean_x)", "mean_y": "n * (mean_y - _mean_y)"})
    return shifted.groupBy(*keys).agg(
        *exprs(
            n="sum(n)",
            mean_x="max(_mean_x)",
            mean_y="max(_mean_y)",
            xx="sum(xx + _mean_x_off * (mean_x - _mean_x))",
            yy="sum(yy + _mean_y_off * (mean_y - _mean_y))",
            xy="sum(xy + _mean_x_off * (mean_y - _mean_y))",
            low_x="min(low_x)",
            high_x="max(high_x)",
            low_y="min(low_y)",
            high_y="max(high_y)",
        )
    )


def _around_mean(moments: DataFrame, keys: list[str], offsets: dict[str, str]) -> DataFrame:
    """Each row with the merged means of its group and its weighted distance to them."""
    # Groups are as many as the result has rows; the join is left to Spark, null labels included.
    means = moments.groupBy(*keys).agg(*exprs(**{f"_{m}": f"sum(n * {m}) / sum(n)" for m in offsets}))
    means = means.selectExpr(*[f"{k} AS _{k}" for k in keys], *[f"_{m}" for m in offsets])
    same = [moments[k].eqNullSafe(means[f"_{k}"]) for k in keys]
    joined = moments.join(means, same)
    return joined.selectExpr(*moments.columns, *[f"_{m}" for m in offsets], *[f"{sql} AS _{m}_off" for m, sql in offsets.items()])


_VARIES = "low_x < high_x AND low_y < high_y"


def correlations(merged: DataFrame) -> DataFrame:
    """Rows of merged pairs with ``r``; null where either side is constant."""
    return merged.selectExpr("*", f"CASE WHEN {_VARIES} THEN xy / sqrt(xx) / sqrt(yy) END AS r")


def correlation_table(merged: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """The square matrix of ``all_pairs(columns)`` merged over everything, one row per column."""
    found = correlations(merged).selectExpr(
        "split(pair, '[|]')[0] AS a", "split(pair, '[|]')[1] AS b", f"{rounded('r', digits)} AS r"
    )
    cells = found.selectExpr("stack(2, a, b, b, a) AS (column_name, other)", "r")
    wide = {c: f"max(CASE WHEN other = '{c}' THEN r END)" for c in columns}
    return cells.groupBy("column_name").agg(*exprs(**wide))


def lines(merged: DataFrame) -> DataFrame:
    """Rows of merged pairs with the least-squares line of y on x: ``slope``, ``intercept``, ``r2``."""
    fitted = merged.selectExpr("*", "CASE WHEN low_x < high_x THEN xy / xx END AS slope")
    r2 = f"CASE WHEN {_VARIES} THEN xy / xx * xy / yy WHEN low_x < high_x THEN 1D END AS r2"
    return fitted.selectExpr("*", "mean_y - slope * mean_x AS intercept", r2)


def shape_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``(by, column_name, n, mean, m2, m3, m4, low, high)`` per group and column, values that are finite."""
    cells = df.selectExpr(*by, *[f"{_finite(c)} AS `_{c}`" for c in columns]).selectExpr(
        *by, f"stack({len(columns)}, {', '.join(f'''"{c}", `_{c}`''' for c in columns)}) AS (column_name, _v)"
    )
    spread = "var_pop(_v)"
    varies = "min(_v) < max(_v)"
    return (
        cells.filter("_v IS NOT NULL")
        .groupBy(*by, "column_name")
        .agg(
            *exprs(
                n="count(_v)",
                mean="avg(_v)",
                m2=f"CASE WHEN {varies} THEN count(_v) * {spread} ELSE 0D END",
                m3=f"CASE WHEN {varies} THEN count(_v) * skewness(_v) * pow({spread}, 1.5D) ELSE 0D END",
                m4=f"CASE WHEN {varies} THEN count(_v) * (kurtosis(_v) + 3) * pow({spread}, 2) ELSE 0D END",
                low="min(_v)",
                high="max(_v)",
            )
        )
    )


def merged_shapes(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``shape_moments`` merged to one per group and column, in the same columns."""
    keys = [*by, "column_name"]
    shifted = _around_mean(moments, keys, {"mean": "mean - _mean"})
    d = "_mean_off"
    return shifted.groupBy(*keys).agg(
        *exprs(
            n="sum(n)",
            mean="max(_mean)",
            m2=f"sum(m2 + n * pow({d}, 2))",
            m3=f"sum(m3 + 3 * {d} * m2 + n * pow({d}, 3))",
            m4=f"sum(m4 + 4 * {d} * m3 + 6 * pow({d}, 2) * m2 + n * pow({d}, 4))",
            low="min(low)",
            high="max(high)",
        )
    )


def shapes(merged: DataFrame, digits: int = 2) -> DataFrame:
    """``(by, column_name, count, mean, std, skew, kurtosis)`` of merged rows, bias-corrected and rounded."""
    by = [c for c in merged.columns if c not in (*SINGLE, "column_name")]
    std = "CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) END"
    skew = skew_of_moments("n", "m2", "m3", "low", "high")
    kurtosis = kurtosis_of_moments("n", "m2", "m4", "low", "high")
    return merged.selectExpr(
        *by,
        "column_name",
        "n AS count",
        *[f"{rounded(sql, digits)} AS {name}" for name, sql in zip(("mean", "std", "skew", "kurtosis"), ("mean", std, skew, kurtosis))],
    )
