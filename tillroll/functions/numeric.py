"""Numeric rules shared by every report, as Spark SQL expressions.

Sums are kept as whole units and billionths apart (``units`` and ``nanos``), other measures as
whole units plus millionths, so a total is the same however the rows are spread over partitions
and in whatever order they are merged, and buffers stay primitive.  What is 1e19 and beyond,
infinite or NaN is left out of sums.

Each function takes SQL expressions and returns one; ``exprs`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exprs(**named: str) -> list[Column]:
    """Columns from ``name=expression``."""
    return [F.expr(f"{sql} AS `{name}`") for name, sql in named.items()]


def rounded(x: str, digits: int = 2) -> str:
    """Round half to even on the scaled value; never a negative zero."""
    return f"(rint(({x}) * {10**digits}D) / {10**digits}D + 0D)"


def units(x: str) -> str:
    """The whole units of an amount, rounded down; null where it does not count."""
    v = f"cast({x} as double)"
    return f"CASE WHEN abs({v}) < 9e18 THEN cast(floor({v}) as double) WHEN abs({v}) < 1e19 THEN {v} END"


def nanos(x: str) -> str:
    """What is left of an amount beside its ``units``, in billionths.

    As many digits as a double holds for sure: nine below a million, six below a billion, then
    cents, which it holds up to about 4e13.
    """
    v = f"cast({x} as double)"
    rest = f"({v} - cast(floor({v}) as double))"
    return (
        f"CASE WHEN abs({v}) < 1e6 THEN cast(rint({rest} * 1e9D) as bigint) "
        f"WHEN abs({v}) < 1e9 THEN cast(rint({rest} * 1e6D) as bigint) * 1000 "
        f"WHEN abs({v}) < 1e15 THEN cast(rint({rest} * 1e2D) as bigint) * 10000000 "
        f"WHEN abs({v}) < 1e19 THEN 0L END"
    )


def parts(**amounts: str) -> dict[str, str]:
    """Aggregates ``name_units`` and ``name_nanos`` of each amount, which add up any number of times."""
    out = {}
    for name, x in amounts.items():
        out |= {f"{name}_units": f"sum({units(x)})", f"{name}_nanos": f"sum({nanos(x)})"}
    return out


def summed_parts(*names: str) -> dict[str, str]:
    """Sums of such columns, under the same names."""
    return {f"{n}_{part}": f"sum({n}_{part})" for n in names for part in ("units", "nanos")}


def joined(whole: str, billionths: str) -> str:
    """The amount nearest to so many units and billionths; null if there were none."""
    exactly = f"try_cast({whole} as decimal(29, 9)) + cast({billionths} as decimal(29, 9)) / 1000000000"
    return f"coalesce(cast({exactly} as double), {whole} + {billionths} / 1e9D)"


def amount_of(name: str) -> str:
    """The amount of columns ``name_units`` and ``name_nanos``; 0.0 when nothing was added."""
    return f"coalesce({joined(f'{name}_units', f'{name}_nanos')}, 0D)"


def money_total(x: str) -> str:
    """Exact total of an amount; null when nothing was there to add."""
    return joined(f"sum({units(x)})", f"sum({nanos(x)})")


def money_sum(x: str) -> str:
    """Exact total of an amount; 0.0 when nothing was there to add."""
    return f"coalesce({money_total(x)}, 0D)"


def money_avg(x: str) -> str:
    return f"try_divide({money_total(x)}, count({units(x)}))"


def fine_sum(x: str) -> str:
    """Total of a measure kept to six decimals: whole units and millionths apart.

    The units are a sum of doubles, exact up to 9e15; the millionths one of longs, good for
    about nine trillion rows.
    """
    return f"({whole_sum(x)} + {micro_sum(x)} / 1000000D)"


def whole_sum(x: str) -> str:
    return f"sum(cast(floor(cast({x} as double)) as double))"


def micro_sum(x: str) -> str:
    v = f"cast({x} as double)"
    return f"sum(CASE WHEN abs({v}) < 1e15 THEN cast(rint(({v} - floor({v})) * 1000000D) as bigint) ELSE 0 END)"


def fine_avg(x: str) -> str:
    return f"try_divide({fine_sum(x)}, count({x}))"


def int_avg(x: str) -> str:
    return f"try_divide(cast(sum(cast({x} as bigint)) as double), count({x}))"


def percent(part: str, whole: str) -> str:
    return f"(try_divide(cast({part} as double), cast({whole} as double)) * 100D)"


def int_sum(x: str) -> str:
    return f"coalesce(sum(cast({x} as bigint)), 0)"


def skew_corrected(x: str) -> str:
    """Sample skewness: null below three values, 0.0 for a constant column."""
    n = f"cast(count({x}) as double)"
    return (
        f"CASE WHEN count({x}) < 3 THEN null WHEN min({x}) = max({x}) THEN 0D "
        f"ELSE skewness({x}) * sqrt({n} * ({n} - 1)) / nullif({n} - 2, 0D) END"
    )


def kurtosis_corrected(x: str) -> str:
    """Sample excess kurtosis: null below four values, 0.0 for a constant column."""
    n = f"cast(count({x}) as double)"
    return (
        f"CASE WHEN count({x}) < 4 THEN null WHEN min({x}) = max({x}) THEN 0D "
        f"ELSE ({n} - 1) / nullif(({n} - 2) * ({n} - 3), 0D) "
        f"* (({n} + 1) * kurtosis({x}) + 6) END"
    )


def skew_of_moments(n: str, m2: str, m3: str, low: str, high: str) -> str:
    """Likewise from sums of powers of the distance to the mean."""
    size = f"cast({n} as double)"
    return (
        f"CASE WHEN {n} < 3 THEN null WHEN {low} = {high} THEN 0D "
        f"ELSE {m3} / {size} / pow({m2} / {size}, 1.5D) * sqrt({size} * ({size} - 1)) / nullif({size} - 2, 0D) END"
    )


def kurtosis_of_moments(n: str, m2: str, m4: str, low: str, high: str) -> str:
    size = f"cast({n} as double)"
    return (
        f"CASE WHEN {n} < 4 THEN null WHEN {low} = {high} THEN 0D "
        f"ELSE ({size} - 1) / nullif(({size} - 2) * ({size} - 3), 0D) "
        f"* (({size} + 1) * ({m4} / {size} / pow({m2} / {size}, 2) - 3) + 6) END"
    )


def pearson(a: str, b: str) -> str:
    """Correlation over the rows where both are present; null if either is constant.

    ``corr`` divides by zero on a constant column; the coefficient of determination does
    not, and the covariance gives its sign.
    """
    x, y = f"cast({a} as double)", f"cast({b} as double)"
    return (
        f"CASE WHEN covar_pop({x}, {y}) = 0 AND regr_r2({x}, {y}) = 1 THEN null "
        f"ELSE signum(covar_pop({x}, {y})) * sqrt(regr_r2({x}, {y})) END"
    )
