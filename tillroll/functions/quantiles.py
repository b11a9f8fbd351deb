"""Exact quantiles of very large groups, and the bins cut at them.

``percentile`` keeps every distinct value of a group in one task's memory.  Here equal values are
counted first, so a value that fills a third of the table is one row from then on.  The counted
values go into narrow logarithmic buckets; a bucket that holds a wanted rank and has more distinct
values than one task should sort gets a finer histogram of its own, between its least and its
largest value, and so on until it fits.  Which buckets matter is a table like any other: it is
joined without a hint, for one group as for millions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import exprs
from tillroll.sources.staging import staged

# Bin probabilities as floating-point arithmetic yields them (even steps,
# to percent and back); the plain 0.6 or 2/3 would put edges on tied data elsewhere.
FIFTHS = [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]
THIRDS = [0.0, 0.33333333333333326, 0.6666666666666665, 1.0]

BUCKETS_PER_E_FOLD = 4096
FINER_BUCKETS = 4096
FITS = 200_000  # distinct values of one bucket that one task may sort

# Never falls as the value rises; about 0.02 % wide from a ten-thousandth upwards.
_LOGARITHMIC = (
    "CASE WHEN _v = double('Infinity') THEN 4000000000000 WHEN _v = double('-Infinity') THEN -4000000000000 "
    f"ELSE cast(floor(signum(_v) * ln(1D + least(abs(_v), 1e300D) * 10000D) * {BUCKETS_PER_E_FOLD}D) as bigint) END"
)
# Even steps from the least to the largest value, the widest range halved first.
_SHARE = (
    "CASE WHEN _high - _low < 1e308D THEN (_v - _low) / (_high - _low) "
    "ELSE (_v / 2 - _low / 2) / (_high / 2 - _low / 2) END"
)
_EVEN = f"least(cast(floor({_SHARE} * {FINER_BUCKETS}) as bigint), {FINER_BUCKETS - 1})"
_RUNNING = "ROWS UNBOUNDED PRECEDING"


def counted_values(rows: DataFrame, value: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row per group and distinct value: ``by`` columns, ``_v`` (double) and how often, ``_n``.

    Missing values and NaN are left out.  Combined on the map side.
    """
    points = rows.selectExpr(*by, f"cast({value} as double) + 0D AS _v", f"cast({weight or 1} as bigint) AS _n")
    return points.filter("_v IS NOT NULL AND NOT isnan(_v)").groupBy(*by, "_v").agg(*exprs(_n="sum(_n)"))


def exact_quantiles(
    rows: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str],
    weight: str | None = None,
    approx: bool = False,
    fits: int = FITS,
) -> DataFrame:
    """One row per group: ``by`` columns, ``quantiles`` (array<double>), ``n_values``.

    Linear interpolation between order statistics.  ``weight`` counts equal rows that were
    merged beforehand.  ``approx`` takes the least value of each bucket, at most a four-thousandth
    below (or a ten-thousandth's fraction near zero), in a single lazy pass.
    """
    counted = counted_values(rows, value, by, weight)
    return quantiles_of_counted(counted if approx else staged(counted, "values"), probs, by, fits, approx)


def quantiles_of_counted(
    counted: DataFrame, probs: Sequence[float], by: Sequence[str], fits: int = FITS, approx: bool = False
) -> DataFrame:
    """Likewise over a written table of ``counted_values``; it is read a few times."""
    by = list(by)
    keys = ", ".join(by)
    positions = [f"({p!r}D * (_total - 1))" for p in probs]
    ranks = ", ".join(f"floor({at}), ceil({at})" for at in positions)
    holds_rank = f"exists(array({ranks}), r -> r >= _upto - _n AND r < _upto)"

    def wanted(members: DataFrame, inside: list[str], before: str) -> DataFrame:
        """Buckets that hold a wanted rank, with what lies before them and their extremes."""
        histogram = members.groupBy(*by, *inside, "_bucket").agg(
            *exprs(_n="sum(_n)", _values="count(1)", _low="min(_v)", _high="max(_v)")
        )
        scope = ", ".join([*by, *inside])
        if "_total" not in inside:
            histogram = histogram.selectExpr("*", f"sum(_n) OVER (PARTITION BY {scope}) AS _total")
        return (
            histogram.selectExpr("*", f"{before} + sum(_n) OVER (PARTITION BY {scope} ORDER BY _bucket {_RUNNING}) AS _upto")
            .filter(holds_rank)
        )

    members = counted.selectExpr(*by, "_v", "_n", f"{_LOGARITHMIC} AS _bucket")
    found = wanted(members, [], "0")
    if approx:
        picked = found.selectExpr(*by, "_upto", "_low AS _v", "_total")
    else:
        picked = _picked(members, staged(found, "buckets"), by, fits, wanted, holds_rank)

    # At most two picked values per probability and group.
    gathered = picked.groupBy(*by).agg(
        *exprs(_picked="sort_array(collect_list(struct(_upto, _v)))", _total="max(_total)")
    )

    def at_rank(rank: str) -> str:
        return f"filter(_picked, s -> s._upto > {rank})[0]._v"

    neighbours = ", ".join(
        f"named_struct('a', {at_rank(f'floor({at})')}, 'b', {at_rank(f'ceil({at})')}, "
        f"'t', {at} - floor({at}))"
        for at in positions
    )
    # From the nearer neighbour, so that both ends are hit exactly.
    between = (
        "CASE WHEN t.a = t.b THEN t.a WHEN t.t >= 0.5D THEN t.b - (t.b - t.a) * (1 - t.t) "
        "ELSE t.a + (t.b - t.a) * t.t END"
    )
    return gathered.selectExpr(
        *by,
        f"transform(array({neighbours}), t -> {between}) AS quantiles",
        "_total AS n_values",
    )


def _picked(members: DataFrame, found: DataFrame, by: list[str], fits: int, wanted, holds_rank: str) -> DataFrame:
    """The values at the wanted ranks: (by, ``_upto``, ``_v``, ``_total``)."""
    keys = ", ".join(by)

    def settled(buckets: DataFrame) -> DataFrame:
        """Buckets of one value are known without another look."""
        return buckets.filter("_low = _high").selectExpr(*by, "_upto", "_low AS _v", "_total")

    picked = settled(found)
    while True:
        limits = found.filter("_low < _high").selectExpr(
            *by, "_bucket", "_upto - _n AS _before", "_total", "_low", "_high", "_values"
        )
        inside = members.join(limits, [*by, "_bucket"])
        sorted_within = f"(PARTITION BY {keys}, _bucket ORDER BY _v {_RUNNING})"
        small = inside.filter(f"_values <= {fits}")
        small = small.selectExpr("*", f"_before + sum(_n) OVER {sorted_within} AS _upto").filter(holds_rank)
        picked = picked.unionByName(small.select(*by, "_upto", "_v", "_total"))
        if not (limits.agg(*exprs(most="max(_values)")).first()[0] or 0) > fits:
            break
        # Too full for one task: a finer histogram of that bucket alone.
        full = inside.filter(f"_values > {fits}").withColumnRenamed("_bucket", "_outer")
        finer = full.selectExpr(*by, "_v", "_n", "_outer", "_before", "_total", f"{_EVEN} AS _bucket")
        finer = staged(finer, "finer")
        found = wanted(finer, ["_outer", "_before", "_total"], "_before")
        # Buckets of different outer ones must not meet: number them through.
        within = "struct(_outer, _bucket)"
        found = staged(found.selectExpr("*", f"{within} AS _place").drop("_outer", "_bucket", "_before"), "buckets")
        found = found.withColumnRenamed("_place", "_bucket")
        members = finer.selectExpr(*by, "_v", "_n", f"{within} AS _bucket")
        picked = picked.unionByName(settled(found))
    return picked


def bin_index(value: str, edges: str, most: int) -> str:
    """Right-closed bin of a value, the lowest edge included.

    ``edges`` is an array of at most ``most`` ascending edges without repeats: plain comparisons,
    so that the detail rows stay in generated code.
    """
    above = " + ".join(f"CASE WHEN {value} > get({edges}, {i}) THEN 1 ELSE 0 END" for i in range(most))
    return f"CASE WHEN {value} IS NOT NULL AND size({edges}) > 1 THEN greatest({above} - 1, 0) END"
