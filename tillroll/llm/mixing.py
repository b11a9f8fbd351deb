"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Document rates r minimise  sum(v * (r ln r - r + 1))  subject to  sum(r * size) = target  in every
group and 0 <= r <= cap, where v = size ** (1 - tilt).  The dual is one convex function per group,
and its solution tilts rates exponentially in size:  r = min(cap, exp(lam * (size / mean) ** tilt)).
Newton steps on the logarithm of the constraint, kept inside a shrinking bracket, find lam; each is
one aggregate over the counted (group, size) pairs.  Rates are then rounded into whole copies.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.sources.staging import shared_folder, staged

BLANKS = "\t\n\x0b\x0c\r"
GRID = 1024


def group_key(group: Column) -> Column:
    """A group's name that joins match, null included."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and 0x09-0x0D.  0 for null.

    Blanks become spaces and the text is split at single spaces, which needs no regular
    expression; empty pieces are not words.
    """
    plain = text
    for blank in BLANKS:
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("bigint")


def cycled_weights(groups: DataFrame, group: str, cycle: tuple[float, ...]) -> DataFrame:
    """Weights given out in turn to the groups in code point order, null last.

    One row per group: the window without partitions runs over the list of sources alone.
    """
    place = F.row_number().over(Window.orderBy(F.col(group).asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return groups.withColumn("weight", F.get(weights, F.pmod(place, F.lit(len(cycle)))))


def capped_targets(groups: DataFrame, total: str, weight: str, cap: float) -> DataFrame:
    """Column ``target``: shares of all sizes by weight, none above ``cap`` times its own size.

    Resharing an excess again and again ends where target = min(cap * size, level * weight).
    Groups reach their cap in the order of cap * size / weight, so the level follows from sums
    over the groups before and after each.  Groups without weight get nothing.
    """
    limit = F.col(total) * F.lit(float(cap))
    ratio = F.when(F.col(weight) > 0, limit / F.col(weight))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("_ratio").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    positive = F.when(F.col(weight) > 0, F.col(weight)).otherwise(0.0)
    ranked = (
        groups.withColumn("_ratio", ratio)
        .withColumn("_all", F.sum(total).over(everything).cast("double"))
        .withColumn("_weights", F.sum(positive).over(everything))
        .withColumn("_filled", F.coalesce(F.sum(limit).over(rising), F.lit(0.0)))
        .withColumn("_spent", F.coalesce(F.sum(positive).over(rising), F.lit(0.0)))
    )
    # The level if exactly the groups before this one are at their cap.
    level = F.when(
        F.col("_weights") > F.col("_spent"),
        (F.col("_all") - F.col("_filled")) / (F.col("_weights") - F.col("_spent")),
    )
    stands = F.col("_ratio") >= level
    levelled = ranked.withColumn("_level", F.max(F.when(stands, level)).over(everything))
    target = (
        F.when(F.col(weight).isNull() | (F.col(weight) <= 0), 0.0)
        .when(F.col("_level").isNull(), limit)
        .otherwise(F.least(limit, F.col("_level") * F.col(weight)))
    )
    return levelled.withColumn("target", target).drop(
        "_ratio", "_all", "_weights", "_filled", "_spent", "_level"
    )


def _newton(
    counted: DataFrame, groups: DataFrame, cap: float, tilt: float, tolerance: float, steps: int
) -> DataFrame:
    """(g, lam) of every group of ``groups``, started as if all documents were of the mean size."""
    spark = counted.sparkSession
    folder = f"{shared_folder(spark)}/balance-{uuid.uuid4().hex}"
    z = F.pow(F.col("size") / F.col("mean"), F.lit(float(tilt)))
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * z, F.lit(700.0))))
    tokens = F.col("docs") * F.col("size") * rate
    state = groups.select(
        "g", "target", "mean", F.log(F.col("target") / F.col("t")).alias("lam"), F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"),
    )
    for step in range(steps):
        sums = (
            counted.join(state, "g")
            .groupBy("g")
            .agg(
                F.sum(tokens).alias("got"),
                F.sum(F.when(rate < cap, tokens * z).otherwise(0.0)).alias("slope"),
            )
        )
        at = state.join(sums, "g")
        off = F.log(F.col("got") / F.col("target"))
        low = F.when(off < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - off * F.col("got") / F.col("slope")
        middle = (
            F.when(F.col("low").isNull(), F.least(F.col("lam") * 2, F.lit(-1.0)))
            .when(F.col("high").isNull(), F.greatest(F.col("lam") * 2, F.lit(1.0)))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = (
            F.col("newton").isNotNull()
            & (F.col("low").isNull() | (F.col("newton") > F.col("low")))
            & (F.col("high").isNull() | (F.col("newton") < F.col("high")))
            & (F.abs(F.col("newton") - F.col("lam")) < 20.0)
        )
        done = F.abs(F.col("got") - F.col("target")) <= tolerance * F.col("target")
        state = (
            at.withColumn("done", done)
            .withColumn("low", low)
            .withColumn("high", high)
            .withColumn("newton", F.when(F.col("slope") > 0, newton))
            .withColumn(
                "lam",
                F.when(F.col("done"), F.col("lam"))
                .when(inside, F.col("newton"))
                .otherwise(middle),
            )
            .select("g", "target", "mean", "lam", "low", "high", "done")
        )
        path = f"{folder}/{step}"
        state.write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        if state.where("not done").isEmpty():
            break
    return state.select("g", "lam")


def rate_parameters(
    sized: DataFrame, groups: DataFrame, cap: float, tilt: float = 0.5, tolerance: float = 1e-5,
    steps: int = 60,
) -> DataFrame:
    """``groups`` (g, total, target) with ``full``, ``mean`` and ``lam``: what rates depend on."""
    counted = staged(
        sized.where("size > 0").groupBy("g", "size").agg(F.count(F.lit(1)).alias("docs")), "sizes"
    )
    docs = counted.groupBy("g").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("size")).alias("t"))
    known = groups.join(docs, "g", "left").withColumn("mean", F.col("t") / F.col("n"))
    full = F.coalesce(F.col("target") >= F.col("t") * (cap * (1 - 1e-12)), F.lit(False))
    known = known.withColumn("full", full)
    lam = _newton(counted, known.where("target > 0 and t > 0 and not full"), cap, tilt, tolerance, steps)
    return known.join(lam, "g", "left").select("g", "total", "target", "full", "mean", "lam")


def rate_of(cap: float, tilt: float) -> Column:
    """The rate of a document of ``size`` by the parameters of its group."""
    z = F.pow(F.col("size") / F.col("mean"), F.lit(float(tilt)))
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * z, F.lit(700.0))))
    return (
        F.when(F.col("size") <= 0, 1.0)
        .when(F.col("full"), float(cap))
        .when(F.coalesce("target", F.lit(0.0)) <= 0, 0.0)
        .otherwise(tilted)
    )


def _prefix_cut(rows: DataFrame, cell: str, room: DataFrame) -> DataFrame:
    """(g, full cells below which all rows fit, the room left) from sums per cell of a grid."""
    sums = rows.groupBy("g", cell).agg(F.sum("size").alias("cell_size"))
    running = Window.partitionBy("g").orderBy(cell)
    filled = sums.withColumn("upto", F.sum("cell_size").over(running))
    joined = filled.join(room, "g")
    return joined.groupBy("g").agg(
        F.min(F.when(F.col("upto") > F.col("room"), F.col(cell))).alias("cut"),
        F.max(F.when(F.col("upto") <= F.col("room"), F.col("upto")).otherwise(0)).alias("used"),
        F.first("room").alias("room"),
    )


def mix_to_targets(
    docs: DataFrame,
    groups: DataFrame | Callable[[DataFrame], DataFrame],
    group: str = "source",
    size: str = "size",
    key: Column | None = None,
    cap: int = 3,
    tilt: float = 0.5,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``rate`` and whole ``copies`` (0 to ``cap``).

    ``groups`` has one row per group: ``group`` and ``target`` (in units of ``size``); a function
    makes it from the group totals (``group``, ``total``).  Every
    copy count is the rate rounded down or up.  Documents that round up are those of least
    hash / fraction, as many as the target has room for, found by sums over a grid of that key
    and, inside the one cell that is cut, over a finer grid; then the one document that closes the
    gap best.  ``key`` tells rows apart (default: all columns), equal rows are treated by turns of a
    hash, and reruns agree.  Documents of size 0 or of a null size keep one copy; rows of a
    group without a target get none.  Columns of the given result names are replaced.
    """
    made = ("source_size", "target", "rate", "copies")
    docs = docs.drop(*[c for c in made if c not in (group, size)])
    names = docs.columns
    key = F.xxhash64(*[F.col(c) for c in names]) if key is None else key
    # Columns travel under names of their own: none can clash, and unused ones are pruned.
    row = docs.select(
        *[F.col(c).alias(f"row_{i}") for i, c in enumerate(names)], group_key(F.col(group)).alias("g"),
        F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"), key.alias("k"),
    )
    sized = staged(row.select("g", F.col(f"row_{names.index(group)}").alias("named"), "size", "k"), "documents")
    totals = sized.groupBy("g").agg(F.sum("size").alias("total"), F.any_value("named").alias("named"))
    if callable(groups):
        totals = staged(totals, "sources")
        groups = groups(totals.select(F.col("named").alias(group), "total"))
    totals = totals.drop("named")
    goal = groups.select(group_key(F.col(group)).alias("g"), F.col("target").cast("double"))
    goal = totals.join(goal, "g", "left")
    goal = staged(goal.withColumn("target", F.coalesce("target", F.lit(0.0))), "targets")
    known = staged(rate_parameters(sized, goal, cap, tilt), "rates")

    rate = F.col("rate")
    whole = F.floor(rate + 1e-9)
    part = rate - whole
    uniform = F.pmod(F.xxhash64(F.lit(17), "k"), F.lit(1 << 52)) / float(1 << 52)
    order = F.when(part > 1e-9, uniform / part)  # null: nothing to round
    place = F.col("order") / (1.0 + F.col("order"))  # 0 to 1

    def placed(frame: DataFrame) -> DataFrame:
        """Rates, their whole parts, and the cells in which the rest is rounded."""
        return (
            frame.withColumn("rate", rate_of(cap, tilt))
            .withColumn("whole", whole.cast("bigint"))
            .withColumn("order", order)
            .withColumn("cell", F.floor(place * GRID).cast("bigint"))
            .withColumn("fine", F.floor(place * GRID * GRID).cast("bigint"))
        )

    light = placed(sized.drop("named").where("size > 0").join(known, "g"))
    base = light.groupBy("g").agg(F.sum(F.col("whole") * F.col("size")).alias("base"))
    room = goal.join(base, "g")
    room = room.select("g", F.floor(F.col("target") - F.col("base") + 1e-6).alias("room"))
    choice = light.where("`order` is not null")

    coarse = staged(_prefix_cut(choice, "cell", room), "coarse")
    cells = coarse.where("cut is not null").select("g", F.col("cut").alias("cell"))
    inside = choice.join(cells, ["g", "cell"])
    rest = coarse.select("g", (F.col("room") - F.col("used")).alias("room"))
    fine = _prefix_cut(inside.select("g", "size", "fine"), "fine", rest)
    fine = fine.select("g", F.col("cut").alias("fine_cut"), F.col("used").alias("fine_used"))
    both = coarse.join(fine, "g", "left")
    both = both.withColumn("left_over", F.col("room") - F.col("used") - F.coalesce("fine_used", F.lit(0)))
    both = staged(both.select("g", "cut", "fine_cut", "left_over"), "cuts")

    def taken(frame: DataFrame) -> DataFrame:
        """Column ``up``: the document rounds up."""
        below = (
            F.col("cut").isNull()
            | (F.col("cell") < F.col("cut"))
            | ((F.col("cell") == F.col("cut")) & (F.col("fine_cut").isNull() | (F.col("fine") < F.col("fine_cut"))))
        )
        rounds = F.col("order").isNotNull() & F.col("left_over").isNotNull()
        return frame.withColumn("up", F.when(rounds & below, 1).otherwise(0))

    gap = F.abs(F.col("size") - F.col("left_over"))
    spare = taken(choice.join(both, "g", "left")).where((F.col("up") == 0) & (F.col("size") < 2 * F.col("left_over")))
    last = spare.groupBy("g").agg(F.min(F.struct(gap.alias("gap"), "size", "k")).alias("last"))
    last = last.select("g", F.col("last.k").alias("k_last"), F.col("last.size").alias("size_last"))
    # All that a document's copies depend on besides its size and key: one row per group.
    rules = staged(known.join(both, "g", "left").join(last, "g", "left"), "rules")

    chosen = taken(placed(row.join(rules, "g", "left")))
    fills = (F.col("k") == F.col("k_last")) & (F.col("size") == F.col("size_last")) & F.col("order").isNotNull()
    up = F.greatest(F.col("up"), F.when(fills, 1).otherwise(0))
    return chosen.select(
        *[F.col(f"row_{i}").alias(c) for i, c in enumerate(names)],
        F.col("total").alias("source_size"),
        "target",
        "rate",
        (F.col("whole") + F.when(F.col("size") > 0, up).otherwise(0)).alias("copies"),
    )


def balanced_mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), group: str = "source", text: str = "text",
    key: Column | None = None, cap: int = 3, tilt: float = 0.5,
) -> DataFrame:
    """``docs`` with ``size`` in words and the copies of a mix of all sizes by cycled weights."""
    docs = docs.drop("size").withColumn("size", word_count(F.col(text)))

    def targets(totals: DataFrame) -> DataFrame:
        known = capped_targets(cycled_weights(totals, group, weights), "total", "weight", cap)
        return known.select(group, "target")

    return mix_to_targets(docs, targets, group, "size", key, cap, tilt)
