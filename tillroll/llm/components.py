"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tillroll.sources.staging import staged


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, least): each node of an edge and the least node that it is connected to.

    Each round links every larger neighbour of a node to its least neighbour, then every smaller
    one; edges never grow in number and a round that changes nothing ends the work.  The test for
    that comes with the round's own write.  Nodes compare as their type does; nulls and loops are
    left out.  Should ``rounds`` not be enough, which would take a chain of more than 2 ** rounds
    or so, the work ends with an error rather than with unfinished classes.
    """
    current = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current = staged(current.distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(near, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        seen = Observation()
        size, mark = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        current = staged(small.observe(seen, size, mark), "edges")
        now = (seen.get["n"], seen.get["s"])
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    least = current.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "node")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct()
    return least.unionByName(roots.join(least, "node", "left_anti"))
