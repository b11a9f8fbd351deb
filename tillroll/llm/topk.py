"""Exact top-k search by inner product with a KD-tree per shard.

Candidates are dealt to shards of bounded size, queries to blocks of bounded size, and every
block meets every shard.  In a shard a tree of median splits with tight bounding boxes is walked
best first: a box is opened only while the largest inner product that any point of it could have
reaches the query's k-th best score.  The first shard is searched first; its k-th scores go along
to all other shards, which return only what reaches them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.vectors import NO_ID, SCORE, as_long, as_score, group_vectors, usable
from tillroll.sources.staging import staged

SHARD_ROWS = 8_192
BLOCK_ROWS = 16_384
LEAF_ROWS = 64


class Tree:
    """Median splits along the widest side; boxes are tight."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(points))
        low, high, child, span = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            start, stop, parent, side = todo.pop()
            part = points[order[start:stop]]
            a, b = part.min(axis=0), part.max(axis=0)
            node = len(low)
            low.append(a)
            high.append(b)
            child.append([-1, -1])
            span.append((start, stop))
            if parent >= 0:
                child[parent][side] = node
            if stop - start > leaf_rows and (b > a).any():
                middle = (stop - start) // 2
                wide = int(np.argmax(b - a))
                order[start:stop] = order[start:stop][np.argpartition(part[:, wide], middle)]
                todo += [(start, start + middle, node, 0), (start + middle, stop, node, 1)]
        self.low, self.high = np.array(low), np.array(high)
        self.child, self.span = child, span
        self.order, self.points = order, points[order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and box the largest inner product with a point of the box."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.high.T + down @ self.low.T

    def search(
        self, query: np.ndarray, own: int, ids: list[int], bounds: np.ndarray, k: int, floor: int | None
    ) -> list:
        """The k best (score, -id) that reach ``floor``, without the query's own place.

        ``ids`` and ``own`` go by place in the tree's order.
        """
        best: list[tuple[int, int]] = []  # a heap, the worst first
        kth = floor
        heap = [(-int(bounds[0]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if kth is not None and -bound < kth:
                break
            left, right = self.child[node]
            if left >= 0:
                for c in (left, right):
                    if kth is None or bounds[c] >= kth:
                        heapq.heappush(heap, (-int(bounds[c]), c))
                continue
            start, stop = self.span[node]
            scores = self.points[start:stop] @ query
            near = np.arange(stop - start) if kth is None else np.flatnonzero(scores >= kth)
            for score, place in zip(scores[near].tolist(), (near + start).tolist()):
                if place == own:
                    continue
                vec = ids[place]
                if len(best) < k:
                    heapq.heappush(best, (score, -vec))
                elif (score, -vec) > best[0]:
                    heapq.heapreplace(best, (score, -vec))
                if len(best) == k:
                    kth = best[0][0] if kth is None else max(kth, best[0][0])
        return best


def _search_groups(pairs: DataFrame, k: int, factor: int) -> DataFrame:
    """(query, vec_id, score) of each (dim, shard, block) group; ``query`` is a row number.

    A group holds one shard and one block of queries, so its size is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        is_query = table.column("query").to_numpy()
        at, rest = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        out: list[tuple] = []
        if len(at) and len(rest):
            points, row = group_vectors(table, factor), table.column("row").to_numpy()
            tree = Tree(points[rest])
            packed = rest[tree.order]
            ids = [NO_ID if x is None else x for x in table.column("vec_id").take(pa.array(packed)).to_pylist()]
            place_of = {r: i for i, r in enumerate(row[packed].tolist())}
            floors = table.column("floor").take(pa.array(at)).to_pylist()
            for start in range(0, len(at), 256):
                part = at[start : start + 256]
                for i, (query, b) in enumerate(zip(part, tree.bounds(points[part])), start):
                    floor = None if floors[i] is None else int(floors[i])
                    found = tree.search(points[query], place_of.get(int(row[query]), -1), ids, b, k, floor)
                    out += [(int(row[query]), None if vec == -NO_ID else -vec, as_score(score)) for score, vec in found]
        kinds = (pa.int64(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=["query", "vec_id", "score"]
        )

    return pairs.groupBy("dim", "shard", "block").applyInArrow(run, f"query bigint, vec_id bigint, score {SCORE}")


def _best(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best per query; at most k per shard come in."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    rows = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return rows.join(named, "query").select("query_id", "rank", "vec_id", as_long(F.col("score")).alias("score"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    factor: int = 256,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products, ties to the smaller id.

    Vectors that are null or hold a component that is null or not finite take no part.  Rows
    that share an id are rows of their own, each a query if ``is_query`` says so (null: no); a
    query leaves out only its own row.  Rows without an id come last among equal scores.  Vectors
    are compared with those of their own length; empty ones score 0.  Scores that no long holds
    are ranked as they are, up to 38 digits, and returned as the nearest long.  Fewer candidates
    than k give fewer rows.  Other columns are not read.
    """
    kept = vectors.select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("query"),
    ).where(usable(F.col("vector")))
    rows = staged(kept.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}), "vectors")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q")).first()
    shards = max(1, -(-counts["n"] // shard_rows))
    blocks = max(1, -(-counts["q"] // block_rows))
    columns = ["dim", "shard", "block", "row", "vec_id", "vector"]
    candidates = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(shards)))
    queries = rows.where("query").withColumn("block", F.pmod(F.xxhash64(F.lit(6), "row"), F.lit(blocks)))

    def meet(these: Column, known: DataFrame) -> DataFrame:
        """Candidates of some shards for every block, and queries for each of these shards."""
        left = candidates.where(these).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        left = left.withColumn("block", F.col("block").cast("bigint"))
        left = left.select(*columns, F.lit(False).alias("query"), F.lit(None).cast(SCORE).alias("floor"))
        right = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        right = right.withColumn("shard", F.col("shard").cast("bigint")).where(these)
        return left.unionByName(right.select(*columns, "query", "floor"))

    first = queries.withColumn("floor", F.lit(None).cast(SCORE))
    pilot = staged(_search_groups(meet(F.col("shard") == 0, first), k, factor), "pilot")
    if shards == 1:
        return _best(pilot, queries, k)
    floors = pilot.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    known = queries.join(floors.withColumnRenamed("query", "row"), "row", "left")
    rest = _search_groups(meet(F.col("shard") > 0, known), k, factor)
    return _best(pilot.unionByName(rest), queries, k)
