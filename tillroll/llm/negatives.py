"""Hard negatives: rows of other labels that score a little below an anchor's positives.

Candidates are dealt to shards of bounded size, anchors to blocks of bounded size, and every block
meets every shard.  A shard's vectors are packed into an R-tree by sort-tile-recursion.  The
minimum bounding box of a node gives an interval for every coordinate's product with the anchor,
and their sums one for the inner product.  A best-first queue opens boxes by the upper end and
leaves out those whose interval misses every score window, and those strictly below the k-th best
score that a window already has.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.vectors import NO_ID, SCORE, as_long, as_score, group_vectors, usable
from tillroll.sources.staging import staged

SHARD_ROWS = 8_192
BLOCK_ROWS = 8_192
LEAF_ROWS = 128
FAN = 8
QUERIES_AT_ONCE = 256


class RTree:
    """Packed by sort-tile-recursion, the widest coordinates first; boxes are minimal."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS, fan: int = FAN):
        wide = points.max(axis=0) - points.min(axis=0) if points.shape[1] else np.zeros(0)
        sides = [int(c) for c in np.argsort(-wide.astype(np.float64), kind="stable")]
        self.order = np.concatenate(_tiles(points, np.arange(len(points)), sides, leaf_rows))
        packed = points[self.order]
        spans = [(at, min(at + leaf_rows, len(packed))) for at in range(0, len(packed), leaf_rows)]
        low = [packed[a:b].min(axis=0) for a, b in spans]
        high = [packed[a:b].max(axis=0) for a, b in spans]
        self.leaves = len(spans)
        first = 0
        while len(low) - first > 1:
            # Neighbours in the packed order lie close together: each run of them is a node.
            level = range(first, len(low), fan)
            first, last = len(low), len(low)
            for a in level:
                b = min(a + fan, last)
                spans.append((a, b))
                low.append(np.min(low[a:b], axis=0))
                high.append(np.max(high[a:b], axis=0))
        self.points, self.spans = packed, spans
        self.low, self.high = np.array(low), np.array(high)

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, nodes): the least and the largest inner product that a box allows."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def search(
        self, anchor: np.ndarray, least: np.ndarray, most: np.ndarray, allowed: np.ndarray,
        ids: list[int], windows: list[tuple[float, float]], k: int,
    ) -> list[list[tuple]]:
        """For each window (lowest, highest score) the k best ``(-score, id, place)``.

        ``allowed`` and ``ids`` go by place in the packed order.
        """
        floors = [a for a, _ in windows]
        best: list[list[tuple]] = [[] for _ in windows]
        root = len(self.spans) - 1
        queue = [(-most[root], root)]
        while queue:
            above, node = heapq.heappop(queue)
            if -above < min(floors):
                break
            start, stop = self.spans[node]
            if node >= self.leaves:
                for child in range(start, stop):
                    if any(most[child] >= f and least[child] <= w[1] for f, w in zip(floors, windows)):
                        heapq.heappush(queue, (-most[child], child))
                continue
            scores = self.points[start:stop] @ anchor
            for i, (_, highest) in enumerate(windows):
                if -above < floors[i] or least[node] > highest:
                    continue
                hit = np.flatnonzero((scores >= floors[i]) & (scores <= highest) & allowed[start:stop])
                if len(hit):
                    found = [(-s, ids[start + p], start + p) for s, p in zip(scores[hit].tolist(), hit.tolist())]
                    best[i] = heapq.nsmallest(k, best[i] + found)
                    if len(best[i]) == k:
                        floors[i] = max(floors[i], -best[i][-1][0])
        return best


def _tiles(points: np.ndarray, rows: np.ndarray, sides: list[int], leaf_rows: int) -> list[np.ndarray]:
    """Row numbers tile by tile: sorted by one coordinate, cut into slabs, each by the next."""
    pages = -(-len(rows) // leaf_rows)
    if pages <= 1 or not sides:
        return [rows]
    slabs = math.ceil(pages ** (1 / len(sides)) - 1e-9)
    each = leaf_rows * -(-pages // slabs)
    rows = rows[np.argsort(points[rows, sides[0]], kind="stable")]
    out: list[np.ndarray] = []
    for at in range(0, len(rows), each):
        out += _tiles(points, rows[at : at + each], sides[1:], leaf_rows)
    return out


Windows = Callable[[list[Decimal] | None], list[tuple[float, float]]]


def _searched(meeting: DataFrame, same: bool, windows: Windows, k: int, factor: int) -> DataFrame:
    """(anchor, slot, vec_id, score): the k best of each window in every (dim, shard, block) group.

    A group holds one shard and one block of anchors, so its size is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        is_anchor = table.column("is_anchor").to_numpy()
        at, rest = np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
        out: list[tuple[int, int, int | None, Decimal]] = []
        if len(at) and len(rest):
            vectors = group_vectors(table, factor)
            label, row = table.column("label").to_numpy(), table.column("row").to_numpy()
            tree = RTree(vectors[rest])
            packed = rest[tree.order]
            ids = [NO_ID if x is None else x for x in table.column("vec_id").take(pa.array(packed)).to_pylist()]
            own_label, own_row = label[packed], row[packed]
            bounds = table.column("positives").take(pa.array(at)).to_pylist()
            for start in range(0, len(at), QUERIES_AT_ONCE):
                part = at[start : start + QUERIES_AT_ONCE]
                least, most = tree.intervals(vectors[part])
                for i, anchor in enumerate(part):
                    wanted = windows(bounds[start + i])
                    if not wanted:
                        continue
                    alike = own_label == label[anchor]
                    allowed = alike & (own_row != row[anchor]) if same else ~alike
                    found = tree.search(vectors[anchor], least[i], most[i], allowed, ids, wanted, k)
                    for slot, best in enumerate(found, 1):
                        for less, vec, _ in best:
                            out.append((int(row[anchor]), slot, None if vec == NO_ID else vec, as_score(-less)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)],
            names=["anchor", "slot", "vec_id", "score"],
        )

    found = meeting.groupBy("dim", "shard", "block").applyInArrow(
        run, f"anchor bigint, slot int, vec_id bigint, score {SCORE}"
    )
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    factor: int = 256,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its ``positives`` best other rows of the same label; for each, the
    ``negatives`` best rows of other labels whose score lies between the two percentages of the
    positive's.  Scores are inner products of floor(factor * x); ties go to the smaller id, rows
    without an id last.  Rows without a label, without a vector or with a component that is null
    or not finite take no part.  Rows that share an id are rows of their own, each an anchor if
    ``is_anchor`` says so (null: no).  Vectors meet those of their own length only; empty ones
    score 0.  Scores that no long holds are ranked as they are, up to 38 digits, and returned as
    the nearest long.  Other columns are not read.  No rows, or none of another label: no result.
    """
    kept = vectors.select(
        F.col(key).cast("bigint").alias("vec_id"),
        (F.col("label") if label is None else label).cast("bigint").alias("label"),
        F.col(vector).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    kept = kept.where(F.col("label").isNotNull() & usable(F.col("vector")))
    rows = staged(kept.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}), "vectors")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors")).first()
    shards = max(1, -(-counts["n"] // shard_rows))
    blocks = max(1, -(-counts["anchors"] // block_rows))
    columns = ["dim", "shard", "block", "row", "vec_id", "label", "vector", "is_anchor", "positives"]

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    def dealt(seed: int, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n))

    def meet(anchors: DataFrame) -> DataFrame:
        """Every shard once for each block of anchors, and every anchor once for each shard."""
        left = rows.withColumns({"is_anchor": F.lit(False), "shard": dealt(5, shards)}).withColumn("block", each(blocks))
        left = left.withColumn("positives", F.lit(None).cast(f"array<{SCORE}>"))
        right = anchors.withColumn("block", dealt(6, blocks)).withColumn("shard", each(shards))
        return left.select(*columns).unionByName(right.select(*columns))

    anchors = rows.where("is_anchor")
    everything: Windows = lambda _: [(-math.inf, math.inf)]
    first = meet(anchors.withColumn("positives", F.lit(None).cast(f"array<{SCORE}>")))
    near = staged(_searched(first, True, everything, positives, factor), "positives")

    def below(scores: list[Decimal] | None) -> list[tuple[float, float]]:
        """Scores s with low * p <= 100 * s <= high * p."""
        whole = [int(s) for s in scores or []]
        return [(-(-low_percent * p // 100), high_percent * p // 100) for p in whole]

    lists = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("_p"))
    lists = lists.select(F.col("anchor").alias("row"), F.col("_p.score").alias("positives"))
    found = _searched(meet(anchors.join(lists, "row")), False, below, negatives, factor)
    found = found.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative"))
    named = near.select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), "score")
    named = named.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return found.join(named, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id",
        as_long(F.col("score")).alias("positive_score"), as_long(F.col("negative")).alias("negative_score"),
    )
