"""Top-k search and hard negatives against brute force over Python's integers."""

import math

import numpy as np
from pyspark.sql import functions as F

from tillroll.llm import catalog, negatives, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, label int"
LONG = 2**63 - 1


def whole(vector):
    """floor(256 * x) in exact integers; None where the vector takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(x * 256) if abs(x) < 2**52 else int(x) * 256 for x in vector]


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def by_score(row):
    return -row[0], row[1] is None, row[1] or 0


def long(score):
    return max(-LONG - 1, min(LONG, score))


def expected_top(rows, k=5):
    known = [(i, whole(v)) for i, v, _ in rows if whole(v) is not None]
    out = []
    for q, (query, a) in enumerate(known):
        if query is not None and query % 50 == 0:
            scores = [(product(a, b), i) for c, (i, b) in enumerate(known) if c != q and len(a) == len(b)]
            best = sorted(scores, key=by_score)[:k]
            out += [(query, n, i, long(s)) for n, (s, i) in enumerate(best, 1)]
    return out


def expected_negatives(rows):
    known = [(i, whole(v), label) for i, v, label in rows if whole(v) is not None and label is not None]
    known = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in known]
    out = []
    for q, (anchor, a, label) in enumerate(known):
        if anchor is None or anchor % 50:
            continue
        scores = [(product(a, b), i, own) for c, (i, b, own) in enumerate(known) if c != q and len(a) == len(b)]
        for p, positive, _ in sorted((s for s in scores if s[2] == label), key=by_score)[:5]:
            near = [s for s in scores if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p]
            best = sorted(near, key=by_score)[:3]
            out += [(anchor, positive, n, i, long(p), long(s)) for n, (s, i, _) in enumerate(best, 1)]
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x or 0) for x in r))


def odd_rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 8)) * 0.4
    rows = [(i, [float(x) for x in centres[i % 10] + rng.normal(size=8) * 0.3], i % 10) for i in range(420)]
    rows += [(450 + i, [0.5] * 8, i % 3) for i in range(8)]  # ties
    rows += [(50, rows[3][1], 0), (50, rows[50][1], 0), (100, [9.0] * 8, 2)]  # ids that occur again
    rows += [(None, [0.5] * 8, 1), (None, [0.25] * 8, 4)]
    rows += [(550, None, 1), (600, [1.0, None] + [0.0] * 6, 1), (650, [float("nan")] * 8, 1)]
    rows += [(700, [float("inf")] + [0.0] * 7, 1), (701, [2.0, float("-inf")] + [0.0] * 6, 1)]
    rows += [(800, [], 1), (801, [], 2), (802, [], 1), (850, [1.0, 2.0], 3), (851, [1.0, 1.0], 4), (852, [2.0, 1.0], 3)]
    return rows + [(900, [0.1] * 8, None)]


HUGE = [
    (0, [3e6, 1.0], 1), (1, [3e6, -2.0], 1), (2, [2.5e6, 0.0], 2), (3, [1e12, 1.0], 3), (4, [-1e300, 1.0], 2),
    (5, [1e300, 0.0], 2), (6, [1.5e6, 5.0], 5), (50, [1e12, 1e12], 3), (100, [2e4, 1.0], 1),
]


def test_queries_over_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert ordered(catalog.op4_top_k(spark, SF).collect()) == ordered(expected_top(rows))
    found = catalog.op12_hard_negatives(spark, SF)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert ordered(found.collect()) == ordered(expected_negatives(rows))


def test_odd_rows(spark):
    """Ties, repeated and missing ids, lengths, and components that are null or not finite."""
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    df = df.withColumns({c: F.lit(1) for c in ("row", "shard", "block", "dim", "score", "rank")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    for shard_rows, block_rows in ((8192, 8192), (70, 3)):
        sizes = {"shard_rows": shard_rows, "block_rows": block_rows}
        found = topk.top_k(df, F.col("vec_id") % 50 == 0, **sizes)
        assert ordered(found.collect()) == ordered(expected_top(rows))
        found = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, label=label, **sizes)
        assert ordered(found.collect()) == ordered(expected_negatives(rows))


def test_huge_components_take_part(spark):
    df = spark.createDataFrame(HUGE, SCHEMA)
    assert ordered(topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == ordered(expected_top(HUGE))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    small = [r for r in HUGE if max(map(abs, r[1])) < 1e9]
    found = negatives.hard_negatives(spark.createDataFrame(small, SCHEMA), F.col("vec_id") % 50 == 0, label=label)
    assert ordered(found.collect()) == ordered(expected_negatives(small)) != []


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(empty, F.lit(True)).count() == 0
    assert negatives.hard_negatives(empty, F.lit(True)).count() == 0


def test_tree_opens_few_boxes_and_loses_nothing():
    """Clustered points in few dimensions: intervals rule out most leaves; every window is exact."""
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(size=(40, 1, 3)) * 200 + rng.normal(size=(40, 50, 3)) * 5).reshape(-1, 3)
    tree = negatives.RTree(points, leaf_rows=16, fan=4)
    assert sorted(tree.order) == list(range(2000))
    for low, high, (a, b) in zip(tree.low, tree.high, tree.spans[: tree.leaves]):
        assert (tree.points[a:b].min(axis=0) == low).all() and (tree.points[a:b].max(axis=0) == high).all()
    ids, allowed, opened = tree.order.tolist(), np.ones(2000, bool), 0

    class Counted(np.ndarray):
        def __matmul__(self, other):
            nonlocal opened
            opened += 1
            return np.asarray(self) @ other

    tree.points = tree.points.view(Counted)
    for anchor in points[::200]:
        scores = points @ anchor
        windows = [(-math.inf, math.inf), (float(np.quantile(scores, 0.5)), float(np.quantile(scores, 0.6))), (9e9, 9e9)]
        least, most = tree.intervals(anchor[None])
        found = tree.search(anchor, least[0], most[0], allowed, ids, windows, 4)
        for (low, high), best in zip(windows, found):
            exact = sorted((-s, i) for i, s in enumerate(scores) if low <= s <= high)[:4]
            assert [(s, i) for s, i, _ in best] == exact
    assert opened < 0.5 * 10 * tree.leaves
