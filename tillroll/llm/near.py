"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each tree of the forest holds the signatures of all texts, packed into longs and sorted over range
partitions: texts with a common prefix stand together, so the runs of equal prefixes are the nodes
of a trie.  The walk starts with prefixes of ``depth`` values and shortens them by one value a
step.  After each step the links found tell what share of a text's links the step finds: a link of
similarity s is seen with probability 1 - (1 - s ** length) ** trees.  Texts for which that share
reaches the target recall stop; the others, those without a link among them, go on to shorter
prefixes, down to the length that gives a pair just at the threshold the target recall.  A pair is
met if one of its two texts walks that far.

Texts that meet form components, and inside a component every pair is verified on whole shingle
sets, blocks of a large component in pairs of blocks.  A later step verifies only components that
grew.  Links are counted where they are verified, and only one link per text and block pair
travels on, so no list of all pairs is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.components import components
from tillroll.llm.words import mix, pieces, shingles, words_of, worker_cache
from tillroll.sources.staging import staged

THRESHOLD = 0.8
SHINGLE = 5
TREES = 32
DEPTH = 7
RECALL = 0.9999
BLOCK_TEXTS = 256


def least_length(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that a pair at the threshold shares in some tree with ``recall``; no walk goes below."""
    for length in range(depth, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    raise ValueError("not even one value per tree reaches the recall: plant more trees")


def _seeds(n: int) -> np.ndarray:
    cache = worker_cache()
    if ("seeds", n) not in cache:
        odd = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)
        cache["seeds", n] = odd.astype(np.uint32) | np.uint32(1)
    return cache["seeds", n]


def value_bits(depth: int) -> int:
    """Bits of one value of a packed signature; equal values stay equal, others meet by chance."""
    return 63 // depth


def signatures(texts: pa.Array, depth: int, trees: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, trees) packed signatures, first value in the highest bits, and which texts have a shingle."""
    hashes, row = shingles(words_of(texts), size)
    some = np.bincount(row, minlength=len(texts)) > 0
    out = np.zeros((len(texts), trees), np.uint64)
    if not len(hashes):
        return out, some
    first = np.flatnonzero(np.diff(row, prepend=-1))
    short = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(first), trees * depth), np.uint32)
    values = np.empty_like(short)
    for i, seed in enumerate(_seeds(trees * depth)):
        np.multiply(short, seed, out=values)
        least[:, i] = np.minimum.reduceat(values, first)
    bits, packed = value_bits(depth), np.zeros((len(first), trees), np.uint64)
    for i in range(depth):
        value = mix(least[:, i::depth].astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - bits)
        packed = (packed << np.uint64(bits)) | value
    out[some] = packed
    return out, some


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _signatures(rows: DataFrame, depth: int, trees: int, size: int) -> DataFrame:
    """(node, id, signatures) per row; texts without a word have no signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column("text")):
                part = batch.slice(a, b - a)
                found, some = signatures(part.column("text"), depth, trees, size)
                lists = [f.tobytes() if s else None for f, s in zip(found, some)]
                values = np.frombuffer(b"".join(x for x in lists if x is not None), np.int64)
                offsets = np.concatenate([[0], np.cumsum(some * trees)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    names=["node", "id", "signatures"],
                )

    return rows.mapInArrow(run, "node binary, id bigint, signatures array<bigint>")


def _forest(texts: DataFrame, depth: int, floor: int) -> DataFrame:
    """(length, tree, prefix, node, hub): per prefix length from ``floor`` on, the texts of trie nodes with more than one.

    The packed signatures of each tree are sorted over range partitions, with the text as the last
    key, so that a node of very many texts spans partitions.  A text's hub is the first text of its
    node in the partition; nodes that go on in the next partition are joined by the partitions'
    first and last rows, two per partition.
    """
    bits = value_bits(depth)
    lengths = range(floor, depth + 1)
    names = ["length", "tree", "prefix", "node", "hub"]

    def rows_of(length: int, tree: np.ndarray, prefix: np.ndarray, node: pa.Array, hub: pa.Array) -> pa.RecordBatch:
        marks = pa.array(np.full(len(tree), length, np.int32))
        return pa.RecordBatch.from_arrays([marks, pa.array(tree, pa.int32()), pa.array(prefix, pa.int64()), node, hub], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, hubs = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, packed = batch.column("tree").to_numpy(), batch.column("signature").to_numpy()
            node = batch.column("node").cast(pa.binary())
            if before is None:
                yield rows_of(0, tree[:1], packed[:1], node[:1], node[:1])
            for length in lengths:
                shift = bits * (depth - length)
                prefix = packed >> shift
                start = np.ones(len(tree), bool)
                start[1:] = (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])
                if before is not None:
                    start[0] = before[0] != tree[0] or before[1] >> shift != prefix[0]
                at = np.maximum.accumulate(np.where(start, np.arange(1, len(tree) + 1), 0))
                firsts = pa.concat_arrays([pa.array([hubs.get(length, b"")], pa.binary()), node])
                hubs[length] = firsts[int(at[-1])].as_py()
                rest = np.flatnonzero(~start)
                yield rows_of(length, tree[rest], prefix[rest], node.take(pa.array(rest)), firsts.take(pa.array(at[rest])))
            before = int(tree[-1]), int(packed[-1]), node[-1].as_py()
        if before is not None:
            last = pa.array([before[2]], pa.binary())
            yield rows_of(0, np.array(before[:1]), np.array(before[1:2]), last, last)

    long = texts.select("node", F.posexplode("signatures").alias("tree", "signature"))
    order = ["tree", "signature", "node"]
    walked = long.repartitionByRange(*order).sortWithinPartitions(*order)
    forest = staged(walked.mapInArrow(walk, "length int, tree int, prefix bigint, node binary, hub binary"), "forest")

    ends = forest.where("length = 0").select("tree", F.col("prefix").alias("signature"), "node").distinct()
    after = Window.orderBy(*order)
    ends = ends.select(*order, *[F.lead(c).over(after).alias(f"next_{c}") for c in order]).where("tree = next_tree")
    out = forest.where("length > 0")
    for length in lengths:
        prefix, other = (F.shiftright(c, bits * (depth - length)) for c in ("signature", "next_signature"))
        met = ends.where(prefix == other)
        out = out.unionByName(
            met.select(F.lit(length).alias("length"), "tree", prefix.alias("prefix"), F.col("next_node").alias("node"), F.col("node").alias("hub"))
        )
    return out


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each pair of sets has in common."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.diff(every, prepend=~every[:1]) != 0) if len(every) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(every)))
    out = np.zeros((len(sets), len(sets)))
    column = np.repeat(np.where(length > 1, np.cumsum(length > 1) - 1, -1), length)
    keep = column >= 0
    owner, column = owner[keep], column[keep]
    total = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, total, 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        part = np.zeros((len(sets), min(4096, total - start)), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return out


def linked(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sets have a Jaccard similarity of the threshold or more, none with itself, and all similarities."""
    common = shared_counts(sets)
    size = np.array([len(s) for s in sets], dtype=float)
    union = size[:, None] + size[None, :] - common
    out = (common > 0) & (common >= threshold * union - 1e-9)
    np.fill_diagonal(out, False)
    return out, common / np.maximum(union, 1)


def _least_linked(links: np.ndarray) -> np.ndarray:
    """For each place the least place that it is connected to."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1) if len(links) else label
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(members: DataFrame, threshold: float, size: int, length: int, trees: int) -> DataFrame:
    """(node, links, expected, least) per text and block pair that has a link.

    ``members`` has comp, low, high (the block pair), block, node and text.  ``expected`` is how
    many links there are if those found were seen through prefixes of ``length`` values: each
    counts as one over the probability to see it.
    """

    def resolve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, at = [], {}
        for i, node in enumerate(table.column("node").to_pylist()):
            at.setdefault(node, i)  # a text that came twice counts once
        keep = sorted(at.values(), key=lambda i: table.column("node")[i].as_py())
        if len(keep) < 2:
            return
        table = table.take(pa.array(keep)).combine_chunks()
        nodes, block = table.column("node").to_pylist(), table.column("block").to_numpy()
        hashes, row = shingles(words_of(table.column("text").chunk(0)), size)
        cut = np.searchsorted(row, np.arange(len(nodes) + 1))
        links, alike = linked([np.unique(hashes[i:j]) for i, j in zip(cut, cut[1:])], threshold)
        if table.column("low")[0].as_py() != table.column("high")[0].as_py():
            links &= block[:, None] != block[None, :]
        count = links.sum(axis=1)
        seen = 1 - (1 - alike**length) ** trees
        expected = np.divide(1, seen, out=np.zeros_like(seen), where=links).sum(axis=1)
        least = _least_linked(links)
        hit = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([nodes[i] for i in hit], pa.binary()),
                pa.array(count[hit].astype(np.int64)),
                pa.array(expected[hit]),
                pa.array([nodes[least[i]] for i in hit], pa.binary()),
            ],
            names=["node", "links", "expected", "least"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("comp", "low", "high"))))
            start = 0
            for i, mark in enumerate([*marks, None]):
                if i == len(marks) or mark != key:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if i < len(marks):
                        if held:
                            yield from resolve(pa.Table.from_batches(held))
                        key, held, start = mark, [], i
        if held:
            yield from resolve(pa.Table.from_batches(held))

    dealt = members.repartition("comp", "low", "high").sortWithinPartitions("comp", "low", "high")
    return dealt.mapInArrow(run, "node binary, links bigint, expected double, least binary")


def _in_blocks(nodes: DataFrame, block_texts: int) -> DataFrame:
    """(node, comp, block, low, high): each text of a component that grew, once for each block pair.

    ``before`` is the text's component of the step before, null if it had none.
    """
    sizes = nodes.groupBy("comp").agg(
        F.count(F.lit(1)).alias("n"), F.count("before").alias("old"), F.min("before").alias("a"), F.max("before").alias("b")
    )
    sizes = sizes.where("old < n or a <> b")
    blocks = F.ceil(F.col("n") / block_texts).cast("int")
    sized = nodes.join(sizes.select("comp", blocks.alias("blocks")), "comp")
    own = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    # A block meets itself in a pair of its own and every other block without itself.
    return pairs.select("node", "comp", "block", "blocks", low.alias("low"), high.alias("high"))


def _edges(forest: DataFrame, length: int, content: DataFrame | None) -> DataFrame:
    """(node, hub) of the trie nodes of this prefix length that hold a text which walks on."""
    edges = forest.where(F.col("length") == length).drop("length")
    if content is not None:
        ends = edges.drop("hub").unionByName(edges.select("tree", "prefix", F.col("hub").alias("node")))
        walking = ends.join(content, "node", "left_anti").select("tree", "prefix").distinct()
        edges = edges.join(walking, ["tree", "prefix"], "left_semi")
    return edges.select("node", "hub")


def jaccard_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    size: int = SHINGLE,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    block_texts: int = BLOCK_TEXTS,
) -> DataFrame:
    """(key, text_key, copy_of, class_id, n_links, prefix_length) for every row of ``docs``.

    ``copy_of`` is the least id with the same text, ``class_id`` the least id of the texts that
    links connect, ``n_links`` how many other texts are similar by the threshold or more,
    ``prefix_length`` the length at which its links were verified last, null without links.  Shingles
    are sets of ``size`` words; a text of fewer words has one shingle.  Texts without words (null
    counts as empty) link with nothing but are copies of their equals.  Copies are told by whole
    texts; their links are those of the text.  Repeated rows stay, null ids are no one's least.
    """
    floor = least_length(threshold, recall, trees, depth)
    rows = docs.select(
        text_key(F.col(text)).alias("node"), F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    marks = staged(_signatures(rows, depth, trees, size), "signatures")
    texts = staged(
        marks.groupBy("node").agg(F.min("id").alias("copy_of"), F.any_value("signatures").alias("signatures")), "texts"
    )
    forest = _forest(texts, depth, floor)

    # One row per text that meets another: that of its least id, or of any id if it has none.
    meeting = forest.where(F.col("length") == floor)
    wanted = meeting.select("node").unionByName(meeting.select(F.col("hub").alias("node"))).distinct()
    wanted = wanted.join(texts.select("node", "copy_of"), "node")
    first = rows.join(wanted, (rows["node"] == wanted["node"]) & rows["id"].eqNullSafe(F.col("copy_of")), "left_semi")
    first = staged(first.select("node", "text"), "candidates")

    groups = verified = content = None
    large = False
    for length in range(depth, floor - 1, -1):
        edges = _edges(forest, length, content)
        if groups is not None:
            edges = edges.unionByName(groups.select("node", F.col("comp").alias("hub")))
        met = components(edges, "node", "hub").withColumnRenamed("least", "comp")
        if groups is None:
            grown = met.withColumn("before", F.lit(None).cast("binary"))
        else:
            grown = met.join(groups.withColumnRenamed("comp", "before"), "node", "left")
        members = staged(_in_blocks(grown, block_texts), "members")
        large = large or not members.where("blocks > 1").isEmpty()
        found = _verified(members.join(first, "node"), threshold, size, length, trees)
        found = staged(found.withColumn("prefix_length", F.lit(length)), "links")
        if verified is not None:
            found = found.unionByName(verified.join(members.select("node").distinct(), "node", "left_anti"))
        groups, verified = met, found
        links = verified.groupBy("node").agg(
            F.sum("links").alias("n_links"), F.sum("expected").alias("expected"), F.max("prefix_length").alias("prefix_length")
        )
        content = links.where(F.col("n_links") >= recall * F.round("expected", 9)).select("node")
    joined = components(verified, "node", "least") if large else verified.select("node", "least")
    known = texts.select("node", "copy_of").join(links.drop("expected"), "node", "left").join(joined, "node", "left")
    known = known.withColumn("least", F.coalesce("least", "node"))
    classes = known.groupBy("least").agg(F.min("copy_of").alias("class_id"))
    known = known.join(classes, "least").select(
        "node", "copy_of", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "prefix_length"
    )
    out = marks.select(F.col("id").alias(key), "node").join(known, "node")
    return out.select(key, F.col("node").alias("text_key"), "copy_of", "class_id", "n_links", "prefix_length")


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class: its least id, one row of equal ones.

    Rows without an id stay if no row of their class has one, one of each text.  All columns stay,
    whatever their names.
    """
    classes = jaccard_classes(docs.select(key, text), key, text, **options)
    kept = classes.where(F.col(key).eqNullSafe(F.col("class_id")))
    kept = kept.select(F.col(key).alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, F.col(key).cast("bigint").alias("own_id"), text_key(F.col(text)).alias("own_key"))
    same = (F.col("own_key") == F.col("kept_key")) & F.col("own_id").eqNullSafe(F.col("kept_id"))
    return marked.join(kept, same, "left_semi").dropDuplicates(["own_key", "own_id"]).select("row.*")
