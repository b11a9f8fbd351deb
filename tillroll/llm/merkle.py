"""Merkle manifest of a table: a content-addressed DAG, and proofs found by descending from its root.

Rows become leaves, leaves of one group are ordered and every ``FAN`` consecutive nodes become one
until a subroot is left; the subroots, in the order of their groups, likewise give the root.  Each
inner node is stored as a record from its digest to its children.  Records of ``PACKED`` levels
below a node travel as one pack under that node's digest.  A request for a leaf starts at the root
and follows the base-``FAN`` digits of its rank, pack by pack, collecting the children that it does
not take; these segments, reversed, are the proof.  Requests for leaves of one lowest pack walk
together until that pack is reached, so the joins of the upper levels see one row per pack.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.sources.staging import staged

FAN = 3
PACKED = 4
PACK = FAN**PACKED
PART_ROWS = 200_000  # rows of one range of the order, at most about

TOP = "top"  # the group of the subroots; groups of rows start with a digit or are "-"
_STEP = "struct<before:string,after:string>"


class Store(NamedTuple):
    """The manifest: ``places`` (group, rank, size, digest and the rows' columns), ``groups``
    (group, size, subroot, its path from the root), ``packs`` (digest, records), ``root``."""

    places: DataFrame
    groups: DataFrame
    packs: DataFrame
    root: DataFrame


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _in_order(rows: DataFrame, group: str, order: Sequence[str], part_rows: int) -> DataFrame:
    """``rows`` with ``rank`` (from 0) within ``group``, and ``size``, its number of rows.

    ``order`` starts with what orders the groups and ends with what tells any two rows apart.  Rows
    are dealt to ranges of that order, so a group may spread over many tasks, and equal keys too.
    """
    parts = max(1, -(-rows.count() // part_rows))
    sorted_rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The low 33 bits of the increasing id are the place within the task.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = staged(sorted_rows.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")), "ordered")
    runs = dealt.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    own = Window.partitionBy(group)
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        "_part", group, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(own).alias("size"),
    )
    found = dealt.join(runs, ["_part", group]).withColumn("rank", F.col("_place") + F.col("_shift"))
    return found.drop("_part", "_place", "_shift")


def _levels(size: str) -> str:
    """How many levels of a pack stand above ``size`` nodes of one group."""
    cases = " ".join(f"WHEN {size} <= {FAN**k} THEN {k}" for k in range(PACKED))
    return f"(CASE {cases} ELSE {PACKED} END)"


def _above(nodes: str) -> str:
    """The next level: the digest of every run of ``FAN`` nodes."""
    return (
        f"transform(sequence(0, (size({nodes}) - 1) div {FAN}), "
        f"j -> sha2(concat_ws('', slice({nodes}, j * {FAN} + 1, {FAN})), 256))"
    )


def _records(upper: str, lower: str) -> str:
    return f"transform({upper}, (d, j) -> struct(d AS digest, slice({lower}, j * {FAN} + 1, {FAN}) AS children))"


def _packed(nodes: DataFrame) -> DataFrame:
    """One step up: each run of ``PACK`` nodes of a group as a pack under its topmost node."""
    run = nodes.groupBy("group", "size", F.expr(f"rank div {PACK}").alias("rank")).agg(
        F.expr("transform(sort_array(collect_list(struct(rank, digest))), s -> s.digest)").alias("_0")
    )
    run = run.withColumn("levels", F.expr(_levels("size")))
    for k in range(1, PACKED + 1):
        run = run.withColumn(f"_{k}", F.expr(f"CASE WHEN levels >= {k} THEN {_above(f'_{k - 1}')} END"))
    tops = ", ".join(f"_{k}" for k in range(PACKED, -1, -1))
    entries = ", ".join(
        f"coalesce({_records(f'_{k}', f'_{k - 1}')}, array())" for k in range(1, PACKED + 1)
    )
    # Equal nodes have equal children: one record stands for all of them.
    return run.select(
        "group",
        "rank",
        F.expr(f"CASE WHEN levels < {PACKED} THEN 1 ELSE (size + {PACK - 1}) div {PACK} END").alias("size"),
        F.expr(f"coalesce({tops})[0]").alias("digest"),
        F.expr(f"map_from_entries(array_distinct(concat({entries})))").alias("records"),
    )


def _climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(group, digest) of each group's last node, and the packs below it."""
    roots, packs = nodes.where("size = 1").select("group", "digest"), None
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        step = staged(_packed(nodes.where("size > 1")), "packs")
        found = step.select("digest", "records")
        packs = found if packs is None else packs.unionByName(found)
        nodes = step.select("group", "rank", "size", "digest")
        roots = roots.unionByName(nodes.where("size = 1").select("group", "digest"))
        most = 1 if most <= PACK else -(-most // PACK)
    return roots, packs


def _walk(index: str, levels: str, digest: str) -> str:
    """The node at place ``index`` of a pack below ``digest``, and the steps from there to it."""
    powers = ", ".join(str(FAN**k) for k in range(PACKED))
    digit = f"cast(({index} div array({powers})[k]) % {FAN} as int)"
    child = "element_at(records, acc.digest)"
    step = (
        f"named_struct('before', concat_ws('', slice({child}, 1, {digit})), "
        f"'after', concat_ws('', slice({child}, {digit} + 2, {FAN})))"
    )
    return (
        f"aggregate(CASE WHEN {levels} = 0 THEN cast(array() as array<int>) ELSE sequence({levels} - 1, 0, -1) END, "
        f"named_struct('digest', {digest}, 'path', cast(array() as array<{_STEP}>)), "
        f"(acc, k) -> named_struct('digest', {child}[{digit}], 'path', concat(acc.path, array({step}))))"
    )


def _height(size: str, step: int) -> str:
    """Levels within the pack of step ``step`` (0: above the leaves) of a group of ``size``."""
    left = f"(({size} + {PACK**step - 1}) div {PACK**step})"
    return _levels(left)


def _descended(walkers: DataFrame, packs: DataFrame | None, most: int) -> DataFrame:
    """Walkers (group, block, size, top, path) taken from ``top``, the last node of their group,
    down to the ``digest`` above their block of ``PACK`` leaves."""
    walkers = walkers.withColumn("digest", F.col("top"))
    columns = ["group", "block", "size", "top", "digest", "path"]
    steps = 0
    while PACK ** (steps + 1) < most:
        steps += 1
    for step in range(steps, 0, -1):
        moving = walkers.where(f"size > {PACK**step}").join(packs, "digest")
        index = f"((block div {PACK ** (step - 1)}) % {PACK})"
        moving = moving.withColumn("_at", F.expr(_walk(index, _height("size", step), "digest")))
        moving = moving.withColumns({"digest": F.col("_at.digest"), "path": F.concat("path", "_at.path")})
        walkers = walkers.where(f"size <= {PACK**step}").select(*columns).unionByName(moving.select(*columns))
    return walkers.select(*columns)


def _arrived(walkers: DataFrame, packs: DataFrame | None, requests: DataFrame) -> DataFrame:
    """Requests (group, block, rank and more) with the whole ``path`` from ``top`` to their leaf,
    and the digest that was ``found`` there."""
    lone = walkers.where("size = 1").withColumn("records", F.lit(None).cast("map<string,array<string>>"))
    if packs is not None:
        lone = lone.unionByName(walkers.where("size > 1").join(packs, "digest").select(*lone.columns))
    rows = requests.join(lone, ["group", "block"]).where("rank < size")
    at = F.expr(_walk(f"(rank % {PACK})", _height("size", 0), "digest"))
    return rows.withColumn("_at", at).select(
        *requests.columns, "top", F.col("_at.digest").alias("found"), F.concat("path", "_at.path").alias("path")
    )


def _scalar(one_row: DataFrame, name: str) -> Column:
    return one_row.agg(F.max(name)).scalar()


def store(leaves: DataFrame, group: str, order: str, digest: str, part_rows: int = PART_ROWS) -> Store:
    """The manifest of ``leaves``, one row each; within a group they ascend by ``order``.

    Groups ascend, null first; so does ``order`` within a group.  Rows that agree in both go by
    their digest, so the root depends on the rows alone and not on how they are dealt out.
    Repeated rows are leaves of their own.  Other columns go along under their names; ``group``,
    ``rank``, ``size``, ``digest`` and names that begin with an underscore are taken.
    """
    rows = leaves.withColumns(
        {"_source": F.col(group), "_key": F.col(order), "_digest": F.col(digest), "_row": F.monotonically_increasing_id()}
    )
    rows = rows.drop("group", "rank", "size", "digest").withColumns({"group": field(F.col("_source")), "digest": F.col("_digest")})
    rows = staged(rows, "leaves")
    placed = _in_order(rows, "group", ["_source", "_key", "_digest", "_row"], part_rows)
    placed = staged(placed.drop("_key", "_digest", "_row"), "places")
    subroots, packs = _climb(placed.select("group", "rank", "size", "digest"))
    sizes = placed.where("rank = 0").select("group", "size", "_source")
    subroots = staged(sizes.join(subroots, "group"), "subroots")
    tops = _in_order(subroots.drop("size").withColumn("_top", F.lit(TOP)), "_top", ["_source", "group"], part_rows)
    tops = staged(tops.select(F.col("_top").alias("group"), "rank", "size", "digest", F.col("group").alias("of")), "tops")
    root, top_packs = _climb(tops.select("group", "rank", "size", "digest"))
    if top_packs is not None:
        packs = top_packs if packs is None else packs.unionByName(top_packs)
    if packs is not None:
        packs = staged(packs.dropDuplicates(["digest"]), "records")
    root = staged(root.select("digest"), "root")
    wanted = tops.select("group", F.expr(f"rank div {PACK}").alias("block"), "rank", "size", "of")
    walkers = wanted.groupBy("group", "block", "size").agg(_scalar(root, "digest").alias("top"))
    walkers = walkers.withColumn("path", F.expr(f"cast(array() as array<{_STEP}>)"))
    most = tops.agg(F.max("size")).first()[0] or 0
    found = _arrived(_descended(walkers, packs, most), packs, wanted.select("group", "block", "rank", "of"))
    found = found.select(F.col("of").alias("group"), F.col("found").alias("subroot"), "path")
    groups = staged(subroots.select("group", "size").join(found, "group"), "groups")
    return Store(placed.drop("_source"), groups, packs, root)


def proofs(manifest: Store, requests: DataFrame) -> DataFrame:
    """``requests`` (group, rank and more, for instance some of ``places``) with ``subroot``,
    ``root``, the leaf digest ``found`` at that place and its ``path``, the level above the leaf
    first: what stands left and right of the node in each run.  Requests for places that the
    manifest does not have get no row.  Columns of the four names are replaced.
    """
    made = ["subroot", "root", "found", "path"]
    kept = [F.col(f"`{c}`") for c in requests.columns if c not in ("group", "rank", *made)]
    wanted = requests.select(
        "group", "rank", F.expr(f"rank div {PACK}").alias("block"), F.struct(*kept, F.lit(0).alias("_")).alias("_asked")
    )
    blocks = wanted.select("group", "block").distinct()
    walkers = blocks.join(manifest.groups, "group").where(f"block * {PACK} < size")
    walkers = walkers.withColumnRenamed("subroot", "top")
    most = manifest.groups.agg(F.max("size")).first()[0] or 0
    found = _arrived(staged(_descended(walkers, manifest.packs, most), "walkers"), manifest.packs, wanted)
    return found.select(
        "group", "rank", "_asked.*", F.col("top").alias("subroot"), _scalar(manifest.root, "digest").alias("root"),
        "found", F.reverse("path").alias("path"),
    ).drop("_")


def proof_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def checked(docs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Leaf, proof and verification of every row of ``documents``, some of them tampered with.

    The leaf is made of doc_id, source, lang, n_chars and text.  Where crc32 of the decimal doc_id
    is even, the folded leaf is that of the text without its line feeds.  Rows without a doc_id
    come first in their source and are not tampered with; null texts stay null; repeated rows are
    leaves of their own; an empty table gives an empty result.  Other columns are not read.
    """
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    edited = F.when(tampered, F.replace(F.col("text"), F.lit("\n"))).otherwise(F.col("text"))
    leaves = docs.select(
        "doc_id", "source", leaf_digest([*parts, F.col("text")]).alias("leaf"),
        leaf_digest([*parts, edited]).alias("shown"),
    )
    manifest = store(leaves, "source", "doc_id", "leaf", part_rows)
    found = proofs(manifest, manifest.places.select("group", "rank", "doc_id", "leaf", "shown"))
    found = found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("shown"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root").eqNullSafe(F.col("root")))
