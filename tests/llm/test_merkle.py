"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

from pyspark.sql import functions as F

from tillroll.llm import catalog, merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return digest("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def siblings(levels, at):
    found = []
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        found.append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        at //= 3
    return found


def expected(rows):
    groups = {}
    for row in rows:
        place = (row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row, row["text"]))
        groups.setdefault(row["source"], []).append((place, row))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda x: x[0])
    trees = {s: levels_of([place[2] for place, _ in groups[s]]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for p, s in enumerate(sources):
        for i, (place, row) in enumerate(groups[s]):
            path, text = siblings(trees[s], i) + siblings(top, p), row["text"]
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and text:
                text = text.replace("\n", "")
            node = leaf_of(row, text)
            for before, after in path:
                node = digest(before + node + after)
            proof = digest("".join(before + after for before, after in path))
            out.append((row["doc_id"], place[2], trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x or 0) for x in r))


def test_query_equals_a_tree_in_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = catalog.op13_merkle(spark, SF)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert _sorted(found.collect()) == _sorted(expected(docs))


def test_edge_rows(spark):
    """A source above two packs high over several ranges, lone leaves, nulls, repeated rows, long texts."""
    rows = [(i, "hot", "en", i % 5, f"line {i}\nend") for i in range(1, 700)]
    rows += [(7, "hot", "en", 2, "line 7\nend")] * 2  # one row three times
    rows += [(None, "hot", None, None, "a\nb"), (None, "hot", None, None, None)]
    rows += [(800 + i, f"s{i:03}", None, None, "") for i in range(90)]
    rows += [(900, None, "de", 1, None), (901, None, "de", 1, "ü\n" * 200_000), (902, "", "é", 0, "\n")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    clashing = docs.withColumns({c: F.lit("x") for c in ("group", "rank", "size", "digest", "path", "root", "_part")})
    for given, part_rows in ((docs, 100), (clashing, 200_000)):
        got = merkle.checked(given, part_rows=part_rows).collect()
        assert _sorted(got) == _sorted(expected(docs.collect()))


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.checked(empty).collect() == []
    lone = [(1, "a", None, None, "x\ny")]
    assert _sorted(merkle.checked(spark.createDataFrame(lone, SCHEMA)).collect()) == _sorted(
        expected([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), lone[0]))])
    )


def test_requests_for_some_leaves(spark):
    """Any set of places may be asked for; what the manifest does not have gets no row."""
    leaves = spark.createDataFrame([(i, "s", digest(str(i))) for i in range(500)], "id int, source string, leaf string")
    manifest = merkle.store(leaves, "source", "id", "leaf", part_rows=60)
    wanted = spark.createDataFrame([("1:s", 0), ("1:s", 499), ("1:s", 500), ("1:t", 0)], "`group` string, rank bigint")
    found = {r["rank"]: r for r in merkle.proofs(manifest, wanted).collect()}
    assert set(found) == {0, 499}
    levels = levels_of([digest(str(i)) for i in range(500)])
    for rank, row in found.items():
        assert row["found"] == digest(str(rank)) and row["root"] == row["subroot"] == levels[-1][0]
        assert [tuple(s) for s in row["path"]] == siblings(levels, rank)


def test_equal_subtrees_share_a_record(spark):
    """Digests that occur again have one record: the store is addressed by content."""
    leaves = spark.createDataFrame([(i, "s", digest("same")) for i in range(243)], "id int, source string, leaf string")
    manifest = merkle.store(leaves, "source", "id", "leaf")
    records = [r["records"] for r in manifest.packs.collect()]
    assert sum(map(len, records)) == 5  # one node a level
    assert merkle.proofs(manifest, manifest.places).where("root = subroot and found = digest").count() == 243
