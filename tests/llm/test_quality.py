"""The quality vote against plain Python, and its accuracy on held-out documents."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import catalog, quality

SF = "/root/testdata/sf0.01"
TEXTS = ["", None, "a", "ab", "The the THE!! 123 abc abc abc", "x" * 40, "é\n\nü | ü | ü\t", " ", "one two one two two", "$$$ a### b%%%"]


def grams(codes, size, buckets):
    out = Counter()
    for i in range(len(codes) - size + 1):
        key = 0
        for c in codes[i : i + size]:
            key = (key * 257 + c + 1) % 2**64
        out[(key * 0x9E3779B97F4A7C15 % 2**64 >> 40) % buckets] += 1
    return out


def plain_counts(text):
    data = (text or "").encode()
    out = np.zeros(quality.WIDTH)
    for bucket, n in grams(data, 3, quality.BYTES).items():
        out[bucket] = n
    shape = []
    for b in data:
        c = chr(b)
        code = 97 if b >= 128 or "a" <= c <= "z" else 65 if "A" <= c <= "Z" else 48 if "0" <= c <= "9" else 32 if c in "\t\v\f\r " else b
        shape.append(code)
    kept = [c for i, c in enumerate(shape) if i < 2 or not (c == shape[i - 1] == shape[i - 2])]
    for bucket, n in grams(kept, 5, quality.SHAPES).items():
        out[quality.KINDS[1] + bucket] = n
    words = (text or "").split()
    after = sum(a == b for a, b in zip(words, words[1:]))
    out[quality.KINDS[2] : quality.KINDS[3]] = after, len(words) - after, len(words) - len(set(words)), len(set(words))
    out[quality.KINDS[3] + int(np.ceil(np.log2(len(data) + 1)))] = 1
    return out


@pytest.mark.parametrize("chunk", [7, 1 << 19])
def test_counts(monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    found = quality.counts(pa.array(TEXTS))
    assert all((row == plain_counts(text)).all() for row, text in zip(found, TEXTS))


def test_votes_equal_brute_force():
    texts = [f"{'Word ' * (i % 4)}text number {i * 37 % 11} {'!' * (i % 3)}" for i in range(60)]
    found = quality.counts(pa.array(texts))
    idf = np.ones(quality.WIDTH, np.float32)
    matrix = quality.weighted(found, idf)
    directions = quality.directions_of(matrix, 8)
    assert np.allclose(directions.T @ directions, np.eye(8), atol=1e-4)
    sample = quality._unit(matrix @ directions)
    labels, stands = np.arange(60) % 2.0, 1.0 + np.arange(60) % 3
    model = quality.Neighbours(idf, directions, sample, labels, stands, 0.5)
    got = quality.votes(found, model, k=7)
    for vector, score in zip(sample, got):
        cosines = [round(float(vector @ other), 6) for other in sample]
        near = [i for i, c in enumerate(cosines) if c >= sorted(cosines)[-7]]
        weight = [max(cosines[i], 0) ** quality.POWER * stands[i] for i in near]
        assert abs(score - sum(w * labels[i] for w, i in zip(weight, near)) / sum(weight)) < 1e-4


def test_query_on_held_out_documents(spark):
    found = catalog.op11_quality(spark, SF)
    assert [t for _, t in found.dtypes] == ["bigint", "boolean", "double", "int"]
    rows = {r["doc_id"]: r for r in found.collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert rows.keys() == docs.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    tested = [i for i, r in rows.items() if r["held_out"] and i in truth]
    assert len(tested) > 60
    assert sum(rows[i]["predicted"] == truth[i] for i in tested) >= 0.95 * len(tested)
    by_text = {}
    for i, text in docs.items():
        by_text.setdefault(text, set()).add(rows[i]["score"])
    assert all(len(scores) == 1 for scores in by_text.values())


def test_held_out_labels_are_not_learned(spark, tmp_path):
    """Turning every held-out label round changes no score."""
    small = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{small}/labels.parquet")
    held = catalog.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    turned.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.withColumns({"lang": F.lit("zz"), "source": F.lit("?")}).write.parquet(str(tmp_path / "documents.parquet"))
    first, second = catalog.op11_quality(spark, small), catalog.op11_quality(spark, str(tmp_path))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_edge_tables(spark):
    good, bad = "Some plain words in a row, number {}.", "BAD!! BAD!! BAD!! {} {} {}"
    rows = [(i, (good if i % 2 else bad).format(i, i, i), "x") for i in range(80)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "plain words " * 200_000, "x"), (3, rows[3][1], "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(3)
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(0, 80, 3)] + [(1, None), (2, 7), (None, 1), (3, 1), (999, 0)], "doc_id bigint, quality int"
    )
    model = quality.fit(docs, labels, per_label=10)
    assert len(model.labels) == 20 and model.share == 16 / 30  # document 3 and its label are there twice
    got = quality.classify(docs.withColumn("extra", F.lit(1)), model).collect()
    assert got[0].__fields__ == ["doc_id", "text", "extra", "score", "predicted"] and len(got) == len(rows)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[100] == score[101]
    assert all(score[i] > 0.7 if i % 2 else score[i] < 0.3 for i in range(80))
    one = quality.fit(docs, labels.where("quality = 1"), per_label=10)
    assert {r["score"] for r in quality.classify(docs, one).collect()} == {1.0}
    assert quality.fit(docs, labels.limit(0)) is None and quality.fit(docs.limit(0), labels) is None
    assert {r["score"] for r in quality.classify(docs, None).collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0
