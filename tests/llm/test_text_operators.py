"""Operators on texts against brute force, exact round trips and edge rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tillroll.llm import bpe, fingerprints, langid, licences, near, substrings
from tillroll.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
EDGES = [None, "", "   \n", "a", "word " * 40, "don't!! ''s  x\n\n y\t z\xa0q", "é" * 300 + " 12345 ünï"]


@pytest.fixture(scope="module")
def sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(EDGES)] + [(10_004, EDGES[4]), (None, "null id")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_bpe_in_chunks_equals_the_library_and_decodes(sample):
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe._ranks(open(PATH, "rb").read()), special_tokens={})
    ids = bpe.encode(sample, PATH, PATTERN, chunk_chars=200, overlap_chars=60)
    rows = bpe.decode(ids, PATH).collect()
    assert len(rows) == sample.count()
    for r in rows:
        assert r["ids"] == encoding.encode_ordinary(r["text"] or ""), r["text"]
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_keeps_other_columns_and_unknown_ids_show(spark):
    df = spark.createDataFrame([("x", "a b", "extra")], "ids string, text string, key string")
    out = bpe.encode(df, PATH, PATTERN)
    assert out.columns == ["text", "key", "ids"] and out.first()["ids"]
    odd = spark.createDataFrame([([0, 99_999_999],), (None,)], "ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(odd, PATH).collect()] == [b"!" + "�".encode(), b""]


def test_substrings_equal_brute_force(sample):
    rows = sample.collect()
    count = {}
    for r in rows:
        w = words(r["text"])
        for i in range(len(w) - 34):
            count[tuple(w[i : i + 35])] = count.get(tuple(w[i : i + 35]), 0) + 1
    expected = []
    for r in rows:
        w = words(r["text"])
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        expected.append((str(r["doc_id"]), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    # A sketch with hardly any room lets more through, with the same result.
    for bits in (None, 6):
        out = substrings.remove_repeats(sample, sketch_bits=bits).collect()
        got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in out]
        assert sorted(got) == sorted(expected)


def test_jaccard_classes_equal_brute_force(spark, sample):
    rows = {}
    for r in sample.collect():
        rows.setdefault(r["text"] or "", []).append(r["doc_id"])
    sets = {}
    for t in rows:
        w = words(t)
        sets[t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {t: t for t in rows}
    links = {t: set() for t in rows}
    for a in rows:
        for b in rows:
            both = len(sets[a] & sets[b])
            if a < b and both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    for _ in rows:
        for a in rows:
            for b in links[a]:
                label[a] = label[b] = min(label[a], label[b])
    least = {}
    for t, ids in rows.items():
        least.setdefault(label[t], []).extend(i for i in ids if i is not None)
    text_of = {r["doc_id"]: r["text"] or "" for r in sample.collect()}
    for blocks in (256, 1):  # one text per block: every link crosses blocks
        for r in near.jaccard_classes(sample, block_texts=blocks).collect():
            t = text_of[r["doc_id"]]
            assert r["n_links"] == len(links[t])
            assert r["class_id"] == min(least[label[t]], default=None)
    kept = near.one_per_class(sample)
    assert kept.count() == len(set(label.values())) and kept.columns == sample.columns


def _variants(rng, n_words, n_new):
    """Two texts of random words of which the second has ``n_new`` other words at its end."""
    text = [str(rng.randrange(10**9)) for _ in range(n_words)]
    return " ".join(text), " ".join(text[: n_words - n_new] + [str(rng.randrange(10**9)) for _ in range(n_new)])


def test_prefixes_of_the_forest_are_shortened_for_texts_short_of_the_recall(spark):
    rng = random.Random(5)
    texts = [t for _ in range(60) for t in _variants(rng, 104, 10)]  # 90 of 110 shingles in common
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    # Two trees: 0.96 for a pair of 0.97 through prefixes of 7, 0.6 for one of 0.8 through prefixes of 4.
    assert near.least_length(0.8, 0.6, 2, 7) == 4
    found = {r["doc_id"]: r for r in near.jaccard_classes(docs, trees=2, recall=0.6).collect()}
    lengths = [found[i]["prefix_length"] for i in range(0, len(texts), 2)]
    assert len(set(lengths) - {None}) >= 3
    assert sum(x is not None for x in lengths) >= 0.6 * len(lengths)
    for i in range(0, len(texts), 2):
        a, b = found[i], found[i + 1]
        assert a["class_id"] == i and a["n_links"] == b["n_links"] == (lengths[i // 2] is not None)
        assert b["class_id"] == (i if a["n_links"] else i + 1)


def test_trie_nodes_span_partitions_and_content_texts_stop(spark):
    rng = random.Random(6)
    body = [str(rng.randrange(10**9)) for _ in range(300)]
    same = [" ".join([*body, f"end{i}"]) for i in range(300)]  # one trie node of many texts in most trees
    lone = _variants(rng, 104, 10)
    texts = [*same, *lone, None, "", "word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 50)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {r["doc_id"]: r for r in near.jaccard_classes(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert all(found[i]["class_id"] == 0 and found[i]["n_links"] == 299 and found[i]["prefix_length"] == 7 for i in range(300))
    assert found[300]["n_links"] == found[301]["n_links"] == 1 and found[301]["class_id"] == 300
    assert found[302]["class_id"] == found[303]["class_id"] == 302  # null counts as empty
    assert found[304]["class_id"] == 304 and found[304]["prefix_length"] is None


def test_one_per_class_keeps_columns_of_any_name(spark):
    rows = [(2, "a b c", 1, "x", 7), (1, "a b c", 2, "y", 8), (None, "d", 3, "z", 9), (None, "d", 3, "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_links int, _key string, `row.b` int")
    kept = near.one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r)[1:] for r in kept.collect()) == [("a b c", 2, "y", 8), ("d", 3, "z", 9)]


def test_fingerprints_of_edits_and_estimates(sample):
    rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in sample.collect()))
    out = {}
    for r in fingerprints.edited_fingerprints(sample).collect():
        out.setdefault(r["doc_id"] if r["doc_id"] is not None else -1, []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    shape = fingerprints.Shape()
    seen = {}
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        r = next(x for x in out[key] if x["edited_sha256"] == digest)
        assert r["n_chars"] == len(text)
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        a, b = (
            {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words(text), words(edited))
        )
        if len(a | b) > 100:
            assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 0.2
    marks, some = fingerprints.packed(pa.array(["a b c d e f", "", None, "a b c d e f"]), shape)
    assert (marks[0] == marks[3]).all() and some.tolist() == [True, False, False, True]
    assert fingerprints.likeness(marks[:3], marks[[3, 2, 0]], some[:3], some[[3, 2, 0]], shape).tolist() == [1.0, 1.0, 0.0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(empty, PATH, PATTERN).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
    assert near.jaccard_classes(empty).count() == 0
    assert fingerprints.edited_fingerprints(empty).count() == 0
    assert langid.identify(empty, None).count() == 0


def test_language_held_out_accuracy_and_switches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    crf = langid.fit(docs.where("doc_id % 4 <> 2"))
    out = langid.identify(docs.where("doc_id % 4 = 2"), crf).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)
    mixed = "The thing that was over there and here. Der gelichkeit und die einer schung mit einer."
    odd = spark.createDataFrame([(mixed,), ("12 !!",), (None,)], "text string")
    rows = langid.identify(odd, crf, spans=True).collect()
    assert [s["lang"] for s in rows[0]["lang_spans"]] == ["en", "de"]
    assert [(r["lang_pred"], r["score"]) for r in rows[1:]] == [("und", 0.0)] * 2


def test_language_sample_is_of_distinct_texts_and_spans(spark, monkeypatch):
    rows = [(f"text number {i}", "en") for i in range(30)]
    hashed = spark.createDataFrame(rows, "text string, lang string").selectExpr("text", "xxhash64(text) h").collect()
    least = [r["text"] for r in sorted(hashed, key=lambda r: r["h"])[:5]]
    rows += [(least[0], "en")] * 50 + [("wort " * 100, "de"), (" " * 300 + "x" + " " * 300, "fr"), (None, "en"), ("12", "it")]
    labelled = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(langid, "train", lambda texts, langs: list(zip(langs, texts)))
    got = langid.fit(labelled, docs_per_language=5, longest=40)
    assert [t for k, t in got if k == "en"] == least
    spans = dict(got)
    assert set(spans) == {"en", "de", "fr"} and len(spans["de"]) == 40 and spans["de"] in "wort " * 100
    assert "x" in spans["fr"] and len(spans["fr"]) == 40


def test_languages_of_few_words_are_learned():
    texts = ["日本語の文章です", "これは本です", "the cat sat on the mat", "a dog and the other dog ran"] * 3
    crf = langid.train(texts, ["ja", "ja", "en", "en"] * 3)
    batch = pa.RecordBatch.from_pydict({"text": ["これは本です", "the dog sat"], "_has_letter": [True, True]})
    out = langid._identified(batch, batch.column("text"), batch.column("_has_letter"), crf, False)
    assert out.column("lang_pred").to_pylist() == ["ja", "en"]


@pytest.fixture(scope="module")
def licence_model(spark):
    return licences.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))


WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining
 * a copy of this software and associated documentation files (the "Software"),
 * to deal in the Software without restriction, including without limitation
 * the rights to use, copy, modify, merge, publish, distribute, sublicense,
 * and/or sell copies of the Software."""
NOTICES = [
    ("Prose line.\nReleased under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL"),
    (WRAPPED, "MIT"),
    ("Licensed\tunder\tthe\tMIT\tLicense.", "MIT"),
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is "
     "distributed on an \"AS IS\" BASIS.", "Apache-2.0"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse.", "BSD"),
    ("SPDX-License-Identifier: CDDL-1.0", "unknown"),
    ("Licensed under the EUPL, Version 1.2 or later versions approved by the European Commission.", "unknown"),
    ("This program is made available under the terms of the Eclipse Public License v2.0.", "unknown"),
    ("The contents of this file are subject to the terms of the Common Development and Distribution License.", "unknown"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "unknown"),
    ("Licensed under the Artistic License 2.0, which accompanies this distribution.", "unknown"),
    ("Distributed under the terms of the CeCILL license version 2.1.", "unknown"),
    ("This software is licensed under the Microsoft Public License.", "unknown"),
    ("You may use this file under the terms of the PostgreSQL licence.", "unknown"),
    ("This package is released under the University licence, all rights reserved.", "unknown"),
]
PROSE = [
    "Of ing the thorer and thed rethin on the.",
    "Subject to the terms of this Agreement the seller shall hand over the vessel to the buyer on the first of May.",
    "The dog sat on the mat and read the paper.",
    None,
    "",
    " \n\n ",
    "word " * 50_000,
]


def test_licences_found_and_prose_left_alone(spark, licence_model):
    rows = [(i, t, 1.0, "kept") for i, t in enumerate([t for t, _ in NOTICES] + PROSE)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, prediction double, features string")
    got = licences.scan(odd, licence_model).collect()
    assert len(got) == len({r["doc_id"] for r in got})  # a wrapped paragraph is one finding
    found = {r["doc_id"]: r for r in got}
    for i, (text, family) in enumerate(NOTICES):
        if family != "unknown":
            assert found[i]["family"] == family and found[i]["confirmed"], text
        else:
            assert i not in found or not found[i]["confirmed"], text
    strangers = [i for i, (_, family) in enumerate(NOTICES) if family == "unknown"]
    assert 11 in found and sum(i in found for i in strangers) >= 0.9 * len(strangers)
    assert not {i for i in found if i >= len(NOTICES)}
    assert found[0]["paragraph"] == 1 and (found[0]["prediction"], found[0]["features"]) == (1.0, "kept")


def test_licences_of_families_left_out_of_training_are_unknown(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = {"MPL-2.0", "Zlib", "BSL-1.0"}
    kept = [(f, t) for f, t in licences.TEMPLATES if f not in out]
    left = [t for f, t in licences.TEMPLATES if f in out]
    model = licences.fit(docs, notices=kept)
    odd = spark.createDataFrame(list(enumerate(left)), "doc_id int, text string")
    got = {r["doc_id"]: r["family"] for r in licences.scan(odd, model).collect()}
    assert set(got.values()) == {"unknown"} and len(got) >= 0.9 * len(left)


def test_licences_of_repeated_rows_and_of_no_rows(spark, licence_model):
    notice = NOTICES[1][0]
    twice = spark.createDataFrame([(None, notice), (None, notice)], "doc_id int, text string")
    assert [r["family"] for r in licences.scan(twice, licence_model).collect()] == ["Apache-2.0"] * 2
    assert licences.scan(twice.limit(0), licence_model).count() == 0
    assert licences.fit(twice.limit(0)).temperature > 0


def test_training_holds_the_spans_alone():
    """800 texts of 20,000 characters: the features of a bounded number of words are built."""
    import resource

    rng = np.random.default_rng(2)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3300)) for _ in range(40)] * 20
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    words, index, target = langid._sequences(texts, np.arange(800) % 4, np.random.default_rng(7))
    assert index.shape == (langid.MOST_SEQUENCES, 48) and len(words.start) <= index.size
    langid.train(texts, [f"l{i % 4}" for i in range(800)], epochs=1)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 200


def test_spans_are_the_words_of_their_texts():
    texts = [f"Alpha{i} beta gamma{i} delta épsilon zeta" for i in range(30)] + ["x", ""]
    words, index, target = langid._sequences(texts, np.arange(32) % 2, np.random.default_rng(7))
    spelled = [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end)]
    known = {w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower())}
    assert set(spelled) <= known and index.max() < len(spelled)
    pairs = {(spelled[a], spelled[b]) for row in index for a, b in zip(row, row[1:])}
    assert ("beta", "gamma") in pairs and ("gamma", "delta") in pairs


def test_components_that_do_not_settle_raise(spark):
    chain = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    found = {r["node"]: r["least"] for r in components(chain, "a", "b").collect()}
    assert found == {i: 0 for i in range(41)}
    with pytest.raises(RuntimeError):
        components(chain, "a", "b", rounds=2)
