"""The stages of the pipeline, each on what its predecessor kept, against brute force."""

import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from tillroll.llm import bpe
from tillroll.sources.staging import staged

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts):
    """The least place that each text is connected to by a similarity of 0.8 or equality."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if texts[i] == texts[j] or (both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


def without_repeats(texts):
    """Each text's words and those that no repeated window of 35 covers."""
    count, out = {}, []
    for w in map(words, texts):
        for i in range(len(w) - 34):
            count[tuple(w[i : i + 35])] = count.get(tuple(w[i : i + 35]), 0) + 1
    for w in map(words, texts):
        gone = set()
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((w, [x for i, x in enumerate(w) if i not in gone]))
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = [(90_001, "12 !! 34", None, "s", 8), (90_002, None, None, "s", 0), (90_003, "", None, None, 0)]
    tables = [docs.unionByName(spark.createDataFrame(junk, docs.schema))]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(staged(stage(spark, tables[-1], SF), name))
        assert tables[-1].columns == docs.columns
    given, known, distinct, shortened, mixed = (t.orderBy("doc_id").collect() for t in tables)

    # Language: texts without a letter go, nearly all others stay, as they were.
    assert not {r["doc_id"] for r in known} & {90_001, 90_002, 90_003}
    assert len(known) >= 0.97 * len(given)
    text_of = {r["doc_id"]: r["text"] for r in given}
    assert all(r["text"] == text_of[r["doc_id"]] and r["lang"] for r in known)

    # Near duplicates: one document of each class, that of the least id.
    label = classes([r["text"] for r in known])
    assert [r["doc_id"] for r in distinct] == [known[i]["doc_id"] for i in sorted(set(label))]

    # Passages: the words that no repeated window covers; a document that loses all goes.
    expected = {}
    for r, (had, kept) in zip(distinct, without_repeats([r["text"] for r in distinct])):
        if len(kept) == len(had):
            expected[r["doc_id"]] = r["text"]
        elif kept:
            expected[r["doc_id"]] = " ".join(kept)
    assert {r["doc_id"]: r["text"] for r in shortened} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in shortened)

    # Mixture: up to three copies of documents that were given to it.
    copies = {}
    for r in mixed:
        assert r["text"] == expected[r["doc_id"]]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3

    # Tokens: those of the library, one row per copy.
    path = public_tokenizers.path(corpus_pipeline.RANKS)
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(open(path, "rb").read()), special_tokens={}
    )
    out = corpus_pipeline.STAGES[-1][1](spark, tables[-1], SF).collect()
    assert sorted(r["doc_id"] for r in out) == [r["doc_id"] for r in mixed]
    assert all(r["round_trip"] and r["ids"] == encoding.encode_ordinary(expected[r["doc_id"]]) for r in out)
