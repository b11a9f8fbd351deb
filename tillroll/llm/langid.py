"""Language identification of words and texts with a linear-chain conditional random field.

Words are runs of letters.  A word's score for a language is a sum of learned weights of its byte
trigrams, its first and last three bytes and of the word itself (the lexicon); transitions between
the languages of neighbouring words are learned along with them, from sequences that switch
languages.  Forward-backward gives each word's probabilities; a text has the language of the
largest mean probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.words import _hash_ranges, buffers, pieces
from tillroll.sources.staging import staged

BUCKETS = 1 << 16
KINDS = 4  # trigram, start, end, word
DOCS_PER_LANGUAGE = 200
LONGEST_SAMPLE = 20_000
MOST_LANGUAGES = 64
MOST_SEQUENCES = 6_000
BATCH_BYTES = 6 << 20
PIECE_BYTES = 256 << 10
UNDETERMINED = "und"


class Crf(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # (KINDS * BUCKETS, labels)
    start: np.ndarray
    transitions: np.ndarray


class Letters(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each text, the index of its first word; one more entry at the end
    data: np.ndarray


def letter_words(texts: pa.Array) -> Letters:
    """Runs of ASCII letters and bytes beyond ASCII in the lower-cased texts."""
    lowered = pa.array([(t.as_py() or "").lower() for t in texts], pa.large_string())
    offsets, data = buffers(lowered)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = (data >= 128) | ((data >= 97) & (data <= 122))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-2] if len(data) else inside[:0]
    start = np.flatnonzero(inside[:-1] & (~before | edge[:-1]))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
    return Letters(start, end, np.searchsorted(start, offsets), data)


def _bucket(key: np.ndarray, kind: int) -> np.ndarray:
    mixed = (key.astype(np.uint64) + np.uint64(kind + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(np.int64) + kind * BUCKETS


def features(words: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram features and where each word's begin, and (words, 3) other features."""
    start, end, data = words.start, words.end, words.data
    lengths = end - start
    at = np.repeat(start - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    wide = np.zeros(len(data) + 2, dtype=np.uint32)
    wide[1:-1] = data
    inner = np.zeros(len(data) + 2, dtype=bool)
    inner[at + 1] = True
    wide[~inner] = 0
    begin = np.zeros(len(data) + 1, dtype=bool)
    begin[start] = True
    # Words that touch (at the border of two texts) must not see each other's bytes.
    left = np.where(begin[at], 0, wide[at])
    last = np.zeros(len(data) + 1, dtype=bool)
    last[end - 1] = True
    right = np.where(last[at], 0, wide[at + 2])
    trigrams = _bucket((left << 16) | (wide[at + 1] << 8) | right, 0)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])

    def edge_of(places: list[np.ndarray]) -> np.ndarray:
        key = np.zeros(len(start), dtype=np.uint32)
        for p in places:
            ok = (p >= start) & (p < end)
            key = (key << 8) | np.where(ok, data[np.clip(p, 0, max(0, len(data) - 1))], 0).astype(np.uint32)
        return key

    others = np.stack(
        [
            _bucket(edge_of([start, start + 1, start + 2]), 1),
            _bucket(edge_of([end - 3, end - 2, end - 1]), 2),
            _bucket(_hash_ranges(data, start, end), 3),
        ],
        axis=1,
    )
    return trigrams, begins, others


def emissions(words: Letters, weights: np.ndarray) -> np.ndarray:
    """(words, labels) scores."""
    if not len(words.start):
        return np.zeros((0, weights.shape[1]), np.float32)
    trigrams, begins, others = features(words)
    out = np.add.reduceat(weights[trigrams], begins, axis=0)
    for j in range(others.shape[1]):
        out += weights[others[:, j]]
    return out


def posteriors(scores: np.ndarray, first: np.ndarray, crf: Crf) -> np.ndarray:
    """Forward-backward over all texts at once, step by step along the words.

    ``scores`` are overwritten: two arrays of their size are all that is held.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, size = first[:-1][order], lengths[order]
    likely = scores
    if len(scores):
        likely -= scores.max(axis=1, keepdims=True)
        np.exp(likely, out=likely)
    move = np.exp(crf.transitions - crf.transitions.max()).astype(np.float32)
    ones, tiny = np.ones(likely.shape[1], np.float32), np.float32(1e-30)
    forward = np.empty_like(likely)
    longest = int(size[0]) if len(size) else 0
    # How many texts are longer than each step; those come first in the order.
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    alpha = np.exp(crf.start - crf.start.max()).astype(np.float32)[None, :].repeat(len(size), axis=0)
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        a = alpha[:n] if t == 0 else alpha[:n] @ move
        a = a * likely[at]
        a += tiny
        a /= (a @ ones)[:, None]
        alpha = a
        forward[at] = a
    beta = np.zeros((0, likely.shape[1]), np.float32)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        b = np.ones((n, likely.shape[1]), np.float32)
        if len(beta):
            k = len(beta)
            b[:k] = (beta * likely[at[:k] + 1]) @ move.T
            b[:k] /= (b[:k] @ ones)[:, None]
        forward[at] *= b
        beta = b
    out = forward
    out += tiny
    out /= (out @ ones)[:, None]
    return out


def _sequences(texts: list[str], labels: np.ndarray, rng, words: int = 48) -> tuple[Letters, np.ndarray, np.ndarray]:
    """Equal-length sequences of spans of 4 to 24 words whose languages switch at random.

    Returns the words that they use, without any others, the place of each word of a sequence
    among those, and its language.  Texts of fewer words serve only languages that have no longer
    ones.
    """
    parts = []
    for text in texts:
        found = letter_words(pa.array([text], pa.large_string()))
        parts.append((found.data, found.start.astype(np.int32), found.end.astype(np.int32)))
    lengths = np.array([len(start) for _, start, _ in parts])
    first = np.concatenate([[0], np.cumsum(lengths)])
    by_label = [np.flatnonzero((labels == k) & (lengths >= 4)) for k in range(labels.max() + 1)]
    # A language of short texts only, or of a script without blanks, is learned from what it has.
    by_label = [d if len(d) else np.flatnonzero((labels == k) & (lengths > 0)) for k, d in enumerate(by_label)]
    known = [k for k, docs in enumerate(by_label) if len(docs)]
    n = max(64, min(MOST_SEQUENCES, int(lengths.sum()) // words))
    index = np.empty((n if known else 0, words), dtype=np.int64)
    target = np.empty((n, words), dtype=np.int64)
    for i in range(len(index)):
        at = 0
        while at < words:
            k = known[rng.integers(len(known))]
            doc = by_label[k][rng.integers(len(by_label[k]))]
            take = min(int(rng.integers(4, 25)), words - at, int(lengths[doc]))
            begin = first[doc] + rng.integers(lengths[doc] - take + 1)
            index[i, at : at + take] = np.arange(begin, begin + take)
            target[i, at : at + take] = k
            at += take
    used = np.unique(index)
    pieces_, starts, ends, total = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for doc in np.unique(np.searchsorted(first, used, side="right") - 1):
        data, start, end = parts[doc]
        own = used[np.searchsorted(used, first[doc]) : np.searchsorted(used, first[doc + 1])] - first[doc]
        size = (end[own] - start[own]).astype(np.int64)
        ends.append(total + np.cumsum(size))
        starts.append(ends[-1] - size)
        inside = np.repeat(start[own] - (starts[-1] - total), size) + np.arange(size.sum())
        pieces_.append(data[inside])
        total += int(size.sum())
    start, end = np.concatenate(starts), np.concatenate(ends)
    return Letters(start, end, np.array([0, len(start)]), np.concatenate(pieces_)), np.searchsorted(used, index), target


def train(texts: list[str], langs: list[str], epochs: int = 3, batch: int = 100, rate: float = 0.3) -> Crf | None:
    """A CRF from labelled texts, by adaptive gradient steps on the sequences' likelihood."""
    labels = sorted(set(langs))
    if not labels:
        return None
    size = len(labels)
    rng = np.random.default_rng(7)
    marks = np.array([labels.index(x) for x in langs])
    words, index, target = _sequences(texts, marks, rng)
    weights = np.zeros((KINDS * BUCKETS, size), np.float32)
    start, move = np.zeros(size, np.float32), np.zeros((size, size), np.float32)
    if size == 1 or not len(index):
        return Crf(labels, weights, start, move)
    trigrams, begins, others = features(words)
    ends = np.append(begins[1:], len(trigrams))
    squares = [np.full_like(x, 1e-6) for x in (weights, start, move)]
    steps = index.shape[1]
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(index)), max(1, len(index) // batch)):
            flat = index[pick].ravel()
            count = ends[flat] - begins[flat]
            where = np.repeat(begins[flat] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            fid = np.concatenate([trigrams[where], others[flat].ravel()])
            word = np.concatenate([np.repeat(np.arange(len(flat)), count), np.repeat(np.arange(len(flat)), 3)])
            scores = np.stack(
                [np.bincount(word, weights=weights[fid, k], minlength=len(flat)) for k in range(size)], axis=1
            ).reshape(len(pick), steps, size)
            y = target[pick]
            likely = np.exp(scores - scores.max(axis=2, keepdims=True))
            m = np.exp(move - move.max())
            alpha = np.empty_like(likely)
            a = np.exp(start - start.max()) * likely[:, 0]
            alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
            for t in range(1, steps):
                a = (alpha[:, t - 1] @ m) * likely[:, t] + 1e-30
                alpha[:, t] = a / a.sum(axis=1, keepdims=True)
            grad_move = np.zeros_like(move, dtype=np.float64)
            post = np.empty_like(likely)
            post[:, -1] = alpha[:, -1]
            beta = np.ones((len(pick), size))
            for t in range(steps - 2, -1, -1):
                ahead = likely[:, t + 1] * beta
                pair = alpha[:, t][:, :, None] * m[None] * ahead[:, None, :] + 1e-30
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                grad_move -= pair.sum(axis=0)
                post[:, t] = pair.sum(axis=2)
                beta = ahead @ m.T
                beta /= beta.sum(axis=1, keepdims=True)
            np.add.at(grad_move, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
            gap = np.eye(size)[y] - post
            grad_start = gap[:, 0].sum(axis=0)
            rows = gap.reshape(-1, size)
            grads = np.stack(
                [np.bincount(fid, weights=rows[word, k], minlength=len(weights)) for k in range(size)], axis=1
            )
            for value, grad, square in zip((weights, start, move), (grads, grad_start, grad_move), squares):
                g = (grad / len(pick)).astype(np.float32)
                square += g * g
                value += np.float32(rate) * g / np.sqrt(square)
    return Crf(labels, weights, start, move)


def _least_hashed(distinct: DataFrame, counts: dict[str, int], most: int) -> DataFrame:
    """(lang, h, place): the ``most`` least hashes of each language.

    Only hashes below a bound that lets little more than ``most`` of a language pass are ranked,
    since they meet in one task; should too few pass, the bound is doubled.
    """
    shares = {lang: (most + 10 * most**0.5 + 100) / n for lang, n in counts.items()}
    while True:
        bounds = [(lang, None if share >= 1 else int(share * 2**64) - 2**63) for lang, share in shares.items()]
        frame = distinct.sparkSession.createDataFrame(bounds, "lang string, bound bigint")
        passing = distinct.join(F.broadcast(frame), "lang").where("bound is null or h < bound")
        passed = {r["lang"]: r["n"] for r in passing.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [lang for lang, share in shares.items() if share < 1 and passed.get(lang, 0) < most]
        if not short:
            break
        shares |= {lang: 2 * shares[lang] for lang in short}
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return passing.select("lang", "h", place.alias("place")).where(F.col("place") <= most)


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None,
    docs_per_language: int = DOCS_PER_LANGUAGE, longest: int = LONGEST_SAMPLE, languages: int = MOST_LANGUAGES,
) -> Crf | None:
    """Train on ``docs_per_language`` distinct texts of each language, those of least hash.

    Of more than ``languages`` labels, those with most distinct texts are learned (ties: by name).

    Of a text beyond ``longest`` characters a span of that length serves, placed by the hash, or
    from its first letter on if that one has none.  Texts without letters or without a language
    are not sampled, so the sample that the driver holds is bounded by the three parameters.  None
    without any labelled text.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("text"))
    # Copies fall together before they are ranked, without shuffling any text.
    distinct = staged(rows.select("lang", "h").distinct(), "language-hashes")
    counts = distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    most = counts.orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not most:
        return None
    least = staged(_least_hashed(distinct, {r["lang"]: r["n"] for r in most}, docs_per_language), "language-sample")
    texts = rows.join(F.broadcast(least), ["lang", "h"]).groupBy("lang", "place", "h").agg(F.min("text").alias("text"))
    start = F.pmod("h", F.length("text") - longest + 1) + 1
    span = F.substr("text", start.cast("int"), F.lit(longest))
    lettered = F.substr("text", F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(longest))
    cut = F.when(span.rlike(r"\p{L}"), span).otherwise(lettered)
    texts = texts.withColumn("text", F.when(F.length("text") <= longest, F.col("text")).otherwise(cut))
    sample = texts.select("lang", "place", "text").orderBy("lang", "place").collect()
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


def identify(
    docs: DataFrame, crf: Crf | None, text: str = "text", spans: bool = False
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (mean probability of that language, 0 to 1).

    With ``spans`` also ``lang_spans``: runs of words of one language, as the number of the first
    word (runs of letters count as words), how many, and the language.  Null texts and texts
    without a letter are ``und`` with score 0, as is everything without a model.  Repeated rows
    stay; columns of the given result names are replaced.
    """
    made = ["lang_pred", "score"] + ["lang_spans"] * spans
    docs = docs.drop(*[c for c in made if c != text])
    flag = "_has_letter"
    lettered = docs.withColumn(flag, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    model = docs.sparkSession.sparkContext.broadcast(crf)  # languages x a fixed number of weights
    span_type = T.ArrayType(
        T.StructType(
            [T.StructField("first", T.LongType()), T.StructField("words", T.LongType()), T.StructField("lang", T.StringType())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in pieces(batch.column(text), BATCH_BYTES):
                part = batch.slice(start, stop - start)
                yield _identified(part, part.column(text), part.column(flag), model.value, spans)

    fields = [
        *docs.schema.fields,
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        *([T.StructField("lang_spans", span_type)] if spans else []),
    ]
    return lettered.mapInArrow(run, T.StructType(fields))


def _identified(part: pa.RecordBatch, texts: pa.Array, flags: pa.Array, crf: Crf | None, spans: bool) -> pa.RecordBatch:
    rows = part.num_rows
    names, scores = [UNDETERMINED] * rows, np.zeros(rows)
    runs: list[list[dict]] = [[] for _ in range(rows)]
    if crf is not None:
        found, firsts, total = [], [np.zeros(1, np.int64)], 0
        for a, b in pieces(texts, PIECE_BYTES):
            words = letter_words(texts.slice(a, b - a))
            found.append(emissions(words, crf.weights))
            firsts.append(words.first[1:] + total)
            total += len(words.start)
        first = np.concatenate(firsts)
        every = np.concatenate(found) if found else np.zeros((0, len(crf.labels)), np.float32)
        found.clear()
        post = posteriors(every, first, crf)
        count = np.diff(first)
        some = np.flatnonzero((count > 0) & flags.to_numpy(zero_copy_only=False))
        if len(some):
            sums = np.zeros((rows, post.shape[1]))
            sums[count > 0] = np.add.reduceat(post, first[:-1][count > 0], axis=0, dtype=np.float64)
            mean = sums[some] / count[some][:, None]
            best = mean.argmax(axis=1)
            scores[some] = np.clip(mean[np.arange(len(some)), best], 0.0, 1.0)
            for i, k in zip(some, best):
                names[i] = crf.labels[k]
        if spans:
            word = post.argmax(axis=1)
            for i in some:
                own = word[first[i] : first[i + 1]]
                turn = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
                runs[i] = [
                    {"first": int(x), "words": int(y - x), "lang": crf.labels[own[x]]} for x, y in zip(turn, turn[1:])
                ]
    kept = [n for n in part.schema.names if n != "_has_letter"]
    columns = [*(part.column(n) for n in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
    if spans:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))
        columns.append(pa.array(runs, kind))
    return pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score", *(["lang_spans"] * spans)])
