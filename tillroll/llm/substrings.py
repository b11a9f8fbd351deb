"""Substring dedup: words covered by windows that occur elsewhere are removed.

Every window of ``size`` consecutive words is named by its least run of ``GRAM`` words, so equal
windows have equal names at equal places and a window occurs no more often than its name.  First
pass: each partition counts names in a sparse count-min sketch; the merged sketch overestimates
every count.  Second pass: only windows whose name was estimated to repeat are grouped exactly, by
96-bit hashes of all their words.  Nothing that repeats is lost: a fuller sketch only lets more
windows through to the exact grouping.

Rows are staged with the number of a chunk of bounded size.  Chunks send each window hash once
with its count, so a passage of countless copies is one entry per chunk; chunks get back the
hashes that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.words import WORD_BASES, Words, buffers, mix, pieces, range_hashes, words_of
from tillroll.sources.staging import staged

WINDOW = 35
GRAM = 12
DEPTH = 2
CHUNK_BYTES = 2 << 20
SEGMENT_BITS = 22  # counters of a segment of the sketch, as a power of two
LARGEST_SKETCH_BITS = 28  # counters of a row of the sketch at most: 32 MB a row as bits
ROOM = 8  # counters per name aimed at
SHARE_BITS = 18  # window hashes that one segment of the exact grouping is meant for


def windows_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, place of the first word of its least gram).

    Windows do not cross texts.  Of equal grams the first counts; a place depends on the words of
    the window alone.
    """
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = min(GRAM, size)
    count = size - gram + 1
    names = range_hashes(words.hashes, np.arange(n - gram + 1), np.arange(gram, n + 1), WORD_BASES[1])
    # The least of each run of `count` names, by doubling; ties to the first.
    best = np.arange(len(names))
    width = 1
    while width < count:
        step = min(width, count - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(names[right] < names[left], right, left)
        width += step
    start = np.flatnonzero(words.row[: n - size + 1] == words.row[size - 1 :])
    return start, best[start]


def gram_names(words: Words, places: np.ndarray, size: int) -> np.ndarray:
    gram = min(GRAM, size)
    return range_hashes(words.hashes, places, places + gram, WORD_BASES[1])


def window_keys(words: Words, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and an independent 32-bit hash of all words of each window."""
    a = range_hashes(words.hashes, start, start + size, WORD_BASES[0])
    b = range_hashes(mix(words.hashes), start, start + size, WORD_BASES[1])
    return a, (b >> np.uint64(32)).astype(np.uint32)


def _numbered(docs: DataFrame, text: str, column: str) -> DataFrame:
    """Rows with the number of a run of rows of about ``CHUNK_BYTES`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, filled = context.partitionId() << 40, 0
        for batch in batches:
            sizes = np.diff(buffers(batch.column(text))[0])
            marks = np.empty(batch.num_rows, dtype=np.int64)
            for i, size in enumerate(sizes.tolist()):
                if filled and filled + size > CHUNK_BYTES:
                    number, filled = number + 1, 0
                filled += size + 64
                marks[i] = number
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks)], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


def counters(names: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(names + np.uint64(row * 0x9E37)) >> np.uint64(64 - bits)).astype(np.int64)


def _sparse_sketches(rows: DataFrame, text: str, size: int, bits: int, segment_bits: int) -> DataFrame:
    """(depth, segment, counters, twice): each partition's sketch, cut into segments.

    ``counters`` are the segment's counters that are not 0, as ascending 32-bit numbers;
    ``twice`` are those that are above 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            for a, b in pieces(batch.column(text)):
                words = words_of(batch.column(text).slice(a, b - a))
                places = np.unique(windows_of(words, size)[1])
                found.append(gram_names(words, places, size))
        names, copies = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64),) * 2
        for d in range(DEPTH):
            at = counters(names, d, bits)
            order = np.argsort(at, kind="stable")
            at, many = at[order], (copies[order] > 1)
            first = np.flatnonzero(np.diff(at, prepend=-1))
            total = np.add.reduceat(many.astype(np.int64), first) if len(first) else first
            length = np.diff(np.append(first, len(at)))
            unique, above = at[first], (total > 0) | (length > 1)
            segment = unique >> segment_bits
            cut = np.flatnonzero(np.diff(segment, prepend=-1))
            for i, j in zip(cut, np.append(cut[1:], len(unique))):
                low = (unique[i:j] & ((1 << segment_bits) - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d], pa.int32()),
                        pa.array([int(segment[i])], pa.int64()),
                        pa.array([np.diff(low, prepend=np.uint32(0)).astype(np.uint32).tobytes()], pa.binary()),
                        pa.array([low[above[i:j]].tobytes()], pa.binary()),
                    ],
                    names=["depth", "segment", "counters", "twice"],
                )

    return rows.select(text).mapInArrow(run, "depth int, segment bigint, counters binary, twice binary")


def _merged(sketches: DataFrame, segment_bits: int) -> DataFrame:
    """(depth, segment, repeated): bits of the counters whose sum over partitions is above 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0]], pa.int32()),
                    pa.array([key[1]], pa.int64()),
                    pa.array([np.packbits(held > 1).tobytes()], pa.binary()),
                ],
                names=["depth", "segment", "repeated"],
            )

        for batch in batches:
            for d, s, some, twice in zip(*(batch.column(c) for c in ("depth", "segment", "counters", "twice"))):
                if key != (d.as_py(), s.as_py()):
                    if key is not None:
                        yield done()
                    key, held = (d.as_py(), s.as_py()), np.zeros(1 << segment_bits, np.uint8)
                low = np.cumsum(np.frombuffer(some.as_py(), np.uint32), dtype=np.uint32)
                held[low] = np.minimum(held[low] + 1, 2)
                held[np.frombuffer(twice.as_py(), np.uint32)] = 2
        if key is not None:
            yield done()

    dealt = sketches.repartition("depth", "segment").sortWithinPartitions("depth", "segment")
    return dealt.mapInArrow(run, "depth int, segment bigint, repeated binary")


def _sketch(rows: DataFrame, text: str, size: int, bits: int) -> Broadcast:
    """Bits of the merged sketch: at most ``DEPTH`` rows of ``2 ** LARGEST_SKETCH_BITS`` bits."""
    segment_bits = min(bits, SEGMENT_BITS)
    merged = _merged(_sparse_sketches(rows, text, size, bits, segment_bits), segment_bits)
    table = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
    width = (1 << segment_bits) // 8
    for r in merged.toLocalIterator():
        table[r["depth"], r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["repeated"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(table)


def maybe_repeated(names: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(names), dtype=bool)
    for d in range(len(sketch)):
        at = counters(names, d, bits)
        out &= (sketch[d][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def _candidates(rows: DataFrame, text: str, chunk: str, size: int, sketch: Broadcast, bits: int, shares: int) -> DataFrame:
    """(chunk, share, keys, more): distinct window hashes of a chunk that may repeat.

    ``keys`` are 12 bytes each; ``more`` has a bit for those that the chunk holds twice or more.
    """

    def emit(number: int, keys: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        a = np.concatenate([k[0] for k in keys]) if keys else np.zeros(0, np.uint64)
        if not len(a):
            return
        both = np.empty(len(a), dtype=[("a", "<u8"), ("b", "<u4")])
        both["a"], both["b"] = a, np.concatenate([k[1] for k in keys])
        order = np.lexsort((both["b"], both["a"]))
        both = both[order]
        first = np.ones(len(both), dtype=bool)
        first[1:] = (both["a"][1:] != both["a"][:-1]) | (both["b"][1:] != both["b"][:-1])
        at = np.flatnonzero(first)
        more = np.diff(np.append(at, len(both))) > 1
        both = both[at]
        share = ((both["a"] >> np.uint64(32)) * np.uint64(shares)) >> np.uint64(32)
        cut = np.flatnonzero(np.diff(share.astype(np.int64), prepend=-1))
        ends = np.append(cut[1:], len(both))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number] * len(cut), pa.int64()),
                pa.array(share[cut].astype(np.int64)),
                pa.array([both[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()),
                pa.array([np.packbits(more[i:j]).tobytes() for i, j in zip(cut, ends)], pa.binary()),
            ],
            names=["chunk", "share", "keys", "more"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys = None, []
        for batch in batches:
            marks = batch.column(chunk).to_numpy()
            texts = batch.column(text)
            cuts = np.append(np.flatnonzero(np.diff(marks, prepend=-1)), len(marks))
            for i, j in zip(cuts, cuts[1:]):
                if number is not None and marks[i] != number:
                    yield from emit(number, keys)
                    keys = []
                number = int(marks[i])
                for p, q in pieces(texts.slice(i, j - i)):
                    words = words_of(texts.slice(i + p, q - p))
                    start, places = windows_of(words, size)
                    there, back = np.unique(places, return_inverse=True)
                    hit = maybe_repeated(gram_names(words, there, size), sketch.value, bits)[back]
                    keys.append(window_keys(words, start[hit], size))
        if number is not None:
            yield from emit(number, keys)

    return rows.select(chunk, text).mapInArrow(run, "chunk bigint, share bigint, keys binary, more binary")


def _repeated(candidates: DataFrame) -> DataFrame:
    """(chunk, keys): the window hashes of a chunk that occur twice or more over all chunks."""
    pair = np.dtype([("a", "<u8"), ("b", "<u4")])

    def resolve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [np.frombuffer(k.as_py(), pair) for k in table.column("keys")]
        more = [np.unpackbits(np.frombuffer(m.as_py(), np.uint8))[: len(k)] for m, k in zip(table.column("more"), keys)]
        every, many = np.concatenate(keys), np.concatenate(more).astype(bool)
        order = np.lexsort((every["b"], every["a"]))
        a, b = every["a"][order], every["b"][order]
        first = np.ones(len(a), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, len(a)))
        twice = (length > 1) | (np.add.reduceat(many[order].astype(np.int64), at) > 0)
        hit = np.zeros(len(a), dtype=bool)
        hit[order] = np.repeat(twice, length)
        chunks, out, done = [], [], 0
        for number, own in zip(table.column("chunk").to_pylist(), keys):
            mine = own[hit[done : done + len(own)]]
            done += len(own)
            if len(mine):
                chunks.append(number)
                out.append(mine.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(out, pa.binary())], names=["chunk", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            marks = batch.column("share").to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(marks, prepend=-1)), len(marks))
            for i, j in zip(cuts, cuts[1:]):
                if held and held[0].column("share")[0].as_py() != marks[i]:
                    yield from resolve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield from resolve(pa.Table.from_batches(held))

    dealt = candidates.repartition("share").sortWithinPartitions("share")
    return dealt.mapInArrow(run, "chunk bigint, keys binary")


def covered(words: Words, start: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window that starts at one of ``start``."""
    turn = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(turn, start, 1)
    np.add.at(turn, start + size, -1)
    return np.cumsum(turn[:-1]) > 0


def _removed(rows: DataFrame, keys: DataFrame, text: str, chunk: str, size: int, made: tuple[str, ...]) -> DataFrame:
    """Rows with their repeated words taken out; one group is one chunk and its hashes."""
    pair = np.dtype([("a", "<u8"), ("b", "<u4")])
    columns = [c for c in rows.columns if c != chunk]
    fields = [*(rows.schema[c] for c in columns)]
    schema = T.StructType(
        [*fields, T.StructField(made[0], T.LongType()), T.StructField(made[1], T.LongType()), T.StructField(made[2], T.StringType())]
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(k.as_py(), pair) for k in right.column("keys")]
        known = np.concatenate(hashes) if hashes else np.zeros(0, pair)
        known = known[np.argsort(known["a"], kind="stable")]
        out = []
        for batch in left.combine_chunks().to_batches():
            for i, j in pieces(batch.column(text)):
                part = batch.slice(i, j - i)
                words = words_of(part.column(text))
                gone = np.zeros(len(words.hashes), dtype=bool)
                if len(known):
                    start, _ = windows_of(words, size)
                    a, b = window_keys(words, start, size)
                    low = np.searchsorted(known["a"], a, side="left")
                    hit = np.zeros(len(a), dtype=bool)
                    for step in range(_longest_run(known["a"])):
                        at = np.minimum(low + step, len(known) - 1)
                        hit |= (known["a"][at] == a) & (known["b"][at] == b)
                    gone = covered(words, start[hit], size)
                out.append(_kept(part, columns, words, gone, text, made))
        return pa.Table.from_batches(out) if out else schema_table(schema)

    grouped = rows.groupBy(chunk).cogroup(keys.groupBy("chunk"))
    return grouped.applyInArrow(run, schema)


def schema_table(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def _longest_run(values: np.ndarray) -> int:
    first = np.flatnonzero(np.diff(values, prepend=values[0] ^ np.uint64(1)) != 0)
    return int(np.diff(np.append(first, len(values))).max()) if len(values) else 0


def _kept(part: pa.RecordBatch, columns: list[str], words: Words, gone: np.ndarray, text: str, made) -> pa.RecordBatch:
    counts = np.diff(words.first)
    sums = np.concatenate([[0], np.cumsum(gone)])
    removed = sums[words.first[1:]] - sums[words.first[:-1]]
    texts = part.column(text)
    kept = []
    for i in range(part.num_rows):
        body = (texts[i].as_py() or "").encode().split()
        if removed[i]:
            mask = gone[words.first[i] : words.first[i + 1]]
            body = [w for w, g in zip(body, mask.tolist()) if not g]
        kept.append(b" ".join(body).decode())
    return pa.RecordBatch.from_arrays(
        [*(part.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
        names=[*columns, *made],
    )


def remove_repeats(
    docs: DataFrame, text: str = "text", size: int = WINDOW, sketch_bits: int | None = None
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words, one space between).

    A word goes if a window of ``size`` words that covers it starts anywhere else too, in the same
    text or another.  Null and empty texts, and texts shorter than a window, lose nothing; null
    texts keep an empty text.  Repeated rows count as separate texts.  Columns of the given
    result names are replaced.  ``sketch_bits`` sets the size of the sketch (default: by the
    number of words, up to ``LARGEST_SKETCH_BITS``); it changes work, not results.
    """
    made, chunk = ("n_words", "n_removed", "kept_text"), "_chunk"
    docs = docs.drop(*[c for c in made if c != text])
    rows = staged(_numbered(docs, text, chunk), "chunks")
    octets = rows.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    expected = max(1, octets // 6 // 8)  # about a name every eight words of six bytes
    if sketch_bits is None:
        sketch_bits = min(LARGEST_SKETCH_BITS, max(16, int(expected * ROOM - 1).bit_length()))
    sketch = _sketch(rows, text, size, sketch_bits)
    shares = max(1, (octets // 6) >> SHARE_BITS)
    keys = _repeated(_candidates(rows, text, chunk, size, sketch, sketch_bits, shares))
    return _removed(rows, keys, text, chunk, size, made)
