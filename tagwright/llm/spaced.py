"""Benchmark decontamination with spaced seeds.

Texts are cut into words (runs of letters and digits, A-Z lower-cased). A seed is a fixed mask over some words of
which only some positions count, so the hash of a stretch of text does not change when an ignored word is substituted.
Every mask is hashed at every position of benchmark items and documents; equal hashes are hits. At a hit item and
document are laid over each other and compared word by word along the whole item. The overlap is the longest stretch of
which at least ``min_equal`` percent of the words are equal; it counts as contamination when it holds at least
``min_words`` words, or the whole item where that is shorter.

No such stretch goes without a hit. One of twice ``min_words`` words or more can be halved, and one half has no larger
share of substitutions than the whole; so it is enough that every placement of the allowed substitutions in
``min_words`` to ``2 * min_words - 1`` words leaves a mask untouched. ``MASKS`` do that for 13 words and 80 percent
(found by set cover over all placements, and tested on all of them). For weaker limits, and for items shorter than
``min_words``, the mask is a run of as many words as any placement must leave in one piece; documents are cut into such
short runs only when the benchmark has such items.

The hashes of the benchmark are brought to the documents when their measured size is at most ``FILTER_BYTES``, so the
documents are not shuffled. Beyond that the hashes of both sides meet in a join, in which a hash that most documents
hold is split by the adaptive skew join; the verification is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm import words as W
from tagwright.llm.shared import attach, map_batches
from tagwright.operators.lookup import measured_bytes
from tagwright.storage import store

MASKS = ("1111011", "110100010011", "110101011", "1110111")  # 1: the word counts
MIN_WORDS = 13
MIN_EQUAL = 80
FILTER_BYTES = 64 * 2**20
_KEY_BITS = 20
_HITS = 2**21  # pairs of a seed's place and an item held at once


def _run(words: int, min_equal: int) -> str:
    """A mask of the longest run of equal words that ``words`` words with the allowed substitutions must hold."""
    other = words * (100 - min_equal) // 100
    return "1" * max(1, -(-(words - other) // (other + 1)))


def masks_for(words: int, min_words: int, min_equal: int) -> tuple[str, ...]:
    """Masks that together hit every overlap with an item of so many words."""
    if words < min_words:
        return (_run(words, min_equal),)
    if min_words >= MIN_WORDS and min_equal >= MIN_EQUAL:
        return MASKS
    return (min((_run(n, min_equal) for n in range(min_words, 2 * min_words)), key=len),)


def _seeds(words: W.Words, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes at all positions where a mask fits inside one text, and the positions."""
    total = len(words.hashes)
    last = np.repeat(words.first[1:], words.counts)
    hashes, places = [], []
    for mask in masks:
        on = [i for i, c in enumerate(mask) if c == "1"]
        n = total - on[-1]
        if n <= 0:
            continue
        h = np.full(n, int(mask, 2), dtype=np.uint64)
        for i in on:
            h = (h ^ words.hashes[i:i + n]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        at = np.flatnonzero(np.arange(n) + on[-1] < last[:n])
        hashes.append(W.mix(h[at]))
        places.append(at)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def _word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, W.Words]]:
    for low, high, data, offsets in W.groups(texts):
        yield low, high, W.cut(data, offsets, W.LETTERS, fold=True)


def _items(benchmark: DataFrame) -> DataFrame:
    """Items as the hashes of their words: ``item_id``, ``words`` (binary of 64-bit hashes)."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high, w in _word_hashes(batch.column(1)):
            packed = [w.hashes[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.array(packed, pa.binary())], ["item_id", "words"])

    return map_batches(benchmark, work, "item_id bigint, words binary")


def _item_seeds(items: DataFrame, min_words: int, min_equal: int) -> DataFrame:
    """Rows ``(hash, item_id, item_pos)``."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, packed in zip(batch.column(0), batch.column(1)):
            h = np.frombuffer(packed.as_buffer(), dtype=np.uint64)
            w = W.Words(h, h, h, np.array([0, len(h)]), h)
            hashes, at = _seeds(w, masks_for(len(h), min_words, min_equal))
            yield pa.RecordBatch.from_arrays(
                [W.longs(hashes), pa.array([i.as_py()] * len(at), pa.int64()), pa.array(at.astype(np.int32))],
                ["hash", "item_id", "item_pos"])

    return map_batches(items, work, "hash bigint, item_id bigint, item_pos int").distinct()


class _Index:
    """Sorted seed hashes of the benchmark with the item and place of each; a bit table answers most look-ups."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray, places: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items, self.places = hashes[order], items[order], places[order]
        self.some = np.zeros(2**_KEY_BITS, dtype=bool)
        self.some[(self.hashes >> np.uint64(64 - _KEY_BITS)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index into ``hashes``, index into the table) of equal hashes, for some documents at a time.

        ``doc`` is the document of each hash. A seed that many items share makes many pairs; no more than ``_HITS`` are
        held at once, or those of one document.
        """
        maybe = np.flatnonzero(self.some[(hashes >> np.uint64(64 - _KEY_BITS)).astype(np.int64)])
        maybe = maybe[np.argsort(doc[maybe], kind="stable")]
        low = np.searchsorted(self.hashes, hashes[maybe], "left")
        n = np.searchsorted(self.hashes, hashes[maybe], "right") - low
        maybe, low, n = maybe[n > 0], low[n > 0], n[n > 0]
        if not len(maybe):
            return
        first = np.flatnonzero(np.diff(doc[maybe], prepend=-1))  # where the documents begin
        part = (np.cumsum(n) - n)[first] // _HITS
        cuts = np.append(first[np.flatnonzero(np.diff(part, prepend=-1))], len(maybe))
        for a, b in zip(cuts[:-1], cuts[1:]):
            where = np.repeat(maybe[a:b], n[a:b])
            inside = np.arange(len(where)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
            yield where, np.repeat(low[a:b], n[a:b]) + inside


def longest_overlap(doc: np.ndarray, item: np.ndarray, shift: int, min_equal: int) -> tuple[int, int, int]:
    """Longest stretch with ``min_equal`` percent equal words at ``shift`` (the most equal, then the first, of such):
    first item word, end, equal words."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high <= low:
        return 0, 0, 0
    same = doc[low + shift:high + shift] == item[low:high]
    sums = np.concatenate([[0], np.cumsum(np.where(same, 100 - min_equal, -min_equal))])
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums)  # the first place with no larger sum
    lengths = np.arange(len(sums)) - starts
    equal = np.concatenate([[0], np.cumsum(same)])
    ends = np.flatnonzero(lengths == lengths.max())
    end = int(ends[np.argmax(equal[ends] - equal[starts[ends]])])
    start = int(starts[end])
    return low + start, low + end, int(equal[end] - equal[start])


_FOUND = "doc_id bigint, item_id bigint, doc_start int, item_start int, n_words int, n_equal int"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _best(doc_words: np.ndarray, item_words: np.ndarray, shifts: list[int], min_words: int, min_equal: int):
    best = None
    for shift in shifts:
        start, end, same = longest_overlap(doc_words, item_words, shift, min_equal)
        if same and end - start >= min(min_words, len(item_words)):
            row = (start + shift, start, end - start, same)
            if best is None or (row[3], -row[0]) > (best[3], -best[0]):
                best = row
    return best


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, min_equal: int = MIN_EQUAL,
    key: str = "doc_id", text: str = "text", filter_bytes: int | None = None,
) -> DataFrame:
    """One row per document and benchmark item that overlap, with the largest overlap (words, counted from 0).

    Null and empty texts overlap with nothing. An item shorter than ``min_words`` must be met as a whole. Texts of any
    length are looked at whole. Equal items give a row each; repeated items or documents with the same id one row, and so do
    those with a null id, which count as one. Empty tables give no rows. Other columns are not looked at.
    """
    bench = benchmark.select(F.col("item_id").cast("bigint"), F.col("text"))
    items = store(_items(bench).dropDuplicates(), "spaced-items")
    seeds = store(_item_seeds(items, min_words, min_equal), "spaced-seeds")
    lengths = items.select(F.least(F.expr("length(words) div 8"), F.lit(min_words)).alias("n")).distinct()  # min_words at most
    masks = tuple(sorted({m for r in lengths.collect() if r.n for m in masks_for(r.n, min_words, min_equal)}))
    named = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    limit = FILTER_BYTES if filter_bytes is None else filter_bytes
    if measured_bytes(seeds) + measured_bytes(items) <= limit:
        found = _filtered(named, seeds, items, masks, min_words, min_equal)
    else:
        found = _joined(named, seeds, items, masks, min_words, min_equal)
    order = F.struct("n_equal", (-F.col("doc_start")).alias("from_end"), "item_start", "n_words")
    best = found.groupBy("doc_id", "item_id").agg(F.max(order).alias("b"))
    return best.select(F.col("doc_id").alias(key), "item_id", (-F.col("b.from_end")).alias("doc_start"), "b.item_start",
                       "b.n_words", "b.n_equal")


def _filtered(
    docs: DataFrame, seeds: DataFrame, items: DataFrame, masks: tuple[str, ...], min_words: int, min_equal: int
) -> DataFrame:
    got = seeds.select("hash", "item_id", "item_pos").toArrow()  # measured: within the limit
    column = lambda n: got.column(n).to_numpy()
    held = items.toArrow()
    texts: dict[int, list[bytes]] = {}
    for i, packed in zip(held.column(0).to_pylist(), held.column(1).to_pylist()):
        texts.setdefault(i, []).append(packed)
    shared = docs.sparkSession.sparkContext.broadcast(
        (column("hash").view(np.uint64), column("item_id"), column("item_pos"), texts))

    def each(batches):
        hashes, ids, places, packed = shared.value
        index = _Index(hashes, ids, places)
        words = {i: [np.frombuffer(p, dtype=np.uint64) for p in ps] for i, ps in packed.items()}
        for batch in batches:
            rows = []
            for low, _, w in _word_hashes(batch.column(1)):
                seed, at = _seeds(w, masks)
                for where, entry in index.hits(seed, w.doc[at]):
                    doc = w.doc[at[where]]
                    shift = at[where] - w.first[doc] - index.places[entry]
                    every = np.unique(np.column_stack([doc, index.items[entry], shift]), axis=0)
                    pairs: dict[tuple[int, int], list[int]] = {}
                    for d, i, s in every.tolist():
                        pairs.setdefault((d, i), []).append(s)
                    for (d, i), shifts in pairs.items():
                        mine = w.hashes[w.first[d]:w.first[d + 1]]
                        for item in words[i]:
                            best = _best(mine, item, shifts, min_words, min_equal)
                            if best:
                                rows.append((batch.column(0)[low + d].as_py(), i, *best))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(zip(*rows))], _NAMES)

    return docs.mapInArrow(each, _FOUND)


def _joined(
    docs: DataFrame, seeds: DataFrame, items: DataFrame, masks: tuple[str, ...], min_words: int, min_equal: int
) -> DataFrame:
    """The same without a filter on the driver: seeds meet in a join, then texts, items and shifts of each pair."""
    ids = docs.withColumn("row", F.xxhash64("doc_id", "text"))

    def seed_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, _, w in _word_hashes(batch.column(1)):
            seed, at = _seeds(w, masks)
            doc = w.doc[at]
            yield pa.RecordBatch.from_arrays(
                [W.longs(seed), batch.column(2).take(pa.array(low + doc)), pa.array((at - w.first[doc]).astype(np.int32))],
                ["hash", "row", "pos"])

    rows = map_batches(ids.select("doc_id", "text", "row"), seed_rows, "hash bigint, row bigint, pos int")
    rows = store(rows, "spaced-rows")
    known = store(seeds.select("hash").distinct(), "spaced-known")
    rows = store(attach(rows, known, ["hash"], "left_semi"), "spaced-met")
    # one row per place and item: a seed that many items share is split by the adaptive skew join, no list of them is held
    met = rows.join(seeds.hint("merge"), "hash").select("row", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"))
    pairs = store(met.distinct().groupBy("row", "item_id").agg(F.collect_list("shift").alias("shifts")), "spaced-pairs")
    some = store(pairs.select("row").distinct(), "spaced-some")
    texts = store(attach(ids, some, ["row"], "left_semi"), "spaced-texts")
    hashed = map_batches(texts.select("row", "text"), _packed_words, "row bigint, doc_words binary").distinct()
    whole = pairs.join(hashed, "row").join(items, "item_id").join(texts.select("row", "doc_id").distinct(), "row")

    def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for d, i, shifts, mine, item in zip(*[batch.column(k) for k in range(5)]):
            best = _best(np.frombuffer(mine.as_buffer(), dtype=np.uint64), np.frombuffer(item.as_buffer(), dtype=np.uint64),
                         sorted(shifts.as_py()), min_words, min_equal)
            if best:
                rows.append((d.as_py(), i.as_py(), *best))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(zip(*rows))], _NAMES)

    return map_batches(whole.select("doc_id", "item_id", "shifts", "doc_words", "words"), verify, _FOUND)


def _packed_words(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for low, high, w in _word_hashes(batch.column(1)):
        packed = [w.hashes[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).slice(low, high - low), pa.array(packed, pa.binary())], ["row", "doc_words"])
