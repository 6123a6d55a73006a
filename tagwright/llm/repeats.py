"""Removal of repeated word windows by level-wise doubling.

A window of ``length`` words that also starts earlier (in a smaller document, or earlier in its own) is a repeat, and
all words of repeats are removed. Windows are found level by level: 5, 10, 20 words.

1. *Anchors.* Of the five-word windows inside each 20-word window the one with the least hash is kept. Equal 20-word
   windows keep the same one at the same place, so nothing is lost while about one position in nine is looked at.
2. *Doubling.* Only anchors whose five words occur twice or more are extended to ten words, only those that repeat as
   ten to twenty, and so on up to the asked length, until no candidate is left.
3. *First occurrence.* At the last level equal windows of one Arrow batch are combined before the shuffle, so a passage
   with very many copies is no hot key; then all starts but the first of each hash are marked.
4. *Removal.* Marked starts are merged into word ranges per document, which is what meets the texts again.

Hashes have 64 bits. Words are runs of anything but ASCII white space, unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from tagwright.llm import words as W
from tagwright.llm.shared import attach, map_batches
from tagwright.storage import store

BASE = 5
_LAST = 2**63 - 1  # a null document id comes after all others


def _levels(length: int) -> list[int]:
    levels = [length]
    while levels[0] % 2 == 0 and levels[0] // 2 >= BASE:
        levels.insert(0, levels[0] // 2)
    if len(levels) == 1:
        raise ValueError("the length must be an even number of words, 10 or more")
    return levels


def _anchors(words: W.Words, base: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``length`` words: its start, its anchor (leftmost least ``base``-gram) and the anchor's hash."""
    hashes, at = W.grams(words, base)
    none = np.zeros(0, dtype=np.int64)
    if not len(at):
        return none, none, np.zeros(0, dtype=np.uint64)
    full = np.full(len(words.hashes) + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[at] = hashes
    _, starts = W.grams(words, length)
    best, where = full[starts], starts.copy()
    for k in range(1, length - base + 1):
        other = full[starts + k]
        less = other < best
        best, where = np.where(less, other, best), np.where(less, starts + k, where)
    return starts, where, best


def _local(words: W.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc = words.doc[at]
    return doc, at - words.first[doc]


def _rows(ids: pa.Array, low: int, doc: np.ndarray, pos: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [W.longs(hashes), ids.take(pa.array(low + doc)), pa.array(pos.astype(np.int32))], ["hash", "doc", "pos"])


_ROW = "hash bigint, doc bigint, pos int"


def _first_level(docs: DataFrame, base: int, length: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, _, data, offsets in W.groups(batch.column(1)):
            words = W.cut(data, offsets)
            _, anchor, hashes = _anchors(words, base, length)
            fresh = np.ones(len(anchor), dtype=bool)
            fresh[1:] = anchor[1:] != anchor[:-1]
            anchor, hashes = anchor[fresh], hashes[fresh]
            anchor, unique = np.unique(anchor, return_index=True)
            yield _rows(batch.column(0), low, *_local(words, anchor), hashes[unique])

    return map_batches(docs, work, _ROW)


def _next_level(docs: DataFrame, base: int, length: int, level: int) -> DataFrame:
    """Windows of ``level`` words around the surviving ones: rows ``(doc, text, at)`` in, ``(hash, doc, pos)`` out."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, _, doc, pos, hashes in _extended(batch, base, length, level):
            yield _rows(batch.column(0), low, doc, pos, hashes)

    return map_batches(docs, work, _ROW)


def _extended(batch: pa.RecordBatch, base: int, length: int, level: int) -> Iterator[tuple]:
    for low, high, data, offsets in W.groups(batch.column(1)):
        words = W.cut(data, offsets)
        starts, anchor, _ = _anchors(words, base, length)
        alive = np.zeros(len(words.hashes) + 1, dtype=bool)
        for i in range(low, high):
            mine = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.int32) + words.first[i - low]
            alive[mine[mine < words.first[i - low + 1]]] = True
        keep = alive[_window_key(starts, anchor, base, length, level // 2)]
        at = np.unique(_window_key(starts[keep], anchor[keep], base, length, level))
        hashes, every = W.grams(words, level)
        yield low, high, *_local(words, at), hashes[np.searchsorted(every, at)]


def _last_level(docs: DataFrame, base: int, length: int) -> DataFrame:
    """Starts of repeats: rows ``(doc, pos, some)``, one start ``pos`` or 32-bit starts packed in ``some``.

    Equal windows of one Arrow batch are combined before the shuffle: all but the first are repeats already and stay
    in one packed row per document, so a window that occurs everywhere sends one row per batch.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = [(low + doc, pos, hashes) for low, _, doc, pos, hashes in _extended(batch, base, length, length)]
        row, pos, hashes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64))
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((pos, doc[row], hashes))
        row, pos, hashes = row[order], pos[order], hashes[order]
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        own = (doc[row] == doc[row[lead]]) & (pos == pos[lead])  # the same place, in a row that repeats
        yield pa.RecordBatch.from_arrays(
            [W.longs(hashes[fresh]), pa.array(doc[row[fresh]]), pa.array(pos[fresh].astype(np.int32)),
             pa.nulls(int(fresh.sum()), pa.binary())], ["hash", "doc", "pos", "some"])
        late = ~fresh & ~own
        r, p = row[late], pos[late].astype(np.int32)
        order = np.argsort(r, kind="stable")
        r, p = r[order], p[order]
        rows, first = np.unique(r, return_index=True)
        packed = [x.tobytes() for x in np.split(p, first[1:])] if len(rows) else []
        yield pa.RecordBatch.from_arrays(
            [W.longs(W.mix(doc[rows].astype(np.uint64))), pa.array(doc[rows]), pa.array(np.full(len(rows), -1, dtype=np.int32)),
             pa.array(packed, pa.binary())], ["hash", "doc", "pos", "some"])

    rows = map_batches(docs, work, _ROW + ", some binary")
    place = F.struct("doc", "pos")
    first = F.first(F.when(F.col("some").isNull(), place), ignorenulls=True).over(
        Win.partitionBy("hash").orderBy(F.col("some").isNotNull(), "doc", "pos"))
    return rows.withColumn("first", first).where(F.col("some").isNotNull() | (place != F.col("first"))).select("doc", "pos", "some")


def _window_key(starts: np.ndarray, anchor: np.ndarray, base: int, length: int, level: int) -> np.ndarray:
    """Start of the ``level``-word window that stands for each ``length``-word window.

    It begins with the anchor, or ends with it where it would otherwise reach beyond the longer window.
    """
    if level == length:
        return starts
    return np.where(anchor + level <= starts + length, anchor, anchor + base - level)


def _per_doc(rows: DataFrame, name: str) -> DataFrame:
    """Positions of each document, ascending, as one binary value of 32-bit integers."""
    lists = rows.groupBy("doc").agg(F.sort_array(F.collect_list("pos")).alias("pos"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        packed = [np.asarray(x.values, dtype=np.int32).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc", "at"])

    return store(map_batches(lists, work, "doc bigint, at binary"), name)


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows whose hash occurs at two places or more."""
    some = rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    return attach(rows, store(some, "repeats-hashes"), ["hash"], "left_semi")


def repeated_ranges(docs: DataFrame, length: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Word ranges to remove per document: ``doc`` and ``at``, 32-bit pairs of first word and end, merged and ascending."""
    named = docs.select(F.coalesce(key, F.lit(_LAST)).alias("doc"), F.col(text).alias("text"))
    levels = _levels(length)
    rows = store(_first_level(named, levels[0], length), "repeats-anchors")
    for level in levels[1:]:
        alive = _per_doc(_repeated(rows), "repeats-alive")
        work = attach(named, alive, ["doc"], "inner").select("doc", "text", "at")
        if level < length:
            rows = store(_next_level(work, levels[0], length, level), "repeats-windows")
    late = _last_level(work, levels[0], length)
    marked = late.groupBy("doc").agg(F.collect_list("pos").alias("pos"), F.collect_list("some").alias("some"))

    def merge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for x, some in zip(batch.column(1), batch.column(2)):
            p = np.frombuffer(b"".join(some.as_py()), dtype=np.int32)
            p = np.unique(np.concatenate([np.asarray(x.values, dtype=np.int32), p]))
            p = p[p >= 0]
            gap = np.flatnonzero(p[1:] - p[:-1] > length) + 1
            low, high = p[np.r_[0, gap]], p[np.r_[gap - 1, len(p) - 1]] + length
            out.append(np.column_stack([low, high]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc", "at"])

    return store(map_batches(marked, merge, "doc bigint, at binary"), "repeats-ranges")


def drop_repeats(docs: DataFrame, length: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_removed`` and ``kept``, the words that stay joined by one space, one row per input row.

    A null text has no words and an empty ``kept``. A null key counts as the largest document id. Rows that share their
    key count as one document place: a window at the same start of both is no repeat of itself. Texts of any length are
    looked at whole; an empty table gives no rows. Columns beside key and text are not looked at.
    """
    ranges = repeated_ranges(docs, length, key, text)
    named = docs.select(F.col(key).alias("key"), F.coalesce(key, F.lit(_LAST)).alias("doc"), F.col(text).alias("text"))
    work = attach(named, ranges, ["doc"], "left").select("key", "text", "at")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        totals, gone, kept = [], [], []
        for text, at in zip(batch.column(1), batch.column(2)):
            found = (text.as_py() or "").encode().split()
            totals.append(len(found))
            keep = found
            if at.is_valid:
                keep, last = [], 0
                for low, high in np.frombuffer(at.as_buffer(), dtype=np.int32).reshape(-1, 2).tolist():
                    keep += found[last:low]
                    last = min(high, len(found))
                keep += found[last:]
            gone.append(len(found) - len(keep))
            kept.append(b" ".join(keep).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            ["key", "n_words", "n_removed", "kept"])

    out = map_batches(work, cut, "key bigint, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("key", key)
