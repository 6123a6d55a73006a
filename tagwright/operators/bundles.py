"""Lossless bundles: sparse columns that never meet in a row share one dense column.

Columns that meet in some row are neighbours in a conflict graph; a proper colouring of it gives the bundles. The graph is
never built (it has up to columns**2 edges): each round is two passes over the rows with the colours broadcast. The
first finds the columns that share a colour with a column they meet, of which the one that comes first in the order
(most frequent first) stays. The second collects, for those that have to move, the colours of the columns they meet,
one bit each. Both results are sets, so the colouring is the same however the rows are partitioned.

Inside a bundle every column has a stretch of its own: the ``p``-th holds the values ``(p - 1, p]``, so value and column
can be read back. Columns stand in the order of a given score; with the mean label of their rows as score one threshold
parts the columns of cheap rows from those of dear ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.operators.lookup import lookup_join
from tagwright.storage import store

MAX_COLUMNS = 2**22  # columns that can be bundled: the colours (16 MiB) are broadcast, all else is smaller or a table
_MASK_BYTES = 64 * 2**20  # colours met by moving columns, per task; more columns move in several passes


@dataclass
class Bundles:
    """Stored ``(feature, bundle, place, top)``: bundle and place of every column, and its largest value; number of bundles."""

    table: DataFrame
    count: int


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers of all entries of a batch, and the row of each."""
    lists = batch.column(0)
    lengths = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), lengths)


def _losers(rows: DataFrame, colour: np.ndarray, fixed: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Columns that meet another of their colour which is fixed or comes before them."""
    held = rows.sparkSession.sparkContext.broadcast((colour, fixed, rank))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        colour, fixed, rank = held.value
        lost = np.zeros(len(colour), dtype=bool)
        for batch in batches:
            at, row = _flat(batch)
            order = np.lexsort((np.where(fixed[at], -1, rank[at]), colour[at], row))
            at, row = at[order], row[order]
            behind = (row[1:] == row[:-1]) & (colour[at[1:]] == colour[at[:-1]]) & (at[1:] != at[:-1])
            lost[at[1:][behind]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(lost))], ["feature"])

    try:
        found = rows.mapInArrow(each, "feature bigint").distinct().toArrow()  # at most one number per column
        return np.sort(found.column("feature").to_numpy())
    finally:
        held.unpersist()


def _taken(rows: DataFrame, moving: np.ndarray, colour: np.ndarray, fixed: np.ndarray, colours: int) -> np.ndarray:
    """For each moving column a row of flags: which colours are those of fixed columns it meets."""
    held = rows.sparkSession.sparkContext.broadcast((moving, colour, fixed))
    width = -(-colours // 8)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moving, colour, fixed = held.value
        masks = np.zeros((len(moving), width), dtype=np.uint8)
        slot = np.full(len(colour), -1, dtype=np.int64)
        slot[moving] = np.arange(len(moving))
        for batch in batches:
            at, row = _flat(batch)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for low, high in zip(ends[:-1], ends[1:]):
                mine = at[low:high]
                mine_slots = slot[mine]
                mine_slots = mine_slots[mine_slots >= 0]
                if len(mine_slots):
                    flags = np.zeros(8 * width, dtype=np.uint8)
                    flags[colour[mine[fixed[mine]]]] = 1
                    masks[mine_slots] |= np.packbits(flags)
        some = np.flatnonzero(masks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([masks[i].tobytes() for i in some], pa.binary())], ["slot", "mask"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                masks[i] = masks.get(i, np.uint8(0)) | np.frombuffer(m.as_buffer(), dtype=np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(masks), pa.int64()), pa.array([m.tobytes() for m in masks.values()], pa.binary())], ["slot", "mask"])

    schema = "slot bigint, mask binary"
    try:
        found = rows.mapInArrow(each, schema).repartition("slot").mapInArrow(either, schema).toArrow()
    finally:
        held.unpersist()
    out = np.zeros((len(moving), width), dtype=np.uint8)
    for i, m in zip(found.column("slot").to_pylist(), found.column("mask")):
        out[i] = np.frombuffer(m.as_buffer(), dtype=np.uint8)
    return np.unpackbits(out, axis=1)[:, :colours].astype(bool)


def colour_columns(rows: DataFrame, size: int, rank: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """A colour for each column ``0..size - 1`` so that no two columns of a colour meet in a row of ``entries``.

    ``rank`` orders the columns, those that come first keep their colour. Columns of a ``group`` from 0 start in one
    colour of their own, which suits blocks of codes; those of group -1 start spread over as many colours as the longest
    row has entries, the least that can do.
    """
    if size > MAX_COLUMNS:
        raise ValueError(f"{size} columns; at most {MAX_COLUMNS} can be bundled")
    group = np.full(size, -1) if group is None else group
    features = rows.select(F.col("entries.feature").alias("feature"))
    own = int(group.max(initial=-1)) + 1
    longest = features.agg(F.coalesce(F.max(F.size("feature")), F.lit(0))).first()[0]
    colours = own + max(1, longest)
    rng = np.random.default_rng(1)
    colour = np.where(group >= 0, group, own + rng.permutation(size) % (colours - own)).astype(np.int64)
    fixed = np.zeros(size, dtype=bool)
    while True:
        moving = _losers(features, colour, fixed, rank)
        fixed[:] = True
        fixed[moving] = False
        if not len(moving):
            return colour
        step = max(1, _MASK_BYTES * 8 // colours)
        free = [None] * len(moving)
        for low in range(0, len(moving), step):
            part = ~_taken(features, moving[low:low + step], colour, fixed, colours)
            part[:, :own] = False
            for i, flags in enumerate(part):
                free[low + i] = np.flatnonzero(flags)
        stuck = sum(not len(f) for f in free)
        more = -(-stuck // 16)  # new colours, when some columns meet every colour there is
        for column, some in zip(moving, free):
            colour[column] = rng.choice(some) if len(some) else colours + rng.integers(more)
        colours += more


def bundle(rows: DataFrame, features: DataFrame, size: int) -> Bundles:
    """Bundle the columns of stored ``rows`` (``entries`` of feature ids below ``size`` with positive values).

    ``features``: ``feature``, ``often`` (more frequent columns keep their colour), ``score`` (order inside the bundle)
    and ``block``, not negative for blocks of codes that start together. A column without a row there has no entries.
    """
    known = features.select("feature", "often", "score", "block").toArrow()  # at most MAX_COLUMNS rows
    at = known.column("feature").to_numpy()
    often, score, group = np.zeros(size), np.zeros(size), np.full(size, -1)
    often[at], score[at], group[at] = (known.column(c).to_numpy() for c in ("often", "score", "block"))
    rank = np.empty(size, dtype=np.int64)
    rank[np.lexsort((np.arange(size), -often))] = np.arange(size)
    colour = colour_columns(rows, size, rank, group)
    used, colour = np.unique(colour, return_inverse=True)
    order = np.lexsort((np.arange(size), score, colour))
    place = np.empty(size, dtype=np.int64)
    place[order] = np.arange(size) - np.searchsorted(colour[order], colour[order])
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((colour.astype(np.int32), place.astype(np.int32)))

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value[0][i]), pa.array(held.value[1][i])],
                                             ["feature", "bundle", "place"])

    places = spark.range(size).mapInArrow(lookup, "feature bigint, bundle int, place int")
    tops = rows.select(F.explode("entries").alias("e")).groupBy(F.col("e.feature").alias("feature")).agg(F.max("e.value").alias("top"))
    return Bundles(store(places.join(tops, "feature"), "bundles"), len(used))


def bundled(rows: DataFrame, bundles: Bundles, key: str = "item_id", max_bytes: int | None = None) -> DataFrame:
    """Rows with their ``entries`` moved into bundles; the other columns stay.

    For rows the bundles were made of nothing is lost. A row that holds two columns of a bundle, which only others can,
    keeps the later one; columns never seen are left out, larger values than seen count as the largest.
    """
    long = rows.select(key, F.explode("entries").alias("e")).select(key, "e.feature", "e.value")
    hit = lookup_join(long, bundles.table, ["feature"], "inner", max_bytes=max_bytes)
    value = F.col("place") + F.least(F.col("value") / F.col("top"), F.lit(1.0))
    one = hit.groupBy(key, "bundle").agg(F.max(value).alias("value"))
    entry = F.struct(F.col("bundle").cast("bigint").alias("feature"), "value")
    lists = one.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    none = F.array().cast("array<struct<feature:bigint,value:double>>")
    return rows.drop("entries").join(lists, key, "left").withColumn("entries", F.coalesce("entries", none))


def column_of(value: Column) -> Column:
    """The place that a bundled value belongs to."""
    return F.ceil(value) - 1
