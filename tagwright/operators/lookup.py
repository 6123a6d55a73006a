"""Lookup joins that broadcast only what has been measured and stay even under hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright.storage import store

BROADCAST_BYTES = 64 * 2**20  # a table measured larger than this is never broadcast
HEAVY_KEYS = 1024  # keys treated as hot, at most
HEAVY_KEY_BYTES = 512  # longer keys are left to the shuffle, so the hot list stays under 1 MiB
HEAVY_SAMPLE = 0.01


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Size of a value, as an expression; arrays and structs by what they hold."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.ArrayType):
        count = F.coalesce(F.greatest(F.size(value), F.lit(0)), F.lit(0)).cast("bigint")
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            held = F.aggregate(value, F.lit(0).cast("bigint"), lambda s, x: s + _bytes(x, kind.elementType))
            return F.coalesce(held, F.lit(0).cast("bigint")) + 24
        return count * 8 + 24
    if isinstance(kind, T.StructType):
        return reduce(Column.__add__, [_bytes(value.getField(f.name), f.dataType) for f in kind.fields], F.lit(16).cast("bigint"))
    if isinstance(kind, T.AtomicType):
        return F.lit(16 if isinstance(kind, T.DecimalType) else 8).cast("bigint")
    raise TypeError(f"no size known for {kind.simpleString()}")


def _row_bytes(table: DataFrame) -> Column:
    return reduce(Column.__add__, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields], F.lit(16).cast("bigint"))


def measured_bytes(table: DataFrame) -> int:
    """Size of a stored table, from one aggregate over it."""
    return table.agg(F.coalesce(F.sum(_row_bytes(table)), F.lit(0))).first()[0]


def _heavy_keys(big: DataFrame, on: list[str]) -> DataFrame:
    # The sample decides only which rows take which route, never which rows are kept.
    short = F.lit(True)
    for c in on:
        short = short & (F.octet_length(F.col(c).cast("string")) <= HEAVY_KEY_BYTES)
    found = (
        big.select(*on).sample(False, HEAVY_SAMPLE, 11).where(short)
        .groupBy(*on).count().where("count > 1").orderBy(F.desc("count"), *on).limit(HEAVY_KEYS).select(*on)
    )
    return store(found, "heavy-keys")


def lookup_join(
    big: DataFrame, table: DataFrame, on: list[str], how: str = "left", stored: bool = False,
    max_bytes: int | None = None,
) -> DataFrame:
    """Join ``big`` to a stored ``table`` that is unique on ``on``; keys of ``big`` are not null.

    A table measured within ``max_bytes`` is broadcast, so ``big`` is not shuffled. Beyond it, the hot keys of ``big``
    (a bounded list) meet their table rows by broadcast and the rest by a shuffle join, so no task gets a hot key.
    That way reads ``big`` several times: it is stored first unless the caller says it is ``stored`` already.
    """
    limit = BROADCAST_BYTES if max_bytes is None else max_bytes
    if measured_bytes(table) <= limit:
        return big.join(F.broadcast(table), on, how)
    big = big if stored else store(big, "lookup-rows")
    heavy = F.broadcast(_heavy_keys(big, on))
    hot = big.join(heavy, on, "left_semi").join(F.broadcast(table.join(heavy, on, "left_semi")), on, how)
    cold = big.join(heavy, on, "left_anti").join(table.hint("merge"), on, how)
    return hot.unionByName(cold)
