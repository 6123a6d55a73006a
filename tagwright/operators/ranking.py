"""Dense ranks and order statistics without a single-task sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagwright.operators.lookup import lookup_join
from tagwright.storage import store

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits
_FANOUT = 4096
_SMALL = 10_000


def with_rank(df: DataFrame, order: list[Column | str], name: str = "rank", start: int = 1) -> DataFrame:
    """Number the rows ``start``, ``start + 1``, ... in the given total order.

    A range-partitioned sort numbers rows inside each partition; the sorted rows are stored once, and the counts of the
    partitions (one small row each) give every partition its offset.
    """
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = store(placed, "ranked")
    part = F.shiftright("_at", _LOCAL_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row per partition
    within = F.col("_at") - F.shiftleft("_part", _LOCAL_BITS)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + within + start)
        .drop("_part", "_before", "_at")
    )


def with_rank_within(
    df: DataFrame, groups: list[str], order: list[Column | str], name: str = "rank", start: int = 1
) -> DataFrame:
    """Number rows inside each group (blocks, label columns), groups not null; large groups are still sorted by many tasks."""
    ranked = with_rank(df, [*groups, *order], "_rank", 0)
    first = store(ranked.groupBy(*groups).agg(F.min("_rank").alias("_first")), "group-starts")
    return (
        lookup_join(ranked, first, groups, "inner")
        .withColumn(name, F.col("_rank") - F.col("_first") + start)
        .drop("_rank", "_first")
    )


def kth_smallest(df: DataFrame, column: str, place: int | Callable[[int], int]) -> int | None:
    """The value of an integer column at a place (from 1) in ascending order, exact.

    ``place`` may be a function of the number of rows. Each pass counts the values into at most 4096 equal ranges and
    goes on inside the one that holds the answer; a range of few rows is sorted. Only range counts reach the driver.
    """
    values = df.select(F.col(column).cast("bigint").alias("v"))
    low, high, rows = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    k = place(rows) if callable(place) else place
    if k < 1 or k > rows:
        return None
    while low < high:
        inside = values.where(F.col("v").between(low, high))
        if rows <= _SMALL:
            return inside.orderBy("v").offset(k - 1).limit(1).first()[0]
        width = (high - low) // _FANOUT + 1
        bucket = F.expr(f"(v - ({low}L)) div {width}L").alias("b")
        counts = sorted(inside.groupBy(bucket).count().collect())  # at most 4096 rows
        for b, n in counts:
            if k <= n:
                low, high, rows = low + b * width, min(high, low + (b + 1) * width - 1), n
                break
            k -= n
    return low
