"""Minimax contiguous partition of ordered atomic groups into shards.

Rows with equal texts form a group that is never cut. Groups are ordered by the md5 of their text, so the order mixes
sources and lengths and is found without comparing texts. The smallest capacity for which greedy filling needs at most
the asked number of shards is found by binary search, and the groups are cut where that filling cuts.

Running totals of the groups come from a range-partitioned sort with one offset per partition. Greedy checks ask for
"the last running total up to x" only. All capacities of a round are checked at once: one aggregate per shard answers
for all of them. Every round narrows the capacities and with them the stretch in which each cut can lie; when all
stretches together hold at most ``LOCAL_TOTALS`` running totals, those numbers alone (a fixed bound, whatever the input)
are fetched and the search ends on them. No text and no group passes through the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from tagwright.operators.ranking import with_rank
from tagwright.storage import store

LOCAL_TOTALS = 200_000
_ROUND = 15  # capacities per round


def running_totals(groups: DataFrame, order: str, size: str) -> DataFrame:
    """Stored ``order``, ``size`` and ``total``, the sum of sizes up to and including the row (``order`` is unique)."""
    placed = groups.select(order, size).orderBy(order).withColumn("part", F.spark_partition_id())
    placed = store(placed, "shard-groups")
    sums = placed.groupBy("part").agg(F.sum(size).alias("s"))
    before = sums.select("part", F.coalesce(F.sum("s").over(
        Win.orderBy("part").rowsBetween(Win.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per partition
    upto = F.sum(size).over(Win.partitionBy("part").orderBy(order).rowsBetween(Win.unboundedPreceding, 0))
    out = placed.withColumn("upto", upto).join(F.broadcast(before), "part")
    return store(out.select(order, size, (F.col("before") + F.col("upto")).alias("total")), "shard-totals")


def _fill(capacity: int, shards: int, total: int, reach: Callable[[int], int]) -> list[int]:
    """Running totals at the cuts of greedy filling, at most ``shards`` of them."""
    cuts, at = [], 0
    while at < total and len(cuts) < shards:
        at = reach(at + capacity)
        cuts.append(at)
    return cuts


def cut_points(totals: DataFrame, shards: int, size: str = "size", local_totals: int = LOCAL_TOTALS) -> tuple[int, list[int]]:
    """The least capacity, and the running totals at which the shards end (the last is the grand total)."""
    total, largest = totals.agg(F.max("total"), F.max(size)).first()
    if not total:
        return 0, []
    low = max(largest, -(-total // shards))  # no capacity below this is enough
    high = low + largest  # always enough: each shard but the last holds more than high - largest
    fills: dict[int, list[int]] = {}

    def fill(capacities: list[int]) -> None:
        at = {c: 0 for c in capacities}
        cuts: dict[int, list[int]] = {c: [] for c in capacities}
        for _ in range(shards):
            last = [F.max(F.when(F.col("total") <= at[c] + c, F.col("total"))) for c in capacities]
            for c, reached in zip(capacities, totals.agg(*last).first()):
                if at[c] < total:
                    at[c] = reached
                    cuts[c].append(reached)
        fills.update(cuts)

    fill(sorted({low, high}))
    if fills[low][-1] == total:
        return low, fills[low]
    while high - low > 1:  # low is too small, high is enough
        stretch: Column = F.lit(False)
        for a, b in zip(fills[low], fills[high]):
            stretch = stretch | F.col("total").between(a, b)
        near = totals.where(stretch).select("total")
        if near.count() <= local_totals:
            known = sorted(r[0] for r in near.collect())  # at most local_totals numbers
            reach = lambda x: known[bisect_right(known, x) - 1]
            while high - low > 1:
                middle = (low + high) // 2
                cuts = _fill(middle, shards, total, reach)
                low, high, fills[middle] = (low, middle, cuts) if cuts[-1] == total else (middle, high, cuts)
            break
        step = max(1, (high - low) // (_ROUND + 1))
        tried = sorted({c for c in range(low + step, high, step)})[:_ROUND]
        fill(tried)
        for c in tried:
            if fills[c][-1] == total:
                high = c
                break
            low = c
    return high, fills[high]


def shard(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null) of every row.

    The law is ``bytes``: a row's size is the UTF-8 bytes of its text plus 1, a null text counts as empty. Equal texts
    lie in one shard. Slots follow the order of groups and keys inside a shard; rows that repeat a key and its text get
    a slot each, a null key comes first. There may be fewer shards than asked for when a group outweighs its share.
    Texts of any length count whole; an empty table gives no rows. Other columns are not looked at.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(content) + 1).cast("bigint").alias("size"),
                       F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"), F.md5(F.encode(content, "UTF-8")).alias("group"))
    rows = with_rank(rows, ["group", "key"], "rank", 0)
    rows = store(rows, "shard-rows")
    totals = running_totals(rows.groupBy("group").agg(F.sum("size").alias("size")), "group", "size")
    _, cuts = cut_points(totals, shards)
    ends = [r[0] for r in totals.where(F.col("total").isin(cuts)).orderBy("total").select("group").collect()]  # one per shard
    number = F.lit(0)
    for end in ends[:-1]:
        number = number + (F.col("group") > end).cast("int")
    placed = rows.withColumn("shard", number)
    first = [(r[0], r[1]) for r in placed.groupBy("shard").agg(F.min("rank")).collect()]  # one per shard
    start = F.lit(None).cast("bigint")
    for s, at in first:
        start = F.when(F.col("shard") == s, F.lit(at)).otherwise(start)
    return placed.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - start).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
