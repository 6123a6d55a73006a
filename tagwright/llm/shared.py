"""Helpers of several operators: stored steps, measured lookups by row key, graph components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.operators.lookup import lookup_join
from tagwright.storage import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as it takes not to be one of the columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Apply ``work`` to every Arrow batch of every partition."""

    def each(batches):
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(each, schema)


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join rows of ``big`` to a stored table that is unique on ``on``: by broadcast when its measured size allows,
    else with hot keys apart."""
    return lookup_join(big, small, on, how, stored=True)


def components(edges: DataFrame, name: str = "component") -> DataFrame:
    """Connected components of an undirected graph of bigint columns ``a``, ``b``: columns ``node``, ``label``.

    Alternates large-star and small-star steps: every node hands its larger (smaller) neighbours to its least
    neighbour, until each node points at the least node of its component. Rounds grow with the logarithm of the
    component size; each step is stored, and only a count and a checksum reach the driver. A hub is pre-aggregated for
    its least neighbour, and its rows are split by the adaptive skew join. Loops (``a = b``) give one-node components.
    """
    now = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if mark == seen:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = now.where("u = v")
        large = store(large.unionByName(loops).distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        now = store(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    labels = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(roots).groupBy("node").agg(F.min("label").alias("label"))
