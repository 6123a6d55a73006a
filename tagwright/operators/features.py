"""Feature blocks of the linear and the tree model as long tables ``(item_id, ..., block, feature, value)``.

All blocks of a listing are built inside its row and exploded once: one scan and no shuffle, however many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagwright import fixed
from tagwright.functions import category, text
from tagwright.functions.arrays import counted, exploded, unit_length
from tagwright.functions.counting import ENTRIES, word_entries
from tagwright.functions.hashing import hashed, hashed_text
from tagwright.operators.lookup import lookup_join
from tagwright.operators.ranking import with_rank, with_rank_within
from tagwright.operators.vocabulary import smooth_idf
from tagwright.storage import store

ONE_HOT_BLOCKS = ("has_brand", "shipping", "item_condition_id")
TREE_LIMITS = {"name": fixed.NAME_TERMS, "item_description": fixed.DESCRIPTION_TERMS}


def _entry(block: str, feature: Column, value: Column) -> Column:
    return F.struct(
        F.lit(block).alias("block"), feature.cast("string").alias("feature"), value.cast("double").alias("value"))


def count_block(block: str, tokens: Column) -> Column:
    return F.transform(counted(tokens), lambda e: _entry(block, e["token"], e["tf"]))


def one_hot_block(block: str, code: Column) -> Column:
    return F.array(_entry(block, code, F.lit(1.0)))


def text_ngrams(column: str) -> Column:
    """Word tokens without stop words, as 1- and 2-grams."""
    return text.word_ngrams(text.remove_stopwords(text.word_tokens(F.col(column))))


def linear_entries(method: str = "md5", buckets: int = fixed.HASH_BUCKETS) -> dict[str, Column]:
    """The linear model's blocks, each an array of entries, for cleaned rows with imputed brands."""
    return {
        "name": hashed_text("name", F.col("name"), buckets, method),
        "category_name": hashed(category.path_tokens(F.col("category_name")), buckets, method, "category_name"),
        **{b: count_block(b, text.whole_value_tokens(F.col(b)))
           for b in ("brand_name", "gencat_cond", "subcat_1_cond", "subcat_2_cond")},
        **{b: one_hot_block(b, F.col(b)) for b in ONE_HOT_BLOCKS},
        "item_description": hashed_text("item_description", F.col("item_description"), buckets, method, single=True),
    }


def tree_entries() -> dict[str, Column]:
    """The tree model's blocks: plain counts, for rows cleaned by ``clean_tree``."""
    low = {c: F.lower(c) for c in ("name", "category_name", "brand_name", "item_description")}
    return {
        "name": word_entries("name", low["name"]),
        "category_name": count_block("category_name", text.whole_value_tokens(low["category_name"])),
        "brand_name": count_block("brand_name", text.whole_value_tokens(low["brand_name"])),
        "shipping": count_block("shipping", text.digit_tokens(F.col("shipping"))),
        "item_condition_id": count_block("item_condition_id", text.digit_tokens(F.col("item_condition_id"))),
        "item_description": word_entries("item_description", low["item_description"]),
    }


def explode_blocks(rows: DataFrame, entries: dict[str, Column], keep: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Stack blocks into the long table; ``keep`` names the row columns carried along."""
    stacked = F.concat(*[e.cast(ENTRIES) for e in entries.values()])
    return exploded(rows, keep, stacked).select(*keep, "e.block", "e.feature", "e.value")


def fit_linear_features(train_long: DataFrame, n_rows: Column, min_df: int = fixed.MIN_DF) -> DataFrame:
    """``(block, feature, df, fid, idf)`` of the features that survive ``min_df``; one-hot blocks all survive."""
    df = train_long.where("value <> 0").groupBy("block", "feature").agg(F.count("*").alias("df"))
    kept = df.where((F.col("df") >= min_df) | F.col("block").isin(*ONE_HOT_BLOCKS))
    return with_rank(kept, ["block", "feature"], "fid", 0).withColumn("idf", smooth_idf(F.col("df"), n_rows))


def fit_tree_features(
    train_long: DataFrame, n_rows: Column, limits: dict[str, int] | None = None
) -> DataFrame:
    """``(block, feature, cnt, df, fid, idf)``: per block the most frequent terms, idf 1 outside descriptions."""
    limits = TREE_LIMITS if limits is None else limits
    counts = train_long.groupBy("block", "feature").agg(
        F.sum("value").cast("bigint").alias("cnt"), F.count("*").alias("df"))
    ranked = with_rank_within(counts, ["block"], [F.desc("cnt"), "feature"], "place")
    limit = F.coalesce(*[F.when(F.col("block") == b, F.lit(k)) for b, k in limits.items()], F.lit(2**62))
    top = ranked.where(F.col("place") <= limit)
    sizes = top.groupBy("block").agg(F.count("*").alias("n"))  # one row per block
    before = F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("block", F.coalesce(before, F.lit(0)).alias("_offset"))
    idf = F.when(F.col("block") == "item_description", smooth_idf(F.col("df"), n_rows)).otherwise(1.0)
    return (
        top.join(F.broadcast(offsets), "block")
        .withColumns({"fid": F.col("_offset") + F.col("place") - 1, "idf": idf})
        .drop("place", "_offset")
    )


def weighted(
    long: DataFrame, features: DataFrame, keep: tuple[str, ...], stored: bool = False, max_bytes: int | None = None
) -> DataFrame:
    """Long table -> ``(*keep, entries)``: per item the surviving features as ``(block, feature id, value * idf)``.

    The lookup is left outer and the grouping collects only hits, so an item without any surviving feature stays.
    Entries of an item lie together in a long table, so under a broadcast lookup the partial aggregation hands one row
    per item to the shuffle.
    """
    table = features.select("block", "feature", "fid", "idf")
    hit = lookup_join(long, table, ["block", "feature"], "left", stored, max_bytes)
    entry = F.struct("block", F.col("fid").alias("feature"), (F.col("value") * F.col("idf")).alias("value"))
    return hit.groupBy(*keep).agg(F.sort_array(F.collect_list(F.when(F.col("fid").isNotNull(), entry))).alias("entries"))


def _plain(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value")))


def row_unit(items: DataFrame) -> DataFrame:
    """L2 norm over the whole row."""
    return items.withColumn("entries", unit_length(_plain(F.col("entries"))))


def description_unit(items: DataFrame) -> DataFrame:
    """L2 norm over the description block only; other blocks keep their values."""
    is_text = lambda e: e["block"] == "item_description"
    text_part = unit_length(_plain(F.filter("entries", is_text)))
    rest = _plain(F.filter("entries", lambda e: ~is_text(e)))
    return items.withColumn("entries", F.concat(rest, text_part))


def unit_blocks(entries: dict[str, Column]) -> dict[str, Column]:
    """Blocks of a row, each divided by its L2 norm inside the row; ``row_l2_norm`` before anything is exploded."""
    return {b: unit_length(e, lambda feature, value, b=b: _entry(b, feature, value)) for b, e in entries.items()}


def row_l2_norm(long: DataFrame) -> DataFrame:
    """Divide the values of each ``(item_id, block)`` by their L2 norm."""
    entry = F.struct("feature", "value")
    grouped = long.groupBy("item_id", "block").agg(unit_length(F.sort_array(F.collect_list(entry))).alias("entries"))
    return grouped.select("item_id", "block", F.explode("entries").alias("e")).select("item_id", "block", "e.*")


def feature_ids(long: DataFrame) -> DataFrame:
    """Stored ``(block, feature, fid)``: one dense id per feature over all blocks."""
    return store(with_rank(long.select("block", "feature").distinct(), ["block", "feature"], "fid", 0), "feature-ids")


def feature_union(long: DataFrame, ids: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Put blocks side by side: give each entry its global feature id."""
    return lookup_join(long, ids, ["block", "feature"], "inner", max_bytes=max_bytes)
