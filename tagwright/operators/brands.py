"""Brand dictionary and brand imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.functions import text
from tagwright.operators.lookup import lookup_join
from tagwright.storage import store


def brand_counts(rows: DataFrame) -> DataFrame:
    """Listings per brand; missing brands are not counted."""
    return rows.where(F.col("brand_name").isNotNull()).groupBy("brand_name").agg(F.count("*").alias("cnt"))


def multiword_brands(brands: DataFrame, keep: bool = True) -> DataFrame:
    """Brands with (``keep``) or without a blank."""
    blank = F.instr(F.col("brand_name"), " ") > 0
    return brands.where(blank if keep else ~blank)


def brand_dictionary(rows: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Stored ``(*scope, word, multiword)``: every known brand, per value of ``scope``; the empty brand never enters."""
    words = (
        rows.where(F.col("brand_name") != "").select(*scope, "brand_name").distinct()
        .select(*scope, (F.instr("brand_name", " ") > 0).alias("multiword"),
                F.explode(text.whole_value_tokens(F.col("brand_name"))).alias("word"))
        .distinct()
    )
    return store(words, "brands")


def brand_candidates(rows: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Long table ``(item_id, *scope, stage, pos, word, multiword)`` of the strings that may name a listing's brand.

    Stages 1, 2: the first two words of name, description, to be found among multi-word brands.
    Stages 3, 4: each word of name, description, in order, to be found among one-word brands.
    A word repeated within a stage is kept once, at its first place.
    """
    def stage(number, words, multiword):
        return F.transform(F.array_distinct(words), lambda w, i: F.struct(
            F.lit(number).alias("stage"), i.alias("pos"), w.alias("word"), F.lit(multiword).alias("multiword")))

    name, description = F.col("name"), F.col("item_description")
    lists = F.concat(
        stage(1, F.array(text.leading_two_words(name)), True),
        stage(2, F.array(text.leading_two_words(description)), True),
        stage(3, text.brand_tokens(name), False),
        stage(4, text.brand_tokens(description), False),
    )
    return (
        rows.select("item_id", *scope, F.explode(lists).alias("c")).select("item_id", *scope, "c.*").where("word <> ''")
    )


def brand_lookup(
    candidates: DataFrame, dictionary: DataFrame, scope: tuple[str, ...] = (), max_bytes: int | None = None
) -> DataFrame:
    """Keep the candidates that are known brands of the wanted kind."""
    return lookup_join(candidates, dictionary, [*scope, "word", "multiword"], "left_semi", max_bytes=max_bytes)


def imputed_brands(
    rows: DataFrame,
    brands_from: DataFrame | None = None,
    scope: tuple[str, ...] = (),
    max_bytes: int | None = None,
) -> DataFrame:
    """``(item_id, brand_name)`` for listings whose empty brand was found: the least (stage, pos) hit wins.

    Brands come from ``rows`` itself unless ``brands_from`` names another table; with ``scope=("split",)`` train and
    test listings each use the brands of their own part.
    """
    dictionary = brand_dictionary(rows if brands_from is None else brands_from, scope)
    candidates = brand_candidates(rows.where(F.col("brand_name") == ""), scope)
    hits = brand_lookup(candidates, dictionary, scope, max_bytes)
    return hits.groupBy("item_id").agg(F.min_by("word", F.struct("stage", "pos")).alias("brand_name"))


def impute_brands(
    rows: DataFrame,
    brands_from: DataFrame | None = None,
    scope: tuple[str, ...] = (),
    keep: tuple[str, ...] | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Fill empty brands of cleaned listings. Listings that have a brand are not shuffled.

    ``keep`` names the columns wanted in the result; the fewer, the less the join moves.
    """
    found = imputed_brands(rows, brands_from, scope, max_bytes).withColumnRenamed("brand_name", "_found")
    rows = rows.select(*keep) if keep else rows
    empty = (
        rows.where(F.col("brand_name") == "")
        .join(found, "item_id", "left")
        .withColumn("brand_name", F.coalesce("_found", "brand_name"))
        .drop("_found")
    )
    return rows.where(F.col("brand_name") != "").unionByName(empty)


def name_with_brand(rows: DataFrame) -> DataFrame:
    """Append the brand to the name; a blank is left behind where there is no brand."""
    return rows.withColumn("name", F.concat("name", F.lit(" "), "brand_name"))


def empty_brand_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("brand_name") == "").alias("n_empty"))
