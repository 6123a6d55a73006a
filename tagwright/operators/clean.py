"""Cleaning: filters, fills, flags, category parts and text normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright import fixed
from tagwright.functions import category, text
from tagwright.operators.ranking import with_rank


def filter_nonzero_price(rows: DataFrame) -> DataFrame:
    """Drop zero prices; a missing price stays."""
    return rows.where(F.col("price").isNull() | (F.col("price") != 0))


def fill_missing(rows: DataFrame, policy: dict[str, str]) -> DataFrame:
    """Fill string columns by one of the fill policies in ``fixed``."""
    return rows.fillna(policy)


def missing_flags(rows: DataFrame) -> DataFrame:
    """``has_category`` and ``has_brand``; call it before filling."""
    return rows.withColumns({
        "has_category": F.col("category_name").isNotNull().cast("int"),
        "has_brand": F.col("brand_name").isNotNull().cast("int"),
    })


def fill_linear(rows: DataFrame) -> DataFrame:
    """Fill by the linear model's policy, then lowercase."""
    return rows.withColumns({
        c: F.lower(F.coalesce(F.col(c), F.lit(v))) for c, v in fixed.FILL_LINEAR.items()
    })


def replace_placeholder(description: Column, mode: str = "as_written") -> Column:
    """Blank the placeholder description.

    ``as_written`` compares the mixed-case placeholder with lowercased text and so never fires; ``intended`` compares
    in lower case.
    """
    wanted = {"as_written": fixed.PLACEHOLDER, "intended": fixed.PLACEHOLDER.lower()}[mode]
    return F.when(description == wanted, "").otherwise(description)


def category_parts(rows: DataFrame) -> DataFrame:
    return rows.withColumns(category.split_strict(F.col("category_name")))


def condition_keys(rows: DataFrame) -> DataFrame:
    """Category part and condition as one value."""
    return rows.withColumns({
        name: category.with_condition(F.col(part), F.col("item_condition_id"))
        for name, part in (("gencat_cond", "general_cat"), ("subcat_1_cond", "subcat_1"), ("subcat_2_cond", "subcat_2"))
    })


def normalise_text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: text.normalise_measures(F.col(c)) for c in ("name", "item_description")})


def clean_linear(rows: DataFrame, placeholder: str = "as_written") -> DataFrame:
    """Everything the linear model does to a listing before brands are imputed. No shuffle."""
    rows = fill_linear(missing_flags(rows))
    rows = condition_keys(category_parts(rows))
    rows = rows.withColumn("item_description", replace_placeholder(F.col("item_description"), placeholder))
    return normalise_text(rows)


def clean_tree(rows: DataFrame) -> DataFrame:
    """The tree model's cleaning: fills and codes as text."""
    rows = fill_missing(rows, fixed.FILL_TREE)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("shipping", "item_condition_id")})


def clean_embedding(rows: DataFrame) -> DataFrame:
    """The embedding model's cleaning: fills and padded category parts."""
    rows = fill_missing(rows, fixed.FILL_CONSTANT)
    return rows.withColumns(category.split_padded(F.col("category_name")))


def positional_ids(rows: DataFrame, key: str = "item_id", name: str = "position") -> DataFrame:
    """Renumber rows from 0 in key order."""
    return with_rank(rows, [key], name, start=0)
