"""Dictionaries, vocabularies, document frequencies and idf weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright import fixed
from tagwright.functions import text
from tagwright.functions.arrays import counted
from tagwright.operators.lookup import lookup_join
from tagwright.operators.ranking import kth_smallest, with_rank
from tagwright.storage import store


def token_counts(rows: DataFrame, tokens: Column) -> DataFrame:
    """``(token, cnt)`` over all rows; counts are combined before the shuffle."""
    return rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def word_dictionary(rows: DataFrame, column: str, pattern: str = fixed.LETTER_WORD) -> DataFrame:
    """``(word, cnt)``: runs of ``pattern`` in the lowercased column."""
    return token_counts(rows, text.extract_all(F.lower(column), pattern)).withColumnRenamed("token", "word")


def dictionary_from_lines(spark: SparkSession, path: str) -> DataFrame:
    """``word_dictionary`` of a text file."""
    return word_dictionary(spark.read.text(path), "value")


def dictionary_entries(words: DataFrame, k: int = 0) -> DataFrame:
    """Words and, for ``k`` > 0, their delete variants, each once."""
    own = words.select("word")
    if k:
        own = own.unionAll(words.select(F.explode(text.delete_variants(F.col("word"), k)).alias("word")))
    return own.distinct()


def dictionary_stats(words: DataFrame, k: int = 0) -> DataFrame:
    """One row: words counted, different words, entries with delete variants, length of the longest word."""
    return words.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_words"),
        F.count("*").alias("n_unique"),
        F.coalesce(F.max(F.length("word")), F.lit(0)).alias("longest"),
    ).withColumn("n_entries", dictionary_entries(words, k).agg(F.count("*")).scalar())


def term_counts(rows: DataFrame, block: str, tokens: Column) -> DataFrame:
    """Long table ``(item_id, block, feature, value)`` of token counts per row, counted inside the row."""
    return rows.select("item_id", F.explode(counted(tokens)).alias("e")).select(
        "item_id", F.lit(block).alias("block"), F.col("e.token").alias("feature"),
        F.col("e.tf").cast("double").alias("value"),
    )


def document_frequency(long: DataFrame) -> DataFrame:
    """``(block, feature, df)``: rows with a non-zero value. A long table holds a feature of an item once."""
    return long.where("value <> 0").groupBy("block", "feature").agg(F.count("*").alias("df"))


def features_in_range(df: DataFrame, min_df: int = 1, max_df: float = 1.0, rows: Column | int | None = None) -> DataFrame:
    """Features with ``df >= min_df``; a ``max_df`` below 1.0 is a share of ``rows``."""
    kept = df.where(F.col("df") >= min_df)
    if max_df < 1.0:
        if rows is None:
            raise ValueError("max_df needs the number of rows")
        kept = kept.where(F.col("df") <= (rows if isinstance(rows, Column) else F.lit(rows)) * max_df)
    return kept


def keep_features(long: DataFrame, kept: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Rows of the long table whose feature is in ``kept``."""
    return lookup_join(long, store(kept.select("block", "feature"), "kept"), ["block", "feature"], "left_semi", max_bytes=max_bytes)


def drop_features_by_df(
    long: DataFrame, min_df: int = 1, max_df: float = 1.0, rows: Column | int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Fit the frequency range on ``long`` and apply it to ``long``."""
    return keep_features(long, features_in_range(document_frequency(long), min_df, max_df, rows), max_bytes)


def intersect_features(
    train: DataFrame, valid: DataFrame, min_df: int = 0, max_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Keep on both tables the features frequent enough on both.

    ``min_df=0`` keeps every feature, as a column of zeros also has df 0.
    """
    if min_df <= 0:
        return train, valid
    both = (
        features_in_range(document_frequency(train), min_df).select("block", "feature")
        .intersect(features_in_range(document_frequency(valid), min_df).select("block", "feature"))
    )
    both = store(both, "features")
    train, valid = [
        lookup_join(part, both, ["block", "feature"], "left_semi", max_bytes=max_bytes) for part in (train, valid)]
    return train, valid


def vocabulary_ranks(counts: DataFrame) -> DataFrame:
    """Terms numbered from 1 by falling count, then token."""
    return with_rank(counts, [F.desc("cnt"), "token"], "rank")


def vocabulary_top_k(counts: DataFrame, k: int) -> DataFrame:
    """The first ``k`` terms of ``vocabulary_ranks``; only terms that reach the k-th highest count are sorted."""
    counts = store(counts, "term-counts")  # read by several passes
    least = kth_smallest(counts.select((-F.col("cnt")).alias("minus")), "minus", k)
    reaching = counts if least is None else counts.where(F.col("cnt") >= -least)
    return vocabulary_ranks(reaching).where(F.col("rank") <= k)


def sequence_tokens(column: str) -> Column:
    return text.filter_char_tokens(F.col(column))


def token_index(train: DataFrame, max_words: int = fixed.MAX_WORDS) -> DataFrame:
    """``(token, idx)`` over the train descriptions and names; only indices below ``max_words`` exist."""
    texts = stack_text_columns(train, "item_description", "name")
    ranked = vocabulary_top_k(token_counts(texts, sequence_tokens("text")), max_words - 1)
    return ranked.select("token", F.col("rank").cast("int").alias("idx"))


def stack_text_columns(rows: DataFrame, *columns: str) -> DataFrame:
    """One ``text`` column out of several; one pass over the rows."""
    return rows.select(F.explode(F.array(*columns)).alias("text"))


def smooth_idf(df: Column, rows: Column) -> Column:
    return F.log((rows + 1) / (df + 1)) + 1


def idf_weights(df: DataFrame, rows: Column) -> DataFrame:
    """Add the smooth idf ``ln((1 + n) / (1 + df)) + 1``."""
    return df.withColumn("idf", smooth_idf(F.col("df"), rows))
