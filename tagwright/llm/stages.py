"""Stages of the corpus pipeline: each takes what the stage before kept and returns the columns of ``documents``.

Every stage takes tables of any size, empty ones too, whole texts of any length, null and empty ones included, and ignores
columns that ``documents`` does not have. Null ids count as one id. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.llm import jaccard, packing, pii, quality, spaced
from tagwright.llm.shared import attach, table
from tagwright.storage import arrow_rows, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH_ROWS = 2_000  # whole texts that a task holds outside of Spark's own memory at once
_ID = f"coalesce(doc_id, {-(2**63) + 1}L)"  # a null id is an id like others


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents whose id is (``left_semi``) or is not (``left_anti``) among stored ``ids``."""
    return attach(docs.withColumn("id", F.expr(_ID)), ids, ["id"], how).select(*COLUMNS)


def _in_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage whose tasks hand ``BATCH_ROWS`` texts at most to Python, however it is run: its result is stored under that bound,
    and its other tables go."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with arrow_rows(spark, BATCH_ROWS), scratch(spark, stage.__name__) as keep:
            return keep(stage(spark, docs, sf_dir))

    return run


def _judged(apply: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """A stage that looks at texts in batches and stores only what it found, a few bytes a text; ``apply`` puts that to the
    documents, without Python."""

    def made(judge: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(judge)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            return apply(docs.select(*COLUMNS), _in_batches(judge)(spark, docs.select(*COLUMNS), sf_dir))

        return run

    return made


@_judged(quality.without)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the limits of their language and source go; null and empty texts fail."""
    return quality.rejected(docs)


@_judged(partial(_by_id, how="left_semi"))
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (shingles of five words, similarity 0.8) the smallest id stays; texts without words
    are in no group, rows that share the id that stays all stay."""
    groups = jaccard.near_duplicates(docs.select(F.expr(_ID).alias("doc_id"), "text"), 5, 80)
    return groups.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()


@_judged(partial(_by_id, how="left_anti"))
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go; null and empty texts overlap with none."""
    found = spaced.contaminated(docs.select(F.expr(_ID).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc_id").alias("id")).distinct()


def _redacted(docs: DataFrame, found: DataFrame) -> DataFrame:
    return pii.apply_redactions(docs, found).withColumn("n_chars", F.length("text").cast("bigint"))


@_judged(_redacted)
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind in brackets; ``n_chars`` follows. A null text stays null."""
    return pii.redactions(docs)


@_in_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens, with their ids. A null or empty text has only its end id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("packing", packed),
]
