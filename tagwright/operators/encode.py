"""Label codes, one-hot, token sequences and the embedding model's input row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright import fixed
from tagwright.functions.sequences import pad_sequence
from tagwright.operators.lookup import BROADCAST_BYTES, lookup_join, measured_bytes
from tagwright.operators.ranking import with_rank_within
from tagwright.operators.vocabulary import sequence_tokens
from tagwright.storage import store

LABEL_COLUMNS = ("brand_name", "cat_1", "cat_2", "cat_3")
_NO_LABEL = "null"


def stacked_labels(rows: DataFrame, columns: tuple[str, ...] = LABEL_COLUMNS) -> DataFrame:
    """Distinct ``(column, label)`` over train and test, all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("label").isNotNull()).distinct()


def fit_labels(rows: DataFrame, columns: tuple[str, ...] = LABEL_COLUMNS) -> DataFrame:
    """Stored ``(column, label, code)``: codes 0.. in label order per column."""
    ranked = with_rank_within(stacked_labels(rows, columns), ["column"], ["label"], "code", 0)
    return store(ranked.select("column", "label", F.col("code").cast("int").alias("code")), "labels")


def label_codes(
    rows: DataFrame, labels: DataFrame, columns: tuple[str, ...] = LABEL_COLUMNS, suffix: str = "_code",
    max_bytes: int | None = None,
) -> DataFrame:
    """Add a code per column; a value that was not fitted raises."""
    for c in columns:
        own = labels.where(F.col("column") == c).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
        keyed = rows.withColumn("_label", F.col(c).cast("string"))
        unseen = F.raise_error(F.concat(F.lit(f"unseen label in {c}: "), F.coalesce("_label", F.lit("null"))))
        rows = (
            lookup_join(keyed, own, ["_label"], "left", max_bytes=max_bytes)
            .withColumn(c + suffix, F.when(F.col("_code").isNull(), unseen.cast("int")).otherwise(F.col("_code")))
            .drop("_label", "_code")
        )
    return rows


def label_sizes(labels: DataFrame, columns: tuple[str, ...] = LABEL_COLUMNS) -> dict[str, Column]:
    """``max(code) + 1`` per column, as aggregate expressions over the label table."""
    return {c: F.max(F.when(F.col("column") == c, F.col("code"))) + 1 for c in columns}


def max_code_sizes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of vocabulary sizes: label columns and condition fitted, text sizes constant."""
    sizes = label_sizes(labels)
    condition = rows.agg(F.max("item_condition_id") + 1).scalar()
    return labels.agg(
        sizes["cat_1"].alias("max_cat_1"), sizes["cat_2"].alias("max_cat_2"), sizes["cat_3"].alias("max_cat_3"),
        sizes["brand_name"].alias("max_brand"),
    ).select(
        "*", condition.alias("max_condition"),
        F.lit(fixed.NAME_SEQUENCE).alias("max_name_seq"), F.lit(fixed.DESCRIPTION_SEQUENCE).alias("max_item_desc_seq"),
        F.lit(fixed.MAX_WORDS + 1).alias("max_text"),
    )


def one_hot(rows: DataFrame, code: str, block: str) -> DataFrame:
    """Long form of one column per code."""
    return rows.select("item_id", F.lit(block).alias("block"), F.col(code).alias("code"), F.lit(1.0).alias("value"))


def positioned_tokens(rows: DataFrame, columns: tuple[str, ...], keep: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Long table ``(*keep, field, pos, token)``; an item without tokens gets one row with an empty token."""
    def placed(column: str) -> Column:
        return F.transform(sequence_tokens(column), lambda t, i: F.struct(
            F.lit(column).alias("field"), i.alias("pos"), t.alias("token")))

    per_field = [placed(c) for c in columns]
    rows = rows.select(*keep, F.explode_outer(F.concat(*per_field)).alias("t"))
    return rows.select(*keep, "t.field", "t.pos", F.coalesce("t.token", F.lit("")).alias("token"))


def _fits(tables: list[DataFrame], max_bytes: int | None) -> bool:
    return sum(measured_bytes(t) for t in tables) <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def _numbered(
    rows: DataFrame, texts: dict[str, Column], codes: dict[str, Column], index: DataFrame, labels: DataFrame | None,
    keep: tuple[str, ...],
) -> DataFrame:
    """``(*keep, *texts, *codes)``: word lists as numbers of the known ones, labels as codes, looked up inside the row.

    ``index`` and ``labels`` are held by every task, so the caller has measured them; nothing is exploded or shuffled. A label
    that was not fitted raises.
    """
    def held(table: DataFrame, word: str, number: str) -> tuple[pa.Array, np.ndarray]:
        got = table.select(word, number).toArrow()
        return got.column(0).combine_chunks(), got.column(1).to_numpy()

    known = {"": held(index, "token", "idx")}
    known |= {c: held(labels.where(F.col("column") == c), "label", "code") for c in codes}
    known = rows.sparkSession.sparkContext.broadcast(known)
    names, n_keep, n_texts, labelled = [*keep, *texts, *codes], len(keep), len(texts), list(codes)

    def numbers_of(words: pa.Array, table: tuple[pa.Array, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = pc.index_in(words, value_set=table[0].cast(words.type))
        return at.is_valid().to_numpy(zero_copy_only=False), table[1][at.drop_null().to_numpy()].astype(np.int32)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(batch.columns[:n_keep])
            for i in range(n_texts):
                lists = batch.column(n_keep + i)
                lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                found, numbers = numbers_of(lists.flatten(), known.value[""])
                row = np.repeat(np.arange(len(lists)), lengths)[found]
                ends = np.cumsum(np.bincount(row, minlength=len(lists)))
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(numbers)))
            for i, c in enumerate(labelled):
                values = batch.column(n_keep + n_texts + i)
                found, numbers = numbers_of(values, known.value[c])
                if not found.all():
                    raise ValueError(f"unseen label in {c}: {values[int(np.argmin(found))].as_py()}")
                out.append(pa.array(numbers))
            yield pa.RecordBatch.from_arrays(out, names)

    schema = T.StructType([
        *(rows.schema[c] for c in keep), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in texts),
        *(T.StructField(c, T.IntegerType()) for c in codes)])
    made = rows.select(*keep, *[e.alias(c) for c, e in (texts | codes).items()])
    return made.mapInArrow(number, schema)


def texts_to_sequences(
    rows: DataFrame, index: DataFrame, columns: tuple[str, ...] = ("name", "item_description"),
    keep: tuple[str, ...] = ("item_id",), max_bytes: int | None = None,
) -> DataFrame:
    """Per item and text column the word indices in order (``<column>_seq``); unknown words are dropped.

    An index measured within ``max_bytes`` is looked up inside the row. Beyond it all columns share one lookup join and one
    grouping.
    """
    if _fits([index], max_bytes):
        return _numbered(rows, {f"{c}_seq": sequence_tokens(c) for c in columns}, {}, index, None, keep)
    hit = lookup_join(positioned_tokens(rows, columns, keep), index, ["token"], "left", max_bytes=max_bytes)
    place = F.struct("pos", "idx")
    grouped = hit.groupBy(*keep).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("idx").isNotNull() & (F.col("field") == c), place))).alias(c)
        for c in columns
    ])
    return grouped.select(*keep, *[F.transform(c, lambda e: e["idx"]).alias(f"{c}_seq") for c in columns])


def padded_sequences(sequences: DataFrame) -> DataFrame:
    return sequences.withColumns({
        "name_seq": pad_sequence(F.col("name_seq"), fixed.NAME_SEQUENCE),
        "item_description_seq": pad_sequence(F.col("item_description_seq"), fixed.DESCRIPTION_SEQUENCE),
    })


def model_input_row(
    rows: DataFrame, index: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("item_id",),
    max_bytes: int | None = None,
) -> DataFrame:
    """The embedding model's named inputs: words and labels of all columns in one lookup and one grouping.

    Tables measured within ``max_bytes`` are looked up inside the row. Beyond it every word and every label is a narrow row
    ``(*keep, field, pos, token)``, so no text is carried through the join. A label that was not fitted raises.
    """
    texts = ("name", "item_description")
    label_token = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(_NO_LABEL))

    def words_of(c: str) -> Column:
        return F.transform(sequence_tokens(c), lambda t, i: F.struct(F.lit(c).alias("field"), i.alias("pos"), t.alias("token")))

    def label_of(c: str) -> Column:
        return F.array(F.struct(F.lit(c).alias("field"), F.lit(0).alias("pos"), label_token(c).alias("token")))

    def inputs_of(numbered: DataFrame) -> DataFrame:
        return padded_sequences(numbered).select(
            *keep, F.col("name_seq").alias("name"), F.col("item_description_seq").alias("item_desc"), *LABEL_COLUMNS,
            F.col("item_condition_id").alias("item_condition"), F.col("shipping").alias("num_vars"),
        )

    carried = (*keep, "item_condition_id", "shipping")
    if _fits([index, labels], max_bytes):
        words, codes = {f"{c}_seq": sequence_tokens(c) for c in texts}, {c: label_token(c) for c in LABEL_COLUMNS}
        return inputs_of(_numbered(rows, words, codes, index, labels, carried))
    long = rows.select(*carried, F.explode(F.concat(*[words_of(c) for c in texts], *[label_of(c) for c in LABEL_COLUMNS])).alias("t"))
    kind = F.when(F.col("t.field").isin(*texts), "").otherwise(F.col("t.field"))
    long = long.select(*carried, "t.field", "t.pos", kind.alias("kind"), "t.token")
    table = index.select(F.lit("").alias("kind"), "token", "idx").unionByName(
        labels.select(F.col("column").alias("kind"), F.col("label").alias("token"), F.col("code").alias("idx")))
    hit = lookup_join(long, store(table, "words-and-labels"), ["kind", "token"], "left", max_bytes=max_bytes)
    found = F.col("idx").isNotNull()
    sequence = lambda c: F.sort_array(F.collect_list(F.when(found & (F.col("field") == c), F.struct("pos", "idx"))))
    grouped = hit.groupBy(*carried).agg(
        *[sequence(c).alias(c) for c in texts],
        *[F.max(F.when(F.col("field") == c, F.struct(F.col("idx"), F.col("token")))).alias(c) for c in LABEL_COLUMNS])

    def code(c: str) -> Column:
        unseen = F.raise_error(F.concat(F.lit(f"unseen label in {c}: "), F.col(f"{c}.token")))
        return F.when(F.col(f"{c}.idx").isNull(), unseen.cast("int")).otherwise(F.col(f"{c}.idx"))

    numbers = [F.transform(c, lambda e: e["idx"]).alias(f"{c}_seq") for c in texts]
    return inputs_of(grouped.select(*carried, *numbers, *[code(c).alias(c) for c in LABEL_COLUMNS]))
