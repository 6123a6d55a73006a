"""Tab-separated listing files and the submission sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright import fixed, schema
from tagwright.sources.quoted import read_records


def fold_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn every missing-value marker in the string columns into null."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*fixed.NA_MARKERS), F.col(c)) for c in columns})


_FORMAT = {"mode": "FAILFAST", "sep": "\t", "quote": '"', "escape": '"'}


def _read(spark: SparkSession, path: str, file_schema: T.StructType, multiline: bool) -> DataFrame:
    # Numbers are read as text first: a marker such as 'NA' in a number column is missing, not malformed.
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in file_schema.fields])
    if multiline:
        fields = F.from_csv("record", as_text.simpleString()[7:-1].replace(":", " "), _FORMAT | {"multiLine": "true"})
        raw = read_records(spark, path).select(fields.alias("r")).select("r.*")
    else:
        # Pruned columns would hide broken records, so all columns are parsed and a record of another width is an error.
        raw = spark.read.schema(as_text).options(**_FORMAT).option("columnPruning", False).option("header", True).csv(path)
    folded = fold_missing(raw)
    return folded.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in file_schema.fields])


def read_train(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Train listings (with ``price``).

    A file is split between tasks. Where every record is one line it is read once, and a line break inside quotes is an
    error. Pass ``multiline=True`` for files that have such breaks: they are split as well, but read twice.
    """
    return _read(spark, path, schema.TRAIN_FILE, multiline)


def read_test(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Test listings (with ``test_id``, without ``price``)."""
    return _read(spark, path, schema.TEST_FILE, multiline)


def write_tsv(df: DataFrame, path: str) -> None:
    """Write listings in the form the readers take; doubled quotes, header, null as an empty field."""
    (
        df.write.option("sep", "\t").option("header", True)
        .option("quote", '"').option("escape", '"').option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def as_listings(train: DataFrame, test: DataFrame) -> DataFrame:
    """Stack the two files into the one listing table; test rows have no price."""
    columns = [f.name for f in schema.LISTING.fields]
    a = train.withColumnRenamed("train_id", "item_id").withColumn("split", F.lit("train"))
    b = test.withColumnRenamed("test_id", "item_id").withColumn("split", F.lit("test"))
    return a.unionByName(b, allowMissingColumns=True).select(*columns)


def submission(predictions: DataFrame, price: str | Column = "price") -> DataFrame:
    """The submission frame: 64-bit ``test_id`` and ``price``."""
    price = F.col(price) if isinstance(price, str) else price
    return predictions.select(F.col("test_id").cast("bigint").alias("test_id"), price.alias("price"))


def write_submission(predictions: DataFrame, path: str) -> None:
    """Write the submission as a folder of CSV part files, each with a header."""
    submission(predictions).write.option("header", True).csv(path)
