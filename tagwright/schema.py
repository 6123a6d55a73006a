"""The listing table: one fixed schema, never inferred."""

from pyspark.sql import types as T

TRAIN_FILE = T.StructType([
    T.StructField("train_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("item_condition_id", T.IntegerType()),
    T.StructField("category_name", T.StringType()),
    T.StructField("brand_name", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("shipping", T.IntegerType()),
    T.StructField("item_description", T.StringType()),
])

TEST_FILE = T.StructType([
    T.StructField("test_id", T.LongType()),
    *[f for f in TRAIN_FILE.fields if f.name not in ("train_id", "price")],
])

LISTING = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("split", T.StringType()),
    *[f for f in TRAIN_FILE.fields if f.name != "train_id"],
])

TEXT_COLUMNS = ("name", "category_name", "brand_name", "item_description")
