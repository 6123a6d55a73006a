"""Queries on feature blocks, encodings and sequences."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright import fixed
from tagwright.catalog.base import query, rounded, tokens
from tagwright.catalog.lookups import _index, _is_train, _tree_long, _usable
from tagwright.functions import category
from tagwright.functions import text as X
from tagwright.functions.arrays import exploded
from tagwright.functions.hashing import bucket_codes
from tagwright.operators import clean, encode, features, models, vocabulary
from tagwright.operators.stages import CountBlock, DropByDf
from tagwright.plans import flows


def _linear_long(t: DataFrame) -> DataFrame:
    return flows.linear_long(t, "md5", ("item_id", "split"), scope=())


def _summary(long: DataFrame, *keys: str) -> DataFrame:
    """Per item (and block): entries, sum, and extremes of the values."""
    return long.groupBy(*keys).agg(
        F.count("*").alias("n"), rounded(F.sum("value"), "total"), rounded(F.min("value"), "lowest"),
        rounded(F.max("value"), "highest"))


def _summary_sql(source: str, keys: str) -> str:
    return (f"SELECT {keys}, count(*) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS lowest, "
            f"round(max(value), 6) AS highest FROM {source} GROUP BY {keys}")


# ---- hashed, counted and weighted blocks ----

@query("hashed_features", """
SELECT item_id, block, count(*) AS n, round(sum(value), 6) AS total, CAST(sum(CAST(feature AS BIGINT)) AS BIGINT) AS sum_buckets,
       round(sum(value * (CAST(feature AS BIGINT) % 1000)), 6) AS weighted FROM hashed GROUP BY item_id, block""", "hashed")
def hashed_features(t: DataFrame) -> DataFrame:
    long = _linear_long(t).where(F.col("block").isin("name", "category_name", "item_description"))
    bucket = F.col("feature").cast("bigint")
    return long.groupBy("item_id", "block").agg(
        F.count("*").alias("n"), rounded(F.sum("value"), "total"), F.sum(bucket).alias("sum_buckets"),
        rounded(F.sum(F.col("value") * (bucket % 1000)), "weighted"))


_M = 4294967295
_MUL = "(({x})::HUGEINT * {f} % 4294967296)::BIGINT"
_ROT = "((({x}) << {r}) | (({x}) >> {s})) & 4294967295"


def _mixed_sql(k: str) -> str:
    turned = _ROT.format(x=_MUL.format(x=k, f=0xCC9E2D51), r=15, s=17)
    return _MUL.format(x=turned, f=0x1B873593)


def _four_bytes(at: str) -> str:
    return "('0x' || " + " || ".join(f"substr(d, {at} + {i}, 2)" for i in (7, 5, 3, 1)) + ")::BIGINT"


_BLOCK_SQL = _ROT.format(x=f"xor(h, {_mixed_sql('k')})", r=13, s=19)


@query("murmur_buckets", f"""
SELECT token, CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END % {fixed.HASH_BUCKETS} AS bucket, h >= 2147483648 AS negative
FROM (SELECT token, xor(h, h >> 16) AS h
FROM (SELECT token, {_MUL.format(x='xor(h, h >> 13)', f=0xC2B2AE35)} AS h
FROM (SELECT token, {_MUL.format(x='xor(h, h >> 16)', f=0x85EBCA6B)} AS h
FROM (SELECT token, xor(xor(h, {_mixed_sql('tail')}), n) AS h
FROM (SELECT token, n, ('0x' || t[7:8] || t[5:6] || t[3:4] || t[1:2])::BIGINT AS tail, list_reduce(
        list_concat([0::BIGINT], list_transform(range(0, n // 4), lambda i: {_four_bytes('8 * i')})),
        lambda h, k: (({_BLOCK_SQL}) * 5 + 3864292196) & {_M}) AS h
FROM (SELECT token, d, (len(d) // 2)::BIGINT AS n, rpad(substr(d, (len(d) // 8) * 8 + 1, 8), 8, '0') AS t
FROM (SELECT token, hex(encode(token)) AS d FROM (
  SELECT DISTINCT unnest({tokens('lower(name)', fixed.WORD_TOKEN)}) AS token FROM t))))))))""")
def murmur_buckets(t: DataFrame) -> DataFrame:
    """Buckets and signs of the words of names as the original vectoriser has them."""
    words = t.select(F.explode(X.word_tokens(F.lower("name"))).alias("token")).distinct()
    code = F.get(bucket_codes(F.array("token"), method="murmur3"), F.lit(0))
    return words.select("token", code.alias("code")).select(
        "token", F.shiftright("code", 1).alias("bucket"), (F.col("code") % 2 == 1).alias("negative"))


@query("count_features", """
SELECT item_id, block, count(*) AS n, CAST(sum(value) AS BIGINT) AS n_tokens, CAST(sum(fid) AS BIGINT) AS sum_fid
FROM tree_long JOIN tree_features USING (block, feature) GROUP BY item_id, block""", "tree_long tree_features")
def count_features(t: DataFrame) -> DataFrame:
    from tagwright.operators.lookup import lookup_join

    train = _is_train(t)
    fitted = features.fit_tree_features(_tree_long(train), train.agg(F.count("*")).scalar())
    hits = lookup_join(_tree_long(t), fitted.select("block", "feature", "fid"), ["block", "feature"], "inner")
    return hits.groupBy("item_id", "block").agg(
        F.count("*").alias("n"), F.sum("value").cast("bigint").alias("n_tokens"), F.sum("fid").alias("sum_fid"))


@query("tfidf_description", _summary_sql("""(
  SELECT item_id, v / sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS value FROM (
    SELECT item_id, value * idf AS v FROM tree_long JOIN tree_features USING (block, feature) WHERE block = 'item_description'))""",
       "item_id"), "tree_long tree_features")
def tfidf_description(t: DataFrame) -> DataFrame:
    entries = {"item_description": features.tree_entries()["item_description"]}
    train = _is_train(t)
    fitted = features.fit_tree_features(
        features.explode_blocks(clean.clean_tree(train), entries), train.agg(F.count("*")).scalar())
    items = features.weighted(features.explode_blocks(clean.clean_tree(t), entries), fitted, ("item_id",))
    long = exploded(features.description_unit(items), ("item_id",), "entries")
    return _summary(long.select("item_id", "e.value"), "item_id")


@query("tfidf_all_features", _summary_sql("linear_weighted", "item_id"), "linear_weighted")
def tfidf_all_features(t: DataFrame) -> DataFrame:
    items = flows.linear_items_of(_linear_long(t), _is_train(t), ("item_id",)).rows
    return _summary(exploded(items, ("item_id",), "entries").select("item_id", "e.value"), "item_id")


@query("row_l2_norm", _summary_sql("""(
  SELECT item_id, block, value / sqrt(sum(value * value) OVER (PARTITION BY item_id, block)) AS value FROM tree_long)""",
       "item_id, block"), "tree_long")
def row_l2_norm(t: DataFrame) -> DataFrame:
    long = features.explode_blocks(clean.clean_tree(t), features.unit_blocks(features.tree_entries()))
    return _summary(long, "item_id", "block")


@query("cast_float32", "SELECT item_id, round(min(value), 6) AS lowest, round(max(value), 6) AS highest FROM hashed "
       "WHERE block = 'item_description' GROUP BY item_id", "hashed")
def cast_float32(t: DataFrame) -> DataFrame:
    entries = {"item_description": features.linear_entries("md5")["item_description"]}
    long = features.explode_blocks(clean.clean_linear(t), entries)
    return long.groupBy("item_id").agg(rounded(F.min("value"), "lowest"), rounded(F.max("value"), "highest"))


@query("stack_feature_batches", """
SELECT split, block, count(*) AS n_entries, CAST(sum(value) AS BIGINT) AS n_tokens FROM tree_long GROUP BY split, block""", "tree_long")
def stack_feature_batches(t: DataFrame) -> DataFrame:
    keep = ("item_id", "split")
    stacked = _tree_long(_is_train(t), keep).unionByName(_tree_long(t.where("split = 'test'"), keep))
    return stacked.groupBy("split", "block").agg(F.count("*").alias("n_entries"), F.sum("value").cast("bigint").alias("n_tokens"))


@query("feature_union", """
SELECT item_id, count(*) AS n, CAST(sum(fid) AS BIGINT) AS sum_fid, CAST(sum(value * (fid % 1000)) AS BIGINT) AS weighted
FROM tree_long JOIN (SELECT block, feature, row_number() OVER (ORDER BY block, feature) - 1 AS fid
                     FROM (SELECT DISTINCT block, feature FROM tree_long)) USING (block, feature)
GROUP BY item_id""", "tree_long")
def feature_union(t: DataFrame) -> DataFrame:
    long = _tree_long(t)
    united = features.feature_union(long, features.feature_ids(long))
    return united.groupBy("item_id").agg(
        F.count("*").alias("n"), F.sum("fid").alias("sum_fid"),
        F.sum(F.col("value") * (F.col("fid") % 1000)).cast("bigint").alias("weighted"))


@query("custom_tokenizer", """
SELECT item_id, token, count(*) AS n FROM (
  SELECT item_id, unnest([general_cat, subcat_1, subcat_2, gen_subcat1]) AS token FROM clean) GROUP BY item_id, token""", "clean")
def custom_tokenizer(t: DataFrame) -> DataFrame:
    long = vocabulary.term_counts(clean.fill_linear(t), "category_name", category.path_tokens(F.col("category_name")))
    return long.select("item_id", F.col("feature").alias("token"), F.col("value").cast("bigint").alias("n"))


@query("table_transformer", """
SELECT item_id, feature, CAST(value AS BIGINT) AS n FROM tree_long WHERE block = 'name' AND feature IN (
  SELECT feature FROM tree_long WHERE block = 'name' AND split = 'train' GROUP BY feature HAVING count(*) >= 2)""", "tree_long")
def table_transformer(t: DataFrame) -> DataFrame:
    stages = [CountBlock("name", lambda c: X.word_tokens(F.lower(c))), DropByDf(min_df=fixed.MIN_DF)]
    rows = clean.clean_tree(t)
    long = Pipeline(stages=stages).fit(_is_train(rows)).transform(rows)
    return long.select("item_id", "feature", F.col("value").cast("bigint").alias("n"))


# ---- codes ----

@query("label_encode", "SELECT col AS \"column\", label, code FROM labels_", "labels_")
def label_encode(t: DataFrame) -> DataFrame:
    return encode.fit_labels(clean.clean_embedding(_usable(t)))


_CODE_COLUMNS = ("has_brand", "shipping", "item_condition_id")
_CODE_SQL = " UNION ALL ".join(f"""
SELECT item_id, '{c}' AS block, CAST(k.code AS INT) AS code FROM filled x JOIN (
  SELECT v, row_number() OVER (ORDER BY CAST(v AS VARCHAR)) - 1 AS code
  FROM (SELECT DISTINCT {c} AS v FROM filled WHERE split = 'train')) k ON k.v = x.{c}""" for c in _CODE_COLUMNS)


def _category_codes(t: DataFrame) -> DataFrame:
    rows = clean.missing_flags(t).select("item_id", "split", *_CODE_COLUMNS)
    return encode.label_codes(rows, encode.fit_labels(_is_train(rows), _CODE_COLUMNS), _CODE_COLUMNS)


@query("category_codes", _CODE_SQL, "filled")
def category_codes(t: DataFrame) -> DataFrame:
    coded = _category_codes(t)
    pairs = F.array(*[F.struct(F.lit(c).alias("block"), F.col(f"{c}_code").alias("code")) for c in _CODE_COLUMNS])
    return coded.select("item_id", F.explode(pairs).alias("p")).select("item_id", "p.*")


@query("one_hot", f"SELECT item_id, block, code, 1.0 AS value FROM ({_CODE_SQL})".replace("1.0", "CAST(1 AS DOUBLE)"), "filled")
def one_hot(t: DataFrame) -> DataFrame:
    coded = _category_codes(t)
    first, *rest = [encode.one_hot(coded, f"{c}_code", c) for c in _CODE_COLUMNS]
    for r in rest:
        first = first.unionByName(r)
    return first


# ---- sequences ----

@query("texts_to_sequences", """
SELECT item_id, array_to_string(name_seq, ',') AS name_seq, array_to_string(item_description_seq, ',') AS item_description_seq
FROM sequences""", "sequences")
def texts_to_sequences(t: DataFrame) -> DataFrame:
    rows = clean.clean_embedding(_usable(t))
    return _joined(encode.texts_to_sequences(rows, _index(rows)), "name_seq", "item_description_seq")


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in columns})


def _padded_sql(column: str, n: int) -> str:
    return (f"array_to_string(list_concat([0 for i in range(greatest({n} - len({column}), 0))], "
            f"{column}[greatest(len({column}) - {n} + 1, 1):]), ',')")


@query("pad_sequences", f"""
SELECT item_id, {_padded_sql('name_seq', 10)} AS name_seq, {_padded_sql('item_description_seq', 75)} AS item_description_seq
FROM sequences""", "sequences")
def pad_sequences(t: DataFrame) -> DataFrame:
    rows = clean.clean_embedding(_usable(t))
    padded = encode.padded_sequences(encode.texts_to_sequences(rows, _index(rows)))
    return _joined(padded, "name_seq", "item_description_seq")


@query("model_input_row", f"""
SELECT item_id, {_padded_sql('name_seq', 10)} AS name, {_padded_sql('item_description_seq', 75)} AS item_desc,
       brand_code AS brand_name, cat_1_code AS cat_1, cat_2_code AS cat_2, cat_3_code AS cat_3,
       item_condition_id AS item_condition, shipping AS num_vars
FROM coded JOIN sequences USING (item_id)""", "coded sequences")
def model_input_row(t: DataFrame) -> DataFrame:
    rows = clean.clean_embedding(_usable(t))
    return _joined(encode.model_input_row(rows, _index(rows), encode.fit_labels(rows)), "name", "item_desc")


# ---- vectors ----

def by_place(part: str, kind: str) -> Column:
    """Sum of the entries of an array of ``v``, each times its place from 1, in ``kind``: indices times places pass 32 bits."""
    return F.expr(f"aggregate(transform(v.{part}, (x, i) -> CAST(i + 1 AS {kind}) * x), CAST(0 AS {kind}), (s, x) -> s + x)")


@query("assemble_sparse_vector", """
SELECT item_id, count(*) AS n_nonzero, CAST(sum(pos * fid) AS BIGINT) AS index_sum, round(sum(pos * value), 6) AS value_sum
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fid) AS pos FROM linear_weighted JOIN (
  SELECT block, feature, row_number() OVER (ORDER BY block, feature) - 1 AS fid FROM linear_features) USING (block, feature))
GROUP BY item_id""", "linear_weighted linear_features")
def assemble_sparse_vector(t: DataFrame) -> DataFrame:
    items = flows.linear_items_of(_linear_long(t), _is_train(t), ("item_id",))
    vectors = models.assemble(items.rows, items.size)
    parts = "features struct<type:int,size:int,indices:array<int>,values:array<double>>"
    read = vectors.select("item_id", F.from_json(F.to_json(F.struct("features")), parts)["features"].alias("v"))
    return read.select("item_id", F.size("v.indices").cast("bigint").alias("n_nonzero"), by_place("indices", "bigint").alias("index_sum"),
                       rounded(by_place("values", "double"), "value_sum"))
