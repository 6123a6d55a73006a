"""Queries on sources, sinks, cleaning and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright import fixed
from tagwright.catalog.base import mean_predictor, measures, no_stopwords, query, rounded, text, tokens
from tagwright.functions import category, metrics
from tagwright.functions import text as X
from tagwright.operators import brands, clean, encode, features, vocabulary
from tagwright.plans import flows
from tagwright.sources import tsv
from tagwright.storage import scratch_path

# ---- sources and sinks ----

_FILE = "name, item_condition_id, category_name, brand_name, {price}shipping, item_description"


@query("scan_train", f"SELECT item_id AS train_id, {_FILE.format(price='price, ')} FROM t WHERE split = 'train'")
def scan_train(t: DataFrame) -> DataFrame:
    path = scratch_path(t.sparkSession, "train-tsv")
    tsv.write_tsv(t.where("split = 'train'").selectExpr("item_id AS train_id", *_FILE.format(price="price, ").split(", ")), path)
    return tsv.read_train(t.sparkSession, path, multiline=True)  # descriptions hold line breaks


@query("scan_test", f"SELECT item_id AS test_id, {_FILE.format(price='')} FROM t WHERE split = 'test'")
def scan_test(t: DataFrame) -> DataFrame:
    path = scratch_path(t.sparkSession, "test-tsv")
    tsv.write_tsv(t.where("split = 'test'").selectExpr("item_id AS test_id", *_FILE.format(price="").split(", ")), path)
    return tsv.read_test(t.sparkSession, path, multiline=True)


_CODES = """
SELECT item_id, item_condition_id, CAST(dense_rank() OVER (ORDER BY CAST(item_condition_id AS VARCHAR)) - 1 AS INT) AS condition_code,
       shipping, CAST(dense_rank() OVER (ORDER BY CAST(shipping AS VARCHAR)) - 1 AS INT) AS shipping_code FROM t"""


@query("scan_typed_categories", _CODES)
def scan_typed_categories(t: DataFrame) -> DataFrame:
    columns = ("item_condition_id", "shipping")
    coded = encode.label_codes(t.select("item_id", *columns), encode.fit_labels(t, columns), columns)
    return coded.select("item_id", "item_condition_id", F.col("item_condition_id_code").alias("condition_code"),
                        "shipping", F.col("shipping_code").alias("shipping_code"))


@query("sink_submission", "SELECT CAST(item_id AS BIGINT) AS test_id, round(pred, 6) AS price FROM mean_category_name",
       "mean_category_name")
def sink_submission(t: DataFrame) -> DataFrame:
    path = scratch_path(t.sparkSession, "submission")
    predictions = mean_predictor(t, "category_name").select(F.col("item_id").alias("test_id"), rounded("pred", "price"))
    tsv.write_submission(predictions, path)
    return t.sparkSession.read.schema("test_id bigint, price double").option("header", True).csv(path)


@query("table_shape", """
SELECT 'train' AS tbl, count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns FROM t WHERE split = 'train'
UNION ALL SELECT 'test', count(*), 7 FROM t WHERE split = 'test'
UNION ALL SELECT 'tree features', (SELECT count(*) FROM t WHERE split = 'train'), (SELECT count(*) FROM tree_features)
UNION ALL SELECT 'linear features', (SELECT count(*) FROM t WHERE split = 'train'), (SELECT count(*) FROM linear_features)""",
       "t tree_features linear_features")
def table_shape(t: DataFrame) -> DataFrame:
    columns = len(t.columns) - 1
    per_part = t.groupBy("split").agg(F.count("*").alias("n_rows")).select(
        F.col("split").alias("tbl"), "n_rows",
        F.when(F.col("split") == "train", columns).otherwise(columns - 1).cast("bigint").alias("n_columns"))
    train = t.where("split = 'train'")
    n = train.agg(F.count("*"))
    fitted = features.fit_tree_features(features.explode_blocks(clean.clean_tree(train), features.tree_entries()), n.scalar())
    matrix = fitted.agg(F.count("*").alias("n_columns")).select(
        F.lit("tree features").alias("tbl"), n.scalar().alias("n_rows"), "n_columns")
    linear = features.fit_linear_features(flows.linear_long(t, "md5", ("item_id", "split")).where("split = 'train'"), n.scalar())
    linear = linear.agg(F.count("*").alias("n_columns")).select(
        F.lit("linear features").alias("tbl"), n.scalar().alias("n_rows"), "n_columns")
    return per_part.unionByName(matrix).unionByName(linear)


@query("preview_head", """
SELECT item_id, round(pred, 6) AS pred, cat_1, cat_2, cat_3 FROM mean_category_name JOIN emb USING (item_id)
ORDER BY item_id LIMIT 10""", "mean_category_name emb")
def preview_head(t: DataFrame) -> DataFrame:
    """The first predictions, with the split categories of their listings."""
    parts = clean.clean_embedding(t.where("split = 'test'")).select("item_id", "cat_1", "cat_2", "cat_3")
    scored = mean_predictor(t, "category_name").select("item_id", rounded("pred", "pred"))
    return scored.join(parts, "item_id").orderBy("item_id").limit(10)


# ---- projections, filters, predicates ----

@query("filter_nonzero_price", "SELECT item_id, split, price FROM t WHERE price IS NULL OR price <> 0")
def filter_nonzero_price(t: DataFrame) -> DataFrame:
    return clean.filter_nonzero_price(t).select("item_id", "split", "price")


@query("fill_missing_constant", """
SELECT item_id, coalesce(category_name, 'missing') AS category_name, coalesce(brand_name, 'missing') AS brand_name,
       coalesce(item_description, 'missing') AS item_description FROM t""")
def fill_missing_constant(t: DataFrame) -> DataFrame:
    return clean.fill_missing(t, fixed.FILL_CONSTANT).select("item_id", *fixed.FILL_CONSTANT)


@query("fill_missing_tree", "SELECT item_id, name, category_name, brand_name, item_description FROM tree", "tree")
def fill_missing_tree(t: DataFrame) -> DataFrame:
    return clean.fill_missing(t, fixed.FILL_TREE).select("item_id", *fixed.FILL_TREE)


@query("fill_missing_linear", "SELECT item_id, name, category_name, brand_name, item_description FROM filled", "filled")
def fill_missing_linear(t: DataFrame) -> DataFrame:
    return clean.fill_linear(t).select("item_id", *fixed.FILL_LINEAR)


@query("missing_flags", "SELECT item_id, has_category, has_brand FROM filled", "filled")
def missing_flags(t: DataFrame) -> DataFrame:
    return clean.missing_flags(t).select("item_id", "has_category", "has_brand")


@query("category_split_strict", "SELECT item_id, general_cat, subcat_1, subcat_2, gen_subcat1 FROM clean", "clean")
def category_split_strict(t: DataFrame) -> DataFrame:
    return clean.category_parts(clean.fill_linear(t)).select("item_id", "general_cat", "subcat_1", "subcat_2", "gen_subcat1")


@query("category_split_padded", """
SELECT item_id, p[1] AS cat_1, coalesce(p[2], 'missing') AS cat_2, coalesce(p[3], 'missing') AS cat_3
FROM (SELECT item_id, string_split(coalesce(category_name, 'missing'), '/') AS p FROM t)""")
def category_split_padded(t: DataFrame) -> DataFrame:
    return clean.clean_embedding(t).select("item_id", "cat_1", "cat_2", "cat_3")


_CONDITION_SQL = """
SELECT item_id, general_cat || '_' || item_condition_id AS gencat_cond, subcat_1 || '_' || item_condition_id AS subcat_1_cond,
       subcat_2 || '_' || item_condition_id AS subcat_2_cond FROM clean"""


@query("composite_condition_keys", _CONDITION_SQL, "clean")
def composite_condition_keys(t: DataFrame) -> DataFrame:
    return clean.clean_linear(t).select("item_id", "gencat_cond", "subcat_1_cond", "subcat_2_cond")


@query("name_with_brand", "SELECT item_id, name FROM named", "named")
def name_with_brand(t: DataFrame) -> DataFrame:
    return brands.name_with_brand(brands.impute_brands(clean.clean_linear(t))).select("item_id", "name")


@query("cast_to_string", """
SELECT item_id, CAST(shipping AS VARCHAR) AS shipping, CAST(item_condition_id AS VARCHAR) AS item_condition_id, name,
       category_name, brand_name FROM tree""", "tree")
def cast_to_string(t: DataFrame) -> DataFrame:
    return clean.clean_tree(t).select("item_id", "shipping", "item_condition_id", "name", "category_name", "brand_name")


@query("select_field", f"SELECT item_id, name, price, condition_code FROM t JOIN ({_CODES}) USING (item_id)")
def select_field(t: DataFrame) -> DataFrame:
    columns = ("item_condition_id",)
    coded = encode.label_codes(t.select("item_id", "name", "price", *columns), encode.fit_labels(t, columns), columns)
    return coded.select("item_id", "name", "price", F.col("item_condition_id_code").alias("condition_code"))


@query("filter_empty_brand", "SELECT item_id, name FROM clean WHERE brand_name = ''", "clean")
def filter_empty_brand(t: DataFrame) -> DataFrame:
    return clean.clean_linear(t).where("brand_name = ''").select("item_id", "name")


@query("filter_multiword_brand", "SELECT brand_name, count(*) AS cnt, contains(brand_name, ' ') AS multiword FROM t "
       "WHERE brand_name IS NOT NULL GROUP BY brand_name")
def filter_multiword_brand(t: DataFrame) -> DataFrame:
    counts = brands.brand_counts(t)
    many, one = brands.multiword_brands(counts), brands.multiword_brands(counts, keep=False)
    return many.withColumn("multiword", F.lit(True)).unionByName(one.withColumn("multiword", F.lit(False)))


@query("log_target", "SELECT item_id, round(ln(1 + price), 6) AS label FROM t")
def log_target(t: DataFrame) -> DataFrame:
    return t.select("item_id", rounded(F.log1p("price"), "label"))


@query("price_from_log", "SELECT item_id, round(exp(p) - 1, 6) AS price FROM (SELECT item_id, price / 10 AS p FROM t)")
def price_from_log(t: DataFrame) -> DataFrame:
    return t.select("item_id", rounded(metrics.price_from_log(F.col("price") / 10), "price"))


@query("floor_price", """
SELECT item_id, round(CASE WHEN p < 3 THEN 3.0 ELSE p END, 6) AS price
FROM (SELECT item_id, CASE WHEN item_description IS NOT NULL THEN price - 20 END AS p FROM t)""")
def floor_price(t: DataFrame) -> DataFrame:
    shifted = F.when(F.col("item_description").isNotNull(), F.col("price") - 20)
    return t.select("item_id", rounded(metrics.floor_price(shifted), "price"))


@query("replace_placeholder", f"""
SELECT item_id, CASE WHEN item_description = {text(fixed.PLACEHOLDER)} THEN '' ELSE item_description END AS as_written,
       CASE WHEN item_description = lower({text(fixed.PLACEHOLDER)}) THEN '' ELSE item_description END AS intended
FROM filled""", "filled")
def replace_placeholder(t: DataFrame) -> DataFrame:
    d = F.col("item_description")
    return clean.fill_linear(t).select("item_id", clean.replace_placeholder(d).alias("as_written"),
                                       clean.replace_placeholder(d, "intended").alias("intended"))


@query("positional_ids", """
SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS position FROM t WHERE price IS NULL OR price <> 0""")
def positional_ids(t: DataFrame) -> DataFrame:
    return clean.positional_ids(clean.filter_nonzero_price(t).select("item_id"))


# ---- strings and tokenisers ----

@query("lowercase_text", """
SELECT item_id, lower(name) AS name, lower(brand_name) AS brand_name, lower(category_name) AS category_name,
       lower(item_description) AS item_description FROM t""")
def lowercase_text(t: DataFrame) -> DataFrame:
    return t.select("item_id", *[F.lower(c).alias(c) for c in ("name", "brand_name", "category_name", "item_description")])


@query("normalise_karats", f"""
SELECT item_id, regexp_replace(name, {text(fixed.KARATS)}, '\\1k\\4', 'g') AS name,
       regexp_replace(item_description, {text(fixed.KARATS)}, '\\1k\\4', 'g') AS item_description FROM filled""", "filled")
def normalise_karats(t: DataFrame) -> DataFrame:
    return clean.fill_linear(t).select(
        "item_id", *[X.normalise_karats(F.col(c)).alias(c) for c in ("name", "item_description")])


@query("glue_units", f"""
SELECT item_id, {measures('name')} AS name, {measures('item_description')} AS item_description FROM filled""", "filled")
def glue_units(t: DataFrame) -> DataFrame:
    return clean.normalise_text(clean.fill_linear(t)).select("item_id", "name", "item_description")


def _both(fn) -> list:
    return [F.array_join(fn(F.col(c)), "|").alias(c) for c in ("name", "item_description")]


def _both_sql(expression) -> str:
    return ", ".join(f"array_to_string({expression(c)}, '|') AS {c}" for c in ("name", "item_description"))


@query("brand_tokens", f"SELECT item_id, {_both_sql(lambda c: tokens(c, fixed.BRAND_WORD))} FROM clean", "clean")
def brand_tokens(t: DataFrame) -> DataFrame:
    return clean.clean_linear(t).select("item_id", *_both(X.brand_tokens))


@query("leading_two_words", "SELECT item_id, " + ", ".join(
    f"regexp_extract({c}, {text('^' + fixed.TWO_BRAND_WORDS)}) AS {c}" for c in ("name", "item_description")) + " FROM clean",
       "clean")
def leading_two_words(t: DataFrame) -> DataFrame:
    return clean.clean_linear(t).select(
        "item_id", *[X.leading_two_words(F.col(c)).alias(c) for c in ("name", "item_description")])


# Pieces between single whitespace characters; a pair is a piece of brand characters only and the start of the next one.
_PAIRS = " UNION ALL ".join(f"""
SELECT item_id, '{c}' AS field,
       array_to_string([ws[i] || p[i + 1] || ws[i + 1] || regexp_extract(p[i + 2], {text('^' + fixed.BRAND_WORD)})
         for i in range(1, len(ws))
         if regexp_full_match(p[i + 1], {text(fixed.BRAND_WORD)}) AND regexp_matches(p[i + 2], {text('^' + fixed.BRAND_WORD)})],
         '|') AS pairs
FROM (SELECT item_id, string_split_regex({c}, {text(f'[{fixed.SPACE}]')}) AS p,
             {tokens(c, f'[{fixed.SPACE}]')} AS ws FROM clean)""" for c in ("name", "item_description"))


@query("sliding_two_words", _PAIRS, "clean")
def sliding_two_words(t: DataFrame) -> DataFrame:
    rows = clean.clean_linear(t)
    fields = F.array(*[
        F.struct(F.lit(c).alias("field"), F.array_join(X.sliding_two_words(F.col(c)), "|").alias("pairs"))
        for c in ("name", "item_description")])
    return rows.select("item_id", F.explode(fields).alias("f")).select("item_id", "f.*")


@query("letter_words", f"SELECT item_id, {_both_sql(lambda c: tokens(f'lower({c})', fixed.LETTER_WORD))} FROM t")
def letter_words(t: DataFrame) -> DataFrame:
    return t.select("item_id", *_both(X.letter_words))


@query("word_tokens", f"SELECT item_id, {_both_sql(lambda c: tokens(c, fixed.WORD_TOKEN))} FROM filled", "filled")
def word_tokens(t: DataFrame) -> DataFrame:
    return clean.fill_linear(t).select("item_id", *_both(X.word_tokens))


@query("remove_stopwords",
       f"SELECT item_id, {_both_sql(lambda c: no_stopwords(tokens(c, fixed.WORD_TOKEN)))} FROM filled", "filled")
def remove_stopwords(t: DataFrame) -> DataFrame:
    return clean.fill_linear(t).select("item_id", *_both(lambda c: X.remove_stopwords(X.word_tokens(c))))


@query("word_ngrams", "SELECT item_id, block, array_to_string(g, '|') AS grams FROM linear_words WHERE block <> 'category_name'",
       "linear_words")
def word_ngrams(t: DataFrame) -> DataFrame:
    # descriptions do not depend on the imputed brand and stay out of its join
    cleaned = clean.clean_linear(t)
    named = brands.name_with_brand(brands.impute_brands(cleaned, keep=("item_id", "name", "brand_name")))
    grams = [rows.select("item_id", F.lit(c).alias("block"), F.array_join(features.text_ngrams(c), "|").alias("grams"))
             for rows, c in ((named, "name"), (cleaned, "item_description"))]
    return grams[0].unionByName(grams[1])


@query("whole_value_token", """
SELECT item_id, 'brand_name' AS block, brand_name AS token FROM filled WHERE brand_name <> ''
UNION ALL SELECT item_id, 'category_name', category_name FROM filled WHERE category_name <> ''""", "filled")
def whole_value_token(t: DataFrame) -> DataFrame:
    rows = clean.fill_linear(t)
    fields = F.array(*[
        F.struct(F.lit(c).alias("block"), X.whole_value_tokens(F.col(c)).alias("tokens")) for c in ("brand_name", "category_name")])
    return rows.select("item_id", F.explode(fields).alias("f")).select(
        "item_id", "f.block", F.explode("f.tokens").alias("token"))


@query("digit_tokens", f"""
SELECT item_id, array_to_string({tokens('shipping', fixed.DIGIT_TOKEN)}, '|') AS shipping,
       array_to_string({tokens('item_condition_id', fixed.DIGIT_TOKEN)}, '|') AS item_condition_id FROM tree""", "tree")
def digit_tokens(t: DataFrame) -> DataFrame:
    return t.select("item_id", *[
        F.array_join(X.digit_tokens(F.col(c)), "|").alias(c) for c in ("shipping", "item_condition_id")])


@query("category_path_tokens", """
SELECT item_id, general_cat || '|' || subcat_1 || '|' || subcat_2 || '|' || gen_subcat1 AS tokens FROM clean""", "clean")
def category_path_tokens(t: DataFrame) -> DataFrame:
    return clean.fill_linear(t).select(
        "item_id", F.array_join(category.path_tokens(F.col("category_name")), "|").alias("tokens"))


@query("filter_char_tokens", """
SELECT item_id, field, coalesce(tokens, '') AS tokens
FROM (SELECT item_id, unnest(['name', 'item_description']) AS field FROM emb)
LEFT JOIN (SELECT item_id, field, array_to_string(list(token ORDER BY pos), '~') AS tokens FROM seq_tokens
           GROUP BY item_id, field) USING (item_id, field)""", "emb seq_tokens")
def filter_char_tokens(t: DataFrame) -> DataFrame:
    rows = clean.clean_embedding(t.where("split = 'test' or price is null or price <> 0"))
    fields = F.array(*[
        F.struct(F.lit(c).alias("field"), F.array_join(vocabulary.sequence_tokens(c), "~").alias("tokens"))
        for c in ("name", "item_description")])
    return rows.select("item_id", F.explode(fields).alias("f")).select("item_id", "f.*")


# ---- row functions ----

@query("row_function", _CONDITION_SQL.replace("SELECT item_id,", "SELECT item_id, gen_subcat1,"), "clean")
def row_function(t: DataFrame) -> DataFrame:
    rows = clean.condition_keys(clean.category_parts(clean.fill_linear(t)))
    return rows.select("item_id", "gen_subcat1", "gencat_cond", "subcat_1_cond", "subcat_2_cond")
