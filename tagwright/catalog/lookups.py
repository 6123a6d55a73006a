"""Queries on lookups, dictionaries, vocabularies and frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright import fixed
from tagwright.catalog.base import deletes, query, rounded, text, tokens
from tagwright.functions import text as X
from tagwright.operators import brands, clean, encode, features, fuzzy, vocabulary
from tagwright.storage import scratch_path, store


def _is_train(df: DataFrame) -> DataFrame:
    return df.where("split = 'train'")


# ---- brands ----

@query("brand_lookup_exact", """
SELECT DISTINCT item_id, stage, word FROM candidates c SEMI JOIN brands b ON c.word = b.word AND b.multiword = (c.stage <= 2)""",
       "candidates brands")
def brand_lookup_exact(t: DataFrame) -> DataFrame:
    rows = clean.clean_linear(t)
    candidates = brands.brand_candidates(rows.where("brand_name = ''"))
    return brands.brand_lookup(candidates, brands.brand_dictionary(rows)).select("item_id", "stage", "word")


@query("brand_impute", "SELECT item_id, name, has_brand, brand_name FROM imputed", "imputed")
def brand_impute(t: DataFrame) -> DataFrame:
    return brands.impute_brands(clean.clean_linear(t)).select("item_id", "name", "has_brand", "brand_name")


@query("empty_brand_count", """
SELECT (SELECT count(*) FROM clean WHERE brand_name = '') AS n_before,
       (SELECT count(*) FROM imputed WHERE brand_name = '') AS n_after""", "clean imputed")
def empty_brand_count(t: DataFrame) -> DataFrame:
    rows = clean.clean_linear(t)
    before = brands.empty_brand_count(rows).withColumnRenamed("n_empty", "n_before")
    return before.withColumn("n_after", brands.empty_brand_count(brands.impute_brands(rows)).scalar())


@query("brand_value_counts", "SELECT brand_name, count(*) AS cnt FROM t WHERE brand_name IS NOT NULL GROUP BY brand_name")
def brand_value_counts(t: DataFrame) -> DataFrame:
    return brands.brand_counts(t)


# ---- edit distance and fuzzy lookup ----

def _train_words(t: DataFrame) -> DataFrame:
    return store(vocabulary.word_dictionary(_is_train(t), "item_description"), "words")


def _test_words(t: DataFrame) -> DataFrame:
    words = vocabulary.word_dictionary(t.where("split = 'test'"), "item_description")
    return store(words.select(F.col("word").alias("query")), "queries")


_NEW_ROW = """list_reduce(
  list_concat([[CAST(i + 1 AS BIGINT)]], list_transform(range(1, len(word) + 1), lambda j: [j])),
  lambda acc, x: list_append(acc, least(
    cur[x[1] + 1] + 1, acc[x[1]] + 1, cur[x[1]] + CAST(query[i + 1] <> word[x[1]] AS BIGINT),
    CASE WHEN i >= 1 AND x[1] >= 2 AND query[i + 1] = word[x[1] - 1] AND query[i] = word[x[1]]
         THEN prev[x[1] - 1] + 1 ELSE 1000000 END)))"""


@query("edit_distance_osa", f"""
SELECT query, word, CAST(cur[len(word) + 1] AS INT) AS dist FROM (
  WITH RECURSIVE p AS (
    SELECT DISTINCT query, word FROM (
      SELECT lower(brand_name) AS query, regexp_extract(lower(name), {text('^' + fixed.TWO_BRAND_WORDS)}) AS word FROM t)
    WHERE query IS NOT NULL AND word <> ''),
  m AS (
    SELECT query, word, 0 AS i, range(0, len(word) + 1) AS cur, CAST([] AS BIGINT[]) AS prev FROM p
    UNION ALL SELECT query, word, i + 1, {_NEW_ROW}, cur FROM m WHERE i < len(query))
  SELECT * FROM m WHERE i = len(query))""")
def edit_distance_osa(t: DataFrame) -> DataFrame:
    pairs = t.select(F.lower("brand_name").alias("query"), X.leading_two_words(F.lower("name")).alias("word"))
    return fuzzy.score_pairs(pairs.where("query is not null and word <> ''").distinct())


@query("delete_variants", f"""
SELECT word, len(v) AS n_variants, list_min(v) AS first_variant, list_max(v) AS last_variant FROM (
  SELECT word, list_distinct(list_concat(d, flatten([{deletes('w')} for w in d]))) AS v
  FROM (SELECT word, {deletes('word')} AS d FROM words))""", "words")
def delete_variants(t: DataFrame) -> DataFrame:
    words = vocabulary.word_dictionary(_is_train(t), "item_description")
    return words.select("word", X.delete_variants(F.col("word"), 2).alias("v")).select(
        "word", F.size("v").cast("bigint").alias("n_variants"),
        F.array_min("v").alias("first_variant"), F.array_max("v").alias("last_variant"))


@query("fuzzy_dictionary_join", "SELECT query, word, dist, cnt FROM suggestions", "suggestions")
def fuzzy_dictionary_join(t: DataFrame) -> DataFrame:
    return fuzzy.suggestions(_test_words(t), _train_words(t), k=1)


_PLACED = "SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, cnt DESC, word) AS place FROM suggestions"


@query("suggestion_ranking", f"SELECT query, word, dist, cnt, CAST(place AS INT) AS place FROM ({_PLACED})", "suggestions")
def suggestion_ranking(t: DataFrame) -> DataFrame:
    return fuzzy.ranked_suggestions(fuzzy.suggestions(_test_words(t), _train_words(t), k=1))


@query("best_word", f"SELECT l.query, p.word FROM lookups l LEFT JOIN (SELECT * FROM ({_PLACED}) WHERE place = 1) p USING (query)",
       "lookups suggestions")
def best_word(t: DataFrame) -> DataFrame:
    queries = _test_words(t)
    return fuzzy.best_word(queries, fuzzy.suggestions(queries, _train_words(t), k=1))


# ---- code and vocabulary lookups ----

@query("label_code_join", "SELECT item_id, brand_code, cat_1_code, cat_2_code, cat_3_code FROM coded", "coded")
def label_code_join(t: DataFrame) -> DataFrame:
    rows = clean.clean_embedding(_usable(t)).select("item_id", *encode.LABEL_COLUMNS)
    coded = encode.label_codes(rows, encode.fit_labels(rows))
    return coded.select("item_id", F.col("brand_name_code").alias("brand_code"), "cat_1_code", "cat_2_code", "cat_3_code")


def _usable(t: DataFrame) -> DataFrame:
    return t.where("split = 'test' or price is null or price <> 0")


def _index(rows: DataFrame) -> DataFrame:
    return store(vocabulary.token_index(_is_train(rows)), "token-index")


@query("vocabulary_join", """
SELECT item_id, field, count(*) AS n_known, CAST(sum(idx) AS BIGINT) AS sum_idx, CAST(sum(pos * idx) AS BIGINT) AS sum_pos_idx
FROM seq_tokens JOIN token_index USING (token) GROUP BY item_id, field""", "seq_tokens token_index")
def vocabulary_join(t: DataFrame) -> DataFrame:
    from tagwright.operators.lookup import lookup_join

    rows = clean.clean_embedding(_usable(t))
    hits = lookup_join(encode.positioned_tokens(rows, ("name", "item_description")), _index(rows), ["token"], "inner")
    return hits.groupBy("item_id", "field").agg(
        F.count("*").alias("n_known"), F.sum("idx").alias("sum_idx"), F.sum(F.col("pos").cast("bigint") * F.col("idx")).alias("sum_pos_idx"))


# ---- dictionaries ----

@query("word_dictionary", "SELECT word, cnt FROM words", "words")
def word_dictionary(t: DataFrame) -> DataFrame:
    return vocabulary.word_dictionary(_is_train(t), "item_description")


@query("dictionary_stats", f"""
SELECT CAST(sum(cnt) AS BIGINT) AS n_words, count(*) AS n_unique, CAST(max(len(word)) AS INT) AS longest,
       (SELECT count(DISTINCT e) FROM (SELECT unnest(list_append({deletes('word')}, word)) AS e FROM words)) AS n_entries
FROM words""", "words")
def dictionary_stats(t: DataFrame) -> DataFrame:
    return vocabulary.dictionary_stats(_train_words(t), k=1)


@query("dictionary_from_lines", f"""
SELECT word, count(*) AS cnt FROM (SELECT unnest({tokens('lower(name)', fixed.LETTER_WORD)}) AS word FROM t) GROUP BY word""")
def dictionary_from_lines(t: DataFrame) -> DataFrame:
    path = scratch_path(t.sparkSession, "lines")
    t.select(F.col("name").alias("value")).write.text(path)
    return vocabulary.dictionary_from_lines(t.sparkSession, path)


# ---- frequencies and vocabularies ----

def _tree_long(t: DataFrame, keep: tuple[str, ...] = ("item_id",)) -> DataFrame:
    return features.explode_blocks(clean.clean_tree(t), features.tree_entries(), keep)


@query("term_counts", """
SELECT item_id, count(*) AS n_terms, CAST(sum(value) AS BIGINT) AS n_tokens, CAST(max(value) AS BIGINT) AS most
FROM tree_long WHERE block IN ('name', 'item_description') GROUP BY item_id""", "tree_long")
def term_counts(t: DataFrame) -> DataFrame:
    rows = clean.clean_tree(t)
    long = vocabulary.term_counts(rows, "name", X.word_tokens(F.lower("name"))).unionByName(
        vocabulary.term_counts(rows, "item_description", X.word_tokens(F.lower("item_description"))))
    return long.groupBy("item_id").agg(
        F.count("*").alias("n_terms"), F.sum("value").cast("bigint").alias("n_tokens"),
        F.max("value").cast("bigint").alias("most"))


@query("document_frequency", "SELECT block, feature, count(*) AS df FROM tree_long GROUP BY block, feature", "tree_long")
def document_frequency(t: DataFrame) -> DataFrame:
    return vocabulary.document_frequency(_tree_long(t))


@query("drop_features_by_df", """
SELECT item_id, block, count(*) AS n_kept, CAST(sum(value) AS BIGINT) AS n_tokens
FROM tree_long SEMI JOIN (SELECT block, feature FROM tree_long GROUP BY block, feature
  HAVING count(*) >= 2 AND count(*) <= 0.5 * (SELECT count(*) FROM t)) USING (block, feature)
GROUP BY item_id, block""", "tree_long t")
def drop_features_by_df(t: DataFrame) -> DataFrame:
    rows = t.agg(F.count("*")).scalar()
    kept = vocabulary.drop_features_by_df(_tree_long(t), min_df=fixed.MIN_DF, max_df=0.5, rows=rows)
    return kept.groupBy("item_id", "block").agg(F.count("*").alias("n_kept"), F.sum("value").cast("bigint").alias("n_tokens"))


@query("vocabulary_min_df", """
SELECT block, feature, count(*) AS df FROM linear_long
WHERE block IN ('brand_name', 'gencat_cond', 'subcat_1_cond', 'subcat_2_cond') GROUP BY block, feature HAVING count(*) >= 2""",
       "linear_long")
def vocabulary_min_df(t: DataFrame) -> DataFrame:
    rows = brands.impute_brands(clean.clean_linear(t))
    blocks = {b: features.count_block(b, X.whole_value_tokens(F.col(b)))
              for b in ("brand_name", "gencat_cond", "subcat_1_cond", "subcat_2_cond")}
    df = vocabulary.document_frequency(features.explode_blocks(rows, blocks))
    return vocabulary.features_in_range(df, fixed.MIN_DF)


_TOP = """
SELECT '{b}' AS block, feature AS token, CAST(sum(value) AS BIGINT) AS cnt, row_number() OVER (ORDER BY sum(value) DESC, feature) AS rank
FROM tree_long WHERE block = '{b}' GROUP BY feature QUALIFY rank <= {k}"""


@query("vocabulary_top_k", _TOP.format(b="name", k=fixed.NAME_TERMS) + " UNION ALL "
       + _TOP.format(b="item_description", k=fixed.DESCRIPTION_TERMS), "tree_long")
def vocabulary_top_k(t: DataFrame) -> DataFrame:
    rows = clean.clean_tree(t)

    def top(column, k):
        counts = vocabulary.token_counts(rows, X.word_tokens(F.lower(column)))
        return vocabulary.vocabulary_top_k(counts, k).select(F.lit(column).alias("block"), "token", "cnt", "rank")

    return top("name", fixed.NAME_TERMS).unionByName(top("item_description", fixed.DESCRIPTION_TERMS))


@query("token_index_by_frequency", "SELECT token, idx FROM token_index", "token_index")
def token_index_by_frequency(t: DataFrame) -> DataFrame:
    return vocabulary.token_index(clean.clean_embedding(_is_train(_usable(t))))


@query("vocabulary_rank", """
SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) AS rank FROM words""", "words")
def vocabulary_rank(t: DataFrame) -> DataFrame:
    counts = vocabulary.word_dictionary(_is_train(t), "item_description").withColumnRenamed("word", "token")
    return vocabulary.vocabulary_ranks(counts).withColumnRenamed("token", "word")


@query("idf_weights", """
SELECT block, feature, df, round(ln((1 + (SELECT count(*) FROM t WHERE split = 'train')) / (1 + df)) + 1, 6) AS idf
FROM (SELECT block, feature, count(*) AS df FROM tree_long WHERE split = 'train' GROUP BY block, feature)""", "tree_long t")
def idf_weights(t: DataFrame) -> DataFrame:
    train = _is_train(t)
    weights = vocabulary.idf_weights(vocabulary.document_frequency(_tree_long(train)), train.agg(F.count("*")).scalar())
    return weights.select("block", "feature", "df", rounded("idf", "idf"))


@query("max_code_sizes", f"""
SELECT max(cat_1_code) + 1 AS max_cat_1, max(cat_2_code) + 1 AS max_cat_2, max(cat_3_code) + 1 AS max_cat_3,
       max(brand_code) + 1 AS max_brand, max(item_condition_id) + 1 AS max_condition, 10 AS max_name_seq,
       75 AS max_item_desc_seq, {fixed.MAX_WORDS + 1} AS max_text FROM coded""", "coded")
def max_code_sizes(t: DataFrame) -> DataFrame:
    rows = clean.clean_embedding(_usable(t))
    return encode.max_code_sizes(rows, encode.fit_labels(rows))


# ---- stacking and set operations ----

@query("stack_text_columns", """
SELECT text, count(*) AS n FROM (SELECT item_description AS text FROM emb UNION ALL SELECT name FROM emb) GROUP BY text""", "emb")
def stack_text_columns(t: DataFrame) -> DataFrame:
    stacked = vocabulary.stack_text_columns(clean.clean_embedding(_usable(t)), "item_description", "name")
    return stacked.groupBy("text").agg(F.count("*").alias("n"))


@query("distinct_label_union", "SELECT DISTINCT col AS \"column\", label FROM labels_", "labels_")
def distinct_label_union(t: DataFrame) -> DataFrame:
    return encode.stacked_labels(clean.clean_embedding(_usable(t)))


@query("intersect_features", """
SELECT split, block, count(*) AS n_entries, count(DISTINCT feature) AS n_features FROM tree_long
SEMI JOIN (SELECT block, feature FROM tree_long WHERE split = 'train' GROUP BY block, feature HAVING count(*) >= 2
           INTERSECT SELECT block, feature FROM tree_long WHERE split = 'test' GROUP BY block, feature HAVING count(*) >= 2)
USING (block, feature) GROUP BY split, block""", "tree_long")
def intersect_features(t: DataFrame) -> DataFrame:
    keep = ("item_id", "split")
    train, test = _tree_long(_is_train(t), keep), _tree_long(t.where("split = 'test'"), keep)
    train, test = vocabulary.intersect_features(train, test, min_df=2)
    per_feature = train.unionByName(test).groupBy("split", "block", "feature").agg(F.count("*").alias("n"))
    return per_feature.groupBy("split", "block").agg(F.sum("n").alias("n_entries"), F.count("*").alias("n_features"))
