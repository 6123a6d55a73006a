"""Registry of queries with their DuckDB twins, and the SQL fragments the twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright import fixed
from tagwright.sources.tables import LISTINGS_SQL, listings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None, needs: str = "t"):
    """Register ``fn(listings) -> DataFrame`` under ``key``; ``sql`` is its twin over the CTE chain up to ``needs``."""

    def register(fn):
        QUERIES[key] = lambda spark, sf_dir: fn(listings(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = with_ctes(needs, sql)
        return fn

    return register


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def measures(column: str) -> str:
    karats = f"regexp_replace({column}, {text(fixed.KARATS)}, '\\1k\\4', 'g')"
    return f"regexp_replace({karats}, {text(fixed.UNITS)}, '\\1\\2\\3', 'g')"


def tokens(column: str, pattern: str) -> str:
    return f"regexp_extract_all({column}, {text(pattern)})"


def word_ngrams(words: str) -> str:
    return (f"list_concat({words}, [array_to_string({words}[i:i+1], ' ') for i in range(1, len({words}))])")


_STOPS = "(" + ", ".join(text(w) for w in fixed.STOP_WORDS) + ")"


def filter_char_tokens(column: str) -> str:
    blanks = " " * len(fixed.SEQUENCE_FILTERS)
    spaced = f"translate(lower({column}), {text(fixed.SEQUENCE_FILTERS)}, '{blanks}')"
    return f"list_filter(string_split({spaced}, ' '), lambda x: x <> '')"


def no_stopwords(words: str) -> str:
    return f"list_filter({words}, lambda x: x NOT IN {_STOPS})"


def bucket(token: str) -> str:
    return f"(CAST('0x' || substr(md5({token}), 1, 8) AS BIGINT) % {fixed.HASH_BUCKETS})"


def sign(token: str) -> str:
    return f"(CASE WHEN CAST('0x' || substr(md5({token}), 9, 1) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END)"


def deletes(word: str) -> str:
    return f"list_distinct([substr({word}, 1, i - 1) || substr({word}, i + 1) for i in range(1, len({word}) + 1) if len({word}) > 1])"


# CTEs in order; a query that needs one gets all CTEs that one is built on.
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "t": ((), LISTINGS_SQL),
    # linear model cleaning
    "filled": (("t",), """
        SELECT item_id, split, item_condition_id, shipping, price,
               CAST(category_name IS NOT NULL AS INT) AS has_category, CAST(brand_name IS NOT NULL AS INT) AS has_brand,
               lower(coalesce(category_name, 'other/other/other')) AS category_name, lower(coalesce(name, '')) AS name,
               lower(coalesce(brand_name, '')) AS brand_name, lower(coalesce(item_description, '')) AS item_description
        FROM t"""),
    "clean": (("filled",), f"""
        SELECT * REPLACE ({measures('name')} AS name, {measures('item_description')} AS item_description),
               CASE WHEN len(p) >= 3 THEN p[1] ELSE 'other' END AS general_cat,
               CASE WHEN len(p) >= 3 THEN p[2] ELSE 'other' END AS subcat_1,
               CASE WHEN len(p) >= 3 THEN p[3] ELSE 'other' END AS subcat_2,
               CASE WHEN len(p) >= 3 THEN p[1] || '/' || p[2] ELSE 'other/other' END AS gen_subcat1
        FROM (SELECT *, string_split(category_name, '/') AS p FROM filled)"""),
    "brands": (("clean",), """
        SELECT DISTINCT brand_name AS word, contains(brand_name, ' ') AS multiword FROM clean WHERE brand_name <> ''"""),
    "candidates": (("clean",), f"""
        SELECT item_id, stage, pos, word FROM (
          SELECT item_id, 1 AS stage, 0 AS pos, regexp_extract(name, {text('^' + fixed.TWO_BRAND_WORDS)}) AS word
          FROM clean WHERE brand_name = ''
          UNION ALL SELECT item_id, 2, 0, regexp_extract(item_description, {text('^' + fixed.TWO_BRAND_WORDS)})
          FROM clean WHERE brand_name = ''
          UNION ALL SELECT item_id, 3, generate_subscripts(w, 1) - 1, unnest(w)
          FROM (SELECT item_id, {tokens('name', fixed.BRAND_WORD)} AS w FROM clean WHERE brand_name = '')
          UNION ALL SELECT item_id, 4, generate_subscripts(w, 1) - 1, unnest(w)
          FROM (SELECT item_id, {tokens('item_description', fixed.BRAND_WORD)} AS w FROM clean WHERE brand_name = ''))
        WHERE word <> ''"""),
    "found": (("candidates", "brands"), """
        SELECT item_id, arg_min(c.word, CAST(stage AS BIGINT) * 1000000000 + pos) AS word
        FROM candidates c JOIN brands b ON c.word = b.word AND b.multiword = (stage <= 2) GROUP BY item_id"""),
    "imputed": (("clean", "found"), """
        SELECT c.* REPLACE (coalesce(f.word, c.brand_name) AS brand_name) FROM clean c LEFT JOIN found f USING (item_id)"""),
    "named": (("imputed",), "SELECT * REPLACE (name || ' ' || brand_name AS name) FROM imputed"),
    # hashed n-grams of name and description and hashed category paths: unit rows over all buckets
    "linear_words": (("named",), f"""
        SELECT item_id, 'name' AS block, {word_ngrams('w')} AS g
        FROM (SELECT item_id, {no_stopwords(tokens('name', fixed.WORD_TOKEN))} AS w FROM named)
        UNION ALL SELECT item_id, 'item_description', {word_ngrams('w')}
        FROM (SELECT item_id, {no_stopwords(tokens('item_description', fixed.WORD_TOKEN))} AS w FROM named)
        UNION ALL SELECT item_id, 'category_name', [general_cat, subcat_1, subcat_2, gen_subcat1] FROM named"""),
    "hashed_raw": (("linear_words",), f"""
        SELECT item_id, block, {bucket('token')} AS feature, sum({sign('token')}) AS value
        FROM (SELECT item_id, block, unnest(g) AS token FROM linear_words) GROUP BY ALL HAVING sum({sign('token')}) <> 0"""),
    "hashed": (("hashed_raw",), """
        SELECT item_id, block, CAST(feature AS VARCHAR) AS feature,
               CASE WHEN block = 'item_description' THEN CAST(CAST(v AS FLOAT) AS DOUBLE) ELSE v END AS value
        FROM (SELECT *, value / sqrt(sum(value * value) OVER (PARTITION BY item_id, block)) AS v FROM hashed_raw)"""),
    "linear_long": (("hashed", "named"), """
        SELECT * FROM hashed
        UNION ALL SELECT item_id, 'brand_name', brand_name, 1.0 FROM named WHERE brand_name <> ''
        UNION ALL SELECT item_id, 'gencat_cond', general_cat || '_' || item_condition_id, 1.0 FROM named
        UNION ALL SELECT item_id, 'subcat_1_cond', subcat_1 || '_' || item_condition_id, 1.0 FROM named
        UNION ALL SELECT item_id, 'subcat_2_cond', subcat_2 || '_' || item_condition_id, 1.0 FROM named
        UNION ALL SELECT item_id, 'has_brand', CAST(has_brand AS VARCHAR), 1.0 FROM named
        UNION ALL SELECT item_id, 'shipping', CAST(shipping AS VARCHAR), 1.0 FROM named
        UNION ALL SELECT item_id, 'item_condition_id', CAST(item_condition_id AS VARCHAR), 1.0 FROM named"""),
    "linear_features": (("linear_long", "t"), """
        SELECT block, feature, count(*) AS df,
               ln((1 + (SELECT count(*) FROM t WHERE split = 'train')) / (1 + count(*))) + 1 AS idf
        FROM linear_long SEMI JOIN (SELECT item_id FROM t WHERE split = 'train') USING (item_id)
        GROUP BY ALL HAVING count(*) >= 2 OR block IN ('has_brand', 'shipping', 'item_condition_id')"""),
    "linear_weighted": (("linear_long", "linear_features"), """
        SELECT item_id, block, feature, v / sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS value
        FROM (SELECT l.*, l.value * f.idf AS v FROM linear_long l JOIN linear_features f USING (block, feature))"""),
    # tree model
    "tree": (("t",), """
        SELECT item_id, split, CAST(shipping AS VARCHAR) AS shipping, CAST(item_condition_id AS VARCHAR) AS item_condition_id,
               coalesce(name, 'missing') AS name, coalesce(category_name, 'Other') AS category_name,
               coalesce(brand_name, 'missing') AS brand_name, coalesce(item_description, 'None') AS item_description
        FROM t"""),
    "tree_long": (("tree",), f"""
        SELECT item_id, split, block, feature, count(*) AS value FROM (
          SELECT item_id, split, 'name' AS block, unnest({tokens('lower(name)', fixed.WORD_TOKEN)}) AS feature FROM tree
          UNION ALL SELECT item_id, split, 'item_description', unnest({tokens('lower(item_description)', fixed.WORD_TOKEN)})
          FROM tree
          UNION ALL SELECT item_id, split, 'category_name', lower(category_name) FROM tree
          UNION ALL SELECT item_id, split, 'brand_name', lower(brand_name) FROM tree
          UNION ALL SELECT item_id, split, 'shipping', unnest({tokens('shipping', fixed.DIGIT_TOKEN)}) FROM tree
          UNION ALL SELECT item_id, split, 'item_condition_id', unnest({tokens('item_condition_id', fixed.DIGIT_TOKEN)})
          FROM tree) GROUP BY ALL"""),
    "tree_features": (("tree_long", "t"), f"""
        SELECT *, row_number() OVER (ORDER BY block, place) - 1 AS fid,
               CASE WHEN block = 'item_description'
                    THEN ln((1 + (SELECT count(*) FROM t WHERE split = 'train')) / (1 + df)) + 1 ELSE 1.0 END AS idf
        FROM (SELECT block, feature, CAST(sum(value) AS BIGINT) AS cnt, count(*) AS df,
                     row_number() OVER (PARTITION BY block ORDER BY sum(value) DESC, feature) AS place
              FROM tree_long WHERE split = 'train' GROUP BY block, feature)
        WHERE NOT (block = 'name' AND place > {fixed.NAME_TERMS})
          AND NOT (block = 'item_description' AND place > {fixed.DESCRIPTION_TERMS})"""),
    # embedding model
    "kept": (("t",), "SELECT * FROM t WHERE split = 'test' OR price IS NULL OR price <> 0"),
    "emb": (("kept",), """
        SELECT item_id, split, name, item_condition_id, shipping, price, coalesce(brand_name, 'missing') AS brand_name,
               coalesce(item_description, 'missing') AS item_description, p[1] AS cat_1,
               coalesce(p[2], 'missing') AS cat_2, coalesce(p[3], 'missing') AS cat_3
        FROM (SELECT *, string_split(coalesce(category_name, 'missing'), '/') AS p FROM kept)"""),
    "labels_": (("emb",), """
        SELECT col, label, CAST(dense_rank() OVER (PARTITION BY col ORDER BY label) - 1 AS INT) AS code FROM (
          SELECT 'brand_name' AS col, brand_name AS label FROM emb UNION SELECT 'cat_1', cat_1 FROM emb
          UNION SELECT 'cat_2', cat_2 FROM emb UNION SELECT 'cat_3', cat_3 FROM emb)"""),
    "coded": (("emb", "labels_"), """
        SELECT e.*, b.code AS brand_code, c1.code AS cat_1_code, c2.code AS cat_2_code, c3.code AS cat_3_code
        FROM emb e JOIN labels_ b ON b.col = 'brand_name' AND b.label = e.brand_name
        JOIN labels_ c1 ON c1.col = 'cat_1' AND c1.label = e.cat_1
        JOIN labels_ c2 ON c2.col = 'cat_2' AND c2.label = e.cat_2
        JOIN labels_ c3 ON c3.col = 'cat_3' AND c3.label = e.cat_3"""),
    "seq_tokens": (("emb",), f"""
        SELECT item_id, split, field, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token FROM (
          SELECT item_id, split, 'name' AS field, {filter_char_tokens('name')} AS w FROM emb
          UNION ALL SELECT item_id, split, 'item_description', {filter_char_tokens('item_description')} FROM emb)"""),
    "token_index": (("seq_tokens",), f"""
        SELECT token, CAST(idx AS INT) AS idx FROM (
          SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS idx
          FROM seq_tokens WHERE split = 'train' GROUP BY token) WHERE idx < {fixed.MAX_WORDS}"""),
    "sequences": (("emb", "seq_tokens", "token_index"), """
        SELECT e.item_id, coalesce(n.s, []) AS name_seq, coalesce(d.s, []) AS item_description_seq
        FROM emb e
        LEFT JOIN (SELECT item_id, list(idx ORDER BY pos) AS s FROM seq_tokens JOIN token_index USING (token)
                   WHERE field = 'name' GROUP BY item_id) n USING (item_id)
        LEFT JOIN (SELECT item_id, list(idx ORDER BY pos) AS s FROM seq_tokens JOIN token_index USING (token)
                   WHERE field = 'item_description' GROUP BY item_id) d USING (item_id)"""),
    # dictionary of train words, and the different words of test listings
    "words": (("t",), f"""
        SELECT word, count(*) AS cnt FROM (
          SELECT unnest({tokens('lower(item_description)', fixed.LETTER_WORD)}) AS word FROM t WHERE split = 'train')
        GROUP BY word"""),
    "lookups": (("t",), f"""
        SELECT DISTINCT unnest({tokens('lower(item_description)', fixed.LETTER_WORD)}) AS query FROM t WHERE split = 'test'"""),
    "suggestions": (("words", "lookups"), f"""
        SELECT query, word, CAST(dist AS INT) AS dist, cnt FROM (
          SELECT *, min(dist) OVER (PARTITION BY query) AS least FROM (
            SELECT DISTINCT q.query, w.word, damerau_levenshtein(q.query, w.word) AS dist, w.cnt
            FROM (SELECT query, unnest(list_append({deletes('query')}, query)) AS key FROM lookups) q
            JOIN (SELECT word, cnt, unnest(list_append({deletes('word')}, word)) AS key FROM words) w USING (key))
          WHERE dist <= 1) WHERE dist = least"""),
    # stand-in predictions: mean log price of train listings by one column
    **{
        f"mean_{c}": (("t",), f"""
        SELECT x.item_id, exp(coalesce(m.m, (SELECT avg(ln(1 + price)) FROM t WHERE split = 'train' AND price <> 0))) - 1 AS pred
        FROM t x LEFT JOIN (SELECT {c} AS k, avg(ln(1 + price)) AS m FROM t WHERE split = 'train' AND price <> 0
                            GROUP BY 1) m ON m.k = x.{c}
        WHERE x.split = 'test'""") for c in ("category_name", "brand_name", "item_condition_id")
    },
}


def with_ctes(needs: str, sql: str) -> str:
    chain: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in chain:
            before, body = _CTES[name]
            for b in before:
                add(b)
            chain[name] = body

    for name in needs.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in chain.items()) + "\n" + sql


def rounded(column: str | Column, name: str, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits).alias(name)


def mean_predictor(rows: DataFrame, column: str, train: DataFrame | None = None) -> DataFrame:
    """Stand-in model for the queries on blending and metrics: mean log price of train listings by ``column``."""
    train = (rows.where("split = 'train'") if train is None else train).where("price <> 0")
    means = train.groupBy(F.col(column).alias("_k")).agg(F.avg(F.log1p("price")).alias("_m"))
    overall = train.agg(F.avg(F.log1p("price"))).scalar()
    test = rows.where("split = 'test'").select("item_id", F.col(column).alias("_k"), "price")
    joined = test.join(means, "_k", "left")
    return joined.select("item_id", "price", F.expm1(F.coalesce("_m", overall)).alias("pred"))
