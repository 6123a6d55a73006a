"""Operators against brute force, on both routes of the lookup join."""

import math

import pytest
from pyspark.sql import functions as F

from tagwright.operators import blend, brands, clean, encode, features, fuzzy, lookup, ranking, split, vocabulary
from tagwright.storage import store

ROUTES = [None, 0]  # measured broadcast; table taken as too large


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_join_routes_agree(spark, how, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY_SAMPLE", 0.5)
    # one key holds a third of the rows, another misses in the table
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "gone")
                                   .otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("word"))
    table = store(spark.range(60).select(F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("word"),
                                         F.col("id").alias("code")), "table")
    small, large = [rows_of(lookup.lookup_join(big, table, ["word"], how, max_bytes=m)) for m in ROUTES]
    assert small == large and len(small) == (3000 if how == "left" else rows_count(big, table))


def rows_count(big, table):
    return big.join(table, "word", "left_semi").count()


def test_rank_and_order_statistics(spark):
    rows = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("v"))
    ranked = ranking.with_rank(rows, [F.desc("v")]).orderBy("rank").collect()
    values = sorted((r["v"] for r in ranked), reverse=True)
    assert [r["rank"] for r in ranked] == list(range(1, 20001)) and [r["v"] for r in ranked] == values
    wide = rows.select((F.col("v") * 10**12 - 5).alias("v"))
    ordered = sorted(r["v"] for r in wide.collect())
    for k in (1, 2, 777, 19999, 20000):
        assert ranking.kth_smallest(wide, "v", k) == ordered[k - 1]
    assert ranking.kth_smallest(wide, "v", 20001) is None and ranking.kth_smallest(wide, "v", 0) is None


def test_rank_within_groups(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 2), ("c", 9)], "g string, v int")
    got = rows_of(ranking.with_rank_within(rows, ["g"], ["v"], "r", 0).select("g", "v", "r"))
    assert got == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("b", 2, 0), ("c", 9, 0)]


def test_holdout_and_samples(spark):
    rows = spark.range(1003).withColumnRenamed("id", "item_id")
    head, tail = split.ordered_holdout(rows, 0.8)
    heads, tails = {r[0] for r in head.collect()}, {r[0] for r in tail.collect()}
    assert len(heads) == math.floor(0.8 * 1003) and not heads & tails and len(heads | tails) == 1003
    assert max(heads) < min(tails)
    all_in, none = split.ordered_holdout(rows, 1.0)
    assert all_in.count() == 1003 and none.count() == 0
    a, b, again = [split.seeded_subsample(rows, s) for s in (2, 3, 2)]
    assert a.count() == b.count() == math.floor(0.85 * 1003)
    assert rows_of(a) == rows_of(again) != rows_of(b)
    assert abs(split.seeded_subsample(rows, 1, exact=False).count() - 852) < 80


def test_sample_settles_equal_hashes(spark, monkeypatch):
    monkeypatch.setattr(split, "sample_order", lambda seed, key="item_id": F.col(key) % 2)
    rows = spark.range(10).withColumnRenamed("id", "item_id")
    assert [r[0] for r in split.seeded_subsample(rows, 1, 0.7).orderBy("item_id").collect()] == [0, 1, 2, 3, 4, 6, 8]


# ---- brands ----

def brand_rows(spark, data):
    rows = spark.createDataFrame(
        [(i, n, b, d) for i, (n, b, d) in enumerate(data)],
        "item_id long, name string, brand_name string, item_description string")
    return rows


@pytest.mark.parametrize("max_bytes", ROUTES)
def test_brand_stages(spark, max_bytes):
    rows = brand_rows(spark, [
        ("x", "house 17", "d"), ("x", "acme", "d"), ("x", "zed", "d"), ("x", "three word brand", "d"),
        ("house 17 red rod", "", "acme"),  # stage 1
        ("red house 17 rod", "", "house 17 here"),  # not at the start of the name; stage 2
        ("old zed acme", "", "d"),  # stage 3: first word in order
        ("nothing", "", "but (acme) zed"),  # stage 4
        ("three word brand", "", ""),  # three words are never found
        ("acme house 17", "", "house 17 x"),  # stage 2 comes before stage 3
    ])
    got = {r["item_id"]: r["brand_name"] for r in brands.impute_brands(rows, max_bytes=max_bytes).collect()}
    assert [got[i] for i in range(10)] == [
        "house 17", "acme", "zed", "three word brand", "house 17", "house 17", "zed", "acme", "", "house 17"]


def test_brands_from_own_part_or_elsewhere(spark):
    rows = brand_rows(spark, [("x", "acme", ""), ("acme ring", "", ""), ("acme ring", "", "")])
    rows = rows.withColumn("split", F.when(F.col("item_id") < 2, "train").otherwise("test"))
    own = {r[0]: r[1] for r in brands.impute_brands(rows, scope=("split",)).select("item_id", "brand_name").collect()}
    assert own == {0: "acme", 1: "acme", 2: ""}
    test = rows.where("split = 'test'")
    lent = brands.impute_brands(test, brands_from=rows.where("split = 'train'"))
    assert lent.first()["brand_name"] == "acme"


def test_imputation_only_fills(spark, listings):
    rows = store(clean.clean_linear(listings), "rows")
    filled = brands.impute_brands(rows)
    before = {r[0]: r[1] for r in rows.select("item_id", "brand_name").collect()}
    after = {r[0]: r[1] for r in filled.select("item_id", "brand_name").collect()}
    assert before.keys() == after.keys()
    assert all(after[i] == b for i, b in before.items() if b)
    assert sum(b == "" for b in after.values()) < sum(b == "" for b in before.values())


# ---- fuzzy ----

def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


WORDS = [("gold", 5), ("bold", 5), ("cold", 2), ("golden", 1), ("ring", 3), ("wring", 3), ("a", 1), ("ca", 1), ("glod", 4)]
LOOKED_UP = ["gold", "gol", "glod", "rign", "rings", "abc", "b", "olden", "xyzzy", "gdlo"]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_fuzzy_equals_brute_force(spark, k):
    words = spark.createDataFrame(WORDS, "word string, cnt long")
    queries = spark.createDataFrame([(q,) for q in LOOKED_UP], "query string")
    # a pair can be found when something is left after the deletions that make both equal
    near = {(q, w, osa(q, w), c) for q in LOOKED_UP for w, c in WORDS
            if osa(q, w) <= k and (q == w or max(len(q), len(w)) > osa(q, w))}
    assert set(rows_of(fuzzy.suggestions(queries, words, k, "all"))) == near
    least = {q: min(d for p, _, d, _ in near if p == q) for q, *_ in near}
    closest = {r for r in near if r[2] == least[r[0]]}
    found = fuzzy.suggestions(queries, words, k)
    assert set(rows_of(found)) == closest
    best = {q: min(((d, -c, w) for p, w, d, c in closest if p == q), default=(0, 0, None))[2] for q in LOOKED_UP}
    assert {r["query"]: r["word"] for r in fuzzy.best_word(queries, found).collect()} == best


def test_fuzzy_without_edits_is_the_exact_lookup(spark):
    words = spark.createDataFrame(WORDS, "word string, cnt long")
    queries = spark.createDataFrame([(q,) for q in LOOKED_UP], "query string")
    exact = rows_of(queries.join(words, F.col("query") == F.col("word"), "left_semi"))
    assert rows_of(fuzzy.suggestions(queries, words, 0).select("query")) == exact


# ---- vocabularies, features, codes ----

def test_document_frequency_range(spark):
    long = spark.createDataFrame(
        [(i, "b", f, 1.0) for i, fs in enumerate(["xyz", "xy", "x", "x"]) for f in fs],
        "item_id long, block string, feature string, value double")
    for max_bytes in ROUTES:
        kept = vocabulary.drop_features_by_df(long, 2, 0.5, 4, max_bytes)
        assert {r["feature"] for r in kept.collect()} == {"y"}
    train, valid = long.where("item_id < 2"), long.where("item_id >= 2")
    a, b = vocabulary.intersect_features(train, valid, 2)
    assert {r["feature"] for r in a.collect()} == {r["feature"] for r in b.collect()} == {"x"}
    assert vocabulary.intersect_features(train, valid)[0].count() == train.count()


def test_vocabulary_ties(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "token string, cnt long")
    assert rows_of(vocabulary.vocabulary_top_k(counts, 2).select("token", "rank")) == [("a", 2), ("c", 1)]


def test_unseen_label_raises(spark):
    fitted = encode.fit_labels(spark.createDataFrame([("a",), ("b",)], "brand_name string"), ("brand_name",))
    assert rows_of(fitted) == [("brand_name", "a", 0), ("brand_name", "b", 1)]
    other = spark.createDataFrame([("z",)], "brand_name string")
    with pytest.raises(Exception, match="unseen label in brand_name: z"):
        encode.label_codes(other, fitted, ("brand_name",)).collect()


@pytest.mark.parametrize("max_bytes", ROUTES)
def test_sequences_keep_order_and_empty_items(spark, max_bytes):
    rows = spark.createDataFrame([(1, "b a b", ""), (2, "", ""), (3, "zzz", "a")],
                                 "item_id long, name string, item_description string")
    index = store(spark.createDataFrame([("a", 1), ("b", 2)], "token string, idx int"), "index")
    got = encode.texts_to_sequences(rows, index, max_bytes=max_bytes)
    assert rows_of(got) == [(1, [2, 1, 2], []), (2, [], []), (3, [], [1])]


def test_linear_features_on_both_routes(spark, listings):
    from tagwright.plans import flows

    rows = flows.with_label(listings)

    def totals(max_bytes):
        items = flows.linear_items(rows, max_bytes=max_bytes)
        return [(r[0], r[1], round(r[2], 9)) for r in rows_of(items.rows.select("item_id", F.size("entries"), F.aggregate(
            "entries", F.lit(0.0), lambda a, e: a + e["value"] * (e["feature"] % 97))))], items.size

    broadcast, shuffled = totals(None), totals(0)
    assert broadcast == shuffled and len(broadcast[0]) == rows.count()


def test_blend_needs_every_prediction(spark):
    full = spark.createDataFrame([(1, 2.0), (2, 10.0)], "test_id long, pred double")
    got = rows_of(blend.blend({"tree": full, "linear": full, "embedding": full}))
    assert got == [(1, pytest.approx(3.0)), (2, pytest.approx(10.0))]
    short = full.where("test_id = 1")
    for bad in (short, full.unionByName(short)):
        with pytest.raises(Exception, match="do not line up"):
            blend.blend({"tree": full, "linear": bad, "embedding": full}).collect()


def test_answers_do_not_depend_on_partitions(spark, listings):
    rows = clean.clean_linear(listings)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("1", "4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            filled = rows_of(brands.impute_brands(rows).select("item_id", "brand_name"))
            index = rows_of(vocabulary.token_index(clean.clean_embedding(listings.where("split = 'train'"))))
            got.append((filled, index))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] == got[2]


def test_one_hot_blocks_survive(spark):
    long = spark.createDataFrame([(1, "shipping", "1", 1.0), (1, "name", "7", 1.0)],
                                 "item_id long, block string, feature string, value double")
    fitted = features.fit_linear_features(long, F.lit(1))
    assert [r["block"] for r in fitted.collect()] == ["shipping"]
