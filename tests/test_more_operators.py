"""Splittable quoted reader, fuzzy segments, original hashes, honest sizes, saved stages, one lookup for model inputs."""

import random

import pytest
from conftest import SMALL
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F
from test_operators import osa, rows_of

from tagwright.catalog import QUERIES
from tagwright.catalog.encodings import by_place
from tagwright.functions import text
from tagwright.functions.arrays import counted
from tagwright.functions.hashing import bucket_codes, murmur3
from tagwright.operators import clean, encode, features, fuzzy, lookup, vocabulary
from tagwright.operators.stages import CountBlock, DropByDf
from tagwright.sources import quoted, tsv
from tagwright.storage import scratch_path, store


# ---- reader ----

def test_end_of_a_line_inside_quotes():
    cases = {'a\tb': (False, True), 'a\t"b': (True, False), '"': (True, False), 'a"b\t5" ring': (False, False), '""': (False, True),
             '"a""': (True, False), '"a"b\t"c': (True, True), 'x"\t"y': (True, True), 'end"\tplain': (False, False), '': (False, True)}
    for line, want in cases.items():
        assert (quoted.ends_inside(line, False), quoted.ends_inside(line, True)) == want, line


def test_quoted_line_breaks_in_a_split_file(spark, tmp_path):
    rng = random.Random(3)
    pieces = ["plain", 'say "hi"', "two\nlines", "a\n\n\nb", '5" ring', "tab\there", "", "cr\r\nlf", '"', "x" * 50, 'end"\n"start']

    def field(value):
        must = any(c in value for c in '\t\n\r') or value.startswith('"')
        return '"' + value.replace('"', '""') + '"' if must or rng.random() < 0.2 else value

    def row(i):
        text_of = lambda: " ".join(rng.choice(pieces) for _ in range(rng.randrange(4)))
        return "\t".join([str(i), field(text_of() or "n"), str(1 + i % 5), field("a/b/c"), "", "9.5", str(i % 2), field(text_of())])

    header = "train_id\tname\titem_condition_id\tcategory_name\tbrand_name\tprice\tshipping\titem_description\n"
    long = "\n".join(f"line {i}" for i in range(400))  # one record over many splits
    for k in range(3):
        body = [row(1000 * k + i) for i in range(120)]
        body[60] = "\t".join([str(1000 * k + 60), '"' + long + '"', "1", "a/b/c", "", "3.0", "1", "after"])
        with open(tmp_path / f"part{k}.tsv", "w", newline="") as f:
            f.write(header + "\n".join(body) + "\n" * (k != 1))
    want = rows_of(spark.read.schema(tsv.schema.TRAIN_FILE).options(**tsv._FORMAT).option("header", True).option(
        "multiLine", True).csv(str(tmp_path)).withColumns({c: F.when(~F.col(c).isin(*tsv.fixed.NA_MARKERS), F.col(c)) for c in (
            "name", "category_name", "brand_name", "item_description")}).fillna("<null>"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = tsv.read_train(spark, str(tmp_path), multiline=True)
        assert rows_of(got.fillna("<null>")) == want and len(want) == 360
        assert got.where(F.col("name") == long).count() == 3
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_records_of_empty_files_and_open_quotes(spark, tmp_path):
    (tmp_path / "empty.tsv").write_text("")
    (tmp_path / "header.tsv").write_text("a\tb\n")
    (tmp_path / "open.tsv").write_text('a\tb\n1\t2\r\n\n3\t"never\nclosed\n')
    got = [r["record"] for r in quoted.read_records(spark, str(tmp_path)).collect()]
    assert sorted(got) == ["1\t2", '3\t"never\nclosed']


# ---- fuzzy ----

def test_segments_equal_brute_force_for_long_words(spark):
    rng = random.Random(8)

    def edited(word, k):
        for _ in range(k):
            i = rng.randrange(len(word) - 1)
            kind = rng.randrange(4)
            word = [word[:i] + word[i + 1:], word[:i] + rng.choice("abc") + word[i:], word[:i] + rng.choice("abc") + word[i + 1:],
                    word[:i] + word[i + 1] + word[i] + word[i + 2:]][kind]
        return word

    words = {"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(15, 32))) for _ in range(60)}
    words |= {edited(w, 2) for w in sorted(words)[:20]} | {"abcd", "abce", "a"}
    looked_up = {edited(w, rng.randrange(5)) for w in sorted(words) if len(w) > 6} | {"abdc", "zzz", "bcd"}
    table = spark.createDataFrame([(w, 1 + len(w)) for w in sorted(words)], "word string, cnt long")
    queries = spark.createDataFrame([(q,) for q in sorted(looked_up)], "query string")
    want = {(q, w, osa(q, w), 1 + len(w)) for q in looked_up for w in words
            if abs(len(q) - len(w)) <= 3 and osa(q, w) <= 3 and (q == w or max(len(q), len(w)) > osa(q, w))}
    assert set(rows_of(fuzzy.suggestions(queries, table, 3, "all"))) == want
    assert sum(len(w) > 20 for _, w, *_ in want) > 20
    assert set(rows_of(fuzzy.suggestions(queries, table, 2, segments=True))) == set(rows_of(fuzzy.suggestions(queries, table, 2)))
    # far fewer keys than delete variants
    long = queries.where(F.length("query") > 23)
    variants = long.select(F.sum(F.size(text.delete_variants(F.col("query"), 2)))).first()[0] / long.count()
    assert 7**3 < 2 * variants  # at most 343 probes for k = 3, against the variants for k = 2 alone


# ---- hashes ----

def plain_murmur3(data, seed=0):
    def rot(x, r):
        return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF

    h = seed
    for i in range(0, len(data) // 4 * 4, 4):
        k = int.from_bytes(data[i:i + 4], "little")
        h = rot(h ^ (rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF), 13)
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    k = int.from_bytes(data[len(data) // 4 * 4:], "little")
    h ^= rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ (h >> 16)


def test_murmur3(spark):
    published = {"": 0, "test": 0xBA6BD213, "Hello, world!": 0xC0363E43, "The quick brown fox jumps over the lazy dog": 0x2E4FF723}
    for value, want in published.items():
        assert plain_murmur3(value.encode()) == want
    words = [*published, "a", "ab", "abc", "abcd", "abcde", "é", "中文字", "😀 two words", "x" * 1000]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: (r["h"], r["c"][0]) for r in df.select(
        "w", murmur3(F.col("w")).alias("h"), bucket_codes(F.array("w"), 1000, "murmur3").alias("c")).collect()}
    for w in words:
        h = plain_murmur3(w.encode())
        signed = h - 2**32 if h >= 2**31 else h
        assert got[w] == (h, abs(signed) % 1000 * 2 + (signed < 0)), w


# ---- sizes ----

def test_sizes_count_what_arrays_hold(spark):
    rows = spark.range(100).select(
        F.col("id"), F.expr("sequence(1L, 1000L)").alias("a"), F.expr("transform(sequence(1, 10), i -> repeat('x', 50))").alias("t"),
        F.expr("transform(sequence(1, 10), i -> named_struct('n', i, 's', repeat('y', 20)))").alias("s"), F.lit(None).cast("array<int>").alias("z"))
    assert 100 * 8000 < lookup.measured_bytes(rows.select("id", "a")) < 100 * 8200
    assert 100 * 500 < lookup.measured_bytes(rows.select("t")) < 100 * 800
    assert 100 * 280 < lookup.measured_bytes(rows.select("s")) < 100 * 700
    assert lookup.measured_bytes(rows.select("z")) < 100 * 100 and lookup.measured_bytes(rows.limit(0)) == 0
    with pytest.raises(TypeError):
        lookup.measured_bytes(rows.select(F.create_map(F.lit("k"), "id").alias("m")))


def test_a_table_of_long_arrays_is_not_broadcast(spark):
    big = spark.range(50)
    table = store(spark.range(50).select("id", F.expr("sequence(1L, 3000L)").alias("a")), "arrays")
    joined = lookup.lookup_join(big, table, ["id"], "inner", max_bytes=2**20)
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.select(F.sum(F.size("a"))).first()[0] == 150_000


# ---- vocabularies, model inputs, stages ----

def test_only_terms_at_the_cut_off_are_sorted(spark, monkeypatch):
    counts = spark.createDataFrame([(f"w{i:03d}", 1 + (i < 40) * 5 + (i < 3)) for i in range(500)], "token string, cnt long")
    sorted_rows = []
    ranks = vocabulary.vocabulary_ranks
    monkeypatch.setattr(vocabulary, "vocabulary_ranks", lambda c: sorted_rows.append(c.count()) or ranks(c))
    for k, most in ((3, 3), (10, 40), (40, 40), (41, 500), (500, 500), (900, 500)):
        top = rows_of(vocabulary.vocabulary_top_k(counts, k).select("rank", "token"))
        assert top == [(i + 1, f"w{i:03d}") for i in range(min(k, 500))] and sorted_rows.pop() == most
    assert vocabulary.vocabulary_top_k(counts.limit(0), 5).collect() == []


@pytest.mark.parametrize("max_bytes", [None, 0])
def test_model_inputs_carry_no_texts(spark, listings, max_bytes, monkeypatch):
    rows = clean.clean_embedding(listings.where("price is null or price <> 0"))
    index = store(vocabulary.token_index(rows.where("split = 'train'")), "index")
    labels = encode.fit_labels(rows)
    stored = []
    monkeypatch.setattr(lookup, "store", lambda df, name, *a: stored.append(df.columns) or store(df, name, *a))
    got = encode.model_input_row(rows, index, labels, max_bytes=max_bytes)
    assert not {c for columns in stored for c in columns} & {"name", "item_description", "category_name"}
    want = encode.label_codes(rows, labels)
    want = want.join(encode.padded_sequences(encode.texts_to_sequences(rows, index)), "item_id").select(
        "item_id", F.col("name_seq").alias("name"), F.col("item_description_seq").alias("item_desc"),
        *[F.col(f"{c}_code").alias(c) for c in encode.LABEL_COLUMNS], F.col("item_condition_id").alias("item_condition"),
        F.col("shipping").alias("num_vars"))
    assert rows_of(got) == rows_of(want)


def test_small_tables_are_looked_up_in_the_row(spark):
    rows = spark.createDataFrame(
        [(1, "b a x", "a"), (2, None, "b  b"), (3, "", None), (4, "x y", "a,b")], "item_id int, name string, item_description string")
    index = store(spark.createDataFrame([("a", 1), ("b", 2)], "token string, idx int"), "index")
    got = encode.texts_to_sequences(rows, index)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {1: ([2, 1], [1]), 2: ([], [2, 2]), 3: ([], []), 4: ([], [1, 2])}
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == want


def test_blocks_are_normed_in_the_row(spark, listings):
    rows, entries = clean.clean_tree(listings), features.tree_entries()
    got = features.explode_blocks(rows, features.unit_blocks(entries))
    assert rows_of(got) == rows_of(features.row_l2_norm(features.explode_blocks(rows, entries)))
    plan = QUERIES["row_l2_norm"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_snapshots_read_the_documents_once(spark):
    plan = QUERIES["snapshot_ensemble"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan  # only the stored narrow listings


def test_vector_sums_pass_32_bits(spark):
    df = spark.createDataFrame([(([2_000_000_000, 2_000_000_001], [0.5, 2.0]),)], "v struct<indices:array<int>,values:array<double>>")
    got = df.select(by_place("indices", "bigint").alias("i"), by_place("values", "double").alias("x")).first()
    assert (got["i"], got["x"]) == (6_000_000_002, 4.5)


def test_unseen_label_raises_in_model_inputs(spark, listings):
    rows = clean.clean_embedding(listings)
    labels = encode.fit_labels(rows)
    index = store(vocabulary.token_index(rows), "index")
    with pytest.raises(Exception, match="unseen label in brand_name: never seen"):
        encode.model_input_row(rows.withColumn("brand_name", F.lit("never seen")), index, labels).collect()


def test_saved_pipeline(spark, listings):
    pipeline = Pipeline(stages=[CountBlock("name", text.letter_words), DropByDf(min_df=2, max_df=0.9)])
    fitted = pipeline.fit(listings)
    path = scratch_path(spark, "pipeline")
    fitted.write().save(path)
    loaded = PipelineModel.load(path)
    assert loaded.uid == fitted.uid and [type(s) for s in loaded.stages] == [type(s) for s in fitted.stages]
    want = rows_of(fitted.transform(listings))
    assert rows_of(loaded.transform(listings)) == want and want
    unfitted = scratch_path(spark, "unfitted")
    pipeline.write().save(unfitted)
    again = Pipeline.load(unfitted).fit(listings)
    assert rows_of(again.transform(listings)) == want
    with pytest.raises(ValueError):
        CountBlock("name", lambda c: text.letter_words(c)).write()
    assert counted is not None
