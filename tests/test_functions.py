"""Hand cases of the column functions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tagwright.functions import arrays, category, counting, hashing, metrics, sequences, text
from tagwright.functions.edit_distance import distances
from tagwright.operators import clean, vocabulary
from tagwright.sources import tsv


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("path, want", [
    ("a/b/c", ["a", "b", "c", "a/b"]), ("a/b", ["other", "other", "other", "other/other"]),
    ("a/b/c/d", ["a", "b", "c", "a/b"]), ("a/b/", ["a", "b", "", "a/b"]),
])
def test_category_strict(spark, path, want):
    assert one(spark, path, category.path_tokens) == want


@pytest.mark.parametrize("path, want", [
    ("a/b/c", ["a", "b", "c"]), ("missing", ["missing"] * 3), ("a/b", ["a", "b", "missing"]),
])
def test_category_padded(spark, path, want):
    assert one(spark, path, lambda c: F.array(*category.split_padded(c).values())) == want


@pytest.mark.parametrize("given, want", [
    ("14 karat gold", "14k gold"), ("14-karats.", "14k."), ("14kt ", "14k "), ("14 kt", "14 kt"), ("10ktx ", "10ktx "),
    ("14 carat ring", "14k ring"), ("14 kté x", "14 kté x"),
])
def test_karats(spark, given, want):
    assert one(spark, given, text.normalise_karats) == want


@pytest.mark.parametrize("given, want", [("10 oz bottle", "10oz bottle"), ("5-ml x", "5ml x"), ("10 oz", "10 oz")])
def test_units(spark, given, want):
    assert one(spark, given, text.glue_units) == want


def test_brand_words(spark):
    assert one(spark, "h&m (new) l'eau", text.brand_tokens) == ["h&m", "new", "l'eau"]
    assert one(spark, "house 17 red rod", text.leading_two_words) == "house 17"
    assert one(spark, " house 17", text.leading_two_words) == ""
    assert one(spark, "a  b", text.leading_two_words) == ""
    assert one(spark, "a b c(d e", text.sliding_two_words) == [" b c"]
    assert one(spark, "a b c d", text.sliding_two_words) == [" b c", " c d"]


def test_tokenisers(spark):
    assert one(spark, "Abc, d-ef 1é x", text.letter_words) == ["abc", "d", "ef", "x"]
    assert one(spark, "été a b_c 12", text.word_tokens) == ["été", "b_c", "12"]
    assert one(spark, "Don't! a-b [x]\t50%", text.filter_char_tokens) == ["don't", "a", "b", "x", "50%"]
    assert one(spark, "", text.whole_value_tokens) == []
    assert one(spark, "a1b22", text.digit_tokens) == ["1", "22"]


def test_ngrams(spark):
    kind = "array<string>"
    assert one(spark, ["a", "b", "c"], text.word_ngrams, kind) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, ["a"], text.word_ngrams, kind) == ["a"]
    assert one(spark, [], text.word_ngrams, kind) == []
    assert one(spark, ["a", "b", "c"], lambda c: text.word_ngrams(c, 3, 3), kind) == ["a b c"]


def test_delete_variants(spark):
    assert sorted(one(spark, "abc", text.delete_variants)) == ["ab", "ac", "bc"]
    assert sorted(one(spark, "abc", lambda c: text.delete_variants(c, 2))) == ["a", "ab", "ac", "b", "bc", "c"]
    assert one(spark, "a", lambda c: text.delete_variants(c, 2)) == []


@pytest.mark.parametrize("given, want", [
    ([1, 2], [0, 0, 0, 1, 2]), ([1, 2, 3, 4, 5, 6], [2, 3, 4, 5, 6]), ([], [0] * 5), ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5]),
])
def test_pad(spark, given, want):
    assert one(spark, given, lambda c: sequences.pad_sequence(c, 5), "array<int>") == want


def test_counted(spark):
    words = "b a b c b".split()
    got = one(spark, words, arrays.counted, "array<string>")
    assert {e["token"]: e["tf"] for e in got} == dict(Counter(words))
    assert one(spark, [], arrays.counted, "array<string>") == []


@pytest.mark.parametrize("buckets", [2**27, 3])
def test_hashed_equals_plain_python(spark, buckets):
    words = "red red ring gold small bolt nut bolt bolt".split()
    sums = Counter()
    for w in words:
        h = hashlib.md5(w.encode()).hexdigest()
        sums[int(h[:8], 16) % buckets] += 1 if int(h[8], 16) % 2 == 0 else -1
    sums = {k: v for k, v in sums.items() if v}
    norm = math.sqrt(sum(v * v for v in sums.values())) or 1.0
    got = one(spark, words, lambda c: hashing.hashed(c, buckets), "array<string>")
    assert {e["feature"]: pytest.approx(e["value"]) for e in got} == {k: v / norm for k, v in sums.items()}


def test_hashed_fast_method_is_a_unit_row(spark):
    got = one(spark, ["a", "b", "a"], lambda c: hashing.hashed(c, method="xxhash64"), "array<string>")
    assert sorted(abs(e["value"]) for e in got) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


TEXTS = ["The red-red ring is ünïcode ring_2 a", "", None, "x y", "bolt  bolt nut\n٣٤ 日本語 it"] * 3


def _words(value):
    return re.findall(r"\w{2,}", value or "")


def test_word_entries_equal_plain_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", counting.word_entries("name", F.col("t")).alias("e"))
    got = {r["i"]: r["e"] for r in rows.collect()}
    for i, value in enumerate(TEXTS):
        if value is None:
            assert got[i] is None
        else:
            assert sorted((e["block"], e["feature"], e["value"]) for e in got[i]) == sorted(
                ("name", w, float(n)) for w, n in Counter(_words(value)).items())


def test_runs_hold_every_row_once():
    for sizes in ([], [0], [5, 0, 0, 1, 9, 1, 1, 1], [0, 0, 3]):
        got = list(counting.runs(np.array(sizes, dtype=np.int64), 3))
        assert [i for low, high in got for i in range(low, high)] == list(range(len(sizes)))


def test_hashed_text_equals_hashed_ngrams(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    grams = text.word_ngrams(text.remove_stopwords(text.word_tokens(F.col("t"))))
    both = rows.select("i", hashing.hashed_text("b", F.col("t")).alias("a"), hashing.hashed(grams, block="b").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
    assert [len(r["a"] or []) for r in sorted(both)[:4]] == [10, 0, 0, 0]  # the, red, ring, ünïcode, ring_2 and five pairs


def test_exploded_works_an_array_out_once(spark):
    entries = F.transform(F.array("id", "id"), lambda x: x + 1)
    named = spark.range(3).select("id", entries.alias("entries"))
    for e in (entries, F.col("entries")):
        out = arrays.exploded(named, ("id",), e)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1
        assert sorted(r["e"] for r in out.collect()) == [1, 1, 2, 2, 3, 3]


def test_floor_price(spark):
    rows = spark.createDataFrame([(2.5,), (3.0,), (None,)], "p double").select(metrics.floor_price(F.col("p")).alias("r"))
    assert [r["r"] for r in rows.collect()] == [3.0, 3.0, None]


def test_metrics(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, p double")
    y, p = F.col("y"), F.col("p")
    gap = math.log(3 / 2)
    got = rows.agg(metrics.rmsle(y, p), metrics.rmsle_log_inputs(F.log1p(y), F.log1p(p)),
                   metrics.mean_abs_log_error(y, p), metrics.msle(y, p)).first()
    assert list(got) == pytest.approx([math.sqrt(gap**2 / 2)] * 2 + [gap / 2, gap**2 / 2])


def test_smooth_idf(spark):
    rows = spark.createDataFrame([(2,), (1,)], "df int").select(vocabulary.smooth_idf(F.col("df"), F.lit(2)).alias("r"))
    assert [r["r"] for r in rows.collect()] == pytest.approx([1.0, 1.405465], abs=1e-6)


def test_nonzero_price_keeps_missing(spark):
    rows = spark.createDataFrame([(0.0,), (None,), (5.0,)], "price double")
    assert [r["price"] for r in clean.filter_nonzero_price(rows).collect()] == [None, 5.0]


def test_placeholder_modes(spark):
    assert one(spark, "no description yet", clean.replace_placeholder) == "no description yet"
    assert one(spark, "no description yet", lambda c: clean.replace_placeholder(c, "intended")) == ""


def test_edit_distance():
    import pandas as pd

    def plain(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    words = ["", "a", "ab", "ba", "ca", "abc", "acb", "gold", "glod", "golden ring", "é€x", "x€é"]
    pairs = pd.DataFrame([(a, b) for a in words for b in words], columns=["a", "b"])
    got = distances(pairs.a, pairs.b).tolist()
    assert got == [plain(a, b) for a, b in zip(pairs.a, pairs.b)]
    assert distances(pd.Series(["ab", "ca"]), pd.Series(["ba", "abc"])).tolist() == [1, 3]


def test_missing_markers_and_quotes(spark, tmp_path):
    path = tmp_path / "train.tsv"
    path.write_text(
        "train_id\tname\titem_condition_id\tcategory_name\tbrand_name\tprice\tshipping\titem_description\n"
        '0\tring\t1\tN/A\tnull\t10.0\t1\t"two\nlines ""quoted"""\n'
        "1\tnut \\ bolt\t2\ta/b/c\tAcme\tNA\t0\t\n")
    a, b = tsv.read_train(spark, str(path), multiline=True).orderBy("train_id").collect()
    assert (a.category_name, a.brand_name, a.price, a.item_description) == (None, None, 10.0, 'two\nlines "quoted"')
    assert (b.name, b.price, b.item_description, b.shipping) == ("nut \\ bolt", None, None, 0)
    with pytest.raises(Exception, match="MALFORMED|malformed"):  # split reading: an error, not shifted columns
        tsv.read_train(spark, str(path)).select("price").collect()


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "train.tsv"
    with path.open("w") as out:
        out.write("train_id\tname\titem_condition_id\tcategory_name\tbrand_name\tprice\tshipping\titem_description\n")
        out.writelines(f'{i}\tname {i}\t1\ta/b/c\t"say ""x"""\t1.5\t0\tplain text {i}\n' for i in range(20_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = tsv.read_train(spark, str(path))
        assert rows.rdd.getNumPartitions() > 3 and rows.count() == 20_000
        assert rows.where("brand_name = 'say \"x\"' and item_description = concat('plain text ', train_id)").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_whole_values_break_at_line_feeds_only(spark):
    assert one(spark, "a\rb\nc\x85d\u2028e", text.whole_value_tokens) == ["a\rb", "c\x85d\u2028e"]


def test_submission_holds_64_bit_ids(spark, tmp_path):
    tsv.write_submission(spark.createDataFrame([(3_000_000_000, 4.5)], "test_id bigint, price double"), str(tmp_path / "out"))
    back = spark.read.schema("test_id bigint, price double").option("header", True).csv(str(tmp_path / "out"))
    assert [tuple(r) for r in back.collect()] == [(3_000_000_000, 4.5)]


def test_md5_of_many_texts_at_once():
    texts = [b"", b"a", "é".encode() * 27, b"x" * 55, b"x" * 56, b"x" * 200, *[b"%d word" % i for i in range(20_000)]]
    want = [int(hashlib.md5(t).hexdigest()[:9], 16) for t in texts]
    assert hashing.md5_numbers(pa.array(texts, pa.binary())).tolist() == want
    assert hashing.md5_numbers(pa.array(texts, pa.binary()).slice(2, 9)).tolist() == want[2:11]
    assert hashing.md5_numbers(pa.array([], pa.binary())).tolist() == []


def test_equal_texts_of_a_batch_are_worked_on_once():
    seen = []

    def work(texts):
        seen.extend(texts.to_pylist())
        return pc.utf8_length(texts)

    assert counting.each_once(pa.array(["aa", None, "b", "aa", "b"]), work).to_pylist() == [2, None, 1, 2, 1]
    assert seen == ["aa", "b"]
    assert counting.each_once(pa.array([None, None], pa.string()), work).to_pylist() == [None, None]
