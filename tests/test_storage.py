"""Stored tables: scratch blocks leave only what they keep, and writes leave no shuffle files behind."""

import os

import pytest
from pyspark.sql import functions as F

from tagwright.storage import arrow_rows, scratch, scratch_path, store, tidy


def _folder(df):
    return os.path.dirname(df.inputFiles()[0]).removeprefix("file:").replace("file://", "")


def test_tables_of_a_block_go_with_it(spark):
    with scratch(spark, "outer") as keep:
        a = store(spark.range(5), "a")
        with scratch(spark, "inner") as keep_inner:
            b = store(spark.range(6), "b")
            c = keep_inner(b.where("id > 1"), "c")
            b_folder = _folder(b)
            assert b.count() == 6
        assert c.count() == 4 and not os.path.exists(b_folder) and _folder(a)
        d = keep(c.unionByName(a), "d")
        c_folder = _folder(c)
    assert d.count() == 9 and not os.path.exists(c_folder)


def test_a_block_that_fails_leaves_nothing(spark):
    with pytest.raises(ValueError), scratch(spark, "failing"):
        folder = _folder(store(spark.range(5), "a"))
        raise ValueError
    assert not os.path.exists(folder) and "failing" not in scratch_path(spark, "x")


def test_tidy_functions_keep_their_result(spark):
    folders = []

    @tidy
    def doubled(df):
        """Twice the ids."""
        step = store(df, "step")
        folders.append(_folder(step))
        return step.select((F.col("id") * 2).alias("id"))

    out = doubled(spark.range(4))
    assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6] and not os.path.exists(folders[0])
    assert doubled.__doc__ == "Twice the ids."


def test_a_write_frees_its_shuffles(spark):
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    out = store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert out.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_arrow_rows_bound_the_batches_of_a_block(spark):
    most = lambda: max(r["n"] for r in spark.range(0, 9000, 1, 1).mapInArrow(
        lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint").collect())
    before = most()
    assert before > 2000
    with pytest.raises(ValueError), arrow_rows(spark, 2000):
        assert most() == 2000
        with arrow_rows(spark, 5000):  # a smaller setting stays
            assert most() == 2000
        raise ValueError
    assert most() == before
