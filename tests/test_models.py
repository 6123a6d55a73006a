"""Fitted models: closed forms and better-than-mean checks."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tagwright.operators import boosting, bundles, models, neural, ridge
from tagwright.plans import flows
from tagwright.storage import store


@pytest.fixture(scope="module")
def problem():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6)) * (rng.random((200, 6)) < 0.5) * np.array([1, 1, 3, 0.1, 1, 1])
    y = x @ np.array([1.0, -2.0, 0.5, 4.0, 0.0, 1.0]) + 3 + rng.normal(size=200) * 0.1
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 0.5 * np.eye(6), xc.T @ yc)
    return x, y, w, y.mean() - x.mean(0) @ w


def test_conjugate_gradients_equal_closed_form(spark, problem):
    x, y, w, b = problem
    rows = [(i, float(y[i]), [(int(j), float(x[i, j])) for j in np.flatnonzero(x[i])]) for i in range(len(y))]
    train = spark.createDataFrame(rows, "item_id long, label double, entries array<struct<feature:bigint,value:double>>")
    model = ridge.fit_ridge(train, 6, tolerance=1e-12)
    got = [r["weight"] for r in model.weights.orderBy("feature").collect()]
    assert got == pytest.approx(list(w), abs=1e-8) and model.intercept == pytest.approx(b, abs=1e-8)
    for options in ({"width": 2}, {"max_coefficients": 0}):  # by slices, and with every vector a table
        other = ridge.fit_ridge(train, 6, tolerance=1e-12, **options)
        got = {r["feature"]: r["weight"] for r in other.weights.collect()}
        assert [got[i] for i in range(6)] == pytest.approx(list(w), abs=1e-8)
        assert other.intercept == pytest.approx(b, abs=1e-8)
    for max_bytes in (None, 0):
        scored = model.transform(train, max_bytes).orderBy("item_id").collect()
        assert [r["prediction"] for r in scored] == pytest.approx(list(x @ w + b), abs=1e-8)


def test_slices_meet_whole(spark, problem, monkeypatch):
    """The sliced sum gives each slice once, whatever the number of partitions."""
    x, y, w, b = problem
    monkeypatch.setattr(ridge, "_DIRECT_BYTES", 0)
    rows = [(float(y[i]), [(int(j), float(x[i, j])) for j in np.flatnonzero(x[i])]) for i in range(len(y))]
    train = spark.createDataFrame(rows, "label double, entries array<struct<feature:bigint,value:double>>").repartition(13)
    model = ridge.fit_ridge(train, 6, tolerance=1e-12, width=4)
    assert [r["weight"] for r in model.weights.orderBy("feature").collect()] == pytest.approx(list(w), abs=1e-8)


def test_moments_take_one_vector_a_pass_and_are_sent_in_pieces(spark, problem, monkeypatch):
    x, y, w, b = problem
    rows = [(float(y[i]), [(int(j), float(x[i, j])) for j in np.flatnonzero(x[i])]) for i in range(len(y))]
    train = spark.createDataFrame(rows, "label double, entries array<struct<feature:bigint,value:double>>")
    sizes, summed = [], ridge.summed
    monkeypatch.setattr(ridge, "summed", lambda blocks, step, size, *rest: sizes.append(size) or summed(blocks, step, size, *rest))
    model = ridge.fit_ridge(train, 6, tolerance=1e-12)
    got = [r["weight"] for r in model.weights.orderBy("feature").collect()]
    assert got == pytest.approx(list(w), abs=1e-8) and max(sizes) <= 6 + 2  # a vector as long as the coefficients, and two numbers
    monkeypatch.setattr(ridge, "_PIECE", 8)
    values, total = np.arange(30.0) % 7, np.zeros(30)
    pieces = list(ridge._pieces(values, 4))
    for piece in pieces:
        for number, at, v in ridge._rows(piece):
            ridge._add(total[number * 4:(number + 1) * 4], at, v)
    assert len(pieces) == 4 and (total == values).all() and max(p.num_rows for p in pieces) <= 2


def test_ridge_blocks_are_small():
    rows = [np.arange(300) + i for i in range(3000)]
    frame = pd.DataFrame({"label": np.arange(3000.0), "feature": rows, "value": [r * 0.5 for r in rows]})
    blocks = pd.concat(list(ridge._blocks([frame])))
    entries = [len(c) // 4 for c in blocks["cols"]]
    assert max(entries) <= 2**17 + 300 and sum(entries) == 900_000
    assert np.concatenate([np.frombuffer(y) for y in blocks["y"]]).tolist() == list(range(3000))


def test_long_tables_are_made_from_few_listings_at_a_time(spark, monkeypatch):
    made = []
    monkeypatch.setattr(flows, "store", lambda df, *rest: made.append((rest, store(df, *rest))) or made[-1][1])

    @F.arrow_udf("string")
    def together(texts: pa.Array) -> pa.Array:
        return pa.array([str(len(texts))] * len(texts))

    rows = spark.range(0, 6000, 1, 1).select(
        F.col("id").alias("item_id"), F.lit("train").alias("split"), F.repeat(F.lit("word "), 1000).alias("text"))
    long = rows.select("item_id", "split", F.lit("b").alias("block"), together("text").alias("feature"), F.lit(1.0).alias("value"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    items = flows.linear_items_of(long, rows, ("item_id",))
    assert items.rows.count() == 6000
    named, table = made[0]
    assert named == ("linear-long",)  # nothing is sorted by split
    assert table.agg(F.max(F.col("feature").cast("int"))).first()[0] < 2000  # all at once were 30 MB of text
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_sparse_vector(spark):
    rows = spark.createDataFrame([([(1, 0.5), (4, -2.0)],), ([],)], "entries array<struct<feature:bigint,value:double>>")
    got = [r["features"] for r in models.assemble(rows, 6).collect()]
    assert got == [Vectors.sparse(6, {1: 0.5, 4: -2.0}), Vectors.sparse(6, {})]


@pytest.fixture(scope="module")
def scored_listings(spark, listings):
    train_mean = flows.with_label(listings).where("split = 'train'").agg(F.avg("label")).first()[0]
    prices = listings.where("split = 'test' and price <> 0").select("item_id", "price")

    def check(predictions):
        joined = store(predictions, "scored").join(prices, "item_id")
        gap = lambda p: F.sqrt(F.avg(F.pow(F.log1p("price") - p, 2)))
        got, base, n = joined.agg(gap(F.log1p("pred")), gap(F.lit(train_mean)), F.count("*")).first()
        assert n == prices.count() and got < base
        return got

    return check


def test_ridge_beats_mean(listings, scored_listings):
    scored_listings(flows.ridge_predictions(listings))


def test_trees_beat_mean(listings, scored_listings):
    scored_listings(flows.tree_predictions(listings, rounds=25))


def test_embedding_beats_mean(listings, scored_listings):
    scored_listings(flows.embedding_predictions(listings, passes=8))


def test_blended_prices(listings):
    prices = store(flows.blended_prices(listings, rounds=2, passes=2), "blended")
    want = listings.where("split = 'test' and (price is null or price <> 0 or split = 'test')").count()
    assert prices.count() == want and prices.where("price is null or price < 3").isEmpty()


def test_snapshots_beat_mean(listings, scored_listings):
    scored_listings(flows.embedding_snapshots(listings, passes=8))


def test_hold_out_fit_and_curve(listings):
    model, held, test = flows.tree_fit(listings, fraction=0.8, rounds=22)
    train = flows.with_label(listings).where("split = 'train'")
    assert held.join(train, "item_id", "left_semi").count() == held.count() > 0
    assert held.join(test, "item_id", "left_semi").isEmpty()
    curve = flows.tree_curve(model, held).orderBy("round").collect()
    assert [r["round"] for r in curve] == list(range(1, 23)) and curve[0]["n"] == held.count()  # a point for every round
    assert len(model.trees) == model.kept == 22  # so few held-out rows decide nothing
    deviation = held.agg(F.stddev_pop("label")).first()[0]
    assert curve[-1]["rmse"] < deviation
    scored = model.transform(held).agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)))).first()[0]
    assert scored == pytest.approx(curve[-1]["rmse"], abs=1e-9)  # the curve is that of the model itself


# ---- boosted trees ----

def _sparse_rows(rng, n, size):
    x = rng.integers(1, 5, size=(n, size)) * (rng.random((n, size)) < rng.uniform(0.05, 0.6, size))
    return x, x @ rng.normal(size=size) * 0.1 + (x[:, 0] > 1) * (x[:, 1] == 0) + rng.normal(size=n) * 0.05


def _as_items(spark, x, y, extra=()):
    rows = [(i, float(y[i]), [(int(j), float(x[i, j])) for j in np.flatnonzero(x[i])], *(bool(e[i]) for e in extra)) for i in range(len(y))]
    names = "item_id long, label double, entries array<struct<feature:bigint,value:double>>" + ", is_held boolean" * len(extra)
    return store(spark.createDataFrame(rows, names).repartition(5), "items")


def _plain_boost(x, y, rounds, rate, depth, leaves, min_rows):
    """The same trees by plain loops: every column and threshold tried on the rows of every node."""
    score, out = np.full(len(y), y.mean()), []
    for _ in range(rounds):
        rest, node, active, count = y - score, np.zeros(len(y), int), [0], 1
        for _ in range(depth):
            found = []
            for k in active:
                at = np.flatnonzero(node == k)
                for j in range(x.shape[1]):
                    for v in np.unique(x[at, j][x[at, j] > 0]):
                        right = x[at, j] >= v
                        if min_rows <= right.sum() <= len(at) - min_rows:
                            a, b = rest[at][right], rest[at][~right]
                            found.append((round(a.sum()**2 / len(a) + b.sum()**2 / len(b) - rest[at].sum()**2 / len(at), 9), -k, -j, -v))
            best = {}
            for f in sorted(found, reverse=True):
                best.setdefault(-f[1], f)
            active = []
            for gain, k, j, v in sorted(best.values(), reverse=True)[:leaves - count]:
                if gain > 1e-9:
                    node[(node == -k) & (x[:, -j] >= -v)] = count
                    active += [-k, count]
                    count += 1
        for k in range(count):
            score[node == k] += rate * rest[node == k].mean()
        out.append(score.copy())
    return out


def test_boosting_equals_plain_loops(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = _sparse_rows(rng, 150, 7)
    items = _as_items(spark, x, y)
    want = _plain_boost(x, y, 3, 0.45, 4, 6, 5)
    for direct in (2**26, 0):  # sums by the driver, sums by slice
        monkeypatch.setattr(boosting, "_DIRECT_BYTES", direct)
        monkeypatch.setattr(boosting, "_SLICE", 2**16 if direct else 4)
        # bins of one row each, so every threshold is there
        bins = boosting.fit_bins
        monkeypatch.setattr(boosting, "fit_bins", lambda train, min_rows: bins(train, 1))
        model = boosting.fit(items, 3, depth=4, leaves=6, min_rows=5, share=1.0, patience=None, round_block=2)
        monkeypatch.setattr(boosting, "fit_bins", bins)
        got = [r["prediction"] for r in model.transform(items).orderBy("item_id").collect()]
        assert got == pytest.approx(want[2], abs=1e-9) and len(model.trees) == 3
        assert [c[2] for c in model.curve] == pytest.approx([np.sqrt(np.mean((y - w)**2)) for w in want])


def test_a_task_sends_only_bins_that_rows_hold(spark):
    rng = np.random.default_rng(3)
    lengths = np.full(300, 4, dtype=np.int32)
    block = (lengths, rng.integers(0, 40, 1200).astype(np.int32) * 100, rng.random(300), np.zeros(300, dtype=np.uint8), np.zeros(300))
    layout = SimpleNamespace(value=(np.array([0, 2000, 4000]), np.arange(100, 4100, 100).repeat(100)))
    step = boosting._Pass(boosting.Tree([0], [0], [1500]), [0, 1], 4000, layout, 5, 1.0, (1, 0))
    (totals, at, rows, rest), = step.found([block])
    assert len(at) <= 80 and rows.sum() == 1200  # of 8,000
    table = np.zeros((2, 8000))
    table[0, at], table[1, at] = rows, rest
    whole = [np.concatenate([totals.ravel(), table.reshape(2, 2, 4000)[:, :, a:b].ravel()]) for a, b in ((0, 2000), (2000, 4000))]
    parts = list(step.sums([block]))
    assert all((data == own).all() for (_, data), own in zip(parts, whole))
    direct = step.run(spark.sparkContext.parallelize([block], 1))
    best = [f for part in parts for f in step.best(part)]
    assert all(direct[k][0] == max(f[1] for f in best if f[0] == k) for k in (0, 1))


def test_a_pass_holds_little_beside_the_entries():
    rng, count = np.random.default_rng(4), 500
    lengths = rng.integers(0, 40, 20_000).astype(np.int32)
    bins = rng.integers(0, count, lengths.sum()).astype(np.int32)
    label, score, held = rng.random(len(lengths)), rng.random(len(lengths)), (rng.random(len(lengths)) < 0.2).astype(np.uint8)
    tree = boosting.Tree([0, 1], [10, 40], [12, 90], np.zeros(3))
    step = boosting._Pass(tree, [0, 2], count, SimpleNamespace(value=None), 20, 1.0, (1, 1))
    tracemalloc.start()
    totals, table = step.added([(lengths, bins, label, held, score)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(bins)  # key, weight and a mask of the entries; no numbers of rows beside them
    row = np.repeat(np.arange(len(lengths)), lengths)
    has = np.zeros((2, len(lengths)), bool)
    for i, (low, high) in enumerate(((10, 12), (40, 90))):
        has[i, row[(bins >= low) & (bins < high)]] = True
    node = np.where(~has[0], 0, np.where(has[1], 2, 1))
    for i, k in enumerate((0, 2)):
        inside = (held == 0) & (node == k)
        mine = inside[row]
        assert totals[0, i] == inside.sum() and totals[1, i] == pytest.approx((label - score)[inside].sum())
        assert (table[0, i] == np.bincount(bins[mine], minlength=count)).all()
        assert table[1, i] == pytest.approx(np.bincount(bins[mine], (label - score)[row[mine]], count))


def test_bins_and_values_between_them(spark):
    x = np.zeros((40, 3))
    x[:20, 0], x[20:, 0], x[:30, 1], x[:3, 2] = 1, 2, np.arange(30) + 1.0, 1
    items = _as_items(spark, x, np.zeros(40))
    bins = boosting.fit_bins(items, 5)
    rows = {r["feature"]: r for r in bins.table.collect()}
    assert sorted(rows) == [0, 1] and len(rows[0]["cells"]) == 2 and 4 <= len(rows[1]["cells"]) <= 6
    odd = spark.createDataFrame([(0, [(0, 1.5), (1, 1e-9), (7, 1.0)]), (1, [(0, 99.0)]), (2, [])],
                                "item_id long, entries array<struct<feature:bigint,value:double>>")
    got = {r["item_id"]: r["bins"] for r in boosting.binned(odd, bins, ("item_id",)).collect()}
    assert got == {0: [rows[0]["first"], rows[1]["first"]], 1: [rows[0]["first"] + 1], 2: []}


def test_patience_keeps_the_best_round_and_full_fits_do_not_stop(spark):
    rng = np.random.default_rng(4)
    x, y = _sparse_rows(rng, 500, 6)
    y += rng.normal(size=500)  # noise, so the held-out error soon rises
    items = _as_items(spark, x, y, (np.arange(500) % 2 == 0,))
    model = boosting.fit(items, 60, held="is_held", min_rows=5, patience=2, round_block=5)
    errors = [c[4] for c in model.curve]
    assert len(model.trees) == len(errors) < 60 and errors[model.kept - 1] == min(errors)
    assert len(errors) - model.kept >= 10  # it went on for two blocks
    whole = boosting.fit(items, 12, held="is_held", min_rows=5, patience=None, round_block=5)
    assert whole.kept == len(whole.trees) == 12 and [c[0] for c in whole.curve] == list(range(1, 13))


def test_boosting_without_rows_columns_or_splits(spark):
    x = np.zeros((6, 2))
    items = _as_items(spark, x, np.arange(6.0))
    model = boosting.fit(items, 3)
    assert model.trees == [] and {r["prediction"] for r in model.transform(items).collect()} == {2.5}
    nothing = boosting.fit(items.limit(0), 3)
    assert nothing.trees == [] and nothing.base == 0.0
    with pytest.raises(ValueError):
        boosting.fit(items, 3, leaves=65)


# ---- lossless bundles ----

def test_no_two_columns_of_a_bundle_meet_and_nothing_is_lost(spark):
    rng = np.random.default_rng(9)
    n, size = 120, 90
    x = np.round(rng.random((n, size)) * 9 + 0.1, 3) * (rng.random((n, size)) < 0.08)
    x[:, :5] = np.eye(5)[rng.integers(5, size=n)]  # a block of codes
    items = _as_items(spark, x, np.zeros(n))
    score = rng.normal(size=size)
    known = spark.createDataFrame([(j, int((x[:, j] > 0).sum()), float(score[j]), 0 if j < 5 else -1) for j in range(size)],
                                  "feature bigint, often bigint, score double, block int")
    made = bundles.bundle(items, known, size)
    table = {r["feature"]: r for r in made.table.collect()}
    for row in x:
        at = [table[j]["bundle"] for j in np.flatnonzero(row)]
        assert len(set(at)) == len(at)
    longest = int((x > 0).sum(axis=1).max())
    assert longest <= made.count < size / 2 and len({table[j]["bundle"] for j in range(5)}) == 1
    for b in range(made.count):  # columns of a bundle stand in the order of their score
        inside = sorted((r["place"], score[j]) for j, r in table.items() if r["bundle"] == b)
        assert [p for p, _ in inside] == list(range(len(inside))) and [s for _, s in inside] == sorted(s for _, s in inside)
    column = {(r["bundle"], r["place"]): (j, r["top"]) for j, r in table.items()}
    for max_bytes in (None, 0):
        back = np.zeros((n, size))
        for r in bundles.bundled(items, made, max_bytes=max_bytes).collect():
            for e in r["entries"]:
                place = int(np.ceil(e["value"])) - 1
                j, top = column[e["feature"], place]
                back[r["item_id"], j] = (e["value"] - place) * top
        assert back == pytest.approx(x, abs=1e-9)


def test_colours_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    x = (rng.random((60, 40)) < 0.15).astype(float)
    items = _as_items(spark, x, np.zeros(60))
    got = [bundles.colour_columns(items.repartition(p), 40, np.arange(40)).tolist() for p in (1, 3, 11)]
    assert got[0] == got[1] == got[2]
    assert bundles.colour_columns(items.limit(0), 4, np.arange(4)).tolist() == [0, 0, 0, 0]


def test_spark_trees_on_bundles(listings, scored_listings):
    train = flows.with_label(listings)
    vectors, made = flows.bundled_tree_items(train.where("split = 'train'"), train.where("split = 'test'"))
    vectors = store(vectors, "bundled")
    model = models.fit_trees(vectors.where("split = 'train'"), 5)
    scored_listings(models.predicted_price(model, vectors.where("split = 'test'")))


# ---- the network ----

def _network_rows(spark, n, rng):
    rows = []
    for i in range(n):
        name, desc = [int(v) for v in rng.integers(0, 12, 10)], [int(v) for v in rng.integers(0, 30, 75)]
        codes = [int(v) for v in rng.integers(0, (3, 4, 2, 5, 5))]
        label = 2.0 + 0.5 * codes[0] + 0.1 * (name.count(3)) + float(rng.normal()) * 0.05
        rows.append((i, label, name, desc, *codes, int(rng.integers(2))))
    names = "item_id long, label double, name array<int>, item_desc array<int>, brand_name int, cat_1 int, cat_2 int, cat_3 int, " \
            "item_condition int, num_vars int"
    return store(spark.createDataFrame(rows, names).repartition(3), "network-rows")


def test_gradient_equals_differences():
    rng = np.random.default_rng(6)
    shape = neural.Shape.of(7, {c: 3 for c in neural.CODES})
    flat = shape.start(1.0, 2) + rng.normal(size=shape.size) * 0.02
    data = {"name": rng.integers(0, 7, (5, 10)), "item_desc": rng.integers(0, 7, (5, 75)), "num_vars": rng.random(5)}
    data |= {c: rng.integers(0, 3, 5) for c in neural.CODES}
    label = rng.normal(size=5)

    def loss(v):
        return ((neural._score(shape.views(v), data)[0] - label)**2).sum()

    scores, kept, texts, codes = neural._score(shape.views(flat), data)
    gradient = np.zeros(shape.size)
    neural.backward(shape.views(flat), shape.views(gradient), texts, codes, kept, 2 * (scores - label))
    for part in shape.views(np.arange(shape.size, dtype=float)).values():  # some weights of every part
        for i in rng.choice(part.ravel().astype(int), min(6, part.size), replace=False):
            step = np.zeros(shape.size)
            step[i] = 1e-6
            assert gradient[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, rel=1e-3, abs=1e-6)


def test_network_learns_alike_on_any_partitions_and_goes_on(spark):
    rows = _network_rows(spark, 90, np.random.default_rng(3))
    start = neural.new_state(rows, rows)
    after = [neural.epoch(start, rows, 0.003, passes=6, partitions=p) for p in (1, 4, 16)]
    for other in after[1:]:
        assert np.abs(other.weights - after[0].weights).max() < 1e-3 and other.error == pytest.approx(after[0].error, abs=1e-4)
    more = neural.epoch(after[0], rows, 0.003, passes=6, partitions=1)
    assert more.steps == 12 and more.error < after[0].error < float(np.std([r["label"] for r in rows.collect()])) + 1
    again = neural.epoch(start.load(after[0].save(spark)), rows, 0.003, passes=6, partitions=1)  # taken up from the store
    assert again.steps == 12 and np.array_equal(again.weights, more.weights)
    gap = more.transform(rows).agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))).first()[0] ** 0.5
    assert gap < more.error * 1.05
    assert neural.epoch(start, rows.limit(0), 0.003, passes=2).steps == 0


def test_epochs_continue_one_fit(listings):
    after, held, test = flows.embedding_epochs(listings, fraction=0.8, passes=3)
    assert sorted(after) == [0, 1, 2, 3, 4] and [after[e].steps for e in range(5)] == [3, 6, 9, 12, 15]
    errors = [r["rmse"] for r in flows.embedding_scores(after, held).orderBy("epoch").collect()]
    assert len(errors) == 5 and errors[-1] < errors[0]


def test_filters_meet_each_different_word_once():
    rng = np.random.default_rng(8)
    shape = neural.Shape.of(9, {c: 3 for c in neural.CODES})
    w, ids = shape.views(shape.start(1.0, 2)), rng.integers(0, 5, (6, 10))
    words, at, known, out = neural._convolved(w, "name", ids)
    assert len(known) == len(words) <= 5 and (words[at] == ids).all()
    windows = np.concatenate([w["embed_name"][ids[:, k:k + 8]] for k in range(neural.KERNEL)], axis=2)
    assert np.allclose(out, np.maximum(windows @ w["filter_name"] + w["filter_bias_name"], 0))


def test_sums_take_no_more_tasks_than_cores(spark):
    tasks = spark.sparkContext.accumulator(0)

    def step(batches):
        tasks.add(1)
        yield np.array([float(sum(b.num_rows for b in batches))])

    many = 3 * spark.sparkContext.defaultParallelism
    assert ridge.summed(spark.range(100).repartition(many), step, 1, many, 4).tolist() == [100.0]
    assert tasks.value <= spark.sparkContext.defaultParallelism
