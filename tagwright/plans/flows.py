"""The three model flows and the blended price table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright import fixed
from tagwright.functions import metrics
from tagwright.operators import (
    blend,
    boosting,
    brands,
    bundles,
    clean,
    encode,
    features,
    models,
    neural,
    ridge,
    split,
    vocabulary,
)
from tagwright.storage import arrow_bytes, store

CARRIED = ("item_id", "split", "label")
_BRAND_BLOCKS = ("name", "brand_name")
_TEXT_BYTES = 2**21  # of listings, cut into entries at a time: entries take some twelve times as much


def with_label(rows: DataFrame) -> DataFrame:
    """Usable listings with ``log1p(price)`` in the same row; zero prices of train rows are dropped."""
    usable = rows.where((F.col("split") == "test") | F.col("price").isNull() | (F.col("price") != 0))
    return usable.withColumn("label", F.log1p("price"))


# ---- linear model ----

def linear_long(
    rows: DataFrame, method: str = "xxhash64", keep: tuple[str, ...] = CARRIED, scope: tuple[str, ...] = ("split",),
    max_bytes: int | None = None,
) -> DataFrame:
    """All blocks of the linear model, each value of ``scope`` imputing brands from its own listings.

    Only name and brand depend on the imputed brand, so the join that fills it moves those two columns and never the
    descriptions; both halves meet again in the grouping by item.
    """
    cleaned = clean.clean_linear(rows)
    entries = features.linear_entries(method)
    early = {b: e for b, e in entries.items() if b not in _BRAND_BLOCKS}
    late = {b: e for b, e in entries.items() if b in _BRAND_BLOCKS}
    named = brands.name_with_brand(
        brands.impute_brands(cleaned, scope=scope, keep=(*keep, "name", "brand_name"), max_bytes=max_bytes))
    return features.explode_blocks(cleaned, early, keep).unionByName(features.explode_blocks(named, late, keep))


def stored_long(long: DataFrame, name: str) -> DataFrame:
    """A long table, written once by tasks that hold the entries of few listings at a time, and that sort nothing by split."""
    with arrow_bytes(long.sparkSession, _TEXT_BYTES):
        return store(long, name)


@dataclass
class Items:
    """One row per listing with its sparse entries, and the number of features."""

    rows: DataFrame
    size: int


def linear_items_of(
    long: DataFrame, train: DataFrame, keep: tuple[str, ...] = CARRIED, max_bytes: int | None = None
) -> Items:
    """hash -> L2 per block -> drop rare -> stack -> idf -> L2 per row; everything is fitted on train rows.

    ``long`` carries ``split``; ``train`` is the train part of the listings it was made from. The long table is written
    once: making it costs more than reading it, and both the fit and the lookup need it.
    """
    long = stored_long(long, "linear-long")
    table = features.fit_linear_features(long.where("split = 'train'"), train.agg(F.count("*")).scalar())
    return Items(features.row_unit(features.weighted(long, table, keep, True, max_bytes)), table.count())


def linear_items(rows: DataFrame, method: str = "xxhash64", max_bytes: int | None = None) -> Items:
    return linear_items_of(linear_long(rows, method, max_bytes=max_bytes), rows.where("split = 'train'"), max_bytes=max_bytes)


def ridge_predictions(rows: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``(item_id, pred)`` of the linear model for test listings."""
    items = linear_items(with_label(rows), max_bytes=max_bytes)
    train, test = split.head_tail_split(store(items.rows, "linear-items", ["split"]))
    return models.predicted_price(ridge.fit_ridge(train, items.size), test)


# ---- tree model ----

def tree_items(train: DataFrame, others: DataFrame) -> Items:
    """Counts and description tf-idf; vocabularies are fitted on ``train``, the rows marked so by ``split``."""
    return tree_items_of(train, others)[0]


def tree_items_of(train: DataFrame, others: DataFrame) -> tuple[Items, DataFrame]:
    """``tree_items`` and the feature table behind them."""
    rows = clean.clean_tree(train.unionByName(others))
    long = stored_long(features.explode_blocks(rows, features.tree_entries(), CARRIED), "tree-long")
    table = features.fit_tree_features(long.where("split = 'train'"), train.agg(F.count("*")).scalar())
    items = features.description_unit(features.weighted(long, table, CARRIED, True))
    return Items(items, table.count()), table


def tree_fit(
    rows: DataFrame, fraction: float = fixed.HOLDOUT_FRACTION, rounds: int = fixed.TREE_ROUNDS,
    patience: int | None = boosting.PATIENCE,
) -> tuple[boosting.BoostedTrees, DataFrame, DataFrame]:
    """Fit on the head of the train listings, all columns as they are; the model, the held-out and the test rows."""
    train, test = split.head_tail_split(with_label(rows))
    head, held = split.ordered_holdout(train, fraction)
    items = tree_items(head, held.withColumn("split", F.lit("held")).unionByName(test))
    stored = store(items.rows, "tree-items", ["split"])
    seen = stored.where("split != 'test'").withColumn("is_held", F.col("split") == "held")
    model = boosting.fit(seen, rounds, held="is_held", patience=patience)
    return model, stored.where("split = 'held'"), stored.where("split = 'test'")


def tree_curve(model: boosting.BoostedTrees, held: DataFrame) -> DataFrame:
    """Log-space RMSE on the held-out rows after every round of the fit: ``round``, ``n``, ``rmse``."""
    return held.sparkSession.createDataFrame([(c[0], c[3], c[4]) for c in model.curve], "round int, n bigint, rmse double")


def tree_predictions(rows: DataFrame, rounds: int = fixed.TREE_ROUNDS) -> DataFrame:
    model, _, test = tree_fit(rows, rounds=rounds)
    return models.predicted_price(model, test)


def bundled_tree_items(train: DataFrame, others: DataFrame) -> tuple[DataFrame, bundles.Bundles]:
    """The tree model's rows with their sparse columns in lossless bundles, as ML vectors for learners that want few columns."""
    items, table = tree_items_of(train, others)
    stored = store(items.rows, "tree-items", ["split"])
    blocks = sorted(r["block"] for r in table.select("block").distinct().collect() if r["block"] not in features.TREE_LIMITS)
    group = F.coalesce(*[F.when(F.col("block") == b, F.lit(i)) for i, b in enumerate(blocks)], F.lit(-1))
    seen = stored.where("split = 'train'").select("label", F.explode("entries").alias("e"))
    score = seen.groupBy(F.col("e.feature").alias("feature")).agg(F.avg("label").alias("score"))
    known = table.select(F.col("fid").alias("feature"), F.col("df").alias("often"), group.alias("block"))
    made = bundles.bundle(stored, store(known.join(score, "feature"), "bundle-order"), items.size)
    return models.assemble(bundles.bundled(stored, made), made.count), made


# ---- embedding model ----

def embedding_inputs(rows: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Model input rows of train and test; word index on train texts, label codes on both."""
    cleaned = clean.clean_embedding(with_label(rows))
    index = store(vocabulary.token_index(cleaned.where("split = 'train'")), "token-index")
    labels = encode.fit_labels(cleaned)
    return encode.model_input_row(cleaned, index, labels, CARRIED, max_bytes)


def embedding_epochs(
    rows: DataFrame, fraction: float = fixed.HOLDOUT_FRACTION, passes: int = neural.PASSES,
) -> tuple[dict[int, neural.State], DataFrame, DataFrame]:
    """One continuing fit: the network after each epoch (from 0), the held-out and the test rows.

    Every epoch draws its own seeded sample of the train head and goes on from the stored weights of the one before.
    """
    stored = store(embedding_inputs(rows), "embedding-items", ["split"])
    train, test = split.head_tail_split(stored)
    head, held = split.ordered_holdout(train, fraction)
    state, after = neural.new_state(head, stored), {}
    for at, rate in enumerate(fixed.EPOCH_RATES):
        state = neural.epoch(state, split.seeded_subsample(head, at), rate, passes)
        state.save(rows.sparkSession)  # from here a fit can be taken up again
        after[at] = state
    return after, held, test


def embedding_predictions(rows: DataFrame, passes: int = neural.PASSES) -> DataFrame:
    """The network after its last epoch, scored on test."""
    after, _, test = embedding_epochs(rows, passes=passes)
    return models.predicted_price(after[max(after)], test)


def embedding_scores(after: dict[int, neural.State], held: DataFrame) -> DataFrame:
    """Log-space RMSE on the held-out rows after every epoch: ``epoch``, ``n``, ``rmse``."""
    scores = [
        state.transform(held).agg(F.lit(epoch).alias("epoch"), F.count("*").alias("n"),
                                  metrics.rmse(F.col("label"), F.col("prediction")).alias("rmse"))
        for epoch, state in after.items()
    ]
    return reduce(DataFrame.unionByName, scores)


def embedding_snapshots(rows: DataFrame, passes: int = neural.PASSES) -> DataFrame:
    """The prices of the test listings after the snapshot epochs of one fit, weighted by epoch."""
    after, _, test = embedding_epochs(rows, passes=passes)
    return blend.snapshot_ensemble({
        epoch: after[epoch].transform(test).select("item_id", F.expm1("prediction").alias("pred"))
        for epoch in fixed.SNAPSHOT_WEIGHTS})


# ---- blend ----

def blended_prices(
    rows: DataFrame, rounds: int = fixed.TREE_ROUNDS, passes: int = neural.PASSES,
) -> DataFrame:
    """``(test_id, price)``: the three models' prices, weighted."""
    predictions = {
        "tree": tree_predictions(rows, rounds),
        "linear": ridge_predictions(rows),
        "embedding": embedding_snapshots(rows, passes),
    }
    return blend.blend({n: p.withColumnRenamed("item_id", "test_id") for n, p in predictions.items()})
