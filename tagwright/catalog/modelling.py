"""Queries on splits, metrics, models and blending."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright import fixed
from tagwright.catalog.base import mean_predictor, query, rounded
from tagwright.functions import metrics
from tagwright.operators import blend, boosting, models, ridge, split
from tagwright.plans import flows
from tagwright.sources import tsv
from tagwright.storage import store

# ---- stacking, splits and samples ----

@query("stack_train_test", """
SELECT item_id, split, name, CASE WHEN split = 'train' THEN price END AS price, shipping FROM t""")
def stack_train_test(t: DataFrame) -> DataFrame:
    train = t.where("split = 'train'").withColumnRenamed("item_id", "train_id").drop("split")
    test = t.where("split = 'test'").withColumnRenamed("item_id", "test_id").drop("split", "price")
    return tsv.as_listings(train, test).select("item_id", "split", "name", "price", "shipping")


@query("head_tail_split", "SELECT item_id, 'head' AS part FROM t WHERE split = 'train' UNION ALL "
       "SELECT item_id, 'tail' FROM t WHERE split = 'test'")
def head_tail_split(t: DataFrame) -> DataFrame:
    head, tail = split.head_tail_split(t)
    return head.select("item_id", F.lit("head").alias("part")).unionByName(tail.select("item_id", F.lit("tail").alias("part")))


@query("ordered_holdout", """
SELECT item_id, fraction, CASE WHEN rn <= floor(fraction * n) THEN 'train' ELSE 'valid' END AS part FROM (
  SELECT item_id, row_number() OVER (ORDER BY item_id) AS rn, count(*) OVER () AS n FROM t WHERE split = 'train')
CROSS JOIN (SELECT unnest([CAST(0.999 AS DOUBLE), CAST(0.8 AS DOUBLE)]) AS fraction)""")
def ordered_holdout(t: DataFrame) -> DataFrame:
    train = t.where("split = 'train'").select("item_id")
    parts = []
    for fraction in (fixed.HOLDOUT_FRACTION, 0.8):
        for name, part in zip(("train", "valid"), split.ordered_holdout(train, fraction)):
            parts.append(part.select("item_id", F.lit(fraction).alias("fraction"), F.lit(name).alias("part")))
    return reduce(DataFrame.unionByName, parts)


def _sample_sql(seed: int) -> str:
    order = f"CAST('0x' || substr(md5(item_id || '-{seed}'), 1, 15) AS BIGINT)"
    return f"""(SELECT item_id, {seed} AS seed, price, category_name FROM (
  SELECT *, row_number() OVER (ORDER BY {order}, item_id) AS rn, count(*) OVER () AS n FROM t WHERE split = 'train')
WHERE rn <= floor(0.85::DOUBLE * n))"""


@query("seeded_subsample", " UNION ALL ".join(f"SELECT item_id, seed FROM {_sample_sql(s)}" for s in (2, 3, 4)))
def seeded_subsample(t: DataFrame) -> DataFrame:
    train = t.where("split = 'train'").select("item_id")
    return reduce(DataFrame.unionByName, [
        split.seeded_subsample(train, s).withColumn("seed", F.lit(s)) for s in (2, 3, 4)])


# ---- metrics, on a stand-in prediction ----

_SCORED = "(SELECT x.item_id, x.price, pred FROM t x JOIN mean_category_name USING (item_id))"


def _metric(key: str, expression: str, fn) -> None:
    @query(key, f"SELECT round({expression}, 6) AS score FROM {_SCORED}", "mean_category_name")
    def run(t: DataFrame) -> DataFrame:
        return mean_predictor(t, "category_name").agg(rounded(fn(F.col("price"), F.col("pred")), "score"))


_GAP = "(ln(1 + price) - ln(1 + pred))"
_metric("rmsle_log_inputs", f"sqrt(avg({_GAP} * {_GAP}))",
        lambda y, p: metrics.rmsle_log_inputs(F.log1p(y), F.log1p(p)))
_metric("rmsle", f"sqrt(avg({_GAP} * {_GAP}))", metrics.rmsle)
_metric("mean_abs_log_error", f"avg(abs({_GAP}))", metrics.mean_abs_log_error)
_metric("msle_loss", f"avg({_GAP} * {_GAP})", metrics.msle)


# ---- blending, on stand-in predictions ----

_STAND_INS = {"tree": "item_condition_id", "linear": "category_name", "embedding": "brand_name"}


def _stand_ins(t: DataFrame) -> dict[str, DataFrame]:
    return {name: mean_predictor(t, column).select(F.col("item_id").alias("test_id"), "pred")
            for name, column in _STAND_INS.items()}


_BLEND_FROM = """mean_item_condition_id a JOIN mean_category_name b USING (item_id) JOIN mean_brand_name c USING (item_id)"""
_BLEND_NEEDS = "mean_item_condition_id mean_category_name mean_brand_name"


@query("blend_join", f"SELECT item_id AS test_id, round(a.pred, 6) AS tree, round(b.pred, 6) AS linear, "
       f"round(c.pred, 6) AS embedding FROM {_BLEND_FROM}", _BLEND_NEEDS)
def blend_join(t: DataFrame) -> DataFrame:
    return blend.align_predictions(_stand_ins(t)).select("test_id", *[rounded(c, c) for c in _STAND_INS])


@query("blend", f"SELECT item_id AS test_id, round(0.2::DOUBLE * greatest(a.pred, 3) + 0.4::DOUBLE * greatest(b.pred, 3) "
       f"+ 0.4::DOUBLE * greatest(c.pred, 3), 6) AS price FROM {_BLEND_FROM}", _BLEND_NEEDS)
def blend_query(t: DataFrame) -> DataFrame:
    return blend.blend(_stand_ins(t)).select("test_id", rounded("price", "price"))


def _snapshot_sql(seed: int) -> str:
    return f"""(SELECT x.item_id, exp(coalesce(m.m, o.m)) - 1 AS pred FROM t x
LEFT JOIN (SELECT category_name AS k, avg(ln(1 + price)) AS m FROM {_sample_sql(seed)} WHERE price <> 0 GROUP BY 1) m
ON m.k = x.category_name CROSS JOIN (SELECT avg(ln(1 + price)) AS m FROM {_sample_sql(seed)} WHERE price <> 0) o
WHERE x.split = 'test')"""


@query("snapshot_ensemble", f"""
SELECT item_id, round(greatest(0.2::DOUBLE * c.pred + 0.4::DOUBLE * d.pred + 0.4::DOUBLE * b.pred, 3), 6) AS pred
FROM {_snapshot_sql(2)} b JOIN {_snapshot_sql(3)} c USING (item_id) JOIN {_snapshot_sql(4)} d USING (item_id)""")
def snapshot_ensemble(t: DataFrame) -> DataFrame:
    t = store(t.select("item_id", "split", "price", "category_name"), "snapshot-listings")  # every snapshot reads it
    train = t.where("split = 'train'").select("item_id", "price", "category_name")
    snapshots = {
        s: mean_predictor(t, "category_name", split.seeded_subsample(train, s)).select("item_id", "pred")
        for s in fixed.SNAPSHOT_WEIGHTS
    }
    return blend.snapshot_ensemble(snapshots).select("item_id", rounded("pred", "pred"))


# ---- fitted models ----

@query("ridge_fit_score")
def ridge_fit_score(t: DataFrame) -> DataFrame:
    return flows.ridge_predictions(t)


@query("ridge_one_hot_fit", """
SELECT CAST(feature AS BIGINT) AS feature, round(n / (n + 0.5) * (m - b), 6) AS weight, round(b, 6) AS intercept FROM (
  SELECT *, sum(n / (n + 0.5) * m) OVER () / sum(n / (n + 0.5)) OVER () AS b FROM (
    SELECT item_condition_id - 1 AS feature, CAST(count(*) AS DOUBLE) AS n, avg(ln(1 + price)) AS m
    FROM t WHERE split = 'train' AND price <> 0 GROUP BY 1))""")
def ridge_one_hot_fit(t: DataFrame) -> DataFrame:
    """The solver on one block of codes, where the solution is known: weights and intercept."""
    entry = F.struct((F.col("item_condition_id") - 1).cast("bigint").alias("feature"), F.lit(1.0).alias("value"))
    train = flows.with_label(t).where("split = 'train'").select("label", F.array(entry).alias("entries"))
    model = ridge.fit_ridge(train, 5, tolerance=1e-12)
    return model.weights.where("weight <> 0").select(
        "feature", rounded("weight", "weight"), F.round(F.lit(model.intercept), 6).alias("intercept"))


@query("gbt_shipping_fit", """
SELECT x.item_id, round(m, 6) AS prediction FROM t x JOIN (
  SELECT shipping, avg(ln(1 + price)) AS m FROM t WHERE split = 'train' AND price <> 0 GROUP BY 1) USING (shipping)
WHERE x.split = 'test'""")
def gbt_shipping_fit(t: DataFrame) -> DataFrame:
    """The tree fit on one column of two values with full steps, where every leaf is a group mean."""
    entry = F.struct(F.lit(0).cast("bigint").alias("feature"), F.col("shipping").cast("double").alias("value"))
    entries = F.filter(F.array(entry), lambda e: e["value"] > 0)
    rows = store(flows.with_label(t).select("item_id", "split", "label", entries.alias("entries")), "shipping-items")
    train, test = split.head_tail_split(rows)
    model = boosting.fit(train, 2, rate=1.0, share=1.0, patience=None)
    return model.transform(test).select("item_id", rounded("prediction", "prediction"))


@query("gbt_fit_score")
def gbt_fit_score(t: DataFrame) -> DataFrame:
    return flows.tree_predictions(t)


@query("embedding_fit_score")
def embedding_fit_score(t: DataFrame) -> DataFrame:
    return flows.embedding_predictions(t)


@query("snapshot_fit_score")
def snapshot_fit_score(t: DataFrame) -> DataFrame:
    """The weighted snapshots of one continuing fit, on the test listings."""
    return flows.embedding_snapshots(t)


@query("hold_out_fit")
def hold_out_fit(t: DataFrame) -> DataFrame:
    """Fit on the head of train, score held-out and test listings."""
    model, held, test = flows.tree_fit(t, fraction=0.8)
    return models.predicted_price(model, held.unionByName(test), ("item_id", "split"))


@query("validation_rmse")
def validation_rmse(t: DataFrame) -> DataFrame:
    """Log-space RMSE on the held-out listings: of the tree model after every round, of the network after every epoch."""
    model, held, _ = flows.tree_fit(t, fraction=0.8)
    fits, held_inputs, _ = flows.embedding_epochs(t, fraction=0.8)
    trees = flows.tree_curve(model, held).select(F.lit("tree").alias("model"), F.col("round").alias("step"), "n", "rmse")
    snapshots = flows.embedding_scores(fits, held_inputs)
    return trees.unionByName(snapshots.select(F.lit("embedding").alias("model"), F.col("epoch").alias("step"), "n", "rmse"))


@query("blended_prices")
def blended_prices(t: DataFrame) -> DataFrame:
    return flows.blended_prices(t)
