"""Log-error metrics as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_gap(actual: Column, predicted: Column) -> Column:
    return F.log1p(actual) - F.log1p(predicted)


def rmse(actual: Column, predicted: Column) -> Column:
    gap = actual - predicted
    return F.sqrt(F.avg(gap * gap))


def rmsle_log_inputs(actual_log: Column, predicted_log: Column) -> Column:
    """RMSLE when both inputs are already ``log1p`` values."""
    return rmse(actual_log, predicted_log)


def rmsle(actual: Column, predicted: Column) -> Column:
    return rmse(F.log1p(actual), F.log1p(predicted))


def mean_abs_log_error(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(_log_gap(actual, predicted)))


def msle(actual: Column, predicted: Column) -> Column:
    gap = _log_gap(actual, predicted)
    return F.avg(gap * gap)


def price_from_log(log_price: Column) -> Column:
    return F.expm1(log_price)


def floor_price(price: Column, lowest: float = 3.0) -> Column:
    """Prices below ``lowest`` become ``lowest``; null stays null."""
    return F.when(price < lowest, F.lit(lowest)).otherwise(price)
