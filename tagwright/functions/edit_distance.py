"""Restricted edit distance (insert, delete, substitute, swap of neighbours) for a column of word pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_CELLS = 4_000_000  # most matrix cells held at once


def _codes(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), dtype=np.uint32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), dtype=np.uint32)
    return out


def _block(left: list[str], right: list[str]) -> np.ndarray:
    """Distances of one block of pairs; every step handles all pairs of the block at once."""
    n_left = np.array([len(w) for w in left])
    n_right = np.array([len(w) for w in right])
    rows, cols = int(n_left.max(initial=0)), int(n_right.max(initial=0))
    a, b = _codes(left, rows), _codes(right, cols)
    pair = np.arange(len(left))
    before = None
    above = np.tile(np.arange(cols + 1), (len(left), 1))
    result = np.where(n_left == 0, n_right, 0)
    for i in range(1, rows + 1):
        here = np.empty_like(above)
        here[:, 0] = i
        for j in range(1, cols + 1):
            changed = a[:, i - 1] != b[:, j - 1]
            best = np.minimum(above[:, j] + 1, here[:, j - 1] + 1)
            best = np.minimum(best, above[:, j - 1] + changed)
            if i > 1 and j > 1:
                swapped = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1]) & changed
                best = np.where(swapped, np.minimum(best, before[:, j - 2] + 1), best)
            here[:, j] = best
        done = n_left == i
        result[done] = here[pair[done], n_right[done]]
        before, above = above, here
    return result


def distances(left: pd.Series, right: pd.Series) -> pd.Series:
    """Pairwise distances; pairs of similar length are worked on together so that padding stays small."""
    span = np.maximum(left.str.len().to_numpy(), right.str.len().to_numpy())
    order = np.argsort(span, kind="stable")
    out = np.zeros(len(left), dtype=np.int32)
    at = 0
    while at < len(order):
        # lengths ascend: take as many pairs as fit when padded to the longest taken
        size = min(len(order) - at, max(1, _CELLS // (int(span[order[at]]) + 1)))
        while size > 1 and size * (int(span[order[at + size - 1]]) + 1) > _CELLS:
            size //= 2
        take = order[at : at + size]
        out[take] = _block(left.iloc[take].tolist(), right.iloc[take].tolist())
        at += size
    return pd.Series(out)


def edit_distance(left, right):
    """Column of distances for two word columns without nulls."""
    return F.pandas_udf(distances, "int")(left, right)
