"""Whitening by shifted Cholesky QR: distributed Gram passes over the rows, everything else on small triangles.

Each pass brings the centred rows X to Q = X R1^-1 R2^-1 ... by triangular solves, adds up the Gram matrix of Q over all
tasks and takes its Cholesky factor as the next R. The first factor is that of the Gram matrix plus a small shift, which
keeps it positive whatever the condition; the following ones finish the work. The product of the factors is the R of
X = QR, so its singular values and right vectors are those of X and no covariance is squared: components come out to
double precision. The driver holds matrices of dimension x dimension only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.shared import free_name, map_batches
from tagwright.llm.vectors import commonest_size, matrix, usable
from tagwright.storage import store

PASSES = 6  # at most; two or three suffice unless directions are missing
CLOSE = 1e-10  # a Gram matrix this near to the identity needs no further pass
_UNIT = np.finfo(np.float64).eps
_BLOCK = 4096  # rows worked on at a time


@dataclass
class Whitening:
    """Sums of the fitted rows, components (a row each, longest first), their variances, all variance, and the check."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float
    wide: bool = False  # whether n times an entry can leave 64 bits


def whole_vectors(df: DataFrame, vector_column: str, scale: int, shift: int) -> DataFrame:
    """Rows with ``x = floor(scale * entry) + shift`` in place of a vector column, stored.

    Rows go whose vector is null, empty, or holds a null or non-finite entry; so do those of another dimension than most
    have. Entries whose scaled value lies beyond 2**53 either way count as that bound. All other columns stay.
    """
    bound = float(2**53)
    scaled = F.transform(vector_column, lambda c: (
        F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), c.cast("double") * scale))) + shift).cast("bigint"))
    good = df.where(usable(F.col(vector_column), zero=True))
    x = free_name(df.drop(vector_column), "x")
    rows = store(good.withColumn(vector_column, scaled).withColumnRenamed(vector_column, x), "whole-vectors")
    return rows.where(F.size(x) == commonest_size(rows, x))


def _centred(x: np.ndarray, fit: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - S`` as exact integers, and the centred entries rounded once."""
    kind = object if fit.wide else np.int64
    exact = x.astype(kind) * fit.n - np.array(fit.sums, dtype=kind)
    return exact, (exact / fit.n).astype(np.float64)


def _solve(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``q r^-1`` for an upper triangular ``r``, by substitution over the columns of ``q``."""
    out = np.empty_like(q)
    for j in range(q.shape[1]):
        out[:, j] = (q[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _sums(rows: DataFrame, column: str, size: int) -> tuple[int, list[int], int]:
    """Number of rows, exact sums of all entries, largest entry by size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, [0] * size, 0
        for batch in batches:
            x = matrix(batch.column(0), size, np.int64)
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)  # each part sums without overflow
            total = [t + (int(h) << 32) + int(s) for t, h, s in zip(total, high, low)]
            n, most = n + len(x), max(most, int(np.abs(x).max(initial=0)))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array(total, pa.decimal128(38)), pa.array([n] * size, pa.int64()),
                 pa.array([most] * size, pa.int64())], ["j", "s", "n", "most"])

    parts = rows.select(column).mapInArrow(each, "j int, s decimal(38,0), n bigint, most bigint")
    found = parts.groupBy("j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("j").collect()
    return (found[0]["n"], [int(r["s"]) for r in found], max(r["most"] for r in found)) if found else (0, [0] * size, 0)


def _gram(rows: DataFrame, column: str, size: int, width: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``(W, 1)' (W, 1)`` of ``W = work(x)`` with ``width`` columns, added up over all tasks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                w = work(matrix(batch.column(0).slice(at, _BLOCK), size, np.int64))
                w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
                total += w.T @ w
        if total[-1, -1]:
            i, j = np.triu_indices(width + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    parts = rows.select(column).mapInArrow(each, "i int, j int, v double")
    out = np.zeros((width + 1, width + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dimension**2 / 2 numbers
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def fit(rows: DataFrame, column: str = "x", components: int = 32) -> Whitening:
    """Components of stored rows of whole-number vectors, all of one dimension.

    Directions without variance (up to rounding) give no component: constant entries, or fewer rows than dimensions. An
    empty table gives none at all.
    """
    first = rows.select(F.size(column)).first()
    size = first[0] if first else 0
    n, sums, most = _sums(rows, column, size)
    done = Whitening(n, sums, np.zeros((0, size)), np.zeros(0), 0.0, 0.0, wide=max(n, 1) * max(most, 1) >= 2**61)
    if not n:
        return done
    factors: list[np.ndarray] = []
    product = np.eye(size)
    for turn in range(PASSES):
        def orthogonal(x: np.ndarray) -> np.ndarray:
            q = _centred(x, done)[1]
            for r in factors:
                q = _solve(q, r)
            return q

        gram = _gram(rows, column, size, size, orthogonal)[:size, :size]
        if not gram.any():
            return done  # all rows are equal
        close = bool(turn) and np.abs(gram - np.eye(size)).max() <= CLOSE
        shift = 11 * (n * size + size * (size + 1)) * _UNIT / 2 * np.linalg.norm(gram, 2)
        try:
            factor = np.linalg.cholesky(gram + (0 if turn else shift) * np.eye(size)).T
        except np.linalg.LinAlgError:  # directions without variance: shifted again, they shrink from pass to pass
            factor = np.linalg.cholesky(gram + shift * np.eye(size)).T
        factors.append(factor)
        product = factor @ product
        if close:
            break
    _, lengths, right = np.linalg.svd(product)
    live = lengths > 8 * size * _UNIT * lengths[0]
    variances = np.where(live, lengths, 0) ** 2 / n
    signs = np.sign(right[np.arange(size), np.abs(right).argmax(axis=1)])
    done.total = float(variances.sum())
    done.components = (right * signs[:, None])[live][:components]
    done.variances = variances[live][:components]
    width = len(done.variances)
    check = _gram(rows, column, size, width, lambda x: _projected(_centred(x, done)[1], done))
    covariance = check[:width, :width] / n - np.outer(check[width, :width], check[width, :width]) / n / n
    done.identity_error = float(np.abs(covariance - np.eye(width)).max(initial=0))
    return done


def _projected(centred: np.ndarray, fit: Whitening) -> np.ndarray:
    return (centred @ fit.components.T) / np.sqrt(fit.variances)


def transform(rows: DataFrame, fit: Whitening, column: str = "x", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, ``whitened`` (an entry per component) and ``deviation``, the exact sum of ``(n * x - S)**2`` (null beyond
    38 digits), of every row."""
    size = len(fit.sums)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(at, _BLOCK)
            exact, centred = _centred(matrix(part.column(len(keep)), size, np.int64), fit)
            if not fit.wide and int(np.abs(exact).max(initial=0)) ** 2 * size >= 2**62:
                exact = exact.astype(object)
            squares = [int(s) if s < 10**38 else None for s in (exact * exact).sum(axis=1)]
            white = _projected(centred, fit)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(keep)], lists, pa.array(squares, pa.decimal128(38))], [*keep, "whitened", "deviation"])

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keep)
    return map_batches(rows.select(*keep, column), work, f"{kinds}whitened array<double>, deviation decimal(38,0)")
