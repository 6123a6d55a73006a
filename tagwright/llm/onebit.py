"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is taken relative to a centre, brought to length one, rotated by a random orthogonal matrix and kept as the
signs of its coordinates, with two scalars: its distance to the centre and the inner product of code and vector. A
query, rotated alike and rounded to 4 bits a coordinate, meets the packed signs by counting common bits; the count and
the scalars give an unbiased estimate of the inner product and a bound on its error. Only vectors whose estimate plus
bound reaches the k-th best score known so far are scored exactly, in double precision.

The index holds every vector. The centre and the first thresholds come from a pilot of at most ``PILOT_NUMBERS``
components (the rows of least hash); thresholds from it are exact scores of real candidates, so they lose nothing. The
bound holds with a probability set by ``CONFIDENCE`` (standard deviations), so a neighbour is missed about once in a
thousand at 3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagwright.llm.shared import map_batches
from tagwright.llm.vectors import commonest_size, matrix, usable
from tagwright.storage import store

CONFIDENCE = 3.0
LEAST_BITS = 128  # shorter vectors get codes of this length all the same: more signs, narrower bounds
QUERY_BITS = 4
PILOT_NUMBERS = 2**20  # components of the pilot, 8 MiB
PASS_BYTES = 16 * 2**20  # queries sent to all tasks at once
_PAIRS = 2**20  # pairs of a vector and a query estimated, and components scored, at a time
_SEED = 20


@dataclass
class Index:
    """Stored rows ``row``, ``vec_id``, ``vector``, ``code``, ``far``, ``corr``, ``mid``, and what coded them."""

    rows: DataFrame
    size: int
    centre: np.ndarray
    pilot_rows: np.ndarray
    pilot: np.ndarray


def rotation(size: int) -> np.ndarray:
    """The first ``size`` rows of a random orthogonal matrix, as many columns as a code has bits; always the same."""
    bits = max(LEAST_BITS, -(-size // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:size]


def _rotated(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the centre, and rotated directions from it (of a vector at the centre: zeros)."""
    rest = x - centre
    top = np.abs(rest).max(axis=1, initial=0)  # scaled first, so that squares of large numbers stay finite
    rest = rest / np.where(top > 0, top, 1)[:, None]
    length = np.sqrt((rest * rest).sum(axis=1))
    return length * top, (rest / np.where(length > 0, length, 1)[:, None]) @ turn


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distance to the centre, inner product of direction and code (1 for a vector at the centre)."""
    far, z = _rotated(x, centre, turn)
    corr = np.abs(z).sum(axis=1) / np.sqrt(turn.shape[1])
    return _pack(z >= 0), far, np.where(far > 0, corr, 1.0)


def build(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> Index:
    """Code all vectors of a table.

    Rows whose id is null, or whose vector is null, empty, all zero or holds a null or non-finite component take no
    part; nor do vectors of another dimension than most have. Repeated rows and ids are rows of their own. Other columns
    are ignored.
    """
    vector = F.col(vector_column)
    named = df.where(F.col(id_column).isNotNull() & usable(vector, zero=False)).select(
        F.col(id_column).alias("vec_id"), vector.alias("vector"))
    named = store(named.withColumn("row", F.monotonically_increasing_id()), "onebit-vectors")
    size = commonest_size(named, "vector")
    named = named.where(F.size("vector") == size)
    first = named.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(max(1, PILOT_NUMBERS // max(size, 1))).toArrow()
    pilot = matrix(first.column("vector").combine_chunks(), size) if first.num_rows else np.zeros((0, size))
    centre = (pilot / max(len(pilot), 1)).sum(axis=0)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = matrix(batch.column("vector"), size)
        code, far, corr = encode(x, centre, rotation(size))
        mid = (x * centre).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("vec_id"), batch.column("vector"),
             pa.array([c.tobytes() for c in code], pa.binary()), pa.array(far), pa.array(corr), pa.array(mid)],
            ["row", "vec_id", "vector", "code", "far", "corr", "mid"])

    kind = df.schema[vector_column].dataType.simpleString()
    id_kind = df.schema[id_column].dataType.simpleString()
    schema = f"row bigint, vec_id {id_kind}, vector {kind}, code binary, far double, corr double, mid double"
    rows = store(map_batches(named.select("row", "vec_id", "vector"), work, schema), "onebit-index") if size else named
    return Index(rows, size, centre, first.column("row").to_numpy(), pilot)


def _prepared(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``row``, ``query_id``, ``vector`` with the rounded rotated query and its first threshold."""
    size, centre = index.size, index.centre
    pilot = index.rows.sparkSession.sparkContext.broadcast((index.pilot_rows, index.pilot))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        turn = rotation(size)
        known_rows, known = pilot.value
        widest = np.sqrt((known * known).sum(axis=1)).max(initial=0)
        step = max(1, _PAIRS // max(len(known), 1))
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            x, rows = matrix(part.column("vector"), size), part.column("row").to_numpy()
            far, z = _rotated(x, centre, turn)
            least, most = z.min(axis=1), z.max(axis=1)
            width = np.where(most > least, most - least, 1) / (2**QUERY_BITS - 1)
            level = np.rint((z - least[:, None]) / width[:, None]).astype(np.int64)
            lost = np.sqrt(((z - least[:, None] - width[:, None] * level) ** 2).sum(axis=1))
            planes = np.stack([_pack((level >> b) & 1 == 1) for b in range(QUERY_BITS)], axis=1)
            floor = np.full(len(x), -np.inf)
            if len(known) > k:
                scores = np.where(rows[:, None] == known_rows, -np.inf, x @ known.T)
                floor = np.partition(scores, -k, axis=1)[:, -k]
                floor = floor - 1e-9 * widest * np.sqrt((x * x).sum(axis=1))  # other rounding than the final scores
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("query_id"), part.column("vector"),
                 pa.array([p.tobytes() for p in planes], pa.binary()), *map(pa.array, (
                     far, least, width, level.sum(axis=1).astype(np.float64), lost, (x * centre).sum(axis=1), floor))],
                ["row", "query_id", "vector", "planes", *_SCALARS])

    rows = index.rows.schema
    schema = f"row bigint, query_id {rows['vec_id'].dataType.simpleString()}, vector {rows['vector'].dataType.simpleString()}, " \
             f"planes binary, {', '.join(f'{s} double' for s in _SCALARS)}"
    return map_batches(queries, work, schema)


_SCALARS = ("far", "least", "width", "levels", "lost", "mid", "floor")


@dataclass
class Queries:
    """Prepared queries of one pass as arrays, one entry each."""

    row: np.ndarray
    vector: np.ndarray
    planes: np.ndarray
    far: np.ndarray
    least: np.ndarray
    width: np.ndarray
    levels: np.ndarray
    lost: np.ndarray
    mid: np.ndarray
    floor: np.ndarray

    def part(self, low: int, high: int) -> Queries:
        return Queries(*(getattr(self, f)[low:high] for f in self.__dataclass_fields__))


def upper_bounds(q: Queries, code: np.ndarray, far: np.ndarray, corr: np.ndarray, mid: np.ndarray, centre: np.ndarray,
                 confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of all codes with all queries (a row each), and how far above them the true ones lie at most."""
    bits = code.shape[1] * 64
    common = np.zeros((len(q.row), len(code)), dtype=np.int32)
    for b in range(QUERY_BITS):
        for w in range(code.shape[1]):
            common += np.bitwise_count(q.planes[:, b, w, None] & code[None, :, w]).astype(np.int32) << b
    ones = np.bitwise_count(code).sum(axis=1)
    flat = 2 * (q.least[:, None] * ones + q.width[:, None] * common) - (q.least * bits + q.width * q.levels)[:, None]
    cosine = flat / (np.sqrt(bits) * corr)
    estimate = q.far[:, None] * far * cosine + mid + (q.mid - centre @ centre)[:, None]
    spread = np.sqrt(np.maximum(1 - corr * corr, 0)) / (corr * np.sqrt(bits - 1))
    error = confidence * q.far[:, None] * far * (spread + q.lost[:, None] / (corr * np.sqrt(bits)))
    return estimate, error + 1e-9 * (np.abs(estimate) + np.abs(mid) + np.abs(q.mid[:, None]) + centre @ centre)


class _Best:
    """The k best of each of some queries: highest score, then smaller id, then smaller row."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.id, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        keep = ~(score < self.floor[query])
        query, score = np.concatenate([self.query, query[keep]]), np.concatenate([self.score, score[keep]])
        ids, rows = np.concatenate([self.id, ids[keep]]), np.concatenate([self.row, rows[keep]])
        order = np.lexsort((rows, ids, -score, query))
        query, score = query[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        top = place < self.k
        self.query, self.score, self.id, self.row = query[top], score[top], ids[order][top], rows[order][top]


def _scan(index: Index, queries: Queries, ids: list, k: int, confidence: float) -> DataFrame:
    """For every partition of the index and every query, the partition's best candidates above the query's threshold."""
    size, centre = index.size, index.centre
    sent = index.rows.sparkSession.sparkContext.broadcast((queries, ids))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = sent.value
        step = max(1, _PAIRS // 4096)
        parts = [q.part(low, low + step) for low in range(0, len(q.row), step)]
        best = [_Best(p.floor, k) for p in parts]
        kind = None
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                kind = batch.column("vec_id").type
                x, rows = matrix(batch.column("vector"), size), batch.column("row").to_numpy()
                vec_ids = batch.column("vec_id").to_numpy()
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype="<u8").reshape(len(rows), -1)
                far, corr, mid = (batch.column(c).to_numpy() for c in ("far", "corr", "mid"))
                for p, b in zip(parts, best):
                    estimate, error = upper_bounds(p, code, far, corr, mid, centre, confidence)
                    near = ~(estimate + error < b.floor[:, None]) & (p.row[:, None] != rows)
                    who, which = np.nonzero(near)
                    if not len(who):
                        continue
                    chunk = max(1, _PAIRS // size)
                    score = np.concatenate([
                        (p.vector[who[i:i + chunk]] * x[which[i:i + chunk]]).sum(axis=1) for i in range(0, len(who), chunk)])
                    b.add(who, score, vec_ids[which], rows[which])
        for p, b, low in zip(parts, best, range(0, len(q.row), step)):
            if len(b.query):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.row[b.query]), pa.array([names[low + i] for i in b.query], kind),
                     pa.array(b.id, kind), pa.array(b.row), pa.array(b.score)],
                    ["query_row", "query_id", "vec_id", "row", "score"])

    kind = index.rows.schema["vec_id"].dataType.simpleString()
    schema = f"query_row bigint, query_id {kind}, vec_id {kind}, row bigint, score double"
    return index.rows.mapInArrow(each, schema)


def search(index: Index, queries: DataFrame, k: int = 20, confidence: float = CONFIDENCE) -> DataFrame:
    """The ``k`` nearest of each query: ``query_id``, ``rank``, ``vec_id``, ``score``, nearest first, ties to smaller ids.

    ``queries`` are rows of ``index.rows``; a row is no candidate of itself. They are worked on in passes of bounded
    size, each one map over the index; of every task only k rows a query are left to merge.
    """
    if not index.size:
        return index.rows.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    ready = store(_prepared(index, queries.select("row", F.col("vec_id").alias("query_id"), "vector"), k), "onebit-queries")
    each = index.size * 8 + rotation(index.size).shape[1] // 8 * QUERY_BITS + 8 * (len(_SCALARS) + 2)
    passes = max(1, -(-ready.count() * each // PASS_BYTES))
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    found = None
    for turn in range(passes):
        some = ready.where(F.expr(f"pmod(xxhash64(row), {passes})") == turn).toArrow()  # at most about PASS_BYTES
        planes = np.frombuffer(b"".join(some.column("planes").to_pylist()), dtype="<u8").reshape(some.num_rows, QUERY_BITS, -1) \
            if some.num_rows else np.zeros((0, QUERY_BITS, 1), dtype="<u8")
        vector = matrix(some.column("vector").combine_chunks(), index.size) if some.num_rows else np.zeros((0, index.size))
        sent = Queries(some.column("row").to_numpy(), vector, planes, *(some.column(s).to_numpy() for s in _SCALARS))
        near = _scan(index, sent, some.column("query_id").to_pylist(), k, confidence)
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        near = store(near.select("query_id", "rank", "vec_id", "score"), "onebit-found")
        found = near if found is None else found.unionByName(near)
    return found
