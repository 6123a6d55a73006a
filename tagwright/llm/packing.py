"""Mixture-controlled packing of token streams into fixed windows.

Every source is a queue of its documents' tokens. In each window a source is owed its target share of the window's
tokens; it is served whole tokens, and what it is owed beyond that (its deficit, less than one token) is carried to the
next window, also when that window is filled by another partition. Served in a fixed order of queues, the tokens given
to the first ``j`` queues until stream place ``x`` are ``C[j] * x div W`` for summed weights ``C`` of total ``W``, so any
task can tell from a document's place in its queue which windows it falls into: there is no sequential pass.

When a queue runs dry the others go on in their proportions, so every token is packed and only the last window of all is
not full. Without given targets the weights follow what the queues still hold, and all run dry together.

The plan of the queues is held by every task, so sources below ``MIN_SHARE`` of all tokens come out of one queue of it,
in which they are mixed in turn: each is cut into portions of what a window owes it, and at least ``LEAST_PORTION`` tokens,
for which it saves up its deficit over several windows. A portion whose
middle is at ``m`` of ``size`` tokens is due at the share ``m / size`` of that queue, and all portions are laid down in
the order in which they are due. So a window's part of the small sources holds each in its proportion to within a
portion of its own, what is owed is carried on, and all run dry together. The order comes from a range-partitioned sort.

Documents are tokenised once, into a stored table. A document's place in its queue is its place among the documents of
its source in its task, plus the tokens of that source in tasks before; only task and source totals are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from tagwright.llm.sharding import running_totals
from tagwright.llm.shared import attach, map_batches
from tagwright.llm.tokens import word_tokenizer
from tagwright.storage import scratch_path, store

WINDOW = 2048
MIN_SHARE = 1 / 64
LEAST_PORTION = 64
_PORTIONS = 10_000  # rows of a batch
_WEIGHTS = 2**24  # sum of the weights of a phase
_PHASE = 2**38  # longest phase in tokens, so products of weights and places fit 64 bits


@dataclass(frozen=True)
class Phase:
    """A stretch ``begin..end`` of the token stream with fixed weights; ``taken``: tokens each queue gave before it."""

    begin: int
    end: int
    weights: tuple[int, ...]
    taken: tuple[int, ...]


def _whole_weights(shares: list[float]) -> list[int]:
    """Integers that sum to ``_WEIGHTS`` in the proportions of ``shares``, at least 1 for every positive share."""
    total = sum(shares)
    out = [max(1, int(_WEIGHTS * s / total)) if s > 0 else 0 for s in shares]
    out[max(range(len(out)), key=out.__getitem__)] += _WEIGHTS - sum(out)
    return out


def phases(held: list[int], targets: list[float] | None = None) -> list[Phase]:
    """Phases that serve queues holding ``held`` tokens until all are empty."""
    left, taken, at, out = list(held), [0] * len(held), 0, []
    while any(left):
        aim = [float(n) for n in left] if targets is None else [t if n else 0.0 for t, n in zip(targets, left)]
        if not any(aim):  # only queues without a target are left
            aim = [float(n) for n in left]
        weights = _whole_weights(aim)
        length = min(_PHASE, sum(left), *(n * _WEIGHTS // w for n, w in zip(left, weights) if w))
        out.append(Phase(at, at + length, tuple(weights), tuple(taken)))
        summed = np.cumsum([0, *weights])
        given = np.diff([int(c) * length // _WEIGHTS for c in summed]).tolist()
        left = [a - b for a, b in zip(left, given)]
        taken = [a + b for a, b in zip(taken, given)]
        at += length
    return out


def pieces(plan: list[Phase], queue: int, low: int, high: int, window: int = WINDOW) -> np.ndarray:
    """Rows ``(start, length, sequence, offset)`` of the tokens ``low..high`` of a queue; starts count from ``low``."""
    rows = []
    for phase in plan:
        w = phase.weights[queue]
        a, b = low - phase.taken[queue], high - phase.taken[queue]
        if not w or b <= 0:
            continue
        length = phase.end - phase.begin
        before = sum(phase.weights[:queue])
        total = (before + w) * length // _WEIGHTS - before * length // _WEIGHTS
        if a >= total:
            continue
        first = (phase.begin + max(0, (a - 1) * _WEIGHTS // w)) // window
        last = (phase.begin + min(length, (b + 1) * _WEIGHTS // w)) // window + 1
        edges = np.clip(np.arange(first, last + 1, dtype=np.int64) * window, phase.begin, phase.end)
        x = edges - phase.begin
        under = before * x // _WEIGHTS
        own = (before + w) * x // _WEIGHTS - under
        begin, end = np.maximum(own[:-1], a), np.minimum(own[1:], b)
        some = np.flatnonzero(end > begin)
        place = edges[:-1][some] + (under[1:] - under[:-1])[some] + begin[some] - own[:-1][some]
        sequence = place // window
        rows.append(np.column_stack([begin[some] - a, (end - begin)[some], sequence, place - sequence * window]))
    return np.concatenate(rows) if rows else np.zeros((0, 4), dtype=np.int64)


def token_table(docs: DataFrame, tokenizer: str, end_id: int | None, key: str, text: str, source: str) -> DataFrame:
    """Stored ``key``, ``source`` (never null), ``task``, ``start`` (tokens of the source in the task before), ``n``, ``ids``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, so_far = TaskContext.get().partitionId(), {}
        encoder = word_tokenizer(tokenizer, end_id)
        for batch in batches:
            ids = [encoder.encode(t.as_py()) for t in batch.column(1)]
            starts = []
            for s, i in zip(batch.column(2).to_pylist(), ids):
                starts.append(so_far.get(s, 0))
                so_far[s] = starts[-1] + len(i) // encoder.width
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64()),
                 pa.array([len(i) // encoder.width for i in ids], pa.int64()),
                 pa.array([encoder.width] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                ["key", "source", "task", "start", "n", "width", "ids"])

    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), named.alias("source"))
    schema = "key bigint, source string, task int, start bigint, n bigint, width int, ids binary"
    out, spark = rows.mapInArrow(work, schema), docs.sparkSession
    path = scratch_path(spark, "packing-tokens")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _mixed(small: DataFrame, windows: int) -> DataFrame:
    """Rows of small sources cut into portions, with their place in the queue that they share as ``low``."""

    def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, low, n, queue, width, ids, _, doc_tokens, source, size in zip(*[c.to_pylist() for c in batch.columns]):
            step = max(LEAST_PORTION, size // windows)
            first = low - low % step
            for begin in range(first, low + n, step):
                a, b = max(begin, low), min(begin + step, low + n)
                due = (begin + min(begin + step, size)) / (2 * size)
                rows.append((key, b - a, queue, width, ids[(a - low) * width:(b - low) * width], a - low, doc_tokens, due, source, a))
                if len(rows) == _PORTIONS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    cut = map_batches(small.select("key", "low", "n", "queue", "width", "ids", "skip", "doc_tokens", "source", "size"), portions,
                      "key bigint, n bigint, queue int, width int, ids binary, skip bigint, doc_tokens bigint, due double, "
                      "source string, at bigint")
    cut = store(cut.withColumn("spread", F.xxhash64("source")), "packing-portions")
    order = F.struct("due", "spread", "source", "at").alias("order")  # unique: a place in a source belongs to one row
    placed = running_totals(cut.select(order, "n"), "order", "n")
    lows = placed.select(F.col("order.source").alias("source"), F.col("order.at").alias("at"), (F.col("total") - F.col("n")).alias("low"))
    return cut.join(lows, ["source", "at"]).select("key", "low", "n", "queue", "width", "ids", "skip", "doc_tokens")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64())
    names = ["key", "n", "queue", "width", "ids", "skip", "doc_tokens", "due", "source", "at"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int | None = 1, window: int = WINDOW, targets: dict[str, float] | None = None,
    min_share: float = MIN_SHARE, key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Pieces ``key``, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the file of a tokenizer that drops white space; ``end_id`` is added to every document.
    ``targets`` gives weights of sources (others get none and are packed when those are done); by default sources keep
    the shares they have in the corpus. A null or empty text has only the end id; a null source is a source of its own; a
    null key stays null. Texts of any length are packed whole. Repeated rows are packed each; other columns are not
    looked at. An empty table gives no pieces.
    """
    tokens = token_table(docs, tokenizer, end_id, key, text, source)
    spent = store(tokens.groupBy("task", "source").agg(F.sum("n").alias("n")), "packing-spent")
    totals = store(spent.groupBy("source").agg(F.sum("n").alias("size")), "packing-totals")
    whole = totals.agg(F.sum("size")).first()[0] or 0
    wanted = {f"={s}": w for s, w in (targets or {}).items()}
    large = totals.where((F.col("size") >= min_share * whole) | F.col("source").isin(list(wanted)))
    queues = sorted((r["source"], r["size"]) for r in large.collect())  # at most 1 / min_share, and the targets
    names = [q[0] for q in queues]
    rest = whole - sum(q[1] for q in queues)
    plan = phases([q[1] for q in queues] + [rest],
                  [wanted.get(n, 0.0) for n in names] + [0.0] if targets else None) if whole else []

    before = F.coalesce(F.sum("n").over(Win.partitionBy("source").orderBy("task").rowsBetween(
        Win.unboundedPreceding, -1)), F.lit(0))  # a row per task that holds the source
    number = F.lit(len(names))
    for i, n in enumerate(names):
        number = F.when(F.col("source") == n, F.lit(i)).otherwise(number)
    placed = attach(spent.withColumn("base", before), totals, ["source"], "inner").select(
        "task", "source", "base", "size", number.alias("queue"))
    work = attach(tokens, store(placed, "packing-places"), ["task", "source"], "inner").select(
        "key", (F.col("base") + F.col("start")).alias("low"), "n", "queue", "width", "ids", F.lit(0).cast("bigint").alias("skip"),
        F.col("n").alias("doc_tokens"), "source", "size")
    large_rows = work.where(F.col("queue") < len(names)).drop("source", "size")
    if rest:
        windows = -(-whole // window)
        work = large_rows.unionByName(_mixed(work.where(F.col("queue") == len(names)), windows))
    else:
        work = large_rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts, owner, ids = batch.column(0), [], [], []
            lows, ns, qs, widths = (batch.column(i).to_pylist() for i in range(1, 5))
            skips, wholes = batch.column(6).to_pylist(), batch.column(7).to_numpy()
            for i, packed in enumerate(batch.column(5)):
                found = pieces(plan, qs[i], lows[i], lows[i] + ns[i], window)
                wide = np.frombuffer(packed.as_buffer(), dtype=f"<u{widths[i]}").astype("<u4").tobytes()
                ids += [wide[4 * a:4 * (a + n)] for a, n in found[:, :2].tolist()]
                found[:, 0] += skips[i]
                parts.append(found)
                owner += [i] * len(found)
            table = np.concatenate([*parts, np.zeros((0, 4), dtype=np.int64)])
            long = lambda c: pa.array(c.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(owner, pa.int64())), long(table[:, 0]), long(table[:, 1]), pa.array(ids, pa.binary()),
                 long(wholes[owner]), long(table[:, 2]), long(table[:, 3])],
                ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    out = work.mapInArrow(cut, "key bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
                               "sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", key)
