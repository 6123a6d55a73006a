"""Exact n-gram Jaccard join by rare-first prefixes.

A text's set holds the distinct hashes of its ``n``-word runs (A-Z lower-cased, words cut at ASCII white space). Two
texts link when ``100 * shared >= percent * union``. Texts with equal sets are one class, and only classes are joined:

1. *Order.* Every task counts the words and the n-grams of its texts in 2**20 hash cells each; the summed tables (8 MiB,
   whatever the input) order n-grams rare-first: n-grams that stand out of their cells come last, all others follow the
   frequencies of their words. Any order gives the same links, this one keeps common n-grams out of the prefixes.
2. *Prefix.* Linked sets share an n-gram of their first ``size - ceil(percent/100 * size) + 1``; these are the postings.
   N-grams that occur once are dropped, and places too far behind the foremost place of their n-gram in any set.
3. *Candidates.* Per n-gram and band of sizes the class in whose order the n-gram comes first, the most central one, is
   the hub, and the others of the band and the next ones are paired with it. That connects a group of near copies without
   pairing everything in it. Then pairs under one n-gram that are not yet connected are formed, those of its most common
   component only with others, so no link between components is missed. A pair is passed over where the n-gram before
   is the same in both sets, as it meets there already.
4. *Filters* are conditions of the joins: sizes (length filter); places of the shared n-gram, as nothing is shared before
   the first one (positional filter); and parities of the sets in 256 hash cells, whose differences the sets must differ
   by at least (suffix filter). Pairs that pass are held against parities in as many cells as the larger set has members,
   a bit each, before any whole set is sent.
5. *Verification* of each remaining pair once, on the whole sets, which the tasks that cut the texts send to the place of the
   pair, and connected components of the links.

Links between classes that are already connected are not searched again: the components are exact, and the links
are not counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from tagwright.llm import words as W
from tagwright.llm.shared import attach, components, map_batches
from tagwright.storage import scratch, store

CELLS = 2**20
_SLICE = 2**10
_PARITY = 4  # 64-bit words of parities
_SPOKES = 256  # sets compared with that of a hub in one place
_SENT = 2**24  # bytes of sets in a batch
_WORK = 1000  # pairs that the last join may try per posting before another round of hubs is worth it
HUB_ROUNDS = 2  # at most; more rounds or fewer change the work, not the components
_NULL_KEY = -(2**63)  # stands for a null key inside


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _sets(texts: pa.Array, n: int, rarity: np.ndarray | None = None) -> Iterator[tuple]:
    """Distinct n-gram hashes per text of a group: ``(low, high, text, hash, score, words)``.

    A text of fewer words gives the hash of all of them. ``score`` adds the ``rarity`` of the n-gram's words.
    """
    for low, high, data, offsets in W.groups(texts):
        words = W.cut(data, offsets, fold=True)
        weight = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        if rarity is not None:
            np.cumsum(rarity[_cell(words.hashes)], out=weight[1:])
        hashes, at = W.grams(words, n)
        doc, score = words.doc[at], weight[at + n] - weight[at] if len(at) else np.zeros(0, dtype=np.int64)
        for k in range(1, n):
            short = np.flatnonzero(words.counts == k)
            if len(short):
                first = words.first[short]
                h, p = W.grams(words, k)
                hashes = np.concatenate([hashes, h[np.searchsorted(p, first)]])
                doc, score = np.concatenate([doc, short]), np.concatenate([score, weight[first + k] - weight[first]])
        order = np.lexsort((hashes, doc))
        hashes, doc, score = hashes[order], doc[order], score[order]
        fresh = np.ones(len(doc), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        yield low, high, doc[fresh], hashes[fresh], score[fresh], words


def _class_keys(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and a hash of the whole set per text, from two sums over the set."""
    at = W.bounds(doc, n)
    one, two = np.zeros(len(doc) + 1, dtype=np.uint64), np.zeros(len(doc) + 1, dtype=np.uint64)
    np.cumsum(W.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=one[1:])
    np.cumsum(W.mix(hashes + np.uint64(0x14057B7EF767814F)), out=two[1:])
    size = np.diff(at)
    key = W.mix(W.mix(np.diff(one[at]) + size.astype(np.uint64)) + np.diff(two[at]))
    return size, key


def _sketches(doc: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parities of every set in a power of two of hash cells, as many as it has members at least, a bit each."""
    power = np.ceil(np.log2(np.maximum(size, 8))).astype(np.int64)
    ends = np.cumsum(np.left_shift(1, power))
    start = ends - np.left_shift(1, power)
    cell = (hashes >> (64 - power).astype(np.uint64)[doc]).astype(np.int64)
    odd = np.bincount(start[doc] + cell, minlength=int(ends[-1]) if len(ends) else 0).astype(np.uint8) & 1
    offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(odd))])


def _apart(a: bytes, b: bytes) -> int:
    """In how many members two sets differ at least, by their sketches; the longer one is folded to the shorter one's cells."""
    x, y = (np.unpackbits(np.frombuffer(v, dtype=np.uint8)) for v in (a, b))
    cells = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(cells, -1), axis=1) for v in (x, y))
    return int(np.count_nonzero(x != y))


def classes(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``node`` (hash of the set; null for an empty set), ``parity``, ``sketch``, one row per input row."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        for low, high, doc, hashes, *_ in _sets(batch.column(1), n):
            size, node = _class_keys(doc, hashes, high - low)
            cell = (hashes >> np.uint64(56)).astype(np.int64)
            odd = np.bincount(doc * 64 * _PARITY + cell, minlength=(high - low) * 64 * _PARITY).astype(np.uint8) & 1
            parity = pa.array(np.packbits(odd).view(np.int64))
            parity = pa.FixedSizeListArray.from_arrays(parity, _PARITY).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(low, high - low), pa.array(size.astype(np.int64)), pa.array(node.view(np.int64), mask=size == 0), parity,
                 _sketches(doc, hashes, size)], ["key", "n_shingles", "node", "parity", "sketch"])

    return map_batches(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), work,
                       "key bigint, n_shingles bigint, node bigint, parity array<bigint>, sketch binary")


def frequency_tables(docs: DataFrame, n: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Per hash cell: in how many sets its n-grams occur, and how often its words occur (a fixed 8 MiB)."""

    def count(batches):
        cells = np.zeros(2 * CELLS, dtype=np.int64)
        for batch in batches:
            for _, _, _, hashes, _, words in _sets(batch.column(0), n):
                cells[:CELLS] += np.bincount(_cell(hashes), minlength=CELLS)
                cells[CELLS:] += np.bincount(_cell(words.hashes), minlength=CELLS)
        for i in range(0, 2 * CELLS, _SLICE):
            part = cells[i:i + _SLICE].astype(np.uint32)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()])], ["slice", "counts"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                add = np.frombuffer(c.as_buffer(), dtype=np.uint32).astype(np.uint64)
                sums[i] = sums.get(i, np.zeros(_SLICE, dtype=np.uint64)) + add
        for i, c in sums.items():
            out = np.minimum(c, 2**32 - 1).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([out])], ["slice", "counts"])

    schema = "slice bigint, counts binary"
    parts = docs.select(F.col(text).alias("text")).mapInArrow(count, schema)
    table = np.zeros(2 * CELLS, dtype=np.uint32)
    for i, c in parts.repartition("slice").mapInArrow(total, schema).collect():  # at most 2,048 rows of 4 KiB
        table[i:i + _SLICE] = np.frombuffer(c, dtype=np.uint32)
    return table[:CELLS], table[CELLS:]


def _prefix_sizes(size: np.ndarray, percent: int) -> np.ndarray:
    return size - -(-percent * size // 100) + 1


def postings(docs: DataFrame, n: int, percent: int, text: str = "text") -> DataFrame:
    """Prefix n-grams ``(gram, node, size, pos)`` of every text, positions in rare-first order from 0."""
    grams, words = frequency_tables(docs.select(F.col(text).alias("text")), n)
    usual = 2 * (int(grams.sum(dtype=np.int64)) / CELLS + 1)
    level = np.maximum(np.ceil(np.log2((grams + 1) / usual)), 0).astype(np.int8)  # 0: does not stand out of its cell
    held = docs.sparkSession.sparkContext.broadcast((level, (16 * np.log2(words.astype(np.float64) + 1)).astype(np.int16)))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        levels, rarity = held.value
        for low, high, doc, hashes, score, _ in _sets(batch.column(0), n, rarity):
            size, node = _class_keys(doc, hashes, high - low)
            order = np.lexsort((hashes, score, levels[_cell(hashes)], doc))
            hashes = hashes[order]
            pos = np.arange(len(doc)) - W.bounds(doc, high - low)[doc]
            keep = np.flatnonzero(pos < _prefix_sizes(size, percent)[doc])
            d = doc[keep]
            yield pa.RecordBatch.from_arrays(
                [W.longs(hashes[keep]), W.longs(node[d]), pa.array(size[d].astype(np.int32)),
                 pa.array(pos[keep].astype(np.int32))], ["gram", "node", "size", "pos"])

    return map_batches(docs.select(F.col(text).alias("text")), work, "gram bigint, node bigint, size int, pos int")


def _least_shared(a: str, b: str, percent: int) -> str:
    """Least number of shared n-grams of two linked sets, as SQL over their sizes."""
    return f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}"


def _spokes(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the pairs of ``near`` are compared, as stored rows ``(node, hub, part, own)``, and the classes in them, ``(node)``.

    Of a pair the class with more pairs is the hub, to which the other one's set is sent. The sets of a hub with many such
    are compared in several places, and its ``own`` is sent to each.
    """
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node")))
    degree = store(ends.groupBy("node").agg(F.count("*").alias("d")), "jaccard-degrees")
    side = lambda c: degree.select(F.col("node").alias(c), F.col("d").alias(f"d{c}"))
    more = F.col("da") >= F.col("db")
    stars = near.join(side("a"), "a").join(side("b"), "b").select(
        F.when(more, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("node"))
    stars = store(stars, "jaccard-stars")
    parts = stars.groupBy("hub").agg(F.ceil(F.count("*") / _SPOKES).alias("parts"))
    spokes = store(stars.join(parts, "hub").select(
        "node", "hub", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.lit(False).alias("own")), "jaccard-spokes")
    hubs = spokes.select(F.col("hub").alias("node"), "hub", "part", F.lit(True).alias("own")).distinct()
    return spokes.unionByName(hubs), degree.select("node")


def _asked(near: DataFrame, member: DataFrame) -> DataFrame:
    """Stored ``key``, ``asks``: for which comparisons a text lends its set. One row of each class lends its text."""
    sides, nodes = _spokes(near)
    lender = nodes.join(member, "node").groupBy("node", "key").count()
    lender = lender.groupBy("node").agg(F.min(F.struct("count", "key")).alias("l")).select("node", "l.key")
    asks = sides.join(lender, "node").groupBy("key").agg(F.collect_list(F.struct("node", "hub", "part", "own")).alias("asks"))
    return store(asks, "jaccard-asks")


def _placed(sets: DataFrame) -> DataFrame:
    """Sets by the place they are compared in, the hub's own first: its ``spoke`` is null."""
    return sets.repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("spoke"))


def _close(near: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``near`` whose sketches do not show that they are no link."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, own_size = b"", 0
        for batch in batches:
            links = []
            for hub, spoke, size, sketch in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if spoke is None:
                    own, own_size = sketch, size
                    continue
                both = own_size + size
                if _apart(own, sketch) <= both - 2 * ((percent * both + 99 + percent) // (100 + percent)):
                    links.append((min(hub, spoke), max(hub, spoke)))
            yield _links(links)

    spoke = F.when(~F.col("own"), F.col("node")).alias("spoke")
    sent = _spokes(near)[0].join(sketches.hint("merge"), "node").select("hub", "part", spoke, "size", "sketch")
    return _placed(sent).mapInArrow(compare, "a bigint, b bigint")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*pairs)) or [[]] * 2], ["a", "b"])


def _verify(near: DataFrame, named: DataFrame, member: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that link, each checked once on its whole sets: a set is sent to the place of its pair by the task
    that cuts its text, and nowhere else."""

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for low, high, doc, hashes, *_ in _sets(batch.column(0), n):
            size, node = _class_keys(doc, hashes, high - low)
            at, node = W.bounds(doc, high - low), node.view(np.int64)
            for i in range(high - low):
                members = hashes[at[i]:at[i + 1]].tobytes()
                for ask in batch.column(1)[low + i].as_py() if size[i] else ():
                    if ask["node"] == int(node[i]):
                        rows.append((ask["hub"], ask["part"], None if ask["own"] else ask["node"], members))
                        held += len(members)
                        if held > _SENT:
                            yield _sent(rows)
                            rows, held = [], 0
        yield _sent(rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            links = []
            for hub, spoke, members in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                other = np.frombuffer(members.as_buffer(), dtype=np.uint64)
                if spoke is None:
                    own = other.copy()  # the hub's own set comes before those it is compared with
                    continue
                z = np.sort(np.concatenate([own, other]), kind="stable")
                shared = int(np.count_nonzero(z[1:] == z[:-1]))
                if 100 * shared >= percent * (len(own) + len(other) - shared):
                    links.append((min(hub, spoke), max(hub, spoke)))
            yield _links(links)

    lent = attach(named, _asked(near, member), ["key"], "inner")
    sets = map_batches(lent.select("text", "asks"), send, "hub bigint, part bigint, spoke bigint, members binary")
    return _placed(sets).mapInArrow(compare, "a bigint, b bigint").distinct()


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["hub", "part", "spoke", "members"])


def _pairs(left: DataFrame, right: DataFrame, on: list[str], percent: int, more: str = "true") -> DataFrame:
    """Candidate pairs ``(a, b)`` of rows with different labels, each once, past the length, positional and suffix filter."""
    least = _least_shared("x_size", "y_size", percent)
    apart = " + ".join(f"bit_count(x_parity[{k}] ^ y_parity[{k}])" for k in range(_PARITY))
    cond = F.expr(
        f"x_node != y_node and x_label != y_label and 100 * least(x_size, y_size) >= {percent} * greatest(x_size, y_size) "
        f"and least(x_size - x_pos, y_size - y_pos) >= {least} and {apart} <= x_size + y_size - 2 * ({least}) and ({more})")
    for c in on:
        cond = cond & (F.col(f"x_{c}") == F.col(f"y_{c}"))
    joined = left.join(right, cond)
    return joined.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _as(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def links(docs: DataFrame, n: int, percent: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership ``(key, n_shingles, node)`` of all rows, and verified links ``(a, b)`` between classes ``node``."""
    named = docs.select(F.coalesce(key, F.lit(_NULL_KEY)).alias("key"), F.col(text).alias("text"))
    member = store(classes(named, n, "key"), "jaccard-classes")
    of_class = member.where("node is not null").groupBy("node").agg(
        F.first("parity").alias("parity"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    of_class = store(of_class, "jaccard-parities")
    parities, sketches = of_class.select("node", "parity"), of_class.select("node", "size", "sketch")
    member = member.select("key", "n_shingles", "node")
    posted = _shared_postings(named, n, percent)
    labels, tried, edges = None, None, None
    for turn in range(HUB_ROUNDS + 1):
        with scratch(docs.sparkSession, "jaccard-turn") as keep:  # all rows of a turn go when its links are known
            near, last = _candidates(posted, parities, labels, tried, percent, turn)
            if near is None:
                break
            near = keep(near, "jaccard-near")
            close = store(_close(near, sketches, percent), "jaccard-close")
            fresh = keep(_verify(close, named, member, n, percent), "jaccard-links")
            tried = near if tried is None else tried.unionByName(near)
            edges = fresh if edges is None else edges.unionByName(fresh)
            if last:
                break
            labels = keep(components(edges, "jaccard-component"), "jaccard-labels")
    if edges is None:
        edges = posted.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    return member.select(F.when(F.col("key") != _NULL_KEY, F.col("key")).alias("key"), "n_shingles", "node"), edges


def _shared_postings(named: DataFrame, n: int, percent: int) -> DataFrame:
    """Stored prefix n-grams that two texts hold near enough to their fronts, one row per class and n-gram."""
    with scratch(named.sparkSession, "jaccard-postings") as keep:
        posted = store(postings(named, n, percent), "jaccard-posted")
        often = posted.groupBy("gram").agg(F.count("*").alias("n"), F.min(F.expr("pos * 1000 div size")).alias("front"))
        often = store(often.where("n > 1").select("gram", "front"), "jaccard-often")
        share = percent / (100 + percent)  # linked sets share this part of their summed sizes, which bounds both places
        reach = (1 - share - F.col("pos") / F.col("size")) * (1 - share - F.col("front") / 1000) >= share**2 - 1e-9
        # both sides grow with the texts, so they meet by shuffle at every size
        return keep(posted.join(often.hint("merge"), "gram").where(reach).drop("front").distinct(), "jaccard-shared")


def _candidates(
    posted: DataFrame, parities: DataFrame, labels: DataFrame | None, tried: DataFrame | None, percent: int, turn: int
) -> tuple[DataFrame | None, bool]:
    """Candidate pairs of one turn that were not tried before (None: nothing is open), and whether it is the last turn."""
    band = F.floor(F.log("size") / math.log(100 / percent)).cast("int") if percent < 100 else F.col("size")
    now = posted if labels is None else attach(posted, labels, ["node"])
    now = now.withColumn("label", F.col("node") if labels is None else F.coalesce("label", F.col("node")))
    if labels is not None:
        now = store(now, "jaccard-labelled")
    # per n-gram: all rows, and those of its most common component
    counts = now.groupBy("gram", "label").agg(F.count("*").alias("m"))
    counts = counts.groupBy("gram").agg(F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("top"))
    opened = store(counts.where("m > top.m").select("gram", "m", F.col("top.m").alias("most"), F.col("top.label").alias("major")),
                   "jaccard-open")
    rows, work = opened.agg(F.sum("m"), F.sum(F.expr("cast(m as double) * (m - most)"))).first()
    if not rows:
        return None, True
    now = now.join(opened.select("gram", "major").hint("merge"), "gram")
    now = store(attach(now, parities, ["node"], "inner"), "jaccard-rows")
    minor = now.where("label != major").drop("major")
    last = turn == HUB_ROUNDS or (turn > 0 and work <= _WORK * rows)
    if last:
        back = F.lag("gram").over(Win.partitionBy("node").orderBy("pos"))  # a node has at most its prefix here
        now = store(now.withColumn("back", back), "jaccard-back")
        minor = now.where("label != major").drop("major")
        pairs = _pairs(_as(minor, "x"), _as(now.drop("major"), "y"), ["gram"], percent, "not x_back <=> y_back or x_back is null")
    else:
        rank = F.struct("pos", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "size", "label", "parity")
        source = now.drop("major") if turn == 0 else minor
        hub = source.withColumn("band", band).groupBy("gram", "band").agg(F.min(rank).alias("hub"))
        hub = hub.select("gram", "band", "hub.*").drop("h")
        hub = hub.withColumn("band", F.explode(F.array("band", F.col("band") + 1, F.col("band") - 1)))
        pairs = _pairs(_as(now.drop("major").withColumn("band", band), "x"), _as(hub, "y"), ["gram", "band"], percent)
    return (pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")), last


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id`` of every row.

    ``component_id`` is the smallest key reachable by links.
    A null or empty text has an empty set, ``component_id`` its own key, and no link. Rows with a null key take part;
    a component of null keys alone has a null id. Repeated rows fall into one class. Texts of any length are taken whole;
    an empty table gives no rows. Other columns are not looked at.
    """
    with scratch(docs.sparkSession, "near-duplicates") as keep:
        member, edges = links(docs, n, percent, key, text)
        labels = store(components(edges, "jaccard-component"), "jaccard-labels")
        placed = attach(member.where("node is not null"), labels, ["node"])
        placed = store(placed.withColumn("label", F.coalesce("label", F.col("node"))), "jaccard-placed")
        least = store(placed.groupBy("label").agg(F.min("key").alias("component_id")), "jaccard-least")
        whole = attach(placed, least, ["label"]).select("key", "n_shingles", "component_id")
        empty = member.where("node is null").select("key", "n_shingles", F.col("key").alias("component_id"))
        return keep(whole.unionByName(empty).withColumnRenamed("key", key))
