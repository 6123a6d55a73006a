"""Prefix trie of conversations, grouped by blocks of turns before single turns are looked at.

A conversation is cut into blocks of ``BLOCK`` turns. Every block gets a digest, and the digests of a conversation's
blocks add up (position by position) to the digest of each prefix that ends with a block. Conversations are grouped by
these prefixes first: one row per distinct block behind a distinct prefix, an *edge* of the block tree. Only below
prefixes that go on in more than one way are the edges cut into turns to find where exactly they part; below all others
the turns of the one edge are the nodes as they are. So the work by turn grows with the distinct blocks, not with the
conversations.

Sums over subtrees are taken on the block tree by doubling (every edge hands its sum to the ancestor 1, 2, 4, ... blocks
above), then spread over the turns of each edge.

Digests are 128 bits (two independent 64-bit hashes) and taken for equality. No step holds a group whole: a long
conversation is numbered in a distributed sort, its block digests are added up in stretches, counts are aggregated
before they are shuffled, and the ids that end in one node stream through its hash in sorted order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagwright.llm.shared import attach
from tagwright.storage import store

BLOCK = 4
_STRETCH = 1024  # blocks whose digests are added up in one window
_RUN = 256  # ids joined into one text before a node's ids meet
_KEY = ["pa", "pb"]


def _hashes(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts) for seed in (0x5EED, 0x7A1E)]


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 0, by turn, null first), ``ha``, ``hb`` (digest of role and text), ``bytes`` of the text.

    A null role or text is an empty one; rows without a conversation go. Equal turns of a conversation are put in order
    of role, then of the text's MD5. The rows are sorted by ranges and numbered inside each partition; conversations that
    run over several partitions are moved on by their counts in the partitions before (a row or two per partition).
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    ha, hb = _hashes(role, text)
    narrow = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.md5(F.encode(text, "UTF-8")).alias("md5"), ha.alias("ha"), hb.alias("hb"),
        F.octet_length(text).cast("bigint").alias("bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "md5"]
    placed = narrow.orderBy(*order).select("conv_id", "ha", "hb", "bytes", F.monotonically_increasing_id().alias("at"))
    placed = store(placed, "trie-turns").withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = store(runs, "trie-runs")
    split = runs.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1").select("conv_id")
    split = store(split, "trie-split")  # fewer rows than partitions, as the rows are sorted
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = store(runs.join(F.broadcast(split), "conv_id").select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before")),
                    "trie-offsets")
    first = attach(placed, runs.drop("n"), ["conv_id", "part"])
    return first.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") - F.col("first") + F.coalesce("before", F.lit(0))).alias("pos"), "ha", "hb", "bytes")


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """One row per block: ``conv_id``, ``b``, ``turns`` in order, prefix digests before (``pa``, ``pb``) and after (``qa``, ``qb``)."""
    rows = turns.groupBy("conv_id", F.expr(f"pos div {block}").alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "ha", "hb", "bytes"))).alias("turns"))  # at most ``block`` of them
    da, db = _digest(F.col("turns"), F.col("b"))
    rows = rows.withColumns({"da": da, "db": db, "stretch": F.expr(f"b div {_STRETCH}")})
    rows = store(rows, "trie-blocks")
    sums = rows.groupBy("conv_id", "stretch").agg(F.bit_xor("da").alias("sa"), F.bit_xor("db").alias("sb"))
    ahead = W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    xor = lambda c, w: F.coalesce(F.bit_xor(c).over(w), F.lit(0).cast("bigint"))
    sums = sums.select("conv_id", "stretch", xor("sa", ahead).alias("sa"), xor("sb", ahead).alias("sb"))
    within = W.partitionBy("conv_id", "stretch").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(sums, ["conv_id", "stretch"])
    rows = rows.withColumns({"qa": xor("da", within).bitwiseXOR(F.col("sa")), "qb": xor("db", within).bitwiseXOR(F.col("sb"))})
    return rows.select("conv_id", "b", "turns", F.col("qa").bitwiseXOR(F.col("da")).alias("pa"),
                       F.col("qb").bitwiseXOR(F.col("db")).alias("pb"), "qa", "qb")


def _digest(turns: Column, b: Column) -> list[Column]:
    """What turns at the start of block ``b`` add to the prefix digest before it."""
    lanes = lambda name: F.transform(turns, lambda t: t[name])
    return _hashes(b, F.size(turns), lanes("ha"), lanes("hb"))


def _steps(edges: DataFrame) -> DataFrame:
    """Edges cut into turns: one row per turn ``j`` with its digest (``na``, ``nb``), its parent's and the turn's bytes."""
    cut = edges.withColumn("j", F.explode(F.sequence(F.lit(1), F.size("turns"))))
    here = _digest(F.slice("turns", F.lit(1), F.col("j")), F.col("b"))
    above = _digest(F.slice("turns", F.lit(1), F.col("j") - 1), F.col("b"))
    move = lambda base, lane: F.col(base).bitwiseXOR(lane)
    return cut.withColumns({
        "na": move("pa", here[0]), "nb": move("pb", here[1]),
        "ua": F.when(F.col("j") == 1, F.col("pa")).otherwise(move("pa", above[0])),
        "ub": F.when(F.col("j") == 1, F.col("pb")).otherwise(move("pb", above[1])),
        "bytes": F.expr("turns[j - 1].bytes")}).drop("turns")


def _subtree_sums(edges: DataFrame) -> DataFrame:
    """``qa``, ``qb``, ``t_leaves``, ``t_saved``: sums of ``leaves`` and ``saved`` over an edge and all below it, by doubling."""
    above = edges.select(F.col("qa").alias("pa"), F.col("qb").alias("pb"), F.lit(True).alias("inner"))
    now = attach(edges, store(above, "trie-inner"), _KEY)
    now = now.select("qa", "qb", F.col("leaves").alias("t_leaves"), F.col("saved").alias("t_saved"),
                     *[F.when(F.col("inner"), F.col(c)).alias(c) for c in _KEY])
    now = store(now, "trie-sums")
    while not now.where("pa is not null").isEmpty():
        handed = now.where("pa is not null").groupBy(F.col("pa").alias("qa"), F.col("pb").alias("qb")).agg(
            F.sum("t_leaves").alias("d_leaves"), F.sum("t_saved").alias("d_saved"))
        grown = now.join(handed, ["qa", "qb"], "left").select(
            "qa", "qb", *_KEY, *[(F.col(f"t_{c}") + F.coalesce(f"d_{c}", F.lit(0))).alias(f"t_{c}") for c in ("leaves", "saved")])
        up = store(now.where("pa is not null").select(
            F.col("qa").alias("pa"), F.col("qb").alias("pb"), F.col("pa").alias("ga"), F.col("pb").alias("gb")), "trie-up")
        grown = store(grown, "trie-grown")
        moving = attach(grown.where("pa is not null"), up, _KEY).select(
            "qa", "qb", "t_leaves", "t_saved", F.col("ga").alias("pa"), F.col("gb").alias("pb"))
        now = store(moving.unionByName(grown.where("pa is null")), "trie-sums")
    return now.drop(*_KEY)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``na``, ``nb``, ``ends_sha256`` of the ids that end in a node, ascending and joined by commas."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for batch in batches:
            for a, b, c in zip(*(col.to_pylist() for col in batch.columns)):
                if (a, b) != node or len(ids) == _RUN:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (a, b), []
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["na", "nb", "first", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (*node, ids[0], ",".join(map(str, ids)))], ["na", "nb", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []
        for batch in batches:
            for a, b, _, text in zip(*(col.to_pylist() for col in batch.columns)):
                if (a, b) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (a, b), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["na", "nb", "ends_sha256"])
                out = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], ["na", "nb", "ends_sha256"])

    runs = ends.select("na", "nb", "conv_id").orderBy("na", "nb", "conv_id")
    runs = store(runs.mapInArrow(joined, "na bigint, nb bigint, first bigint, ids string"), "trie-ends")
    runs = runs.repartition("na", "nb").sortWithinPartitions("na", "nb", "first")
    return runs.mapInArrow(hashed, "na bigint, nb bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of stored ``numbered`` turns (``pos`` from 0 without gaps) of ``conversations`` (distinct ``conv_id``, not null).

    One row per distinct prefix, from the empty one: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves`` (nodes without children in its subtree), ``saved_tokens`` (over its subtree,
    members less one times the bytes of the last text) and ``ends_sha256`` (ids of the conversations that end here).
    A conversation without turns ends at the root. Without conversations there is no node. Turns may be of any length:
    only digests and byte counts are kept.
    """
    blocks = store(_blocks(turns, block), "trie-prefixes")
    edges = blocks.groupBy(*_KEY, "qa", "qb", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("turns").alias("turns"))
    edges = store(edges, "trie-edges")
    ways = store(edges.groupBy(*_KEY).agg((F.count("*") > 1).alias("parts")), "trie-ways")
    marked = store(attach(edges, ways, _KEY), "trie-marked")

    # Turns of edges that part from others are grouped; an edge alone behind its prefix is a chain of nodes already.
    steps = store(_steps(marked), "trie-steps")
    one = ["conv_id", F.col("n"), "ua", "ub", "bytes", "qa", "qb"]
    chains = steps.where("not parts").select("na", "nb", (F.col("b") * block + F.col("j")).alias("depth"), *one)
    parted = steps.where("parts").groupBy("na", "nb", (F.col("b") * block + F.col("j")).alias("depth")).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.first("ua").alias("ua"), F.first("ub").alias("ub"),
        F.first("bytes").alias("bytes"), F.min_by("qa", "conv_id").alias("qa"), F.min_by("qb", "conv_id").alias("qb"))
    nodes = store(chains.unionByName(parted), "trie-nodes")
    children = store(nodes.groupBy(F.col("ua").alias("na"), F.col("ub").alias("nb")).agg(F.count("*").alias("n_children")), "trie-children")
    nodes = nodes.join(children, ["na", "nb"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    nodes = store(nodes.withColumn("saved", (F.col("n") - 1) * F.col("bytes")), "trie-counted")

    # Each node counts once, at the edge its smallest member runs through.
    leaf = (F.col("n_children") == 0).cast("bigint")
    own = nodes.groupBy("qa", "qb").agg(
        F.sum(leaf).alias("leaves"), F.sum("saved").alias("saved"),
        F.collect_list(F.struct("depth", leaf.alias("leaf"), "saved")).alias("own"))  # at most ``block`` of them
    owned = store(edges.join(own, ["qa", "qb"], "left").select(
        *_KEY, "qa", "qb", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("leaves", "saved")], "own"), "trie-owned")
    sums = store(_subtree_sums(owned.drop("own")), "trie-subtrees")
    below = owned.join(sums, ["qa", "qb"]).select(
        "qa", "qb", "own", (F.col("t_leaves") - F.col("leaves")).alias("leaves"), (F.col("t_saved") - F.col("saved")).alias("saved"))
    depth = F.col("b") * block + F.col("j")
    rest = lambda c, base: F.expr(
        f"{base} + aggregate(filter(own, o -> o.depth >= depth), 0L, (s, o) -> s + o.{c})")
    shares = steps.select("qa", "qb", "na", "nb", depth.alias("depth")).join(below, ["qa", "qb"]).groupBy("na", "nb").agg(
        F.sum(rest("leaf", "leaves")).alias("n_leaves"), F.sum(rest("saved", "saved")).alias("saved_tokens"))

    last = blocks.groupBy("conv_id").agg(F.max("b").alias("b"))
    ended = blocks.select("conv_id", "b", F.col("qa").alias("na"), F.col("qb").alias("nb")).join(last, ["conv_id", "b"])
    turnless = conversations.join(last, "conv_id", "left_anti").select(
        F.lit(0).cast("bigint").alias("na"), F.lit(0).cast("bigint").alias("nb"), "conv_id")
    ends = _end_hashes(ended.select("na", "nb", "conv_id").unionByName(turnless))

    least, members = conversations.agg(F.min("conv_id"), F.count("*")).first()
    parts = nodes.where("depth = 1").count()
    leaves, saved = sums.join(edges.where("b = 0").select("qa", "qb"), ["qa", "qb"]).agg(F.sum("t_leaves"), F.sum("t_saved")).first()
    long = lambda v: F.lit(v).cast("bigint")
    root = conversations.sparkSession.range(1 if members else 0).select(
        long(0).alias("na"), long(0).alias("nb"), long(0).alias("depth"), long(least).alias("conv_id"), long(members).alias("n"),
        long(None).alias("parent_conv_id"), long(parts).alias("n_children"), long(leaves or 1).alias("n_leaves"),
        long(saved or 0).alias("saved_tokens"))

    names = nodes.select(F.col("na").alias("ua"), F.col("nb").alias("ub"), F.col("conv_id").alias("parent_conv_id"))
    names = names.unionByName(root.select(F.col("na").alias("ua"), F.col("nb").alias("ub"), F.col("conv_id").alias("parent_conv_id")))
    named = attach(nodes, store(names, "trie-names"), ["ua", "ub"]).join(shares, ["na", "nb"])
    every = named.select(root.columns).unionByName(root).join(ends, ["na", "nb"], "left")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return every.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
