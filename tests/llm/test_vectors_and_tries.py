"""Nearest neighbours, whitening and prefix tries against brute force, with every odd case of their tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tagwright.llm import onebit, queries, trie, whitening
from tagwright.storage import store

VECTORS = "vec_id bigint, embedding array<float>, label int"


def _is_usable(v, size, zero):
    return bool(v) and len(v) == size and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Clusters, exact copies of one vector, nulls, zeros, non-finite entries, other dimensions, repeated ids, clashing names."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) + 3 * (i % 4 == 0)).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(400 + i, rows[7][1], 0) for i in range(150)]
    rows += [(1000, None, 0), (1020, [], 0), (1040, [0.0] * 8, 0), (1060, [1.0] * 7 + [None], 0), (None, [1.0] * 8, 0),
             (1080, [1.0] * 7 + [float("nan")], 0), (1100, [float("inf")] * 8, 0), (1120, [1.0] * 5, 0), rows[20], rows[20]]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    clash = ("row", "code", "far", "score", "rank", "x", "whitened", "deviation", "n", "vector", "query_id")
    return df.withColumns({c: F.lit("clash") for c in clash}), rows


def test_nearest_equals_brute_force(odd_vectors):
    df, rows = odd_vectors
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and _is_usable(v, 8, False)]
    index = onebit.build(df)
    assert index.rows.count() == len(good)
    got = defaultdict(list)
    for r in onebit.search(index, index.rows.where("vec_id % 20 = 0"), 20, confidence=8.0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    for place, (i, q) in enumerate(good):
        if i % 20 == 0:
            others = sorted((-(x * q).sum(), j) for k, (j, x) in enumerate(good) if k != place)[:20]
            mine = sorted(got[i])
            if i == 20:  # three rows with this id, each a query
                assert len(mine) == 60
                mine = mine[::3]
            assert [(r, j) for r, j, _ in mine] == [(r + 1, j) for r, (_, j) in enumerate(others)]
            assert [s for *_, s in mine] == [-s for s, _ in others]


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (20, [0.5, 0.5], 0), (3, [-1.0, 1.0], 0)], VECTORS)
    index = onebit.build(df)
    got = onebit.search(index, index.rows.where("vec_id % 20 = 0"), 20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (0, 1, 20, 0.5), (0, 2, 3, -1.0), (20, 1, 0, 0.5), (20, 2, 3, 0.0)]
    for rows in ([], [(1, None, 0)]):
        index = onebit.build(spark.createDataFrame(rows, VECTORS))
        assert onebit.search(index, index.rows, 20).collect() == []


def test_very_large_entries_and_equal_vectors(spark):
    rows = [(i, [1e30 * (i % 7 + 1), -1e30, 1e-30], 0) for i in range(50)] + [(100 + i, [1.0, 1.0, 1.0], 0) for i in range(50)]
    index = onebit.build(spark.createDataFrame(rows, VECTORS))
    got = onebit.search(index, index.rows.where("vec_id = 100"), 3).orderBy("rank").collect()
    exact = sorted((-(np.float32(v).astype(float)).sum(), i) for i, v, _ in rows if i != 100)[:3]
    assert [r.vec_id for r in got] == [i for _, i in exact]


def test_bounds_hold_as_often_as_stated():
    """The estimate is unbiased, and the true product exceeds estimate plus bound about as often as a normal tail."""
    rng = np.random.default_rng(5)
    x, centre = rng.standard_normal((4000, 40)) + 1, np.full(40, 1.0)
    turn = onebit.rotation(40)
    assert np.allclose(turn @ turn.T, np.eye(40))
    code, far, corr = onebit.encode(x, centre, turn)
    _, z = onebit._rotated(x[:50], centre, turn)
    low, width = z.min(axis=1), (z.max(axis=1) - z.min(axis=1)) / 15
    level = np.rint((z - low[:, None]) / width[:, None]).astype(int)
    planes = np.stack([onebit._pack((level >> b) & 1 == 1) for b in range(4)], axis=1)
    lost = np.sqrt(((z - low[:, None] - width[:, None] * level) ** 2).sum(axis=1))
    q = onebit.Queries(np.arange(50), x[:50], planes, far[:50], low, width, level.sum(axis=1).astype(float), lost,
                       x[:50] @ centre, np.full(50, -np.inf))
    estimate, error = onebit.upper_bounds(q, code, far, corr, x @ centre, centre, 3.0)
    off = (x[:50] @ x.T - estimate)[:, 50:]
    assert abs(off.mean()) < 0.05 * np.abs(off).mean()
    assert (off > error[:, 50:]).mean() < 0.002 and (off > error[:, 50:] / 3).mean() > 0.03


def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(set)
    for r in queries.op11_rotated_onebit_search(spark, SMALL).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.99 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def _whitened(spark, rows, size, monkey_rows=None):
    df = monkey_rows if monkey_rows is not None else spark.createDataFrame(rows, VECTORS)
    whole = whitening.whole_vectors(df.select("vec_id", "embedding"), "embedding", 64, 1_000_000)
    fit = whitening.fit(whole, "x", 32)
    return fit, whitening.transform(whole, fit, "x", ("vec_id",)).collect()


def test_whitening_equals_eigenvectors(spark, odd_vectors):
    df, rows = odd_vectors
    fit, got = _whitened(spark, None, 8, df)
    good = [(i, v) for i, v, _ in rows if _is_usable(v, 8, True)]
    x = np.floor(np.array([v for _, v in good], float) * 64) + 1_000_000
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == len(good) and sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in good)
    assert np.allclose(fit.variances, e, rtol=1e-12) and abs(fit.total / e.sum() - 1) < 1e-12
    assert np.abs(np.abs(fit.components @ v) - np.eye(8)).max() < 1e-9 and fit.identity_error < 1e-12
    want = {i: (np.array(r) * 64 // 1 + 1_000_000, d) for (i, r), d in zip(good, x)}
    n, sums = len(good), x.astype(int).sum(axis=0)
    for r in got:
        exact = n * want[r.vec_id][1].astype(int) - sums
        assert int(r.deviation) == int((exact**2).sum())
        assert np.allclose(r.whitened, (exact / n) @ fit.components.T / np.sqrt(fit.variances), atol=1e-9)


def test_whitening_of_ill_conditioned_and_missing_directions(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((200, 4)) * [2.0**16, 2.0**8, 1, 1]
    rows = [(i, [float(a), float(b), float(c), float(c), 5.0], 0) for i, (a, b, c, _) in enumerate(base)]
    fit, got = _whitened(spark, rows, 5)  # one entry twice and one constant: three directions
    assert len(fit.variances) == 3 and fit.identity_error < 1e-9
    w = np.array([r.whitened for r in got])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(3)).max() < 1e-9
    few, some = _whitened(spark, [(i, rng.standard_normal(8).tolist(), 0) for i in range(4)], 8)
    assert len(few.variances) == 3 and len(some) == 4  # four rows span three directions


def test_whitening_of_equal_rows_empty_tables_and_extreme_entries(spark):
    fit, got = _whitened(spark, [(i, [1.0, 2.0], 0) for i in range(5)], 2)
    assert len(fit.variances) == 0 and [int(r.deviation) for r in got] == [0] * 5 and all(r.whitened == [] for r in got)
    for rows in ([], [(1, None, 0), (2, [], 0)]):
        fit, got = _whitened(spark, rows, 0)
        assert fit.n == 0 and got == []
    fit, got = _whitened(spark, [(i, [3e38 * (-1) ** i, float(i)], 0) for i in range(6)], 2)
    assert len(fit.variances) == 2 and fit.identity_error < 1e-6
    big = [2**53 * (-1) ** i + 1_000_000 for i in range(6)]
    exact = [(6 * b - sum(big)) ** 2 + (6 * (64 * i + 1_000_000) - sum(64 * k + 1_000_000 for k in range(6))) ** 2 for i, b in enumerate(big)]
    assert [int(r.deviation) for r in sorted(got, key=lambda r: r.vec_id)] == exact


def test_whitening_query_columns(spark):
    df = queries.op12_cholesky_whitening(spark, SMALL)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                               "whitened": "double", "explained": "double", "identity_error": "double"}
    assert df.count() == 32 * spark.read.parquet(f"{SMALL}/embeddings.parquet").count()


TURNS = "conv_id bigint, turn bigint, role string, text string"


def _plain_trie(convs):
    """Nodes by plain Python: prefix of (role, text) -> what the operator returns."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, told in convs.items():
        for d in range(len(told) + 1):
            members[tuple(told[:d])].append(c)
        ends[tuple(told)].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((
        min(who), len(p), min(members[p[:-1]]) if p else -10**9, len(who), len(children[p]), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, who in members.items())


def _rows(df):
    return sorted((r.conv_id, r.depth, -10**9 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children,
                   r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def _by_conversation(rows):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    return {c: [(x[2], x[4]) for x in sorted(t)] for c, t in told.items()}


@pytest.fixture(scope="module")
def odd_turns(spark):
    """Shared beginnings of every length, copies, a long conversation, ties, nulls, ids of all signs, clashing names."""
    rng = random.Random(4)
    rows = []
    for c in range(-20, 60):
        told = [("user", "hello")] * (c % 3) + [("user" if k % 2 else "assistant", f"é{rng.randrange(2)}") for k in range(rng.randrange(14))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(told)]
    rows += [(100 + i, k, "user", f"copy {k}") for i in range(30) for k in range(9)]
    rows += [(200 + i, k, "user", "again") for i in range(2) for k in range(90 + i)]
    rows += [(300, None, None, None), (300, 1, "user", "b"), (300, 1, "user", "a"), (300, 1, "assistant", "a"), (300, 1, "user", "a"),
             (301, 5, "", ""), (302, 0, "user", "x" * 200_000), (None, 0, "user", "lost"), (303, 0, "a", "bc"), (304, 0, "ab", "c")]
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    return df.withColumns({c: F.lit("clash") for c in ("pos", "ha", "bytes", "b", "j", "depth", "n", "part", "md5")}), rows


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie_equals_brute_force(odd_turns, block):
    df, rows = odd_turns
    turns = store(trie.numbered(df), "turns")
    told = _by_conversation(rows)
    convs = turns.select("conv_id").distinct()
    assert _rows(trie.prefix_trie(turns, convs, block)) == _plain_trie(told)


def test_turns_are_numbered_across_partitions(odd_turns):
    df, rows = odd_turns
    got = defaultdict(list)
    for r in trie.numbered(df).collect():
        got[r.conv_id].append(r.pos)
    assert {c: sorted(p) for c, p in got.items()} == {c: list(range(len(t))) for c, t in _by_conversation(rows).items()}


def test_trie_with_turnless_conversations_and_of_nothing(spark, odd_turns):
    df, _ = odd_turns
    turns = store(trie.numbered(df.where("conv_id = 101")), "turns")
    convs = spark.createDataFrame([(7,), (101,), (-3,)], "conv_id bigint")
    told = {7: [], -3: [], 101: [("user", f"copy {k}") for k in range(9)]}
    assert _rows(trie.prefix_trie(turns, convs)) == _plain_trie(told)
    assert _rows(trie.prefix_trie(turns.limit(0), convs.where("conv_id < 100"))) == _plain_trie({7: [], -3: []})
    assert _rows(trie.prefix_trie(turns.limit(0), convs.limit(0))) == []


def test_rebuilt_conversations(odd_turns):
    df, rows = odd_turns
    told = _by_conversation(rows)
    want = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        want[c] = told.get(base, [])[:h] + own[h:]
    turns = store(trie.numbered(df), "turns")
    convs = store(turns.select("conv_id").distinct(), "convs")
    assert _rows(trie.prefix_trie(store(queries._rebuilt(turns, convs), "rebuilt"), convs)) == _plain_trie(want)


def test_only_parting_blocks_are_refined(odd_turns):
    """The plan has the dealt shape: one grouping by block prefix, then one by turn for the blocks that part."""
    df, _ = odd_turns
    plan = trie.prefix_trie(store(trie.numbered(df), "turns"), df.select("conv_id").where("conv_id is not null").distinct())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
