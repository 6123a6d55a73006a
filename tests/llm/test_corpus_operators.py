"""The llm operators against brute force, on small planted tables: nulls, empty texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagwright.llm import (
    chats,
    html_text,
    jaccard,
    packing,
    pii,
    quality,
    repeats,
    rollups,
    sharding,
    spaced,
    stages,
    words,
)
from tagwright.llm.tokens import word_tokenizer
from tagwright.storage import scratch_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Random texts with copies, near copies, shared passages and every odd case; more columns with clashing names."""
    rng = random.Random(11)
    texts = [_prose(rng, rng.randrange(30, 160)) for _ in range(60)]
    passage = _prose(rng, 55)
    for i in range(12):
        texts.append(texts[0])
        near = texts[1].split(" ")
        near[rng.randrange(len(near))] = f"other{i}"
        texts.append(" ".join(near))
        texts.append(f"{_prose(rng, 25)} {passage}\n{_prose(rng, 9)}")
    texts += [None, "", "   \n ", "one", "one two three", "ONE two Three", "Éa ü 中文 😀", "same line here\nsame line here\n\nx", _prose(rng, 5000)]
    texts += ["a b c d e f g h i j k l m n o p q r s t " * 3, "# $ % & | < > * " * 20]
    rows = [(i, t, ["en", "fr", None][i % 3], ["hot", "hot", None, "b"][i % 4], 0) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[3], "en", "hot", 0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    clash = ("node", "gram", "key", "hash", "doc", "pos", "row", "extra", "ids", "start", "kept", "shard", "label")
    return df.withColumns({c: F.lit("clash") for c in clash}), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_hashes_depend_on_bytes_only():
    texts = pa.array(["a bb  a", None, "", "bb\na é", "é"])
    found = []
    for _, _, data, offsets in words.groups(texts):
        w = words.cut(data, offsets)
        for i, j in zip(w.first[:-1], w.first[1:]):
            found.append(w.hashes[i:j].tolist())
    a, bb, a2 = found[0]
    assert a == a2 != bb and found[1] == found[2] == [] and found[3][:2] == [bb, a] and found[3][2] == found[4][0]


def test_base_counts_equal_brute_force(corpus):
    df, rows = corpus
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for doc_id, text, *_ in rows[:-2]:
        w, lines = _words(text), [x for x in (text or "").split("\n") if _words(x)]
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
        r = by[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_limits_follow_the_group(spark):
    plain, noisy = "word " * 3, "word# " * 3
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20)), "en", "clean", 0) for i in range(250)]
    rows += [(1000 + i, " ".join(f"w{i}x{k}" + "#" * (k % 3 == 0) for k in range(20)), "en", "marked", 0) for i in range(250)]
    rows += [(3000 + i, " ".join(f"w{i}x{k}" + "#" * (k % 2) for k in range(20)), "en", "clean", 0) for i in range(3)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert plain != noisy and all(got[i].kept for i in range(250)) and all(got[1000 + i].kept for i in range(250))
    assert not any(got[3000 + i].kept for i in range(3))  # what passes in one source fails in the other


def test_sketches_merge(corpus):
    df, _ = corpus
    whole = quality.sketches(quality._measures(quality.base_counts(df, carry=("lang", "source"))))
    halves = [df.where(f"coalesce(doc_id, 0) % 2 = {k}") for k in (0, 1)]
    parts = [quality.sketches(quality._measures(quality.base_counts(h, carry=("lang", "source")))) for h in halves]
    keys = ["lang", "source", "measure", "cell"]
    merged = parts[0].unionByName(parts[1]).groupBy(*keys).agg(F.sum("n").alias("n"))
    assert sorted(map(str, merged.select(*keys, "n").collect())) == sorted(map(str, whole.select(*keys, "n").collect()))


def _components(rows, n, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text, *_ in rows:
        w = _words((text or "").translate(low))
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(corpus, n, percent):
    df, rows = corpus
    got = [(r[0], r[1], r[2]) for r in jaccard.near_duplicates(df, n, percent).collect()]
    assert sorted(got, key=str) == sorted(_components(rows, n, percent), key=str)


def test_jaccard_returns_no_partial_counts(empty):
    assert jaccard.near_duplicates(empty, 4, 85).columns == ["doc_id", "n_shingles", "component_id"]


def test_jaccard_chain_of_near_copies(spark):
    """A chain in which only neighbours link: one component, whatever hub is taken."""
    rng = random.Random(3)
    line = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(line)))
        line[rng.randrange(60)] = f"c{i}"
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r[0], r[1], r[2]) for r in jaccard.near_duplicates(df, 4, 85).collect()]
    assert sorted(got) == sorted(_components(rows, 4, 85))


def test_repeats_equal_brute_force(corpus):
    df, rows = corpus
    got = Counter(map(tuple, repeats.drop_repeats(df, 20).collect()))
    first = {}
    last = 2**63 - 1
    for doc_id, text, *_ in rows:
        w, place = _words(text), last if doc_id is None else doc_id
        for i in range(len(w) - 19):
            k = tuple(w[i:i + 20])
            first[k] = min(first.get(k, (place, i)), (place, i))
    want = Counter()
    for doc_id, text, *_ in rows:
        w, place = _words(text), last if doc_id is None else doc_id
        gone = {i + k for i in range(len(w) - 19) if first[tuple(w[i:i + 20])] < (place, i) for k in range(20)}
        want[doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    assert got == want


def test_shards_are_minimax(spark, corpus):
    df, rows = corpus
    got = sharding.shard(df, 8).collect()
    assert len(got) == len(rows) and all(r.law == "bytes" and r.grown_shard is None for r in got)
    sizes = Counter()
    for _, text, *_ in rows:
        b = (text or "").encode()
        sizes[hashlib.md5(b).hexdigest()] += len(b) + 1
    ordered = [sizes[k] for k in sorted(sizes)]

    def shards(capacity):
        n, at = 1, 0
        for s in ordered:
            n, at = (n + 1, s) if at + s > capacity else (n, at + s)
        return n

    best = next(c for c in range(max(ordered), sum(ordered) + 1) if shards(c) <= 8)
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    assert max(load.values()) == best and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    totals = sharding.running_totals(
        spark.createDataFrame([(k, v) for k, v in sizes.items()], "group string, size bigint"), "group", "size")
    assert sharding.cut_points(totals, 8, local_totals=0)[0] == best  # the search that never fetches totals


def test_word_tokenizer_equals_whole_texts(corpus):
    _, rows = corpus
    mine, whole = word_tokenizer(TOKENIZER, 1), Tokenizer.from_file(TOKENIZER)
    odd = ["don't we'll", "x<|endoftext|>y <|endoftext|>", "Ünïcödé ẞ İstanbul ΣΑΣ é  x y 3.5%", "ﬁ ½ _x_ \x1c z\x85q", "a" * 3000]
    for text in [r[1] for r in rows] + odd:
        ids = np.frombuffer(mine.encode(text), dtype=mine.dtype).tolist()
        assert ids == whole.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("targets", [None, {"b": 3.0, "hot": 1.0}])
def test_packing_round_trip(corpus, targets):
    df, rows = corpus
    got = packing.pack(df, TOKENIZER, targets=targets).collect()
    tokenizer = word_tokenizer(TOKENIZER, 1)
    want = Counter((r[0], tokenizer.encode(r[1])) for r in rows)
    texts, windows = defaultdict(list), defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or parts is windows[max(windows)]
    counted = Counter()
    for (doc_id, n), parts in texts.items():
        ids = b"".join(p for _, p in sorted(parts))
        assert len(ids) % (4 * n) == 0
        short = np.frombuffer(ids, dtype="<u4").astype(tokenizer.dtype).tobytes()
        counted[doc_id] += len(short)
    assert counted == Counter({d: sum(len(t) * k for (e, t), k in want.items() if e == d) for d, _ in want})
    unique = {r[0]: r[1] for r in rows[:-3] if r[0] != 5}
    for doc_id, text in unique.items():
        (parts,) = [v for (d, _), v in texts.items() if d == doc_id]
        ids = np.frombuffer(b"".join(p for _, p in sorted(parts)), dtype="<u4").astype(tokenizer.dtype).tobytes()
        assert ids == tokenizer.encode(text)


@pytest.mark.parametrize(("held", "targets"), [
    ([50_000, 3000, 2900, 7, 1, 0], None), ([50_000, 3000, 2900], [0.1, 0.6, 0.3]), ([1], None), ([9000, 9000], [1.0, 0.0])])
def test_packing_plan_fills_every_place_once(held, targets):
    plan, seen, rng = packing.phases(held, targets), np.zeros(sum(held), dtype=int), random.Random(1)
    share = defaultdict(Counter)
    for queue, n in enumerate(held):
        at = 0
        while at < n:
            k = min(n - at, rng.randrange(1, 900))
            for start, length, sequence, offset in packing.pieces(plan, queue, at, at + k).tolist():
                assert start >= 0
                seen[sequence * 2048 + offset:sequence * 2048 + offset + length] += 1
                share[sequence][queue] += length
            at += k
    assert (seen == 1).all()
    first = plan[0]
    for sequence in range(first.end // 2048):  # full windows of the first phase hold the target shares to within a token
        for queue, w in enumerate(first.weights):
            assert abs(share[sequence][queue] - 2048 * w / 2**24) <= 2


@pytest.mark.parametrize("hot", [0, 1])
def test_small_sources_are_mixed_in_every_window(spark, hot):
    rng = random.Random(8)
    rows = [(i, _prose(rng, 60, 50), None, f"s{i % 80:02}", 0) for i in range(800)]
    rows += [(1000 + i, _prose(rng, 60, 50), None, "hot", 0) for i in range(400 * hot)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(5), TOKENIZER).collect()
    source = {r[0]: r[3] for r in rows}
    held, total = defaultdict(Counter), Counter()
    for r in got:
        held[r.sequence_id][source[r.doc_id]] += r.length
        total[source[r.doc_id]] += r.length
    whole = sum(total.values())
    for sequence in range(whole // 2048):
        assert sum(held[sequence].values()) == 2048
        for s, n in total.items():
            want = 2048 * n / whole
            assert abs(held[sequence][s] - want) <= want + packing.LEAST_PORTION + 2, (sequence, s)
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id].append((r.start, bytes(r.ids)))
        assert 4 * r.length == len(r.ids)
    encoder = word_tokenizer(TOKENIZER, 1)
    for doc_id, text, *_ in rows:
        ids = np.frombuffer(b"".join(p for _, p in sorted(parts[doc_id])), dtype="<u4").astype(encoder.dtype).tobytes()
        assert ids == encoder.encode(text)


def test_rollup_deltas(spark):
    rows = spark.createDataFrame([(i, "s" if i % 2 else None, "en", "t@1", 10 + i) for i in range(6)] + [(None, "s", "en", "t@1", 9)],
                                 "doc_id bigint, source string, lang string, tokenizer string, tokens bigint")
    rollup = rollups.TokenRollup(spark, scratch_path(spark, "rollup-test"))
    assert rollup.totals().collect() == []
    totals = lambda: {r.source: (r.docs, r.tokens) for r in rollup.totals().collect()}
    op = lambda df, name: df.withColumn("op", F.lit(name)).withColumn("batch", F.lit("clash"))
    assert rollup.commit(1, op(rows, "insert")) and totals() == {"s": (3, 39), None: (3, 36)}
    assert not rollup.commit(1, op(rows, "insert")) and totals() == {"s": (3, 39), None: (3, 36)}
    gone = rows.where("doc_id in (1, 2)")
    assert rollup.commit(2, op(gone, "delete").unionByName(op(gone, "delete"))) and totals() == {"s": (2, 28), None: (2, 24)}
    rollup.commit(3, op(rows.where("doc_id in (0, 1)").withColumn("source", F.lit("moved")), "revise"))
    assert totals() == {"s": (2, 28), None: (1, 14), "moved": (2, 21)}
    # a batch that died before its commit leaves no trace, and may be sent again
    op(rows, "insert").selectExpr("source", "lang", "tokenizer", "1L as docs", "tokens").write.parquet(f"{rollup.root}/deltas/batch=4")
    assert totals() == {"s": (2, 28), None: (1, 14), "moved": (2, 21)}
    rollup.commit(4, op(rows.where("doc_id = 3"), "delete"))
    assert totals() == {"s": (1, 15), None: (1, 14), "moved": (2, 21)}
    assert not rollup.commit(4, op(rows, "insert"))


def test_escape_is_reversible(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("<|\\>ain_\n") for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chats.escape(F.col("t")).alias("e"), chats.unescape(chats.escape(F.col("t"))).alias("b"),
                       chats.unescape_role(chats.escape_role(F.col("t"))).alias("r"), chats.escape_role(F.col("t")).alias("er")).collect():
        assert r.b == r.r == r.t and "<|" not in r.e and "<|" not in r.er and "\n" not in r.er


def test_reply_trees(spark):
    rows = [  # tree, node, parent, score, role, text
        (1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "low"), (1, 3, 1, 5.0, "assistant", "high <|im_end|>"),
        (1, 4, 2, 1.0, "user", "deep"), (1, 5, 4, 1.0, "assistant", "deeper"), (1, 5, 4, 1.0, "assistant", "deeper"),
        (2, 1, 9, None, None, None),  # the parent is not there
        (3, 1, 2, 1.0, "user", "cycle"), (3, 2, 1, 1.0, "user", "cycle"),
        (None, 7, None, 1.0, "user", "a"), (None, 8, 7, 1.0, "assistant", "b")]
    rows += [(4, i, i - 1, 0.5, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    df = spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, score double, role string, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("depth", "leaf", "branch", "up", "turn")})
    out = chats.format_chats(df, best=2).withColumn("turns", chats.turns_of(F.col("formatted"))).collect()
    got = {(r.tree, r.branch): [(t.role, t.text) for t in r.turns] for r in out}
    assert got[1, 1] == [("user", "q"), ("assistant", "high <|im_end|>")]
    assert got[1, 2] == [("user", "q"), ("assistant", "low"), ("user", "deep"), ("assistant", "deeper")]
    assert got[2, 1] == [("", "")] and got[None, 1] == [("user", "a"), ("assistant", "b")]
    assert [t for _, t in got[4, 1]] == [f"t{i}" for i in range(70)] and len(got) == 5
    for r in out:
        loss = [r.formatted[s.start:s.start + s.length] for s in r.loss_spans]
        assert [x.replace("<\\|", "<|") for x in loss] == [t.text for t in r.turns if t.role == "assistant"]
    assert chats.format_chats(df.limit(0)).collect() == []


def _base(text):
    luhn = lambda d: sum(n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


def test_base_spans_equal_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a.@1+- (9)0b5\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == _base(text)
    assert pii.base_spans("pay 4111 1111 1111 1111 now") == [("card", 4, 23)]
    assert pii.base_spans("a" * 300_000 + " x@y") == []  # long words cost linear time


def test_contexts_find_other_forms(spark):
    rows = [(i, f"zeta{i} please call me on +1 555 010 {1000 + i} today ok") for i in range(8)]
    rows += [(100, "q please call me on 555-0199-22 today ok"), (101, "number 555-0199-22 again"), (102, None), (103, ""),
             (104, "order 5550199222 shipped"), (100, "q please call me on 555-0199-22 today ok"), (None, "mail a@b.co")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("row", "extra", "kind", "id")})
    got = sorted(((r.doc_id, r.base, r.spans) for r in pii.personal_data(df).collect()), key=str)
    assert len(got) == len(rows)
    by = dict((k, (b, s)) for k, b, s in got)
    assert by[100] == ("", "phone:20:31") and by[101] == ("", "phone:7:18") and by[102] == by[103] == by[104] == ("", "")
    assert all(by[i][0] == by[i][1] != "" for i in range(8)) and by[None] == ("email:5:11", "email:5:11")
    clean = {r.doc_id: r for r in pii.redact(df).collect()}
    assert clean[101].text == "number [phone] again" and clean[102].text is None and clean[104].text == "order 5550199222 shipped"
    assert clean[3].extra == "clash" and pii.redact(df).columns == df.columns


def test_contexts_find_spaced_short_and_leading_identifiers(spark):
    rows = [f"please call me on +1 555 010 {1000 + i} today ok" for i in range(8)]
    rows += [f"my address is 10.0.0.{i} for now" for i in range(8)] + [f"write me at box u{i}@h.co any time" for i in range(8)]
    rows += [f"a\n+1 555 020 {1000 + i} is my number" for i in range(8)]
    n = len(rows)
    found = ["please call me on 020 7946 0958 today ok", "please call me on 555 010 1234, today ok", "my address is fe80::1 for now",
             "write me at box joe at host dot com any time", "b\n020 7946 0111 is my number", "in 020 7946 0958 and more"]
    want = ["phone:18:31", "phone:18:30", "ip:14:21", "email:16:35", "phone:2:15", "phone:3:16"]
    df = spark.createDataFrame(list(enumerate(rows + found)), "doc_id bigint, text string").coalesce(2)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert [got[n + i].spans for i in range(len(found))] == want
    assert all(got[i].spans == got[i].base != "" for i in range(n))


def test_bootstrap_goes_on_until_nothing_is_found(spark):
    """Context k is learned from the instances of group k - 1 and finds those of group k."""
    names = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    group = lambda k: [f"+1 555 010 {1000 + i}" if k == 0 else f"555-0{k}-{1000 + i}" for i in range(320 >> k)]
    rows = [f"the {names[c]} line {x} is open" for k in range(6) for c in (k, k + 1) for x in group(k)]
    rows += [f"the {names[6]} line {x} is open" for x in group(6)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").coalesce(2)
    assert all(r.spans.startswith("phone:") for r in pii.personal_data(df).collect())


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(1500):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in "ab")
        at = html_text.shared_lines(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert len(at) == _lcs(a, b) == _lcs([a[i] for i in at], b) and at == sorted(at)


def test_page_text(spark):
    rows = [
        (1, "http://h.x/a/1", "<div>Home</div><div>Text one\n two</div><div>Terms</div>"),
        (2, "http://h.x/a/2", "<div>Home</div><p>Other words</p><p>More</p><div>Terms"),
        (3, None, None), (4, "http://[bad", "<p>x&nbsp;&amp; y<br>z</p>"), (6, "http://other.x/a/2", "<div>Home</div>"),
        (5, "http://h.x/b", "<nav>m<article><header><h1>T</h1></header><p>A<div class='comment-list'>c</div><aside>s</aside></article><p>out</p>"),
        (5, "http://h.x/b", "<nav>m<article><header><h1>T</h1></header><p>A<div class='comment-list'>c</div><aside>s</aside></article><p>out</p>"),
        (7, "http://h.x/c", "<script>var t='</p>';</script><style>p{}</style><form>f</form><p>body</p><footer>f</footer>"), (8, "http://h.x/c", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("clash") for c in ("row", "text", "host", "path")})
    got = html_text.main_text(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert by == {1: "Text one two", 2: "Other words More", 3: "", 4: "x & y z", 5: "T A", 6: "Home", 7: "body", 8: ""}
    assert html_text.main_text(df.limit(0)).collect() == []


def _texts(spark, rows):
    return {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_differencing_decides_inside_and_outside_articles(spark):
    page = lambda i: (f"<div>Top</div><div>Body {i}</div><article>Teaser</article><article><p>Text {i} a</p><p>Text {i} b</p>"  # noqa: E731
                      "<p>Share this</p></article><div>End</div>")
    rows = [(i, f"http://h.x/{i}", page(i)) for i in range(1, 5)] + [(9, "http://h.x/1?ref=a", page(1))]
    want = {i: f"Body {i} Text {i} a Text {i} b" for i in range(1, 5)}
    assert _texts(spark, rows) == want | {9: want[1]}


def test_pages_are_held_against_the_nearest_page_that_is_no_copy(spark):
    frame = "".join(f"<div>Frame {k}</div>" for k in range(20))
    page = lambda i: frame + "".join(f"<p>Text {i} {k}</p>" for k in range(3))
    rows = [(i, f"http://h.x/{i}", page(i)) for i in range(1, 5)]
    rows += [(10 + k, f"http://h.x/1?page={k}", page(1)) for k in range(3)]  # copies around page 1
    text = lambda i: " ".join(f"Text {i} {k}" for k in range(3))
    assert _texts(spark, rows) == {i: text(i) for i in range(1, 5)} | {10 + k: text(1) for k in range(3)}
    # near copies at paths of their own lose the frame, not what they share with each other
    story = lambda end: frame + "".join(f"<p>Story {k}</p>" for k in range(9)) + f"<p>{end}</p>"
    rows = [(i, f"http://h.x/{i}", page(i)) for i in range(1, 6)] + [(i, f"http://h.x/6{i}", story(f"End {i}")) for i in range(6, 9)]
    got = _texts(spark, rows)
    assert [got[i] for i in range(6, 9)] == [" ".join(f"Story {k}" for k in range(9)) + f" End {i}" for i in range(6, 9)]
    assert all(got[i] == text(i) for i in range(1, 6))


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(9)
    items = [(i, _prose(rng, rng.randrange(16, 50), 100_000)) for i in range(12)] + [(90, None), (91, ""), (92, "x y")]
    items.append(items[0])
    docs, want = [], set()
    for i in range(40):
        body = _prose(rng, 60, 100_000).split(" ")
        if i < 24:
            item = items[i % 12][1].upper().split(" ") if i % 3 == 0 else items[i % 12][1].split(" ")
            if i >= 12:
                for k in range(3, len(item), 9):  # every ninth word substituted
                    item[k] = f"other{k}"
            body[20:20] = item
            want.add((i, i % 12))
        docs.append((i, " ".join(body)))
    docs += [(100, None), (101, ""), (102, "one two"), docs[0], (None, docs[1][1])]
    want.add((None, 1))
    make = lambda rows, names: spark.createDataFrame(rows, names)
    clash = {c: F.lit("clash") for c in ("hash", "item_pos", "words", "row", "item_id_")}
    return (make(docs, "doc_id bigint, text string").withColumns(clash),
            make(items, "item_id bigint, text string").withColumns({"doc_id": F.lit("clash")}), want)


@pytest.mark.parametrize("filter_bytes", [None, 0])
def test_spaced_seeds_find_substituted_passages(leaks, filter_bytes):
    docs, items, want = leaks
    got = spaced.contaminated(docs, items, filter_bytes=filter_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(100 * r.n_equal >= 80 * r.n_words for r in got)


def test_masks_hit_every_allowed_placement():
    for n in range(13, 26):  # longer stretches can be halved
        for gone in combinations(range(n), n // 5):
            equal = sum(1 << i for i in range(n) if i not in gone)
            hits = (all(equal >> at + i & 1 for i, c in enumerate(m) if c == "1") for m in spaced.MASKS for at in range(n - len(m) + 1))
            assert any(hits), (n, gone)
    for n in range(1, 13):  # short items
        (mask,) = spaced.masks_for(n, 13, 80)
        assert all(mask in "".join("01"[i not in gone] for i in range(n)) for gone in combinations(range(n), n // 5))


@pytest.mark.parametrize("filter_bytes", [None, 0])
def test_every_overlap_within_the_limits_is_found(spark, filter_bytes):
    rng = random.Random(4)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (1, 4, 5, 10, 13, 15, 20)}
    cases = [(n, gone) for n in (1, 4, 5, 10, 13, 15) for gone in combinations(range(n), n // 5)] + [(20, (2, 7, 12, 17))]
    few = [(10, gone) for gone in combinations(range(10), 3)]  # 70 percent
    make = lambda n, gone: " ".join(
        [f"a{rng.random()}", *("sub" if k in gone else x for k, x in enumerate(items[n])), "z"]).replace(".", "")
    docs = spark.createDataFrame([(i, make(*c)) for i, c in enumerate(cases + few)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in spaced.contaminated(docs, bench, filter_bytes=filter_bytes).collect()}
    assert got == {(i, n) for i, (n, _) in enumerate(cases)}


def test_longest_overlap_equals_brute_force():
    rng = random.Random(6)
    for _ in range(500):
        doc, item = (np.array([rng.randrange(2) for _ in range(rng.randrange(1, 16))]) for _ in "ab")
        shift = rng.randrange(-len(item), len(doc) + 1)
        same = {i: doc[i + shift] == item[i] for i in range(len(item)) if 0 <= i + shift < len(doc)}
        fits = [b - a for a in same for b in range(a + 1, max(same) + 2) if 100 * sum(same[i] for i in range(a, b)) >= 80 * (b - a)]
        start, end, equal = spaced.longest_overlap(doc, item, shift, 80)
        assert end - start == max(fits, default=0) and equal == sum(same[i] for i in range(start, end))


def test_empty_tables(spark, empty):
    assert quality.judge(empty).collect() == [] and jaccard.near_duplicates(empty).collect() == []
    assert repeats.drop_repeats(empty).collect() == [] and sharding.shard(empty).collect() == []
    assert packing.pack(empty, TOKENIZER).collect() == [] and pii.personal_data(empty).collect() == []
    assert spaced.contaminated(empty, spark.createDataFrame([], "item_id bigint, text string")).collect() == []
    assert pii.redact(empty).collect() == [] and quality.keep_good(empty).collect() == []


def test_stage_columns_and_clean_documents(spark, corpus):
    """The filtering stages keep documents that no rule names, and every stage but the last returns documents."""
    df, _ = corpus
    assert [name for name, _ in stages.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "packing"]
    good = stages.quality_rules(spark, df, "")
    assert good.columns == stages.COLUMNS
    assert {r.doc_id for r in good.collect()} >= set(range(2, 60)) and zlib.crc32(b"") == 0
