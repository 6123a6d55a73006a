"""Limits that move, pages against brute force, rollups against a recount, roles with any character, hot seeds, many sources."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL
from pyspark.sql import functions as F
from test_corpus_operators import DOCS, TOKENIZER

from tagwright.llm import chats, html_text, jaccard, packing, pii, quality, queries, rollups, spaced
from tagwright.llm.tokens import byte_pairs
from tagwright.storage import scratch_path

SF = "/root/testdata/sf0.01"


# ---- quality rules ----

def test_a_language_without_spaces_keeps_its_clean_texts(spark):
    rng = random.Random(2)

    def clause():
        return "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(rng.randrange(22, 34)))

    rows = [(i, "。 ".join(clause() for _ in range(30)), "zh", "web", 0) for i in range(260)]
    rows += [(1000 + i, " ".join(f"word{rng.randrange(900)}" for _ in range(80)), "en", "web", 0) for i in range(260)]
    rows += [(2000 + i, "。 ".join(clause() for _ in range(30)), "en", "web", 0) for i in range(5)]  # long words where nobody writes them
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].kept for i in range(260)) and all(got[1000 + i].kept for i in range(260))
    assert not any(got[2000 + i].kept for i in range(5))
    assert got[0].word_length_low > got[1000].word_length_high  # each language by its own sketch


def test_groups_have_limits_of_their_own(spark):
    rows = quality.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    names = quality._limit_names()
    limits = rows.groupBy("lang").agg(*[F.count_distinct(c).alias(c) for c in names]).collect()
    whole = rows.agg(*[F.count_distinct(c).alias(c) for c in names]).first()
    assert whole["symbol_share_high"] > 10 and whole["word_length_high"] > 10 and len(limits) == 4


def test_measures_without_values_have_no_limit(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20)), "en", "s", 0) for i in range(8)]
    got = quality.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.kept and r.dup_line_share_high is None and r.symbol_share_high == 0 for r in got)


# ---- pages ----

def _page(lines, outside=(), cls=""):
    body = "".join(f"<p>{x}</p>" for x in lines)
    return "<html><body>" + "".join(f"<div{cls}>{x}</div>" for x in outside) + f"<article>{body}</article></body></html>"


def _texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in html_text.main_text(df).collect()}


def test_articles_keep_paragraphs_that_a_neighbour_happens_to_share(spark):
    body = lambda i: [f"only {i} {k}" for k in range(6)]
    pages = [(i, f"http://a.example/{i:03}", _page(body(i) + ["By the same author."] * (i in (3, 4)) + ["Printed on paper."], ["Find us here"]))
             for i in range(9)]
    got = _texts(spark, pages)
    assert got[3].endswith("By the same author.") and got[4].endswith("By the same author.")
    assert not any("Printed on paper." in t or "Find us here" in t for t in got.values())  # on every page of the host
    assert all(f"only {i} {k}" in got[i] for i in range(9) for k in range(6))


def test_names_inside_articles(spark):
    html = ('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p><div class="share-price">42</div>'
            '<p class="notice-period">Three months</p><div class="share-buttons">Tweet</div><div id="comments"><p>First!</p></div>'
            '<div class="comment-list">me too</div><div class="related">More</div></article><div class="page-header">Site</div>')
    assert _texts(spark, [(1, "http://b.example/x", html)])[1] == "Title Body 42 Three months"


def _plain_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


@pytest.mark.parametrize("bits", [2**28, 8])
def test_alignment_in_halves(monkeypatch, bits):
    monkeypatch.setattr(html_text, "_LCS_BITS", bits)
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(18))] for _ in "ab")
        got = html_text.shared_lines(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert got == sorted(set(got)) and len(got) == _plain_lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)  # a common subsequence


def _plain_pairs(pages):
    """Pages (host, path, lines) -> lines deleted, by plain loops: contents in order, nearest on either side that is no copy."""
    contents = {}
    for host, path, lines in pages:
        key = (host, tuple(lines))
        contents[key] = min(contents.get(key, path), path)
    order = sorted((host, path, lines) for (host, lines), path in contents.items() if lines)
    size, often = Counter(h for h, *_ in order), Counter((h, x) for h, _, lines in order for x in {t for _, t in lines})
    common = {k for k, n in often.items() if n >= 3 and 2 * n > size[k[0]]}

    def own(c):
        inside = [t for f, t in c[2] if f] or [t for _, t in c[2]]
        return [t for t in inside if (c[0], t) not in common]

    def copies(a, b):
        return 100 * _plain_lcs(own(a), own(b)) > 80 * max(len(own(a)), len(own(b)))

    begins = [i == 0 or order[i][0] != order[i - 1][0] or not copies(order[i], order[i - 1]) for i in range(len(order))]
    run = np.cumsum(begins)
    out = {}
    for i, c in enumerate(order):
        near = []
        for step in (-1, 1):
            j = i
            while True:
                k = j
                while 0 <= k < len(order) and run[k] == run[j]:
                    k += step
                j = k
                if not 0 <= j < len(order) or order[j][0] != c[0]:
                    break
                if not copies(c, order[j]):
                    near.append(j)
                    break
        near.sort(key=lambda j: -html_text._common(c[1], order[j][1]))
        if near:
            a, b = ([t for _, t in x[2]] for x in (c, order[near[0]]))
            ids = {t: n for n, t in enumerate(dict.fromkeys(a + b))}
            hit = html_text.shared_lines(*(np.array([ids[t] for t in x], dtype=np.uint64) for x in (a, b)))
            out[c[0], c[2]] = {p for p in hit if not c[2][p][0] or (c[0], c[2][p][1]) in common}
    return out


def test_pairing_and_deletion_equal_plain_loops(spark):
    rng = random.Random(12)
    pages = []
    for host in ("one.example", "two.example", "three.example"):
        shared = [f"{host} menu {k}" for k in range(4)]
        families = [[f"{host} f{f} {k}" for k in range(rng.randrange(1, 7))] for f in range(5)]
        for i in range(30):
            lines = list(rng.choice(families)) if rng.random() < 0.6 else [f"{host} {i} {k}" for k in range(rng.randrange(5))]
            if rng.random() < 0.3 and lines:
                lines[rng.randrange(len(lines))] = f"{host} changed {i}"
            body = "".join(f"<p>{x}</p>" for x in lines)
            body = f"<article>{body}</article>" if rng.random() < 0.6 else body
            top = "".join(f"<div>{x}</div>" for x in shared if rng.random() < 0.9)
            pages.append((f"http://{host}/{rng.randrange(4)}/{i:02}?ref={i % 3}", top + body))
    pages += [(None, "<p>no url</p>"), (None, "<p>no url</p><p>again</p>"), ("http://[broken", "<p>no url</p>"), ("http://one.example/", None)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")
    placed = [(*html_text._place(u), tuple(html_text.page_lines(h))) for u, h in pages]
    plain = _plain_pairs(placed)
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    for i, (host, _, lines) in enumerate(placed):
        gone = plain.get((host, lines), set())
        assert got[i] == " ".join(t for p, (_, t) in enumerate(lines) if p not in gone), i


def test_no_unmarked_article_paragraph_goes_unless_common_on_its_host(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op2_nearest_page_text(spark, SF).collect()}
    missing = Counter()
    for i, r in rows.items():
        paragraphs = [t for inside, t in html_text.page_lines(r.html) if inside]
        missing[sum(t not in got[i] for t in paragraphs)] += 1
    assert set(missing) == {0} and len(got) == len(rows)


# ---- rollups ----

def test_rollups_equal_a_recount_over_many_batches(spark):
    rng = random.Random(3)
    rollup, held = rollups.TokenRollup(spark, scratch_path(spark, "rollup"), batches=3), {}
    schema = "doc_id bigint, op string, source string, lang string, tokenizer string, tokens bigint"
    sent = []
    for batch in range(1, 9):
        changes = [(rng.choice([*range(12), None]), rng.choice(["insert", "delete", "revise", "other"]), rng.choice(["s", "t", None]),
                    rng.choice(["en", None]), rng.choice(["a@1", "b@1", "b@1", None]), rng.choice([None, 1, 5, 9]))
                   for _ in range(rng.randrange(12) if batch != 5 else 0)]
        sent.append((batch, spark.createDataFrame(changes, schema)))
        best = {}
        for doc, op, source, lang, tokenizer, n in changes:
            if doc is not None and tokenizer is not None and op != "other":
                order = (op == "delete", n or 0, (source is not None, source or ""), (lang is not None, lang or ""))
                best[doc, tokenizer] = max(best.get((doc, tokenizer), order), order)
        for (doc, tokenizer), (gone, n, (_, source), (_, lang)) in best.items():
            held.pop((doc, tokenizer), None)
            if not gone:
                held[doc, tokenizer] = (source, lang, n)
        assert rollup.commit(*sent[-1]) and not rollup.commit(*sent[-1])
        want = defaultdict(lambda: [0, 0])
        for (_, tokenizer), (source, lang, n) in held.items():
            want[source, lang, tokenizer][0] += 1
            want[source, lang, tokenizer][1] += n
        got = {(r.source or None, r.lang or None, r.tokenizer): [r.docs, r.tokens] for r in rollup.totals().collect()}
        assert got == {((s or None), (g or None), t): v for (s, g, t), v in want.items()}, batch
    assert not rollup.commit(*sent[0])
    fresh = rollups.TokenRollup(spark, rollup.root)  # another session over the same folder
    assert sorted(map(str, fresh.totals().collect())) == sorted(map(str, rollup.totals().collect()))


def test_late_batches_are_refused(spark):
    rollup = rollups.TokenRollup(spark, scratch_path(spark, "rollup"))
    row = lambda op, n: spark.createDataFrame([(1, op, "s", "en", "a@1", n)],
                                              "doc_id bigint, op string, source string, lang string, tokenizer string, tokens bigint")
    assert rollup.commit(5, row("insert", 10))
    with pytest.raises(ValueError, match="batch 3 comes after batch 5"):
        rollup.commit(3, row("revise", 20))
    assert rollup.commit(6, row("delete", 0)) and rollup.totals().collect() == []


def test_rollup_query_equals_a_plain_count(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    ranks = byte_pairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert isinstance(ranks, tiktoken.Encoding)
    first = {}
    for r in docs:
        first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    want = defaultdict(lambda: [0, 0])
    for r in docs:
        text = r.text or ""
        if first[text] == r.doc_id:
            want[r.source, r.lang][0] += 1
            want[r.source, r.lang][1] += len(ranks.encode_ordinary("\n".join(dict.fromkeys(text.split("\n")))))
    got = {(r.source, r.lang): [r.docs, r.tokens] for r in queries.op5_token_rollups(spark, SMALL).collect()}
    assert got == dict(want)


# ---- chats, personal data, decontamination, packing ----

def test_roles_with_any_character_are_read_back(spark):
    rng = random.Random(7)
    roles = ["a\0b", "\0", "a\\b", "\\n", "\\\n", "\n\\b", "<|", "<\\|", "<\n|", "\\\\b\\n", "", "user"]
    roles += ["".join(rng.choice("\\bn\n\0<|") for _ in range(rng.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(roles)], "tree bigint, role string")
    for r in df.select("role", chats.escape_role(F.col("role")).alias("e")).withColumn("back", chats.unescape_role(F.col("e"))).collect():
        assert r.back == r.role and "\n" not in r.e and "<|" not in r.e
    nodes = df.select("tree", F.lit(1).alias("node"), F.lit(None).cast("bigint").alias("parent"), F.lit(0.0).alias("score"), "role", F.lit("t\0").alias("text"))
    for r in chats.format_chats(nodes).withColumn("turns", chats.turns_of(F.col("formatted"))).collect():
        assert [(t.role, t.text) for t in r.turns] == [(roles[r.tree], "t\0")]


def test_nothing_is_learned_where_contexts_are_random(spark):
    """The given tables put identifiers between random words: base spans are all there is, and decoys stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pii.personal_data(docs).collect()
    assert all(r.spans == r.base for r in got) and sum(r.n_card for r in got) > 0
    decoys = [r.doc_id for r in docs.collect() if any(
        not pii._luhn(m) for m in re.findall(r"(?<![0-9.@+-])[0-9]{16}(?![0-9])", r.text or ""))]
    assert decoys  # numbers of a card's length that fail its check, which a pattern on shape alone would take


@pytest.mark.parametrize("filter_bytes", [None, 0])
def test_a_seed_that_all_items_share(spark, filter_bytes, monkeypatch):
    monkeypatch.setattr(spaced, "_HITS", 50)
    rng = random.Random(9)
    prefix = "which of the following best describes what the author of this passage means by".split()
    items = {n: prefix + [f"i{rng.randrange(10**6)}" for _ in range(20)] for n in range(40)}
    docs = {0: items[3][10:], 1: prefix[:10] + ["and", "then", "nothing"], 2: ["x"] * 30 + items[7] + ["y"] * 30, 3: [], 4: prefix * 3}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in spaced.contaminated(df, bench, filter_bytes=filter_bytes).collect()}
    want = {(0, 3)} | {(2, n) for n in items} | {(4, n) for n in items}
    assert got == want


def test_many_small_sources_make_few_pieces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.concat(F.lit("host"), F.col("doc_id") % 500))
    got = packing.pack(docs, TOKENIZER)
    rows = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
    assert sum(r.pieces for r in rows) < 30_000 and sorted(r.n for r in rows)[1:] == [2048] * (len(rows) - 1)


def test_sketches_drop_unrelated_long_texts_before_sets_are_sent(spark):
    """Long unrelated texts that share an n-gram are told apart by a bit per member; links stay."""
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (rng.integers(0, 2**64, rng.integers(1, 2000), dtype=np.uint64) for _ in range(2))
        b = np.union1d(a[:rng.integers(0, len(a) + 1)], b)
        a = np.unique(a)
        doc, hashes = np.repeat([0, 2], [len(a), len(b)]), np.concatenate([a, b])
        one, none, two = jaccard._sketches(doc, hashes, np.array([len(a), 0, len(b)])).to_pylist()
        assert jaccard._apart(one, two) == jaccard._apart(two, one) <= len(np.setxor1d(a, b)) and not any(none)
    words = lambda k, n=1500: [f"w{i}" for i in rng.integers(0, 10**6, n) + k * 10**7]
    first, other = words(1), words(2)
    rows = [(1, " ".join(first)), (2, " ".join([*first[:-20], *words(3, 20)])), (3, " ".join([*other, *first[:40]]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    of = {r.key: r.node for r in jaccard.classes(df, 4).collect()}
    sketches = jaccard.classes(df, 4).select("node", F.col("n_shingles").alias("size"), "sketch")
    near = [tuple(sorted((of[a], of[b]))) for a, b in ((1, 2), (1, 3), (2, 3))]
    near = spark.createDataFrame(near, "a bigint, b bigint")
    assert [tuple(r) for r in jaccard._close(near, sketches, 85).collect()] == [tuple(sorted((of[1], of[2])))]
    assert sorted((r.doc_id, r.component_id) for r in jaccard.near_duplicates(df, 4, 85).collect()) == [(1, 1), (2, 1), (3, 3)]
