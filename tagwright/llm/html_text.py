"""Main text of web pages: markup rules and nearest-URL page differencing.

A page is cut into lines at block elements. Lines in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out by their element, role, class or id. All other lines, inside and
outside ``article`` and ``main`` elements, are compared with those of the page whose URL is nearest on the same host and
which is no copy: both pages' lines are aligned by a longest common subsequence, and the shared ones are deleted. A line
inside an article goes only if it is common on the host as well, as two articles may well share a paragraph.

Copies say nothing about boilerplate. Pages of a host with equal lines, inside and outside articles, count as one content, which lies at its least
path. Contents are sorted by host and path; two are copies when they share more than ``COPY_SHARE`` percent of their own
lines: those inside articles where there are any, without the lines that are common on the host (on more than half of
its contents, and on three at least). Neighbours that are copies form runs. Of the contents next to a run before and
behind the one with the longer common path prefix is taken; if it is a copy after all the other one, and then those
beyond the next runs, until one is no copy or the host ends.

Sorting and pairing use only line hashes, hosts and paths; ranks come from a range-partitioned sort, so a host with a
third of all pages is spread over tasks. The pages are read a second time for the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm import words as W
from tagwright.llm.sharding import running_totals
from tagwright.llm.shared import attach, map_batches
from tagwright.operators.ranking import with_rank
from tagwright.storage import store

COPY_SHARE = 80
COMMON = 3  # contents of a host that hold a common line, at least

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr "
    "ul".split())
_DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select textarea iframe object svg canvas dialog "
    "menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_NAMES = (
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification popup promo "
    "promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar")
_DROP_NAME = re.compile(rf"(?:{'|'.join(_NAMES.split())})(?:[-_].*)?|.*[-_](?:header|footer|menu|nav|navigation|comments?)")
# Inside an article only names that say nothing else: one of the names, with or without words for a container around it.
_BOXES = "area bar block box button buttons container form inner item items link links list section thread widget wrap wrapper"
_INNER = "|".join(n for n in _NAMES.split() if n not in ("header", "masthead", "banner"))
_DROP_INNER = re.compile(rf"(?:(?:{'|'.join(_BOXES.split())})[-_])*(?:{_INNER})(?:[-_](?:{'|'.join(_BOXES.split())}))*")
_LCS_BITS = 2**28  # 32 MiB: a larger alignment is cut in two
_OPEN_CONTENT = frozenset(("article", "main"))


class _Lines(HTMLParser):
    """Lines ``(in article, text)`` of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[bool, str]] = []
        self.parts: list[str] = []
        self.content: list[str] = []  # open article and main elements
        self.dropped, self.depth = "", 0  # the element being left out, and how often it is open
        self.around = ("", 0)  # the same for what was open when the article began; it goes on behind the article

    def _break(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((bool(self.content), text))
            self.parts = []

    def _drops(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in _DROPPED or (tag == "header" and not self.content):
            return True
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            if name == "hidden" or (name == "role" and (value or "").lower() in _ROLES):
                return True
            if name in ("class", "id"):
                dropped = _DROP_INNER if self.content else _DROP_NAME
                if any(dropped.fullmatch(x) for x in (value or "").lower().split()):
                    return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropped:
            if tag == self.dropped:
                self.depth += 1
            if tag not in _OPEN_CONTENT or self.content or self.dropped in ("article", "main"):
                return
            self.around, self.dropped = (self.dropped, self.depth), ""  # an unclosed element does not swallow the article
        if tag in _BLOCKS:
            self._break()
        if tag in _VOID:
            return
        if self._drops(tag, attrs):
            self._break()
            self.dropped, self.depth = tag, 1
        elif tag in _OPEN_CONTENT:
            self.content.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _leave(self, tag: str) -> None:
        self.content.remove(tag)
        if not self.content:
            (self.dropped, self.depth), self.around = self.around, ("", 0)

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if tag == self.dropped:
                self.depth -= 1
                if not self.depth:
                    self.dropped = ""
            elif tag in self.content:  # the article ends inside an element that was never closed
                self.dropped = ""
                self._leave(tag)
            return
        if tag == self.around[0]:
            self.around = (tag, self.around[1] - 1) if self.around[1] > 1 else ("", 0)
        if tag in _BLOCKS:
            self._break()
        if tag in self.content:
            self._leave(tag)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)


def page_lines(html: str | None) -> list[tuple[bool, str]]:
    """Lines of a page that the markup rules leave, each with whether it lies in an article."""
    reader = _Lines()
    reader.feed(html or "")
    reader.close()
    reader._break()
    return reader.lines


def _grown(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
    """After each line of ``a`` the places of ``b``, as bits, where a longest common subsequence does not grow."""
    where: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    for x in a.tolist():
        hit = v & where.get(x, 0)
        v = ((v + hit) | (v - hit)) & every
        yield v


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with each beginning of ``b``."""
    v = (1 << len(b)) - 1
    for v in _grown(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared_lines(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``a`` that a longest common subsequence of ``a`` and ``b`` uses, by bit vectors over ``b``.

    Equal beginnings and ends are taken off first. What is left is aligned at once if its bits fit ``_LCS_BITS``; else ``a`` is
    halved and ``b`` cut where the halves share most, so memory stays bounded for pages of any length.
    """
    n = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    n -= head
    tail = int(np.argmin(np.append(a[::-1][:n] == b[::-1][:n], False)))
    out = list(range(head))
    middle, other = a[head:len(a) - tail], b[head:len(b) - tail]
    if len(middle) * len(other) > _LCS_BITS and len(middle) > 1:
        half = len(middle) // 2
        cut = int((_lengths(middle[:half], other) + _lengths(middle[half:][::-1], other[::-1])[::-1]).argmax())
        out += [head + i for i in shared_lines(middle[:half], other[:cut])]
        out += [head + half + i for i in shared_lines(middle[half:], other[cut:])]
    else:
        rows, found, i, j = list(_grown(middle, other)), [], len(middle), len(other)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
                i -= 1
            else:
                found.append(head + i - 1)
                i, j = i - 1, j - 1
        out += found[::-1]
    return out + list(range(len(a) - tail, len(a)))


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), parts.path
    except ValueError:
        return "", url or ""


def _common(a: str, b: str | None) -> int:
    n = 0
    for x, y in zip(a, b or ""):
        if x != y:
            break
        n += 1
    return n


def _open_lines(pages: DataFrame) -> DataFrame:
    """``row``, ``host``, ``path``, the hashes of the lines as binary 64-bit integers, and a byte for each: in an article."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        places = [_place(u) for u in batch.column(1).to_pylist()]
        packed, flags = [], []
        for html in batch.column(2):
            lines = page_lines(html.as_py())
            texts = pa.array([t for _, t in lines], pa.string())
            hashes = [W.cut(d, o, np.ones(256, dtype=bool)).hashes for _, _, d, o in W.groups(texts)]
            packed.append(np.concatenate(hashes).tobytes() if hashes else b"")
            flags.append(bytes(inside for inside, _ in lines))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([h for h, _ in places]), pa.array([p for _, p in places]), pa.array(packed, pa.binary()),
             pa.array(flags, pa.binary())], ["row", "host", "path", "lines", "inside"])

    return map_batches(pages, work, "row bigint, host string, path string, lines binary, inside binary")


def _own_lines(contents: DataFrame) -> DataFrame:
    """``contents`` (stored) with ``own``, the lines by which copies are told, and ``safe``, a byte for each line: inside an
    article and not common on the host."""

    def each_line(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lines = [np.unique(np.frombuffer(b.as_buffer(), dtype=np.int64)) for b in batch.column(2)]
        owner = pa.array(np.repeat(np.arange(len(lines)), [len(x) for x in lines]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(np.concatenate([*lines, np.zeros(0, dtype=np.int64)]))], ["content", "host", "line"])

    lines = map_batches(contents.select("content", "host", "lines"), each_line, "content bigint, host string, line bigint")
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    sizes = store(contents.groupBy("host").agg(F.count("*").alias("size")), "html-hosts")
    common = attach(counts, sizes, ["host"], "inner").where("2 * n > size").select("host", "line")
    held = attach(lines, store(common, "html-common"), ["host", "line"], "inner")
    held = store(held.groupBy("content").agg(F.collect_list("line").alias("common")), "html-held")

    def own(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, safe = [], []
        for lines, inside, common in zip(*[c.to_pylist() for c in batch.columns[4:]]):
            lines, inside = np.frombuffer(lines, dtype=np.int64), np.frombuffer(inside, dtype=bool)
            rare = ~np.isin(lines, np.array(common or [], dtype=np.int64))
            safe.append((inside & rare).tobytes())
            out.append(lines[(inside if inside.any() else True) & rare].tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary()), pa.array(safe, pa.binary())],
                                         ["content", "host", "path", "rank", "lines", "own", "safe"])

    wide = attach(contents, held, ["content"], "left").select("content", "host", "path", "rank", "lines", "inside", "common")
    return map_batches(wide, own, "content bigint, host string, path string, rank bigint, lines binary, own binary, safe binary")


def _copies(a: bytes, b: bytes) -> bool:
    """Do two contents share most of their own lines?"""
    a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    return 100 * len(shared_lines(a, b)) > COPY_SHARE * max(len(a), len(b))


def _runs(ranked: DataFrame) -> DataFrame:
    """``ranked`` with ``first`` and ``last``, the ranks where its run of copies begins and ends."""
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("host").alias("host_a"), F.col("own").alias("own_a"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        begins = [int(h != h_a or not _copies(o, o_a)) for h, o, h_a, o_a in zip(*[c.to_pylist() for c in batch.columns[1:]])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begins, pa.int64())], ["rank", "begins"])

    pairs = ranked.join(before, "rank", "left").select("rank", "host", "own", "host_a", "own_a")
    begins = store(map_batches(pairs, work, "rank bigint, begins bigint"), "html-begins")
    numbered = store(running_totals(begins, "rank", "begins").select("rank", F.col("total").alias("run")), "html-numbered")
    ends = store(numbered.groupBy("run").agg(F.min("rank").alias("first"), F.max("rank").alias("last")), "html-runs")
    bounds = store(attach(numbered, ends, ["run"], "inner").select("rank", "first", "last"), "html-bounds")
    return attach(ranked, bounds, ["rank"], "inner")


def shared_with_nearest(pages: DataFrame) -> DataFrame:
    """``row`` and ``shared``, the places (32-bit, among the page's lines) shared with the nearest page that is no copy."""
    opened = store(_open_lines(pages).withColumn("content", F.xxhash64("host", "lines", "inside")), "html-open")
    least = F.min(F.struct("path", "row", "host", "lines", "inside")).alias("m")
    contents = opened.where("length(lines) > 0").groupBy("content").agg(least).select("content", "m.*").drop("row")
    contents = store(with_rank(contents, ["host", "path", "content"], "rank", 0), "html-ranked")
    ranked = store(_runs(store(_own_lines(contents), "html-own")), "html-copies")

    def differ(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for content, path, lines, safe, *sides in zip(*[c.to_pylist() for c in batch.columns]):
            near = [s for s in (sides[:2], sides[2:]) if s[0] is not None]
            near.sort(key=lambda s: -_common(path, s[0]))  # stable: the one before goes first
            found = np.array(shared_lines(np.frombuffer(lines, dtype=np.uint64), np.frombuffer(near[0][1], dtype=np.uint64))
                             if near else [], dtype=np.int32)
            out.append((content, found[~np.frombuffer(safe, dtype=bool)[found]].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 2, (pa.int64(), pa.binary()))], ["content", "shared"])

    near = ranked.select("content", "path", "lines", "safe", "host", "rank")
    for s, at in (("a", "low"), ("b", "high")):
        partner = store(_partners(ranked, at), f"html-{at}")
        found = ranked.select(F.col("rank").alias(at), *[F.col(c).alias(f"{c}_{s}") for c in ("path", "lines")])
        near = attach(near, partner, ["rank"], "left")
        near = attach(near, store(found.join(partner.select(at).distinct(), at, "left_semi"), "html-side"), [at], "left")
    wide = near.select("content", "path", "lines", "safe", "path_a", "lines_a", "path_b", "lines_b")
    done = store(map_batches(wide, differ, "content bigint, shared binary").where("length(shared) > 0"), "html-done")
    return attach(opened.select("row", "content"), done, ["content"], "inner").select("row", "shared")


def _partners(ranked: DataFrame, side: str) -> DataFrame:
    """``rank`` and the rank of the nearest content of the host before (``low``) or behind (``high``) it that is no copy.

    The next content beyond a run is taken unless it is a copy after all; then the one beyond its run, and so on. Contents
    that have to go on look 1, 2, 4, ... runs further at a time, so a host of many runs takes few rounds.
    """
    beyond = F.col("first") - 1 if side == "low" else F.col("last") + 1
    facts = ranked.select("rank", "host", "own", beyond.alias("next"))
    held = store(facts.select(F.col("rank").alias("at"), F.col("host").alias("host_at"), F.col("own").alias("own_at"),
                              F.col("next").alias("next_at")), "html-facts")

    def copies(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        same = [_copies(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[4:], pa.array(same, pa.bool_())],
                                         ["rank", "at", "next_at", "step", "copy"])

    open_, done, reach = facts.select("rank", F.col("next").alias("at"), F.lit(0).alias("step")), None, 1
    jumps = [held.select("at", F.col("next_at").alias("then"))]  # the content 1, 2, 4, ... runs on
    while True:
        near = attach(attach(open_, facts.select("rank", "host", "own"), ["rank"], "inner"), held, ["at"], "inner")
        near = near.where(F.col("host") == F.col("host_at")).select("rank", "at", "own", "own_at", "next_at", "step")
        tried = store(map_batches(near, copies, "rank bigint, at bigint, next_at bigint, step int, copy boolean"), f"html-{side}-tried")
        hits = tried.where("not copy").groupBy("rank").agg(F.min_by("at", "step").alias(side))
        hits = store(hits, f"html-{side}-found")
        done = hits if done is None else done.unionByName(hits)
        last = tried.groupBy("rank").agg(F.count("*").alias("n"), F.max_by("next_at", "step").alias("at"))
        rest = store(last.where(F.col("n") == reach).join(hits, "rank", "left_anti").select("rank", "at"), f"html-{side}-rest")
        if rest.isEmpty():
            return done
        open_, ahead, reach = rest.withColumn("step", F.lit(0)), 1, reach * 2
        for k in range(reach.bit_length() - 1):
            if k == len(jumps):
                two = jumps[-1].select(F.col("at").alias("then"), F.col("then").alias("after"))
                jumps.append(store(attach(jumps[-1], two, ["then"], "inner").select("at", F.col("after").alias("then")), "html-jump"))
            moved = attach(open_, jumps[k], ["at"], "inner").select(
                "rank", F.col("then").alias("at"), (F.col("step") + ahead).alias("step"))
            open_, ahead = store(open_.unionByName(moved), f"html-{side}-open"), 2 * ahead


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every row.

    White space inside a line becomes one space; lines are joined by one space. A null or empty html gives an empty text. Pages
    with a null or broken URL share the empty host, rows with a null key are pages like others. Repeated rows are copies of each
    other. Pages of any length are read whole; an empty table gives no rows. Other columns are not looked at.
    """
    row = F.xxhash64(key, url, html)
    named = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), row.alias("row"))
    shared = store(shared_with_nearest(named.select("row", "url", "html")).dropDuplicates(["row"]), "html-shared")
    work = attach(named, shared, ["row"], "left").select("key", "url", "html", "shared")

    def extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = []
        for html, gone in zip(batch.column(2), batch.column(3)):
            lines = page_lines(html.as_py())
            drop = set(np.frombuffer(gone.as_buffer(), dtype=np.int32).tolist()) if gone.is_valid else ()
            texts.append(" ".join(t for i, (_, t) in enumerate(lines) if i not in drop))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["key", "url", "text", "n_chars"])

    out = map_batches(work, extract, "key bigint, url string, text string, n_chars bigint")
    return out.withColumnRenamed("key", key)
