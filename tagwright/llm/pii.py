"""Personal data by fixed forms, and by contexts learned from them.

The base forms (emails, IPv4 addresses, card numbers, phone numbers) are found by pattern. They seed a bootstrap that
looks for identifiers of the same kinds which no form covers:

1. Every stretch of a line that could be an identifier is an *instance*, base spans included: a word with an ``@`` or
   five digits and more; a run of number words up to the first other word (of a run too long for any kind its longest
   beginning and end); hexadecimal groups around colons; ``name at host dot com``. Its *patterns* are the two words before
   it, and the word before together with the word after it; at the start of a line the two words after it, and behind
   the first word of a line that word.
2. A pattern's confidence for a kind is the share of its distinct instances that are known to be of that kind, unknown
   ones counting half. Patterns with ``MIN_SUPPORT`` known instances or more and ``MIN_CONFIDENCE`` are kept.
3. An unknown instance is taken up when its patterns say so: one minus the product of their doubts reaches
   ``MIN_SCORE``, and it looks like the kind. It is then known wherever it occurs, and the next round may learn new patterns from it.

Rounds go on until nothing new is found; each but the last adds instances of a finite table. Counts of pattern-instance edges are aggregated in Spark
(combined on the map side, so a context that occurs everywhere is no hot key); only the narrow table of possible
identifiers is read again, never the texts. Every base span stays; learned spans never overlap a base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.llm.shared import attach, free_name, map_batches
from tagwright.storage import store

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
MIN_SCORE = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile("[@0-9]")
_NUMBERS = re.compile(r"(?<![^\s\"'\[{<:;,=])[(+]?[0-9][0-9().+/-]*(?:[\x20\t]+[(]?[0-9][0-9().+/-]*)+(?![^\s\"'.,;:!?\]}>])")
_HEX = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:])")
_AT_DOT = re.compile(r"[A-Za-z0-9._%+-]+[\x20\t]+[(\[]?at[)\]]?[\x20\t]+[A-Za-z0-9-]+(?:[\x20\t]+[(\[]?dot[)\]]?[\x20\t]+[A-Za-z0-9-]+)+", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = "\"'.,;:!?()[]{}<>"
_CONTEXT = 200  # characters in which the words around an instance are looked for


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each ``@`` in linear time."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            last = domain.end()
            yield "email", start, last
        at = text.find("@", max(at + 1, last))


def _marked_words(text: str) -> Iterator[tuple[int, int]]:
    """Words with an ``@`` or five digits and more, without punctuation at their edges."""
    mark = _MARK.search(text)
    last = 0
    while mark:
        start = mark.start()
        while start > last and not _SPACE.match(text[start - 1]):
            start -= 1
        space = _SPACE.search(text, mark.start())
        last = space.start() if space else len(text)
        word = text[start:last]
        if "@" in word or len(_DIGIT.findall(word)) >= 5:
            bare = word.lstrip(_EDGES)
            start = last - len(bare)
            bare = bare.rstrip(_EDGES)
            if bare:
                yield start, start + len(bare)
        mark = _MARK.search(text, last)


def _wider(text: str) -> Iterator[tuple[int, int]]:
    """Possible identifiers of several words, and short ones with colons."""
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            words = [(m.start() + w.start(), m.start() + w.end()) for w in _WORD.finditer(m[0])]
            words[-1] = (words[-1][0], words[-1][0] + len(text[slice(*words[-1])].rstrip("().+/-")) or 1)
            fits = lambda a, b: any(_fits(k, text[a:b]) for k in ("card", "phone"))
            begin, end = words[0][0], words[-1][1]
            if fits(begin, end):
                yield begin, end
            elif len(_DIGIT.findall(m[0])) > 19:
                yield from [(begin, b) for _, b in words[1:20] if fits(begin, b)][-1:]
                yield from [(a, end) for a, _ in words[-20:-1] if fits(a, end)][:1]
    if text.count(":") > 1:
        yield from (m.span() for m in _HEX.finditer(text) if _fits("ip", m[0]))
    if " dot" in text.lower() or "dot)" in text.lower() or "dot]" in text.lower():
        yield from _spelled(text)


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Spans of ``name at host dot com``, looked for from each ``at`` so that long words cost linear time."""
    for m in re.finditer(r"(?<=[\x20\t])[(\[]?at[)\]]?[\x20\t]", text, re.I):
        name_end = len(text[max(0, m.start() - _CONTEXT):m.start()].rstrip(" \t")) + max(0, m.start() - _CONTEXT)
        start = name_end
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        found = _AT_DOT.match(text, start) if start < name_end else None
        if found:
            yield found.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans ``(kind, start, end)`` in code points, by kind as listed, then by start."""
    out = []
    out += _emails(text)
    if not _DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3
                                                                              for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _fits(kind: str, instance: str) -> bool:
    """Could the instance be an identifier of the kind, in another form than the base pattern's?"""
    digits = len(_DIGIT.findall(instance))
    if kind == "email":
        return "@" in instance[1:-1] or bool(_AT_DOT.fullmatch(instance))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9a-fA-F]{1,4}([.:][0-9a-fA-F]{0,4}){3,8}", instance)) or (
            "::" in instance and bool(re.search("[0-9a-fA-F]", instance)) and bool(_HEX.fullmatch(instance)))
    if kind == "card":
        return 12 <= digits <= 19 and bool(re.fullmatch(r"[0-9\x20\t-]+", instance))
    return 7 <= digits <= 15 and bool(re.fullmatch(r"[0-9().+/\x20\t-]+", instance))


def _patterns(text: str, start: int, end: int) -> list[str]:
    low = text.rfind("\n", max(0, start - _CONTEXT), start) + 1 or max(0, start - _CONTEXT)
    before = _WORD.findall(text[low:start].lower())[-2:]
    behind = _WORD.findall(text[end:end + _CONTEXT].split("\n", 1)[0].lower())[:2]
    after = [a for a in behind[:1] if not _DIGIT.search(a)]
    out = [f"{before[0]} {before[1]} _"] if len(before) == 2 else []
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if low == 0 or text[low - 1] == "\n":  # the line begins here
        if len(before) == 1:
            out.append(f"^ {before[0]} _")
        elif not before and behind:
            out.append(" ".join(["^ _", *behind, *["$"] * (2 - len(behind))]))
    return [p for p in out if not _DIGIT.search(p)]


def _found(docs: DataFrame) -> DataFrame:
    """Base spans and other possible identifiers: ``key``, ``row``, ``kind`` (null: unknown), ``start``, ``end``,
    ``instance``, ``patterns``, ``fits`` (kinds an unknown one could be of); one row without a span per text keeps every document in the table."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for key, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            text = text.as_py() or ""
            spans = base_spans(text)
            rows.append((key, row, None, None, None, None, [], _listed(spans), *[sum(s[0] == k for s in spans) for k in KINDS], None))
            none = (None,) * 6
            rows += [(key, row, k, a, b, text[a:b], _patterns(text, a, b), *none) for k, a, b in spans]
            for a, b in sorted({*_marked_words(text), *_wider(text)}):
                fits = [k for k in KINDS if _fits(k, text[a:b])]
                if fits and not any(s < b and a < e for _, s, e in spans):
                    rows.append((key, row, None, a, b, text[a:b], _patterns(text, a, b), *none[1:], fits))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(),
                 *[pa.int64()] * 4, pa.list_(pa.string())]
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _COLUMNS)

    return map_batches(docs, work, _SCHEMA)


_SCHEMA = ("key bigint, row bigint, kind string, start int, end int, instance string, patterns array<string>, base string, "
           "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, fits array<string>")
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def learn(found: DataFrame, rounds: int | None = None) -> DataFrame:
    """Instances taken up by the bootstrap: ``instance``, ``kind``; ``found`` is the stored table of possible identifiers.

    It ends when a round adds nothing, or after ``rounds`` where given.
    """
    edges = found.where("instance is not null").select(
        F.explode("patterns").alias("pattern"), "instance", "kind", "fits").distinct()
    edges = store(edges, "pii-edges")
    spark = found.sparkSession
    known = spark.createDataFrame([], "instance string, taken string")
    for _ in count() if rounds is None else range(rounds):
        now = edges.join(known, "instance", "left").select("pattern", "instance", F.coalesce("kind", "taken").alias("kind"), "fits")
        per_pattern = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k) for k in KINDS]
        counts = now.groupBy("pattern").agg(*per_pattern, F.sum(F.when(F.col("kind").isNull(), 1).otherwise(0)).alias("unknown"))
        per_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in KINDS]))
        total = F.expr(" + ".join(KINDS) + " + unknown / 2")
        rules = counts.withColumn("all", total).select("pattern", "unknown", "all", per_kind.alias("r"))
        rules = rules.where((F.col("r.n") >= MIN_SUPPORT) & (F.col("r.n") >= MIN_CONFIDENCE * F.col("all")) & (F.col("unknown") > 0))
        rules = store(rules.select("pattern", F.col("r.kind").alias("said"), (F.col("r.n") / F.col("all")).alias("trust")), "pii-rules")
        hits = attach(now.where("kind is null").select("pattern", "instance", "fits"), rules, ["pattern"], "inner")
        hits = hits.where(F.array_contains("fits", F.col("said")))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))
        scored = hits.groupBy("instance", "said").agg((1 - doubt).alias("score")).where(F.col("score") >= MIN_SCORE)
        best = scored.groupBy("instance").agg(F.max(F.struct("score", "said")).alias("b"))
        new = store(best.select("instance", F.col("b.said").alias("taken")), "pii-new")
        if new.isEmpty():
            break
        known = store(known.unionByName(new), "pii-known")
    return known.withColumnRenamed("taken", "kind")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base`` and ``spans`` of every row.

    ``base`` lists the base spans, ``spans`` base and learned ones, each ``kind:start:end`` in code points, comma-joined
    by kind and start. Null and empty texts have none; texts of any length are searched whole. Rows that repeat a key and
    a text give a row each with the same spans, rows with a null key like others. An empty table gives no rows. Other columns
    are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))
    found = store(_found(rows), "pii-found")
    extra = store(_learned(found), "pii-extra")
    whole = attach(found.where("base is not null"), extra, ["row"], "left")

    def join(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [_listed(_merged(b, e)) for b, e in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:6], pa.array(out, pa.string())],
            ["key", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    whole = whole.select("key", "n_email", "n_ip", "n_card", "n_phone", "base", "extra")
    return map_batches(whole, join, "key bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                                    "base string, spans string").withColumnRenamed("key", key)


def _learned(found: DataFrame) -> DataFrame:
    """Learned spans per text: ``row``, ``extra`` (comma-joined)."""
    known = store(learn(found).withColumnRenamed("kind", "taken"), "pii-taken")
    hits = attach(found.where("kind is null and instance is not null"), known, ["instance"], "inner")
    span = F.concat_ws(":", "taken", "start", "end")
    return hits.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set(span)), ",").alias("extra"))


def _merged(base: str, extra: str | None) -> list[tuple[str, int, int]]:
    parts = [x.split(":") for x in f"{base},{extra or ''}".split(",") if x]
    return sorted(((k, int(a), int(b)) for k, a, b in parts), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redactions(docs: DataFrame, text: str = "text") -> DataFrame:
    """How texts with personal data are cut: ``row`` (a hash of the text), ``cuts`` (``begin`` and ``length`` of what stays before a
    span, in code points, and the span's ``tag``) and ``rest``, where what stays behind the last one begins."""
    found = _found(docs.select(F.lit(0).cast("bigint").alias("key"), _text_row(text).alias("row"), F.col(text).alias("text")))
    found = store(found, "pii-found")
    extra = store(_learned(found), "pii-extra")
    whole = attach(found.where("base is not null").groupBy("row").agg(F.first("base").alias("base")), extra, ["row"], "left")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cuts, rests = [], []
        for base, extra in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            last, own = 0, []
            for kind, a, b in sorted(_merged(base, extra), key=lambda s: (s[1], -s[2])):
                if a >= last:
                    own.append({"begin": last, "length": a - last, "tag": f"[{kind}]"})
                last = max(last, b)
            cuts.append(own)
            rests.append(last)
        kind = pa.list_(pa.struct({"begin": pa.int32(), "length": pa.int32(), "tag": pa.string()}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts, kind), pa.array(rests, pa.int32())], ["row", "cuts", "rest"])

    return map_batches(whole.where("base != '' or extra is not null").select("row", "base", "extra"), cut,
                       "row bigint, cuts array<struct<begin int, length int, tag string>>, rest int")


def apply_redactions(docs: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its texts cut as stored ``redactions`` say; all other texts and columns stay as they are."""
    row, cuts, rest = (free_name(docs, c) for c in ("row", "cuts", "rest"))
    named = rows.withColumnsRenamed({"row": row, "cuts": cuts, "rest": rest})
    out = attach(docs.withColumn(row, _text_row(text)), named, [row], "left")
    stays = F.transform(cuts, lambda c: F.concat(F.substring(F.col(text), c["begin"] + 1, c["length"]), c["tag"]))
    tail = F.substring(F.col(text), F.col(rest) + 1, F.length(text))
    done = F.when(F.col(rest).isNull(), F.col(text)).otherwise(F.concat(F.array_join(stays, ""), tail))
    return out.withColumn(text, done).select(*docs.columns)


def _text_row(text: str) -> Column:
    return F.xxhash64(F.lit(0), text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one.

    Other columns stay as they are; a null text stays null, an empty table empty.
    """
    return apply_redactions(docs, store(redactions(docs, text), "pii-cuts"), text)
