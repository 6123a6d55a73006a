"""Quality rules with thresholds that follow the corpus.

Every text gets fixed base counts and three measures in thousandths: symbols per word character, repeated lines per
line, characters per word. For each language and source a mergeable quantile sketch holds how the measures of its base-passing documents spread:
a log-linear histogram that keeps the eight leading bits of a value (relative error below 1/128), so sketches are
summed like any count, on the map side first, and merged upwards from (language, source) to language to everything. A
document is judged, measure by measure, by the finest of the three that holds at least ``MIN_DOCS`` values. A limit lies
``SPREAD`` times the distance of the quartiles outside them and at least a stated share of the group's mean, so it moves
with the group: no fixed bound takes part, a source that writes long words or many symbols keeps its texts, and one in
which hardly anybody does so loses the few. Limits are then joined to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from tagwright.llm import words as W
from tagwright.llm.shared import attach, free_name, map_batches
from tagwright.storage import store

MIN_DOCS = 200
SPREAD = 6
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Measure:
    """A measure in thousandths, which limits it has, and how they follow from a group's sketch.

    Limits lie ``SPREAD`` interquartile ranges outside the quartiles, and at least ``floor`` quarters of the group's mean.
    With ``positive`` only documents that have any of it count for the sketch, as most have none.
    """

    name: str
    upper: bool = True
    lower: bool = False
    floor: int = 0
    positive: bool = False


MEASURES = (
    Measure("symbol_share", floor=4),
    Measure("dup_line_share", positive=True),
    Measure("word_length", lower=True, floor=1),
)

_LINES = np.ones(256, dtype=bool)
_LINES[10] = False
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def _same_as_other(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is there an equal one in its text, and does an equal one come earlier?"""
    order = np.lexsort((hashes, doc))  # stable: equal items stay in text order
    same = (doc[order][1:] == doc[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    earlier, any_other = np.zeros(len(doc), dtype=bool), np.zeros(len(doc), dtype=bool)
    earlier[order[1:]] = same
    any_other[order[1:]] = same
    any_other[order[:-1]] |= same
    return any_other, earlier


def base_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``carry``, word and line counts and ``base_failed`` of every row; a null text has no words."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high, data, offsets in W.groups(batch.column(1)):
            words = W.cut(data, offsets)
            inside = W.SPACES[data]
            chars = _per_text(inside & ((data & 0xC0) != 0x80), offsets)
            lines = W.cut(data, offsets, _LINES)
            has_word = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum(inside, out=has_word[1:])
            real = has_word[lines.ends] > has_word[lines.starts]
            line_doc = lines.doc[real]
            _, earlier = _same_as_other(line_doc, lines.hashes[real])
            grams, at = W.grams(words, 5)
            again, _ = _same_as_other(words.doc[at], grams)
            step = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            np.add.at(step, at[again], 1)
            np.add.at(step, at[again] + 5, -1)
            covered = np.cumsum(step)[:-1] > 0
            n = high - low
            counts = [words.counts, chars, _per_text(_SYMBOL[data], offsets), np.bincount(line_doc, minlength=n),
                      np.bincount(line_doc[earlier], minlength=n), _per_text(covered, words.first)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, n), *(batch.column(i + 2).slice(low, n) for i in range(len(carry))),
                 *(pa.array(c.astype(np.int64)) for c in counts)],
                ["key", *carry, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(["key bigint", *(f"{c} {kinds[c]}" for c in carry), "n_words bigint", "word_chars bigint",
                        "n_symbols bigint", "n_lines bigint", "n_dup_lines bigint", "n_repeat_words bigint"])
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *carry)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return map_batches(rows, work, schema).withColumn("base_failed", failed).withColumnRenamed("key", key)


def _measures(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.expr(f"if({b} = 0, 0, {a} * 1000 div {b})")
    return counts.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "word_length": share("word_chars", "n_words")})


def sketches(measured: DataFrame) -> DataFrame:
    """Rows ``(lang, source, measure, cell, n, s)``: number and sum of the values per histogram cell; adding up merges sketches."""
    cell = F.expr("shiftleft(shiftright(v, greatest(length(bin(v)) - 8, 0)), greatest(length(bin(v)) - 8, 0))")
    value = lambda m: F.when(F.col(m.name) > 0, F.col(m.name)) if m.positive else F.col(m.name)
    long = F.explode(F.array(*[F.struct(F.lit(m.name).alias("measure"), value(m).alias("v")) for m in MEASURES]))
    rows = measured.where("not base_failed").select("lang", "source", long.alias("m")).select("lang", "source", "m.*")
    return rows.where("v is not null").withColumn("cell", cell).groupBy("lang", "source", "measure", "cell").agg(
        F.count("*").alias("n"), F.sum("v").alias("s"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (depth, lang, source) with a low and high limit of each measure, null where fewer than ``MIN_DOCS``
    values stand behind it (not at depth 0).

    Depth 2 is a language and source, 1 a language, 0 everything. A group's histogram has at most some thousand cells.
    """
    levels = None
    for depth, keys in ((2, ("lang", "source")), (1, ("lang",)), (0, ())):
        part = sketch.select(
            F.lit(depth).alias("depth"), *[(F.col(c) if c in keys else F.lit(None).cast("string")).alias(c)
                                           for c in ("lang", "source")], "measure", "cell", "n", "s")
        levels = part if levels is None else levels.unionByName(part)
    group = ["depth", "lang", "source", "measure"]
    merged = levels.groupBy(*group, "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    upto = F.sum("n").over(Win.partitionBy(*group).orderBy("cell"))
    total = F.sum("n").over(Win.partitionBy(*group))
    ranked = merged.withColumn("upto", upto).withColumn("docs", total)
    quartiles = ranked.groupBy(*group, "docs").agg(
        F.min(F.when(F.expr("4 * upto >= docs"), F.col("cell"))).alias("q1"),
        F.min(F.when(F.expr("4 * upto >= 3 * docs"), F.col("cell"))).alias("q3"), F.sum("s").alias("s"))
    wide = []
    for m in MEASURES:
        width = f"greatest({SPREAD} * (q3 - q1), {m.floor} * s div (4 * docs))"
        for wanted, side, at in ((m.upper, "high", f"q3 + {width}"), (m.lower, "low", f"q1 - {width}")):
            if wanted:
                enough = (F.col("measure") == m.name) & ((F.col("docs") >= MIN_DOCS) | (F.col("depth") == 0))
                wide.append(F.max(F.when(enough, F.expr(at))).alias(f"{m.name}_{side}"))
    return quartiles.groupBy("depth", "lang", "source").agg(*wide)


def _limit_names() -> list[str]:
    return [f"{m.name}_{side}" for m in MEASURES for side, wanted in (("high", m.upper), ("low", m.lower)) if wanted]


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Base counts, measures, the limits that hold for the row, and ``kept``, one row per input row.

    Null languages and sources are groups of their own. A text without words fails the base rules. A measure without any
    value behind it has no limit. Texts of any length are judged whole, rows with a null key like others, repeated rows
    alike; an empty table gives no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"),
                       F.col(source).cast("string").alias("source"))
    measured = store(_measures(base_counts(rows, carry=("lang", "source"))), "quality-measures")
    names = _limit_names()
    columns = ["lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
               "base_failed", *[m.name for m in MEASURES], *names]
    out = _verdicts(measured, store(thresholds(sketches(measured)), "quality-limits"), names)
    return out.select(F.col("doc_id").alias(key), *columns, "kept")


def rejected(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``row``, a hash of text, language and source, of all rows that the rules do not keep; texts are read once."""
    rows = docs.select(_row(text, lang, source).alias("doc_id"), F.col(text).alias("text"),
                       F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"))
    measured = store(_measures(base_counts(rows, carry=("lang", "source"))), "quality-measures")
    out = _verdicts(measured, store(thresholds(sketches(measured)), "quality-limits"), _limit_names())
    return out.where("not kept").select(F.col("doc_id").alias("row")).distinct()


def without(docs: DataFrame, rows: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are not among stored ``rejected`` rows, unchanged."""
    row = free_name(docs, "row")
    return attach(docs.withColumn(row, _row(text, lang, source)), rows.withColumnRenamed("row", row), [row], "left_anti").select(
        *docs.columns)


def _row(text: str, lang: str, source: str) -> Column:
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (text, lang, source)]
    return F.xxhash64(*parts)  # null differs from empty


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    return without(docs, store(rejected(docs, text, lang, source), "quality-rejected"), text, lang, source)


def _verdicts(measured: DataFrame, limits: DataFrame, names: list[str]) -> DataFrame:
    out = measured.withColumns({"g_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")),
                                "g_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    for depth, keys in ((2, ["g_lang", "g_source"]), (1, ["g_lang"])):
        part = limits.where(f"depth = {depth}").select(
            *[F.coalesce(F.concat(F.lit("="), k[2:]), F.lit("")).alias(k) for k in keys],
            *[F.col(c).alias(f"{c}_{depth}") for c in names])
        out = attach(out, store(part, "quality-part"), keys)
    top = limits.where("depth = 0").select(*names).first()  # one row or none
    out = out.withColumns({c: F.coalesce(f"{c}_2", f"{c}_1", F.lit(top[c] if top else None).cast("bigint")) for c in names})
    good = ~F.col("base_failed")
    for m in MEASURES:
        if m.upper:
            good = good & F.coalesce(F.col(m.name) <= F.col(f"{m.name}_high"), F.lit(True))
        if m.lower:
            good = good & F.coalesce(F.col(m.name) >= F.col(f"{m.name}_low"), F.lit(True))
    return out.withColumn("kept", good)
