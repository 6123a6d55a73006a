"""Approximate dictionary lookup: words within a small edit distance, found by joining on delete variants.

Both sides are made distinct first. A delete key is then shared only by the different words that lie within ``k``
letters of it, a number set by word length and alphabet and not by how often a word occurs in the data.

Delete variants grow as length**k. Long words under larger ``k`` are found by segments instead: a word is cut into
``2k + 1`` pieces, and as an edit touches at most two of them (a swap across a cut), one piece at least stands unchanged in any
word within ``k`` edits, moved by ``k`` places at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagwright.functions.edit_distance import edit_distance
from tagwright.functions.text import delete_variants


def _with_deletes(words: DataFrame, column: str, k: int) -> DataFrame:
    """Each word under itself and under its delete variants."""
    keys = F.array(column) if k == 0 else F.concat(F.array(column), delete_variants(F.col(column), k))
    return words.select(column, F.explode(keys).alias("key"))


SEGMENT = 3  # least letters of a segment; words too short for that are found by delete variants


def _segments(length: str, k: int) -> tuple[str, str]:
    """Start (from 0) and size of segment ``i`` of a word, as SQL; the last ones are a letter longer."""
    m = 2 * k + 1
    plain = f"({length} div {m})"
    return (f"(i * {plain} + greatest(0, i - ({m} - {length} % {m})))",
            f"({plain} + if(i >= {m} - {length} % {m}, 1, 0))")


def segment_pairs(queries: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """Distinct candidates ``(query, word)`` among which are all pairs within ``k`` edits."""
    short = SEGMENT * (2 * k + 1) - 1
    near = lambda df, c: df.where(F.length(c) <= short + k)  # noqa: E731  a pair with a short word has no other
    pairs = _with_deletes(near(queries, "query"), "query", k).join(
        _with_deletes(near(words.select("word"), "word"), "word", k), "key").select("query", "word")
    pieces = f"sequence(0, {2 * k})"
    start, size = _segments("length(word)", k)
    index = words.where(F.length("word") > short).select("word", F.explode(F.expr(
        f"transform({pieces}, i -> struct(length(word) as length, i as i, substring(word, {start} + 1, {size}) as piece))")).alias("s"))
    start, size = _segments("l", k)
    probes = F.expr(f"""
        filter(flatten(transform(sequence(greatest({short + 1}, length(query) - {k}), length(query) + {k}), l ->
          flatten(transform({pieces}, i -> transform(sequence(-{k}, {k}), s ->
            struct(l as length, i as i, {start} + s as at, {size} as size)))))),
          p -> p.at >= 0 and p.at + p.size <= length(query))""")
    probe = queries.where(F.length("query") + k > short).select("query", F.explode(probes).alias("p")).select(
        "query", "p.length", "p.i", F.expr("substring(query, p.at + 1, p.size)").alias("piece")).distinct()
    long = probe.join(index.select("word", "s.*"), ["length", "i", "piece"]).select("query", "word")
    return pairs.unionByName(long).distinct()


def score_pairs(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Add the edit distance ``dist`` of ``query`` and ``word``; with ``k``, keep pairs within it.

    A swap of neighbours costs two plain edits, so pairs whose plain distance exceeds ``2k`` are dropped inside the JVM
    and never reach Python.
    """
    if k is not None:
        pairs = pairs.where(F.levenshtein("query", "word", 2 * k) >= 0)
    scored = pairs.withColumn("dist", edit_distance(F.col("query"), F.col("word")))
    return scored if k is None else scored.where(F.col("dist") <= k)


def suggestions(
    queries: DataFrame, words: DataFrame, k: int, keep: str = "closest", segments: bool | None = None
) -> DataFrame:
    """``(query, word, dist, cnt)``: dictionary words within edit distance ``k`` of each distinct query.

    ``segments`` says how they are found; by default delete variants up to ``k`` = 2 and segments beyond.

    ``queries`` has a column ``query``; ``words`` has ``word`` (unique) and ``cnt``. ``closest`` keeps the words at the
    least distance of their query (an exact hit stands alone), ``all`` keeps every word within ``k``.
    """
    if keep not in ("closest", "all"):
        raise ValueError(keep)
    queries = queries.select("query").where("query <> ''").distinct()
    if k == 0:
        found = queries.withColumn("word", F.col("query")).join(words, "word").withColumn("dist", F.lit(0))
        return found.select("query", "word", "dist", "cnt")
    exact = queries.join(words, F.col("query") == F.col("word"), "left").select(
        "query", F.col("word").isNotNull().alias("known"))
    open_queries = exact.where(~F.col("known")).select("query") if keep == "closest" else queries
    if k > 2 if segments is None else segments:
        pairs = segment_pairs(open_queries, words, k)
    else:
        pairs = (
            _with_deletes(open_queries, "query", k)
            .join(_with_deletes(words.select("word"), "word", k), "key")
            .select("query", "word").distinct()
        )
    near = score_pairs(pairs, k)
    if keep == "closest":
        least = F.min("dist").over(W.partitionBy("query"))
        near = near.withColumn("_least", least).where(F.col("dist") == F.col("_least")).drop("_least")
        hits = exact.where("known").select("query", F.col("query").alias("word"), F.lit(0).alias("dist"))
        near = near.unionByName(hits)
    return near.join(words, "word").select("query", "word", "dist", "cnt")


def ranked_suggestions(found: DataFrame) -> DataFrame:
    """Order the suggestions of each query: least distance, highest count, then word."""
    order = W.partitionBy("query").orderBy("dist", F.desc("cnt"), "word")
    return found.withColumn("place", F.row_number().over(order))


def best_word(queries: DataFrame, found: DataFrame) -> DataFrame:
    """``(query, word)``: the best suggestion per distinct query, null where there is none."""
    best = found.groupBy("query").agg(F.min_by("word", F.struct("dist", -F.col("cnt"), "word")).alias("word"))
    return queries.select("query").distinct().join(best, "query", "left")
