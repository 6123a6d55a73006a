"""Records of delimited files with line breaks inside quotes, read by many tasks per file.

A quote opens only at the start of a field, so whether a line ends inside quotes depends on where the line before ended,
and a task that starts in the middle of a file cannot know. Every split is therefore read twice. First each task finds
for its split both answers: the state at its end if it starts outside quotes, and if it starts inside. From these (a row per
split) the state at the start of every split follows in order. Then each task cuts its lines into records; the ends
of a record that runs over several splits are put together by the split it starts in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagwright.operators.lookup import BROADCAST_BYTES, measured_bytes
from tagwright.storage import store


def ends_inside(line: str, inside: bool, sep: str = "\t", quote: str = '"') -> bool:
    """Whether a line, started inside or outside quotes, ends inside them; a doubled quote stands for one."""
    if quote not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if not line.startswith(quote, at):  # an unquoted field, whatever quotes it holds
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at += 1
        while True:  # to the closing quote
            at = line.find(quote, at)
            if at < 0:
                return True
            if not line.startswith(quote, at + 1):
                break
            at += 2
        inside = False
        at = line.find(sep, at) + 1  # what stands between the closing quote and the separator belongs to the field
        if not at:
            return False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], tuple]]:
    """Lines of the same split that follow each other: split, lines, and the other columns of the split."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in batch.schema.names]
        low = 0
        for high in range(1, batch.num_rows + 1):
            if high == batch.num_rows or (columns[1][high], columns[2][high]) != (columns[1][low], columns[2][low]):
                yield (columns[1][low], columns[2][low]), columns[0][low:high], tuple(c[low] for c in columns[3:])
                low = high


def _outlines(sep: str, quote: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}
        for split, lines, _ in _runs(batches):
            state = seen.setdefault(split, [False, True, False])  # end if outside, end if inside, a record starts if inside
            for line in lines:
                state[2] |= not state[1]
                state[0], state[1] = ends_inside(line, state[0], sep, quote), ends_inside(line, state[1], sep, quote)
        rows = [(*split, *state) for split, state in seen.items()]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("file", "block", "outside", "inside", "opens"), r)) for r in rows],
            pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_()), ("opens", pa.bool_())]))

    return run


def _starts(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """Stored ``(file, block, start, owner)``: does a split start inside quotes, and in which split began the record it starts in."""
    splits = store(lines.mapInArrow(_outlines(sep, quote), "file string, block bigint, outside boolean, inside boolean, opens boolean"),
                   "quoted-splits")
    order = W.partitionBy("file").orderBy("block")  # a row per split
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    fixed = F.when(F.col("outside") == F.col("inside"), F.col("outside").cast("int"))
    turns = F.when(F.col("outside") & ~F.col("inside"), 1).otherwise(0)
    rows = splits.withColumns({"fixed": fixed, "turns": F.sum(turns).over(upto)})
    last = lambda c: F.last(c, ignorenulls=True).over(before)
    start = F.coalesce(last(F.col("fixed")), F.lit(0)) + F.coalesce(last(F.col("turns")), F.lit(0)) - F.coalesce(
        last(F.when(F.col("fixed").isNotNull(), F.col("turns"))), F.lit(0))
    rows = rows.withColumn("start", start % 2 == 1)
    owner = F.last(F.when(~F.col("start") | F.col("opens"), F.col("block")), ignorenulls=True).over(before)
    return store(rows.withColumn("owner", owner).select("file", "block", "start", "owner"), "quoted-starts")


def _cut(sep: str, quote: str):
    """Whole records, and the parts of those that run over the end of a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, parts, inside, owner, first = None, [], False, None, False

        def row(whole: bool) -> dict:
            return {"file": split[0], "owner": owner, "block": split[1], "text": "\n".join(parts), "whole": whole, "header": first}

        names = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("text", pa.string()),
                           ("whole", pa.bool_()), ("header", pa.bool_())])
        for here, lines, (start, began) in _runs(batches):
            out = []
            if here != split:
                if parts:
                    out.append(row(False))
                split, parts, inside, owner, first = here, [], start, began if start else here[1], here[1] == 0
            for line in lines:
                parts.append(line)
                inside = ends_inside(line, inside, sep, quote)
                if not inside:
                    out.append(row(owner == here[1]))
                    parts, owner, first = [], here[1], False
            yield pa.RecordBatch.from_pylist(out, names)
        if parts:
            yield pa.RecordBatch.from_pylist([row(False)], names)

    return run


def read_records(spark: SparkSession, path: str, sep: str = "\t", quote: str = '"', header: bool = True) -> DataFrame:
    """The records of all files under ``path`` as one column ``record``, without the first one of each file under ``header``.

    Lines end with a line feed; a carriage return before it is dropped at the end of a record and kept inside quotes.
    Empty records go. A quote that is never closed takes in the rest of its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    starts = _starts(lines, sep, quote)
    if measured_bytes(starts) > BROADCAST_BYTES:
        raise ValueError("more splits than can be told to every task; read the files in groups")
    known = lines.join(F.broadcast(starts), ["file", "block"]).select("value", "file", "block", "start", "owner")
    cut = store(known.mapInArrow(_cut(sep, quote), "file string, owner bigint, block bigint, text string, whole boolean, header boolean"),
                "quoted-records")
    pieces = cut.where("not whole").groupBy("file", "owner").agg(  # the splits one record runs over
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"),
        F.max("header").alias("header"))
    records = cut.where("whole").select("text", "header").unionByName(pieces.select("text", "header"))
    records = records.where(~F.col("header")) if header else records
    return records.select(F.regexp_replace("text", "\r$", "").alias("record")).where("record <> ''")
