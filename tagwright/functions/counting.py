"""Words of texts, cut and counted by Arrow and numpy for a batch of rows at once, as entries of a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwright import fixed

ENTRIES = "array<struct<block:string,feature:string,value:double>>"
_BYTES = 2**22  # of text, worked on at a time
_BETWEEN = f"[^{fixed.WORD}]+"


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows ``low, high`` whose sizes add up to about ``limit``; a larger row is a run of its own."""
    part = np.cumsum(sizes) // limit
    cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(sizes)]
    return zip(cuts[:-1], cuts[1:])


def text_runs(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for low, high in runs(sizes, _BYTES):
        yield texts.slice(low, high - low)


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``text.word_tokens`` and the row of each; a null text has none."""
    lists = pc.split_pattern_regex(texts.fill_null(""), pattern=_BETWEEN)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    words = lists.flatten()
    long = pc.greater_equal(pc.utf8_length(words), 2)
    return words.filter(long), row[long.to_numpy(zero_copy_only=False)]


def row_lists(rows: pa.Array, row: np.ndarray, **columns: pa.Array) -> pa.Array:
    """Structs, given with their ascending row, as a list per row; null where ``rows`` is."""
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(columns.values()), list(columns)), mask=rows.is_null())


def joined(parts: list[pa.Array], rows: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if len(rows) else pa.array([], kind)


def constant(value: str, count: int) -> pa.Array:
    return pa.repeat(pa.scalar(value), count)


def each_once(texts: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``work`` on every different text of a batch, its results given to all rows that have the text; null for null."""
    coded = texts.dictionary_encode()
    return work(texts) if len(coded.dictionary) == len(texts) else work(coded.dictionary).take(coded.indices)


def word_entries(block: str, texts: Column) -> Column:
    """How often each word of two or more letters, digits or underscores is in the text; ``text.word_tokens``, counted."""

    def work(texts: pa.Array) -> pa.Array:
        out = []
        for mine in text_runs(texts):
            words, row = cut_words(mine)
            coded = words.dictionary_encode()
            size = max(len(coded.dictionary), 1)
            key, times = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(key, size)
            out.append(row_lists(mine, row, block=constant(block, len(row)), feature=coded.dictionary.take(pa.array(code)),
                                 value=pa.array(times.astype(np.float64))))
        kind = pa.list_(pa.struct([("block", pa.string()), ("feature", pa.string()), ("value", pa.float64())]))
        return joined(out, texts, kind)

    @F.arrow_udf(ENTRIES)
    def count(texts: pa.Array) -> pa.Array:
        return each_once(texts, work)

    return count(texts)
