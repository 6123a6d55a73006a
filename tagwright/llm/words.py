"""Words, hashes and n-grams of many texts at once, over the bytes of an Arrow batch.

All functions work on UTF-8 bytes with numpy, so a batch of documents is cut and hashed without a Python loop over its
words. Hashes are 64-bit and depend only on the bytes, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2**18  # texts are worked on in groups of about this size; a longer text forms a group of its own

_BYTE_FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_WORD_FACTOR = 0xD6E8FEB86659FD93
_U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (xor-shift and multiply, twice)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _powers(factor: int, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    have = cache.get(factor)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), factor, dtype=_U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * CHUNK_BYTES:
            cache[factor] = have
    return have[:n]


_VALUES = mix(np.arange(1, 257, dtype=_U64) * _U64(_BYTE_FACTOR))
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]  # A-Z hash like a-z

SPACES = np.ones(256, dtype=bool)  # words are runs of anything but ASCII white space
SPACES[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, dtype=bool)  # words are runs of ASCII letters, digits and all non-ASCII bytes
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


@dataclass
class Words:
    """Words of a group of texts: ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs ``(low, high, bytes, offsets)``; a null text counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, where, content = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def cut(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACES, fold: bool = False) -> Words:
    """Find the words of a group of texts and hash each of them; ``fold`` hashes A-Z like a-z."""
    n = len(data)
    word = inside[data]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[offsets[offsets < n]] = False
    after[offsets[offsets > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(starts, offsets)
    sums = np.zeros(n + 1, dtype=_U64)
    np.cumsum((_FOLDED if fold else _VALUES)[data] * _powers(_BYTE_FACTOR, n), out=sums[1:])
    inverse = _powers(pow(_BYTE_FACTOR, -1, 2**64), n)
    hashes = (sums[ends] - sums[starts]) * inverse[starts] if n else np.zeros(0, dtype=_U64)
    return Words(data, starts, ends, first, mix(hashes + (ends - starts).astype(_U64)))


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside one text, and the index of each run's first word."""
    total = len(words.hashes)
    if total < k:
        return np.zeros(0, dtype=_U64), np.zeros(0, dtype=np.int64)
    sums = np.zeros(total + 1, dtype=_U64)
    np.cumsum(words.hashes * _powers(_WORD_FACTOR, total), out=sums[1:])
    out = (sums[k:] - sums[:-k]) * _powers(pow(_WORD_FACTOR, -1, 2**64), total)[:total - k + 1]
    last = np.repeat(words.first[1:], words.counts)  # end of the text that holds the word
    at = np.flatnonzero(np.arange(total - k + 1) + k <= last[:total - k + 1])
    return mix(out[at] + _U64(k)), at


def bounds(sorted_groups: np.ndarray, n: int) -> np.ndarray:
    """Where each of the groups ``0..n`` starts in an ascending array of group numbers."""
    return np.searchsorted(sorted_groups, np.arange(n + 1))


def longs(values: np.ndarray) -> pa.Array:
    """Hashes as signed 64-bit integers, as Spark holds them."""
    return pa.array(values.view(np.int64) if values.dtype == _U64 else values.astype(np.int64))
