"""Token ids of texts, by word, for tokenizers that drop white space.

``word_bpe_49k`` and its like cut at white space and never look across it, so a text's ids are those of its words in a
row. Words recur, so their ids are kept in a bounded cache per worker; a text is then a join of byte strings. Words of
plain Latin letters with trailing punctuation go to the merge model directly, all others through the whole tokenizer.
"""

from __future__ import annotations

import re

import numpy as np

CACHE_WORDS = 2**17  # entries per cache and worker (some 50 MB in all); beyond that, words are encoded anew

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"([{_LETTERS}]+)([!-&(-/:;=>?@\\[-`{{-~]*)")  # no apostrophe, which may start a suffix, and no "<"
_CASED = re.compile("[A-ZÀ-ÖØ-Þ]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of texts as little-endian bytes of ``width`` bytes per id."""

    def __init__(self, path: str, end_id: int | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        largest = max(self.whole.get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
        self.width = 2 if largest < 2**16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.end = b"" if end_id is None else np.array([end_id], dtype=self.dtype).tobytes()
        self.packed = [i.to_bytes(self.width, "little") for i in range(largest + 1)]
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.table = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.stems.get(piece)
        if found is None:
            mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
            packed = self.packed
            found = b"".join([packed[t.id] for t in self.model.tokenize(mapped)])
            if len(self.stems) < CACHE_WORDS:
                self.stems[piece] = found
        return found

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        plain = _PLAIN.fullmatch(word)
        if not plain:
            return self._pack(self.whole.encode(word, add_special_tokens=False).ids)
        stem, tail = plain.groups()
        out = self._piece(stem.lower() if _CASED.search(stem) else stem)
        return out + self._piece(tail) if tail else out

    def encode(self, text: str | None) -> bytes:
        """The text's ids and the end id; a null text counts as empty."""
        known, new = self.words.get, self._new
        return b"".join([known(w) or new(w) for w in (text or "").encode().split()]) + self.end

    def _new(self, raw: bytes) -> bytes:
        ids = self._word(raw)
        if len(self.words) < CACHE_WORDS:
            self.words[raw] = ids
        return ids


_MADE: dict[tuple, object] = {}


def word_tokenizer(path: str, end_id: int | None = None) -> WordTokenizer:
    """One tokenizer per worker process, so its caches live on between tasks."""
    key = (path, end_id)
    if key not in _MADE:
        _MADE[key] = WordTokenizer(path, end_id)
    return _MADE[key]


def byte_pairs(path: str, pattern: str):
    """A byte-level encoder from a file of ranks, one per worker process; ``encode_ordinary`` gives a text's ids."""
    key = (path, pattern)
    if key not in _MADE:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _MADE[key] = tiktoken.Encoding("byte_pairs", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _MADE[key]
