"""String functions and tokenisers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwright import fixed
from tagwright.functions.arrays import let


def normalise_karats(text: Column) -> Column:
    """``14 karat `` -> ``14k ``, for lowercased text."""
    return F.regexp_replace(text, fixed.KARATS, "$1k$4")


def glue_units(text: Column) -> Column:
    """``10 oz `` -> ``10oz ``, for lowercased text."""
    return F.regexp_replace(text, fixed.UNITS, "$1$2$3")


def normalise_measures(text: Column) -> Column:
    """Karats first, then units."""
    return glue_units(normalise_karats(text))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def brand_tokens(text: Column) -> Column:
    """Maximal runs of brand characters, in order."""
    return extract_all(text, fixed.BRAND_WORD)


def leading_two_words(text: Column) -> Column:
    """Two brand words split by one whitespace character at the very start of the text, else ``''``."""
    return F.regexp_extract(text, f"^{fixed.TWO_BRAND_WORDS}", 0)


def sliding_two_words(text: Column) -> Column:
    """Overlapping pairs of brand words, each with the whitespace character before it."""
    return extract_all(text, f"(?=([{fixed.SPACE}]{fixed.TWO_BRAND_WORDS}))", 1)


def letter_words(text: Column) -> Column:
    """``[a-z]+`` runs of the lowercased text."""
    return extract_all(F.lower(text), fixed.LETTER_WORD)


def word_tokens(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores."""
    return extract_all(text, fixed.WORD_TOKEN)


def digit_tokens(text: Column) -> Column:
    return extract_all(text.cast("string"), fixed.DIGIT_TOKEN)


def whole_value_tokens(text: Column) -> Column:
    """The value as one token per line of it; no token for an empty value."""
    return extract_all(text.cast("string"), r"[^\n]+")


def filter_char_tokens(text: Column) -> Column:
    """Lowercase, turn the listed punctuation into blanks, split on blanks."""
    blanks = " " * len(fixed.SEQUENCE_FILTERS)
    parts = F.split(F.translate(F.lower(text), fixed.SEQUENCE_FILTERS, blanks), " ")
    return F.filter(parts, lambda t: t != "")


def remove_stopwords(tokens: Column, stop_words: tuple[str, ...] = fixed.STOP_WORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def _ngrams(tokens: Column, n: int) -> Column:
    """Each step puts the next token behind the grams of one token less."""
    grams = tokens
    for k in range(2, n + 1):
        left = F.greatest(F.size(tokens) - k + 1, F.lit(0))
        grams = F.zip_with(F.slice(grams, 1, left), F.slice(tokens, k, left), lambda g, t: F.concat(g, F.lit(" "), t))
    return grams


def word_ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams for ``low <= n <= high`` joined by a blank, shorter ones first."""
    return let(tokens, lambda t: F.concat(*[_ngrams(t, n) for n in range(low, high + 1)]))


def delete_variants(word: Column, k: int = 1) -> Column:
    """All strings left after removing 1..k characters, never down to nothing. Grows as length**k: keep k <= 2."""

    def one_less(w: Column) -> Column:
        cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.length(w) > 1)
        return F.transform(cuts, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    def rounds(level: Column, left: int) -> Column:
        if left == 1:
            return level
        deeper = lambda found: F.array_distinct(F.flatten(F.transform(found, one_less)))
        return let(level, lambda found: F.array_distinct(F.concat(found, rounds(deeper(found), left - 1))))

    return rounds(F.array_distinct(one_less(word)), k)
