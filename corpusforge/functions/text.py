"""Tokenizers, n-grams, normalization and set similarity as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BUCKETS, LANG_NAMES

WORD_CHARS = r"[\p{L}\p{N}_]+"
SPACES = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(col) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_CHARS), F.lit(0))


def words(col, lower: bool = False) -> Column:
    """Whitespace-separated words."""
    text = F.lower(_c(col)) if lower else _c(col)
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def token_count(col) -> Column:
    return F.size(tokens(col))


def word_count(col) -> Column:
    return F.size(words(col))


def ngrams_of(items: Column, n: int) -> Column:
    """Contiguous n-grams of an array, joined by a blank, duplicates kept."""
    if n == 1:
        return items
    return bind(items, lambda x: _joined(x, n, " "))


def _joined(items: Column, n: int, blank: str) -> Column:
    size = F.greatest(F.size(items) - (n - 1), F.lit(0))
    grams = F.slice(items, F.lit(1), size)
    for i in range(1, n):
        grams = F.zip_with(
            grams, F.slice(items, F.lit(i + 1), size), lambda a, b: F.concat(a, F.lit(blank), b) if blank else F.concat(a, b)
        )
    return grams


def ngrams(col, n: int) -> Column:
    """Token n-grams of a text."""
    return ngrams_of(tokens(col), n)


def bigram_set(col) -> Column:
    """Distinct bigrams of the lower-cased words."""
    return F.array_distinct(ngrams_of(words(col, lower=True), 2))


def norm_hard(col) -> Column:
    """Lower-case and keep only ASCII letters and digits."""
    return F.regexp_replace(F.lower(_c(col)), "[^0-9a-z]", "")


def char_trigrams_of(norm: Column) -> Column:
    """Distinct trigrams of a normalized string; a shorter string is its own only member."""
    # an empty match at every place, with the three characters that follow
    return F.when(F.length(norm) >= 3, F.array_distinct(F.regexp_extract_all(norm, F.lit("(?=(...))"), F.lit(1)))) \
        .when(F.length(norm) > 0, F.array(norm)).otherwise(F.array().cast("array<string>"))


def char_trigrams(col) -> Column:
    """Distinct character trigrams of the hard-normalized text."""
    return bind(norm_hard(col), char_trigrams_of)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets held as arrays; 0.0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        common / (F.size(a) + F.size(b) - common)
    )


def jaccard_bigram(a, b) -> Column:
    return jaccard(bigram_set(a), bigram_set(b))


def jaccard_trigram(a, b) -> Column:
    x, y = char_trigrams(a), char_trigrams(b)
    common = F.size(F.array_intersect(x, y))
    return common / F.greatest(F.lit(1), F.size(x) + F.size(y) - common)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; 1.0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of Python's ``difflib``, for candidate pairs only."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return ratio(a, b)


def length_bucket_of(n: Column) -> Column:
    """Index of the length bucket; lengths beyond the last bound fall into the last bucket."""
    return F.least(F.floor(n / 10), F.lit(len(BUCKETS) - 1)).cast("int")


def length_bucket(col) -> Column:
    return length_bucket_of(token_count(col))


def parse_lid(col) -> Column:
    """Language code from a label such as ``__label__jav_Latn``."""
    raw = F.regexp_replace(_c(col), "__label__", "")
    return F.element_at(F.split(raw, "_"), 1)


def lid_text(col) -> Column:
    """Input of a language identifier: newlines to blanks, trimmed of whitespace."""
    return F.regexp_replace(F.regexp_replace(_c(col), "\n", " "), f"^{SPACES}|{SPACES}$", "")


def preview(col, n: int = 80) -> Column:
    text = _c(col)
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def reason_prefix(col, n: int = 120) -> Column:
    return F.left(_c(col), F.lit(n))


def lang_name(col) -> Column:
    pairs = [F.lit(x) for kv in LANG_NAMES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(col))
