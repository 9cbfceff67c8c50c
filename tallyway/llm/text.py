"""Words and word shingles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyway.llm.tables import let

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words of the whole text, in order. Null and blank texts have none."""
    return F.array_remove(F.split(whole(text), GAP), "")


def stripped_of(text: Column, pattern: str) -> Column:
    """Code points of ``text`` outside the matches of ``pattern``."""
    return F.length(F.regexp_replace(text, pattern, ""))


def window_hashes(hashes: Column, n: int) -> Column:
    """A 64-bit hash for each run of ``n`` neighbours in an array of word hashes; empty if it is shorter."""
    return F.when(
        F.size(hashes) >= n,
        F.transform(
            F.sequence(F.lit(0), F.size(hashes) - n),
            lambda i: F.xxhash64(*[hashes[i + k] for k in range(n)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def word_hashes(word_array: Column) -> Column:
    return F.transform(word_array, lambda w: F.xxhash64(w))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct hashes of the runs of ``n`` words of the whole text."""
    return let(word_hashes(words(text)), lambda h: F.array_distinct(window_hashes(h, n)))
