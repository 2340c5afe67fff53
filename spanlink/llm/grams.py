"""Native word-gram expressions shared by the scanning operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_keys(words: Column) -> Column:
    """64-bit hash of each word, so that a gram hashes k longs and no strings."""
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_keys(keys: Column, k: int) -> Column:
    """Hashes of all rolling k-grams, in order; empty when there are fewer than k words."""
    starts = F.when(F.size(keys) >= k, F.sequence(F.lit(1), F.size(keys) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(keys, i, k)))


def gram_texts(words: Column, k: int) -> Column:
    """All rolling k-grams as text, words joined by one space."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))
