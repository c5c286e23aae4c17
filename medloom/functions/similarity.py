"""String similarity as Column expressions; sequence matchers, which need a scan with state, as Arrow UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of each word, padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared 3-grams over all 3-grams; 0 where both are empty."""
    x, y = trigrams(a), trigrams(b)
    return jaccard(x, y)


def jaccard(x: Column, y: Column) -> Column:
    shared = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - shared
    return F.when(every == 0, 0.0).otherwise(shared / every)


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda t: t != "")), " ")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: the row of the dynamic programme is folded over the letters."""
    letters = lambda s: F.filter(F.split(s, ""), lambda c: c != "")

    def next_row(row: Column, x: Column) -> Column:
        def cell(acc: Column, z: Column) -> Column:
            j = F.size(acc)
            best = F.when(z == x, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, -1)))
            return F.array_append(acc, best)

        return F.aggregate(letters(b), F.array(F.lit(0)), cell)

    start = F.transform(F.sequence(F.lit(0), F.length(b)), lambda i: F.lit(0))
    return F.element_at(F.aggregate(letters(a), start, next_row), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (m + n); 100 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * common_subsequence(a, b) / total)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def _indel(a: str, b: str) -> float:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The best indel ratio of the shorter text against windows of the longer one; null where either is null."""

    def best(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        short, long = sorted((x, y), key=len)
        if not short:
            return 100.0 if not long else 0.0
        # Windows that hang over either end count too.
        return max(_indel(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))

    return pd.Series([best(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks (Ratcliff and Obershelp); null where either is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])
