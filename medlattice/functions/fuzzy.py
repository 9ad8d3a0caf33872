"""Similarities that Spark lacks, over Arrow batches; the trigram one also as an expression."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank

#: What both sides of a similarity take for a word: runs of letters and digits of any script.
WORD = "[\\p{L}\\p{N}]+"


def trigrams(word: str) -> set[str]:
    return {f"  {word} "[i : i + 3] for i in range(len(word) + 1)}


def word_similarity_of(query: str, target: str) -> float:
    """Greatest share of the query's trigrams that a run of the target's trigrams holds."""
    import re

    ordered = lambda t: [g for w in re.findall(r"[^\W_]+", t.lower()) for g in (f"  {w} "[i : i + 3] for i in range(len(w) + 1))]
    want, have = set(ordered(query)), ordered(target)
    if not want or not have:
        return 0.0
    best, hits = 0.0, [i for i, g in enumerate(have) if g in want]
    for k, start in enumerate(hits):
        seen: set[str] = set()
        extra: set[str] = set()
        for end in hits[k:]:
            for g in have[start : end + 1]:
                (seen if g in want else extra).add(g)
            start = end + 1
            best = max(best, len(seen) / (len(want) + len(extra)))
    return best


def indel_ratio_of(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_sort_ratio_of(a: str, b: str) -> float:
    return indel_ratio_of(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _pairwise(function):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())


word_similarity = _pairwise(word_similarity_of)
indel_ratio = _pairwise(indel_ratio_of)
token_sort_ratio = _pairwise(token_sort_ratio_of)
sequence_ratio = _pairwise(lambda a, b: SequenceMatcher(None, a, b).ratio())


def grams(c: Column) -> Column:
    """Distinct trigrams of a text's words, each with two spaces before and one behind."""
    words = F.regexp_extract_all(F.lower(blank(c)), F.lit(WORD), 0)
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams of both texts' words, in the JVM."""
    x, y = grams(a), grams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def trigram_containment(query: Column, target: Column) -> Column:
    """Share of the query's distinct trigrams that the target has: an upper bound of its word similarity."""
    x = grams(query)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, grams(target))) / F.size(x)).otherwise(0.0)
