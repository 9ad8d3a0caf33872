"""An inverted index of trigrams for fuzzy search of names.

Every distinct name has one posting for each of its trigrams; postings are
sorted by trigram, so a search reads the row groups of its own trigrams. A name
within the limit shares at least ``needed`` of the query's trigrams, and so at
least one of any ``size - needed + 1`` of them: the rarest are looked up, which
leaves out the long lists of common trigrams and loses no name. Only the names
found that way, without the products' other columns, go through Python.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import grams, trigram_containment, word_similarity_of


class NameIndex(NamedTuple):
    """names(name_id, name), postings(gram, name_id) by gram, and owners(id, name_id)."""

    names: DataFrame
    postings: DataFrame
    owners: DataFrame


def build(products: DataFrame, columns: list[str], stored: Callable[[str, Callable[[], DataFrame]], DataFrame]) -> NameIndex:
    """The index of some columns of products(id, ...). ``stored(name, build)`` writes a table once and reads it."""
    each = products.select("id", F.explode(F.array(*columns)).alias("name")).filter("name is not null")
    names = stored("names", lambda: each.select("name").distinct().withColumn("name_id", F.monotonically_increasing_id()))
    listed = lambda: names.select("name_id", F.explode(grams(F.col("name"))).alias("gram")).repartitionByRange("gram").sortWithinPartitions("gram")
    owners = stored("owners", lambda: each.join(names, "name").select("id", "name_id").distinct())
    return NameIndex(names, stored("postings", listed), owners)


def candidates(index: NameIndex, query: str, limit: float) -> DataFrame:
    """names(name_id, name) that may be as similar as the limit to the query: all that are, and few others."""
    spark = index.names.sparkSession
    asked = spark.range(1).select(grams(F.lit(query)).alias("g")).first()["g"]
    own = index.postings.filter(F.col("gram").isin(asked))
    frequency = {r["gram"]: r["n"] for r in own.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a trigram of the query
    needed = max(1, ceil(limit * len(asked) - 1e-9))
    rare = sorted(asked, key=lambda g: (frequency.get(g, 0), g))[: max(0, len(asked) - needed + 1)]
    found = index.postings.filter(F.col("gram").isin([g for g in rare if g in frequency])).select("name_id").distinct()
    return index.names.join(found, "name_id").filter(trigram_containment(F.lit(query), F.col("name")) >= limit)


def _similar(names: DataFrame, key: str, query: str, limit: float) -> DataFrame:
    """(key, similarity) of names(key, name) at the limit or over it."""

    def run(frames):
        for f in frames:
            out = pd.DataFrame({key: f[key], "similarity": [word_similarity_of(query, n) for n in f["name"]]})
            yield out[out["similarity"] >= limit]

    return names.select(key, "name").mapInPandas(run, f"{key} {names.schema[key].dataType.simpleString()}, similarity double")


def similarities(index: NameIndex, query: str, limit: float) -> DataFrame:
    """(id, similarity): the best of each product's names, where it reaches the limit."""
    near = _similar(candidates(index, query, limit), "name_id", query, limit)
    return near.join(index.owners, "name_id").groupBy("id").agg(F.max("similarity").alias("similarity"))


def scanned(products: DataFrame, columns: list[str], query: str, limit: float) -> DataFrame:
    """``similarities`` without an index: all names are compared by their trigrams, and those that may reach the limit in Python."""
    each = products.select("id", F.explode(F.array_distinct(F.array(*columns))).alias("name")).filter("name is not null")
    near = _similar(each.filter(trigram_containment(F.lit(query), F.col("name")) >= limit), "id", query, limit)
    return near.groupBy("id").agg(F.max("similarity").alias("similarity"))
