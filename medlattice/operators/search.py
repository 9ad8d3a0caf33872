"""Ranked product search: exact, partial and fuzzy matches over products and what belongs to them."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank, compact
from . import trigrams

FUZZY_LIMIT, DEFAULT_LIMIT, MAX_LIMIT = 0.55, 50, 100
NAMES = ["product_name", "brand_name", "normalized_search_name"]


def holds(c: Column, term: str) -> Column:
    """Whether the text contains the term in any case; false for null."""
    return F.contains(F.lower(blank(c)), F.lit(term.lower()))


def equals(c: Column, term: str) -> Column:
    return F.coalesce(F.lower(c) == F.lit(term.lower()), F.lit(False))


def _any(conds: list[Column]) -> Column:
    return reduce(or_, conds)


def _flags(products: DataFrame, children: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """products with one boolean for each flag: whether any of its children has it.

    Children are reduced to one row of flags a product before they are joined,
    so their number never multiplies products.
    """
    made = children.groupBy("product_id").agg(*[F.max(c).alias(n) for n, c in flags.items()])
    joined = products.join(made, products["id"] == made["product_id"], "left")
    return joined.select(*[products[c] for c in products.columns], *[F.coalesce(F.col(n), F.lit(False)).alias(n) for n in flags])


def scored(products: DataFrame, organizations: DataFrame, ingredients: DataFrame, batches: DataFrame, fields: dict[str, str], fuzzy: bool = True, index: trigrams.NameIndex | None = None) -> DataFrame:
    """Products that match all ``fields`` with ``relevance`` and ``match_type``.

    organizations(product_id, name, normalized_name), ingredients(product_id,
    name, normalized_name, strength_text) and batches(product_id, batch_number)
    are only read where a field needs them. Fields: name, manufacturer,
    ingredient, strength, dosage_form, batch_number. A fuzzy search looks names
    up in the ``index`` of NAMES, or compares all of them without one.
    """
    f = {k: v for k, v in fields.items() if v and v.strip()}
    p, keep, exact, partial, exact_name = products, [], [], [], []
    own = products.columns
    names = NAMES
    similarity = None
    wanted: dict[str, Column] = {}
    if "name" in f:
        name = " ".join(f["name"].lower().split())
        for i, token in enumerate(name.split()):
            wanted[f"_t{i}"] = holds(F.col("name"), token) | holds(F.col("normalized_name"), token) | holds(F.col("strength_text"), token)
        wanted["_named"] = equals(F.col("name"), name) | equals(F.col("normalized_name"), name)
    tokens = f.get("ingredient", "").split()
    for i, token in enumerate(tokens):
        wanted[f"_i{i}"] = holds(F.col("name"), token) | holds(F.col("normalized_name"), token)
        wanted[f"_e{i}"] = equals(F.col("name"), token) | equals(F.col("normalized_name"), token)
    if "strength" in f:
        tight = "".join(f["strength"].lower().split())
        wanted |= {"_s": holds(F.col("strength_text"), f["strength"]), "_sc": F.contains(compact(F.col("strength_text")), F.lit(tight)), "_se": F.lower(blank(F.col("strength_text"))) == f["strength"].lower()}
    if wanted:
        p = _flags(p, ingredients, wanted)
    if "manufacturer" in f:
        m = f["manufacturer"]
        p = _flags(p, organizations, {"_m": holds(F.col("name"), m) | holds(F.col("normalized_name"), m), "_me": equals(F.col("name"), m)})
        keep.append(F.col("_m"))
        exact.append(F.col("_me"))
        partial.append(F.col("_m"))
    if "batch_number" in f:
        b = f["batch_number"]
        p = _flags(p, batches, {"_b": holds(F.col("batch_number"), b), "_be": equals(F.col("batch_number"), b)})
        keep.append(F.col("_b"))
        exact.append(F.col("_be"))
        partial.append(F.col("_b"))
    if "name" in f:
        per_token = [_any([holds(F.col(c), t) for c in names] + [F.contains(compact(F.col("product_name")), F.lit(t)), F.col(f"_t{i}")]) for i, t in enumerate(name.split())]
        hit = reduce(and_, per_token)
        if fuzzy:
            near = trigrams.scanned(products, NAMES, name, FUZZY_LIMIT) if index is None else trigrams.similarities(index, name, FUZZY_LIMIT)
            near = near.select(F.col("id").alias("_near_id"), F.col("similarity").alias("_near"))
            p = p.withColumn("_hit", hit).join(near, F.col("id") == F.col("_near_id"), "left").withColumn("_similarity", F.coalesce("_near", F.lit(0.0)))
            similarity, hit = F.col("_similarity"), F.col("_hit")
        keep.append(hit if similarity is None else hit | (similarity >= FUZZY_LIMIT))
        exact_name = [_any([equals(F.col(c), name) for c in names] + [compact(F.col("normalized_search_name")) == name.replace(" ", "")]), F.col("_named")]
        exact += exact_name
        partial += [_any([F.startswith(F.lower(blank(F.col(c))), F.lit(name)) for c in names]), _any([holds(F.col(c), name) for c in names])]
    if "dosage_form" in f:
        d = f["dosage_form"]
        keep.append(holds(F.col("dosage_form"), d))
        exact.append(equals(F.col("dosage_form"), d))
        partial.append(holds(F.col("dosage_form"), d))
    if tokens:
        every = lambda k: reduce(and_, [F.col(f"_{k}{i}") for i in range(len(tokens))])
        keep.append(every("i"))
        exact.append(every("e"))
        partial.append(every("i"))
    if "strength" in f:
        s = f["strength"]
        keep.append(holds(F.col("strength"), s) | F.contains(compact(F.col("strength")), F.lit(tight)) | F.col("_s") | F.col("_sc"))
        exact.append((F.lower(blank(F.col("strength"))) == s.lower()) | F.col("_se"))
        partial.append(holds(F.col("strength"), s) | F.col("_s"))
    never = F.lit(False)
    is_exact, is_partial, is_named = (_any(x) if x else never for x in (exact, partial, exact_name))
    is_fuzzy = never if similarity is None else similarity >= FUZZY_LIMIT
    rank = F.lit(60.0) if similarity is None else F.round(60 + similarity * 20)
    relevance = F.when(is_named, 100).when(is_exact, 95).when(is_partial, 80).when(is_fuzzy, rank).otherwise(60).cast("int")
    match = F.when(is_exact, "EXACT").when(is_partial, "PARTIAL").when(is_fuzzy, "FUZZY").otherwise("PARTIAL")
    found = p.filter(reduce(and_, keep)) if keep else p.filter(never)
    return found.select(*own, relevance.alias("relevance"), match.alias("match_type"))


def top(matches: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The best ``limit`` matches with ``has_more``; one row beyond the limit tells it."""
    limit = max(1, min(limit, MAX_LIMIT))
    order = [F.desc("relevance"), F.asc("product_name"), F.asc("id")]
    some = matches.orderBy(*order).limit(limit + 1)
    # a window over these few rows counts them, so that the search is planned once
    counted = some.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    return counted.orderBy(*order).limit(limit).withColumn("has_more", F.col("_n") > limit).drop("_n")
