"""Reports: metrics, inventories, reconciliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank, words
from .runs import positions


def category_metrics(rows: DataFrame, category: str, counts: dict[str, Column]) -> DataFrame:
    """Counts by category with a TOTAL row."""
    return rows.rollup(category).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(c).alias(n) for n, c in counts.items()]).withColumn(category, F.coalesce(category, F.lit("TOTAL"))).withColumnRenamed(category, "category")


def alias_candidates(rows: DataFrame, normalized: str, raw: str) -> DataFrame:
    """Normalized names that several raw names share."""
    names = F.collect_set(F.nullif(F.col(raw), F.lit("")))
    return rows.filter(blank(F.col(normalized)) != "").groupBy(F.col(normalized).alias("normalized_name")).agg(names.alias("n")).filter(F.size("n") > 1).select("normalized_name", F.size("n").cast("long").alias("raw_name_count"), F.array_join(F.array_sort("n"), " | ").alias("raw_names"))


def part_rollup(parts: DataFrame, doc: str, kind: str, rank: str, usable: str, partial: str, flag: Column) -> DataFrame:
    """Counts, best label, kinds and smallest rank among usable parts of each document."""
    is_usable = F.col(kind) == usable
    return parts.groupBy(doc).agg(
        F.count_if(is_usable).alias("usable"), F.when(F.bool_or(is_usable), "Usable").when(F.bool_or(F.col(kind) == partial), "Partial").otherwise("Unusable").alias("label"),
        F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), F.min(F.when(is_usable, F.col(rank))).alias("best"), F.bool_or(flag).alias("flagged"),
    )


def schema_inventory(tables: DataFrame, variants: int = 3) -> DataFrame:
    """Table schemas by signature with counts, their commonest variants and an id by rank.

    tables(signature, document, n_rows, variant). Signatures are ranked in
    buckets of equal counts and first letters, so not all in one task.
    """
    g = tables.groupBy("signature").agg(F.count(F.lit(1)).alias("tables"), F.countDistinct("document").alias("documents"), F.sum("n_rows").cast("long").alias("total_rows"), F.max("n_rows").cast("long").alias("max_rows"))
    v = tables.groupBy("signature", "variant").agg(F.count(F.lit(1)).alias("n"))
    v = v.withColumn("r", F.row_number().over(Window.partitionBy("signature").orderBy(F.desc("n"), "variant"))).filter(F.col("r") <= variants)
    v = v.groupBy("signature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "variant"))), lambda x: x["variant"]), " | ").alias("variants"))
    fewer = lambda c: F.lpad((F.lit(10**18) - F.coalesce(c, F.lit(0))).cast("string"), 19, "0")
    bucket = F.concat(fewer(F.col("documents")), fewer(F.col("total_rows")), F.substring(F.coalesce("signature", F.lit("")), 1, 2))
    ranked = positions(g.join(v, "signature"), bucket, [F.desc("documents"), F.desc("total_rows"), F.col("signature")], "_rank")
    return ranked.select(F.format_string("T%03d", "_rank").alias("schema_id"), "signature", "tables", "documents", "total_rows", "max_rows", "variants")


def extraction_quality(blocks: DataFrame, doc: str, block: str, chars: int = 200, good: int = 2) -> DataFrame:
    """Characters and good blocks (20 characters or more, upper-case first) of each document."""
    fine = (F.length(block) >= 20) & F.col(block).rlike("^[A-Z]")
    g = blocks.groupBy(doc).agg(F.sum(F.length(block)).alias("chars"), F.count_if(fine).alias("good"))
    return g.withColumn("quality", F.when((F.col("chars") >= chars) & (F.col("good") >= good), "GOOD").otherwise("POOR"))


def page_mix(pages: DataFrame, doc: str, is_text: Column, is_image: Column) -> DataFrame:
    g = pages.groupBy(doc).agg(F.count_if(is_text).alias("t"), F.count_if(is_image).alias("i"))
    t, i = F.col("t") > 0, F.col("i") > 0
    return g.select(doc, F.when(t & i, "mixed").when(t, "text").when(i, "image").otherwise("empty").alias("kind"))


def reconciled(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): equal, mismatch, left only or right only."""
    a, b = left.select(key, F.col(value).alias("_a"), F.lit(True).alias("_l")), right.select(key, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    state = F.when(F.col("_r").isNull(), "left only").when(F.col("_l").isNull(), "right only").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("mismatch")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def merged(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, audit): the right value where there is one; what either side lacks is said."""
    a, b = left.select(key, F.col(value).alias("_a"), F.lit(True).alias("_l")), right.select(key, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    audit = F.when(F.col("_r").isNull(), "left only").when(F.col("_l").isNull(), "right only").otherwise("merged")
    return a.join(b, key, "full_outer").select(key, F.coalesce("_b", "_a").alias(value), audit.alias("audit"))


def phrase_archetypes(docs: DataFrame, phrases: DataFrame, ratio: float = 0.7, least: int = 2) -> DataFrame:
    """(doc_id, archetype): the archetype most of whose phrase groups stand in the text.

    phrases(archetype, grp, phrase) is a dictionary; it is joined through word
    runs of the phrases' lengths, not pair by pair.
    """
    p = phrases.select("archetype", "grp", words(F.col("phrase")).alias("phrase"))
    sizes = sorted(r[0] for r in p.select(F.size(F.split("phrase", " "))).distinct().collect())  # lengths of phrases
    w = F.split(words(F.col("text")), " ")

    def runs_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(F.col("w")) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(n)), " "))

    runs = F.flatten(F.array(*[runs_of(n) for n in sizes]))
    grams = docs.select("doc_id", w.alias("w")).select("doc_id", F.explode(F.array_distinct(runs)).alias("phrase"))
    total = p.groupBy("archetype").agg(F.countDistinct("grp").alias("groups"))
    hit = grams.join(p, "phrase").groupBy("doc_id", "archetype").agg(F.countDistinct("grp").alias("hits")).join(total, "archetype")
    good = hit.withColumn("ratio", F.col("hits") / F.col("groups")).filter((F.col("hits") >= least) & (F.col("ratio") >= ratio))
    return good.groupBy("doc_id").agg(F.max_by("archetype", F.struct("ratio", "hits", "archetype")).alias("archetype"))


def ingest_totals(results: DataFrame) -> DataFrame:
    """(relation, rows, documents, failures) over results(document, relation, n, failed) of all documents."""
    return results.groupBy("relation").agg(F.sum("n").cast("long").alias("rows"), F.count(F.lit(1)).alias("documents"), F.count_if("failed").alias("failures"))
