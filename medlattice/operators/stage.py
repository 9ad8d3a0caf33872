"""The ten staging relations of resolved records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import nested
from ..functions.text import blank, canonical

ROLES = {"MANUFACTURER": "maker", "IMPORTER": "importer", "APPLICANT": "applicant", "MARKETING_AUTHORIZATION_HOLDER": "holder"}

#: What ``staging`` reads of resolved records; the raw values and parts that these come from need not be stored.
COLUMNS = [
    "source_organization", "source_document_id", "filename", "document_title", "publication_date", "reporting_period", "source_url", "file_hash", "document_type", "position", "record", "source_record_id", "page_number",
    "source_location", "extraction_method", "source_text", "maker", "reporter", "importer", "applicant", "holder", "maker_key", "reporter_key", "importer_key", "applicant_key", "holder_key", "state", "country", "product_key",
    "product_name", "brand_name", "dosage_form", "strength", "product_category", "ingredients", "batch_key", "batch_number", "manufacturing_date", "expiry_date", "event_key", "event_type", "scope", "act", "day", "status", "reason",
    "legal_status", "raw_event_type", "review",
]

#: What the keys of the relations are made of: all that a dry run reads.
KEY_COLUMNS = ["source_organization", "source_document_id", "position", "source_record_id", "maker_key", "reporter_key", "importer_key", "applicant_key", "holder_key", "product_key", "ingredients", "batch_key", "event_key"]


def keyed(rows: DataFrame) -> DataFrame:
    """rows(KEY_COLUMNS) in the shape of resolved records, all else null: enough to count what is new by its key."""
    pair = "struct<name:string,address:string>"
    kinds = {"record": "map<string,string>", "page_number": "int", "maker": pair, "reporter": pair, "importer": pair, "applicant": pair, "holder": pair, "act": "struct<action:string,source:string>", "day": "struct<day:string,source:string>", "review": "struct<status:string,reason:string>"}
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def given(rows: DataFrame, key: str, *columns: Column | str) -> DataFrame:
    """columns of the rows that have the key.

    Each row passes as a list of its own: Spark moves a plain filter below the
    projections that make the key and works their expressions out again for it.
    """
    return rows.select(F.explode(F.array(F.struct(*columns))).alias("r")).select("r.*").filter(F.col(key).isNotNull())


def first_of(df: DataFrame, key: list[str], order: list, last: bool = False) -> DataFrame:
    """One row for each key: the first in the order, or the last."""
    o = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*key).orderBy(*[c.desc() if last else c.asc() for c in o])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def staging(resolved: DataFrame, lean: bool = False) -> dict[str, DataFrame]:
    """All ten relations as projections of one DataFrame; cache it or write it first.

    Organizations, products and batches keep a key's first row, ingredients its
    last, bridges are sets. The lean profile keeps the last row of organizations
    and products and all rows of batches and bridges.
    """
    d = resolved
    order = ["source_document_id", "position"]
    e = lambda c: blank(F.col(c) if isinstance(c, str) else c)
    org = lambda role, rank, norm: F.when(F.col(f"{role}_key").isNotNull(), F.struct(F.lit(rank).alias("rank"), F.col(f"{role}_key").alias("organization_key"), F.col(f"{role}.name").alias("organization_name"), norm(F.col(f"{role}.name")).alias("normalized_name"), F.col(f"{role}.address").alias("address")))
    named = F.array(*[org(role, rank, norm) for rank, (role, norm) in enumerate([("maker", canonical), ("reporter", canonical), ("importer", F.lower), ("applicant", F.lower), ("holder", F.lower)])])
    orgs = d.select(*order, F.explode(named).alias("o"), "state", "country").filter("o is not null").select(*order, "o.*", "state", "country")  # all roles in one pass
    products = given(d, "product_key", *order, "product_key", "product_name", canonical(F.col("product_name")).alias("normalized_name"), "brand_name", "dosage_form", "strength", "product_category")
    items = given(d, "product_key", *order, "product_key", "ingredients").select(*order, "product_key", F.posexplode("ingredients").alias("nth", "i"))
    ingredients = items.select(*order, "nth", F.col("i.ingredient_key").alias("ingredient_key"), F.col("i.name").alias("ingredient_name"), F.lower("i.name").alias("normalized_name"), F.col("i.cas_number").alias("cas_number"))
    roles = F.array(*[F.struct("product_key", F.col(f"{c}_key").alias("organization_key"), F.lit(r).alias("role")) for r, c in ROLES.items()])
    bridges = d.select(F.explode(roles).alias("r")).select("r.*").filter("product_key is not null and organization_key is not null")
    batches = given(d, "batch_key", *order, "batch_key", "product_key", e("maker_key").alias("organization_key"), "batch_number", "manufacturing_date", "expiry_date")
    extra = nested.with_provenance(F.col("record"), F.when(F.col("raw_event_type") != "", "EXTRACTED").otherwise("INFERRED"), F.col("day.source"), F.col("act.source"))
    keep = lambda df, key: first_of(df, [key], order + [c for c in ("rank", "nth") if c in df.columns], last=lean).drop(*order, "rank", "nth")
    return {
        "regulatory_documents": d.select("source_organization", "source_document_id", "filename", "document_title", "publication_date", "reporting_period", "source_url", "file_hash", "document_type").distinct(),
        "raw_source_records": d.select("source_document_id", "source_record_id", "page_number", "source_location", "extraction_method", "source_text", F.to_json("record").alias("raw_json")),
        "organizations": keep(orgs, "organization_key"),
        "ingredients": first_of(ingredients, ["ingredient_key"], [*order, "nth"], last=True).drop(*order, "nth"),
        "products": keep(products, "product_key"),
        "product_ingredients": items.select("product_key", F.col("i.ingredient_key").alias("ingredient_key"), F.col("i.strength").alias("ingredient_strength")).distinct(),
        "product_organizations": bridges if lean else bridges.distinct(),
        "batches": batches.drop(*order) if lean else keep(batches, "batch_key"),
        "regulatory_events": d.select("event_key", "source_document_id", "source_record_id", "event_type", e("day.day").alias("event_date"), "scope", e("product_key").alias("product_key"), e("batch_key").alias("batch_key"), e("maker_key").alias("manufacturer_organization_key"), e("reporter_key").alias("reporting_organization_key"), "status", "reason", F.col("act.action").alias("action"), "legal_status", extra.alias("additional_data")),
        "normalization_manifest": d.select("source_record_id", "source_document_id", F.col("filename").alias("source_file"), F.col("page_number").alias("source_page"), F.col("source_location").alias("source_row"), F.col("document_type").alias("source_document_type"), e("maker_key").alias("organization_key"), e("product_key").alias("product_key"), e("batch_key").alias("batch_key"), "event_key", F.col("review.status").alias("normalization_status"), F.lit("PENDING").alias("validation_status"), e("review.reason").alias("review_reason"), F.lit("").alias("error_message")),
    }


def write(relations: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Each relation to its own folder; CSV has a header and is all text."""
    for name, df in relations.items():
        out = df if kind == "parquet" else df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
        out.write.mode("overwrite").format(kind).option("header", True).save(f"{folder}/{name}")


def read_csv(spark, path: str) -> DataFrame:
    """A staging CSV, all text, trimmed, empty texts null; a path without files gives no rows."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path, inferSchema=False)
    name = lambda c: c.removeprefix("﻿")
    trimmed: list[Column] = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(name(c)) for c in df.columns]
    return df.select(*trimmed)
