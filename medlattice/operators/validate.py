"""Validation of staging relations: every finding is a row, nothing stops the job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, content_tokens

#: Admitted statuses and reasons.
NORMALIZATION = ("COMPLETE", "NEEDS_REVIEW", "IGNORED", "FAILED")
VALIDATION = ("PENDING", "VALID", "INVALID")
REASONS = ("missing_product_name", "missing_batch_number", "nsq_without_batch", "ambiguous_organization", "ambiguous_product", "invalid_date_format", "unparseable_row", "duplicate_fingerprint", "excluded_document_type", "")
UNIQUE = {"normalization_manifest": "source_record_id", "regulatory_events": "event_key", "organizations": "organization_key", "products": "product_key", "batches": "batch_key"}
REFERENCES = (
    ("regulatory_events", "product_key", "products", "product_key"), ("regulatory_events", "manufacturer_organization_key", "organizations", "organization_key"), ("regulatory_events", "reporting_organization_key", "organizations", "organization_key"),
    ("regulatory_events", "batch_key", "batches", "batch_key"), ("batches", "product_key", "products", "product_key"), ("batches", "organization_key", "organizations", "organization_key"), ("product_organizations", "product_key", "products", "product_key"), ("product_organizations", "organization_key", "organizations", "organization_key"),
)


def _finding(df: DataFrame, check: str, relation: str, key: Column, detail: Column | str = "") -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), F.lit(relation).alias("relation"), key.cast("string").alias("key"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that several rows have; blank keys don't count."""
    return df.filter(blank(F.col(key)) != "").groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose key is given but has no parent."""
    return child.filter(blank(F.col(fk)) != "").join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def reconciliation(manifest: DataFrame) -> DataFrame:
    """One row: all records, each status, and whether the statuses add up."""
    counts = [F.count_if(F.col("normalization_status") == s).alias(s.lower()) for s in NORMALIZATION]
    r = manifest.agg(F.count(F.lit(1)).alias("total"), *counts)
    return r.withColumn("balanced", F.col("total") == sum((F.col(s.lower()) for s in NORMALIZATION[1:]), F.col("complete")))


def raw_problems(raw: DataFrame) -> DataFrame:
    """Blank fields, repeated ids and texts that are no JSON object or array."""
    parts = [_finding(raw.filter(F.trim(blank(F.col(c))) == ""), "empty", "raw_source_records", F.col("source_record_id"), c) for c in ("source_record_id", "source_document_id", "source_location", "source_text", "raw_json")]
    parts.append(_finding(duplicates(raw, "source_record_id"), "duplicate", "raw_source_records", F.col("key"), "source_record_id"))
    parsed = F.try_parse_json(F.col("raw_json"))
    odd = F.when(parsed.isNull(), "invalid").when(~F.trim(F.col("raw_json")).rlike("^[\\[{]"), "neither object nor array")
    parts.append(_finding(raw.withColumn("_odd", odd).filter("_odd is not null"), "json", "raw_source_records", F.col("source_record_id"), F.col("_odd")))
    return reduce(DataFrame.unionByName, parts)


def lineage_problems(events: DataFrame, raw: DataFrame) -> DataFrame:
    """Events without a raw record, and reasons none of whose words stand in it."""
    r = raw.select(F.col("source_record_id").alias("_id"), F.col("source_text").alias("_text"))
    joined = events.join(r, F.col("source_record_id") == F.col("_id"), "left")
    absent = (blank(F.col("reason")) != "") & ~F.arrays_overlap(content_tokens(F.col("reason")), content_tokens(F.col("_text")))
    what = F.when(F.col("_id").isNull(), "missing raw source").when(absent, "reason is absent from source_text")
    return _finding(joined.withColumn("_what", what).filter("_what is not null"), "lineage", "regulatory_events", F.col("event_key"), F.col("_what"))


def problems(relations: dict[str, DataFrame]) -> DataFrame:
    """All findings: (check_name, relation, key, detail)."""
    m = relations["normalization_manifest"]
    parts = [raw_problems(relations["raw_source_records"]), lineage_problems(relations["regulatory_events"], relations["raw_source_records"])]
    for column, allowed in (("normalization_status", NORMALIZATION), ("validation_status", VALIDATION), ("review_reason", REASONS)):
        parts.append(_finding(m.filter(~blank(F.col(column)).isin(*allowed)), "vocabulary", "normalization_manifest", F.col("source_record_id"), column))
    parts += [_finding(duplicates(relations[t], k), "duplicate", t, F.col("key"), k) for t, k in UNIQUE.items()]
    parts += [_finding(orphans(relations[c], fk, relations[p], pk), "orphan", c, F.col(fk), fk) for c, fk, p, pk in REFERENCES]
    return reduce(DataFrame.unionByName, parts)


def validated(relations: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The relations with each document's manifest rows VALID, or INVALID if any check fails."""
    bad = problems(relations).limit(1).count() > 0
    m = relations["normalization_manifest"].withColumn("validation_status", F.lit("INVALID" if bad else "VALID"))
    return relations | {"normalization_manifest": m}
