"""Safety assessment of products from their regulatory events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from .search import holds

#: Vocabularies and templates of the assessment.
SCOPES = ("BATCH", "PRODUCT", "INGREDIENT", "COMBINATION")
UNCERTAIN = ("UNKNOWN", "QUASHED", "STAYED", "REVOKED_WITH_CONDITIONS")
RESTRICTED = ("PROHIBITED", "RESTRICTED")
CONCERN_TYPES = ("QUALITY_FAILURE", "QUALITY_ALERT", "INVESTIGATION", "CAUTION", "SPURIOUS", "NSQ", "COUNTERFEIT", "RECALL", "WARNING")
CONCERN_STATUSES = ("NOT_OF_STANDARD_QUALITY", "SPURIOUS", "NSQ", "UNDER_INVESTIGATION", "CAUTION", "RECALLED", "WARNING")
SUMMARIES = {
    "NO_MATCHING_ALERT": "No matching regulatory alert was found for this medicine in the available records. This does not guarantee that the medicine is safe.",
    "UNCLEAR_EVENT_SCOPE": "A regulatory record was found, but its applicable scope is unclear. Review the official source record before drawing a conclusion.",
    "UNCLEAR_LEGAL_STATUS": "A regulatory record was found, but the available legal status does not support a reliable current conclusion. Review the official source record.",
    "UNSUPPORTED_LEGAL_RESTRICTION": "A legal restriction is recorded, but its supporting source is unavailable. Review the official record before drawing a conclusion.",
    "INSUFFICIENT_REGULATORY_EVIDENCE": "A regulatory record was found, but its meaning does not establish a safety conclusion. Review the official source record.",
}
INDICATORS = {"NO_MATCHING_ALERT": "GREEN", "LEGAL_RESTRICTION": "RED", "BATCH_QUALITY_ALERT": "YELLOW", "REGULATORY_CONCERN": "YELLOW"}


def _in(c: Column, values) -> Column:
    return F.coalesce(F.upper(c).isin(*values), F.lit(False))


def relevant(events: DataFrame, batch_number: str | None) -> DataFrame:
    """With a batch asked for: events of batches that hold it, and those of no batch unless of batch scope."""
    if not batch_number:
        return events
    return events.filter(F.when(F.col("batch_number").isNotNull(), holds(F.col("batch_number"), batch_number)).otherwise(F.upper(blank(F.col("scope"))) != "BATCH"))


def assessed(products: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """products(id) with indicator, template_id and summary.

    events(product_id, event_type, scope, status, legal_status, reason,
    batch_number, document_id); ``order`` says which event comes first. Each
    product's events are reduced to flags and two first events in one pass.
    """
    restricted = _in(F.col("legal_status"), RESTRICTED)
    concern = _in(F.col("event_type"), CONCERN_TYPES) | _in(F.col("status"), CONCERN_STATUSES)
    sourced = F.col("document_id").isNotNull()
    first = lambda cond: F.min(F.when(cond, F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "scope", "legal_status", "reason", "batch_number", "event_type", "status")))
    made = events.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.max(~_in(F.col("scope"), SCOPES)).alias("bad_scope"), F.max(_in(F.col("legal_status"), UNCERTAIN)).alias("uncertain"),
        F.max(restricted & ~sourced).alias("unsupported"), first(restricted & sourced).alias("restriction"), first(concern).alias("concern"),
    )
    c, r = F.col("concern"), F.col("restriction")
    quality = (F.lower(c["scope"]) == "batch") & (_in(c["event_type"], ("QUALITY_FAILURE", "QUALITY_ALERT")) | _in(c["status"], ("NOT_OF_STANDARD_QUALITY",)))
    template = (
        F.when(F.col("n_events").isNull(), "NO_MATCHING_ALERT").when(F.col("bad_scope"), "UNCLEAR_EVENT_SCOPE").when(F.col("uncertain"), "UNCLEAR_LEGAL_STATUS").when(F.col("unsupported"), "UNSUPPORTED_LEGAL_RESTRICTION")
        .when(r.isNotNull(), "LEGAL_RESTRICTION").when(c.isNull(), "INSUFFICIENT_REGULATORY_EVIDENCE").when(quality, "BATCH_QUALITY_ALERT").otherwise("REGULATORY_CONCERN")
    )
    batch = lambda e: F.when(blank(e["batch_number"]) != "", F.concat(F.lit(" for batch "), e["batch_number"])).otherwise("")
    why = F.when(blank(c["reason"]) != "", F.concat(F.lit(" Reason recorded: "), c["reason"], F.lit("."))).otherwise("")
    pairs = [F.lit(x) for kv in SUMMARIES.items() for x in kv]
    t = F.col("template_id")
    summary = (
        F.when(t == "LEGAL_RESTRICTION", F.concat(F.lit("An applicable "), F.lower(r["scope"]), F.lit("-level legal "), F.lower(r["legal_status"]), F.lit(" is recorded"), batch(r), F.lit(". Review the official source record for details.")))
        .when(t.isin("BATCH_QUALITY_ALERT", "REGULATORY_CONCERN"), F.concat(F.lit("A "), F.lower(c["scope"]), F.lit("-level regulatory concern is recorded"), batch(c), F.lit("."), why, F.lit(" Review the official source record for details.")))
        .otherwise(F.try_element_at(F.create_map(*pairs), t))
    )
    shown = [F.lit(x) for kv in INDICATORS.items() for x in kv]
    out = products.join(made, products["id"] == made["product_id"], "left").withColumn("template_id", template)
    return out.select(*[products[c] for c in products.columns], F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce(F.try_element_at(F.create_map(*shown), t), F.lit("UNKNOWN")).alias("indicator"), "template_id", summary.alias("summary"))


def scan_verdict(indicator: Column) -> Column:
    """struct(status, title): only a red match is unsafe, nothing is ever called safe."""
    red = F.coalesce(indicator == "RED", F.lit(False))
    return F.struct(F.when(red, "unsafe").otherwise("unknown").alias("status"), F.when(red, "Regulatory restriction found").when(indicator.isNull(), "No matching product").when(indicator == "YELLOW", "Regulatory concern recorded").otherwise("Not verified").alias("title"))


def source_references(events: DataFrame) -> DataFrame:
    """(product_id, references): distinct documents and records behind a product's events, in order."""
    return events.filter("document_id is not null").select("product_id", "document_id", "source_record_id").distinct().groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("document_id", "source_record_id"))).alias("references"))


def joined_strengths(ingredients: DataFrame) -> DataFrame:
    """(product_id, strength): a product's distinct ingredient strengths, by name of the ingredient."""
    first = ingredients.filter("coalesce(strength_text, '') <> ''").groupBy("product_id", "strength_text").agg(F.min("name").alias("name"))
    return first.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "strength_text"))), lambda x: x["strength_text"]), ", ").alias("strength"))


def matched_by(name: str, product: Column, brand: Column, ingredient: Column, strength: Column) -> Column:
    """Labels of what a name's words match, each once, in order."""
    labels = [F.when(holds(c, token), label) for token in name.split() for label, c in (("product_name", product), ("brand_name", brand), ("ingredient", ingredient), ("strength", strength))]
    return F.array_distinct(F.array_compact(F.array(*labels)))


def manufacturer(product_organizations: DataFrame, organizations: DataFrame) -> DataFrame:
    """(product_id, manufacturer): the maker with the smallest id."""
    made = product_organizations.filter("role = 'MANUFACTURER'").groupBy("product_id").agg(F.min("organization_id").alias("organization_id"))
    return made.join(organizations, made["organization_id"] == organizations["id"]).select("product_id", F.col("name").alias("manufacturer"))
