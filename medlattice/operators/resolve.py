"""Resolution of parsed records: fields, inferred types, keys and review status (rich and lean profiles)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, keys, records, text
from ..functions.text import blank

#: Vocabularies and candidate key names.
EVENT_TYPES = ("BANNED", "PROHIBITED", "NSQ", "SPURIOUS", "ADR", "RECALL", "APPROVAL", "NOC", "IMPORT_PERMISSION", "SAFETY_ADVISORY", "SUSPENSION", "WITHDRAWAL", "UNDER_INVESTIGATION", "OTHER")
TYPE_ALIASES = {"MARKETING_APPROVAL": "APPROVAL", "NOC_GRANTED": "NOC", "SAFETY_ALERT": "SAFETY_ADVISORY", "UNDER_REVIEW": "UNDER_INVESTIGATION", "QUALITY_ALERT": "NSQ"}
SCOPES = ("BATCH", "PRODUCT", "INGREDIENT", "COMBINATION", "DOCUMENT")
CATEGORIES = ("DRUG", "MEDICAL_DEVICE", "IVD_KIT", "VACCINE", "FDC", "COSMETIC")
ACTIONS = {"BANNED": "BAN", "PROHIBITED": "PROHIBITION", "RECALL": "RECALL", "SUSPENSION": "SUSPENSION", "WITHDRAWAL": "WITHDRAWAL", "APPROVAL": "APPROVAL", "NOC": "IMPORT_PERMISSION", "ADR": "SAFETY_ALERT", "NSQ": "QUALITY_ALERT", "SPURIOUS": "QUALITY_ALERT"}
TYPE_OF_DOCUMENT = {"NSQ_STATE": "NSQ", "NSQ_CDSCO": "NSQ", "LEGACY_CDSCO": "NSQ", "BANNED_DRUGS": "BANNED", "PVPI_ADR": "ADR", "SPURIOUS": "SPURIOUS", "APPROVED_DRUGS": "APPROVAL", "MEDICAL_DEVICE": "RECALL", "NOC_IMPORT_FDC": "NOC"}
NSQ_DOCUMENTS = ("NSQ_STATE", "NSQ_CDSCO", "LEGACY_CDSCO")
PRODUCT = ["suspected drugs", "suspected drug", "suspected_drug", "suspected_drugs", "product_name", "drug_name", "drugs_name", "drug name", "drugs name", "name of drugs", "name of drug", "name of product", "product name", "brand_name", "brand name", "name of fdc", "name of vaccine", "vaccine name", "name of devices", "material name", "name of the drug", "name of the drugs"]
BRAND = ["brand_name", "brand name", "brand"]
BATCH = ["batch_number", "batch_no", "batch no", "batch number", "lot_no", "lot no", "batch", "lot", "affected batches", "b no", "model no", "model number"]
MAKER = ["manufactured_by", "manufactured by", "manufacture d by", "manufacturer", "manufacturer name", "company_name", "name of company", "name of the firm", "mfg_by"]
IMPORTER, APPLICANT = ["importer", "imported by", "name of the importer"], ["applicant", "applicant name"]
HOLDER = ["marketing authorization holder", "marketing_authorisation_holder", "marketing authorization"]
REASON = ["reason for failure", "reasons for failure", "reason for nsq", "nsq result", "sub-standard in", "reason for recall", "reason", "description", "adverse drug reactions", "indications", "intended use", "result"]
REPORTER = ["reporting_organization", "reported_by", "reported by", "reporting source", "reporting by lab/state", "drawn by", "drawn by from", "from", "lab_name", "from name of laboratory", "testing laboratory", "testing facility", "declared by"]
COMBINED = ["batch no/date of manufacture/date of expiry/manufactured by", "batch no/ date of manufacture/ date of expiry/ manufactured by", "batch no., mfg date, exp date, manufactured by", "b no d/m d/e name of the mfg & address", "batch details"]
MADE = ["manufacturing date", "mfg date", "date of manufacture", "manufacturing_date", "mfg_date"]
EXPIRES = ["expiry date", "exp date", "date of expiry", "expiry_date", "exp_date"]
NOTIFICATION = ["notification_no_and_date", "Notification No & Date", "Notification No. & Date", "Notification"]
CAS = ["cas_number", "cas number", "cas no", "cas"]
EXCLUDED = "^Doc (9|10|12|13|14|15|16):"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def document_type(source: Column, record_type: Column, declared: Column, filename: Column) -> Column:
    """Type of a document from its source, its declared type or its file name, the first that tells."""
    d, f = F.upper(blank(declared)), F.lower(blank(filename))
    has, inside = (lambda t: F.contains(d, F.lit(t))), (lambda t: F.contains(f, F.lit(t)))
    cdsco = F.lower(blank(source)) == "cdsco_nsq"
    by_declared = (
        F.when(has("NOC") | has("IMPORT") | has("FDC"), "NOC_IMPORT_FDC").when(has("BANNED"), "BANNED_DRUGS").when(has("PVPI") | has("SAFETY ALERTS") | has("PHARMACOVIGILANCE"), "PVPI_ADR").when(has("SPURIOUS"), "SPURIOUS")
        .when(has("NSQ") & has("CDSCO"), "NSQ_CDSCO").when(has("NSQ") | has("QUALITY"), "NSQ_STATE").when(has("DEVICE") | has("IVD"), "MEDICAL_DEVICE").when(has("APPROVED"), "APPROVED_DRUGS")
    )
    by_name = (
        F.when(inside("banned"), "BANNED_DRUGS").when(inside("pvpi") | inside("adr"), "PVPI_ADR").when(inside("spurious"), "SPURIOUS").when(inside("not_of_standard_quality") | inside("not of standard quality"), "NSQ_STATE")
        .when(inside("cdsco") & inside("nsq"), "NSQ_CDSCO").when(inside("nsq") | inside("drug_alert") | inside("drug alert"), "NSQ_STATE").when(inside("device") | inside("ivd"), "MEDICAL_DEVICE").when(inside("approved"), "APPROVED_DRUGS")
        .when(inside("noc") | inside("import") | inside("fdc"), "NOC_IMPORT_FDC").otherwise("UNKNOWN")
    )
    kind = F.lower(blank(record_type))
    return F.when(cdsco & (kind == "spurious"), "SPURIOUS").when(cdsco & (kind == "nsq"), "NSQ_CDSCO").otherwise(F.coalesce(F.when(d != "", by_declared), by_name))


def event_type(declared: Column, status: Column, document: Column) -> Column:
    """Explicit type, alias, words of the status, type of the document, else NSQ."""
    e, s = F.upper(blank(declared)), F.upper(blank(status))
    says = lambda t: F.contains(s, F.lit(t))
    by_status = F.when(says("SPURIOUS"), "SPURIOUS").when(says("NSQ"), "NSQ").when(says("PROHIBITED") | says("BANNED"), "BANNED").when(says("APPROVED"), "APPROVAL")
    return F.coalesce(F.when(e.isin(*EVENT_TYPES), e), _lookup(TYPE_ALIASES, e), by_status, _lookup(TYPE_OF_DOCUMENT, F.upper(blank(document))), F.lit("NSQ"))


def scope(declared: Column, raw_event_type: Column, document: Column, batch: Column, product: Column) -> Column:
    s = F.upper(blank(declared))
    batchwise = (F.upper(blank(raw_event_type)) == "NSQ") | F.upper(blank(document)).isin(*NSQ_DOCUMENTS)
    return F.when(s.isin(*SCOPES), s).when(batchwise | (blank(batch) != ""), "BATCH").when(blank(product) != "", "PRODUCT").otherwise("DOCUMENT")


def action(kind: Column, declared: Column) -> Column:
    """struct(action, source): explicit, else that of the event type."""
    given = F.trim(blank(declared))
    inferred = _lookup(ACTIONS, kind)
    return F.struct(F.coalesce(F.when(given != "", given), inferred, F.lit("")).alias("action"), F.when(given != "", "EXTRACTED").when(inferred.isNotNull(), "INFERRED").otherwise("MISSING").alias("source"))


def category(declared: Column, n_ingredients: Column) -> Column:
    c = F.upper(blank(declared))
    known = F.when(c.isin(*CATEGORIES), c).otherwise("DRUG")
    return F.when((n_ingredients > 1) & (known == "DRUG"), "FDC").otherwise(known)


def review(document: Column, product: Column, scope: Column, batch: Column, kind: Column) -> Column:
    """struct(status, reason)."""
    reason = F.when(blank(document).rlike(EXCLUDED), "excluded_document_type").when(blank(product) == "", "missing_product_name").when((scope == "BATCH") & (blank(batch) == ""), F.when(kind == "NSQ", "nsq_without_batch").otherwise("missing_batch_number"))
    return F.struct(F.when(reason == "excluded_document_type", "IGNORED").when(reason.isNotNull(), "NEEDS_REVIEW").otherwise("COMPLETE").alias("status"), reason.alias("reason"))


def event_day(own: Column, published: Column) -> Column:
    """struct(day, source): the record's date, else the document's."""
    o, p = text.filled(own), text.filled(published)
    return F.struct(F.coalesce(o, p).alias("day"), F.when(o.isNotNull(), "EXTRACTED").when(p.isNotNull(), "DOCUMENT_PUBLICATION_DATE").otherwise("MISSING").alias("source"))


def parsed_documents(files: DataFrame) -> DataFrame:
    """Headers and records of files(filename, path, content): JSON texts with a root array or object.

    A file whose text is no JSON gets ``error`` and no records, and stops nothing else.
    """
    body = F.col("content")
    root = F.substring(F.trim(blank(body)), 1, 1)
    ok = F.try_parse_json(body).isNotNull() & root.isin("{", "[")
    pick = lambda p: text.filled(F.get_json_object(body, p))
    period = dates.period_of_file(F.col("filename"))
    return files.select(
        "filename", F.when(~ok, F.concat(F.lit("not a JSON object or array: "), F.col("path"))).alias("error"),
        F.coalesce(pick("$.source_organization"), pick("$.document_metadata.issuing_authority"), F.lit("CDSCO")).alias("source_organization"),
        F.coalesce(pick("$.document_id"), pick("$.source_document_id"), F.col("filename")).alias("source_document_id"),
        F.coalesce(pick("$.document_metadata.title"), pick("$.document_title"), F.col("filename")).alias("document_title"),
        F.coalesce(pick("$.document_metadata.date_of_issue"), pick("$.publication_date"), period["day"]).alias("publication_date"),
        F.coalesce(pick("$.reporting_period"), period["label"]).alias("reporting_period"), F.coalesce(pick("$.pdf_path"), F.col("path")).alias("source_url"), F.sha2(body, 256).alias("file_hash"),
        document_type(pick("$.source"), pick("$.record_type"), F.coalesce(pick("$.document_type"), pick("$.doc_type")), F.col("filename")).alias("document_type"),
        F.when(ok, records.records_of(body)).otherwise(F.array().cast("array<map<string,string>>")).alias("records"),
    )


def _any_of(record: Column, *names: str) -> Column:
    return F.coalesce(*[text.filled(F.try_element_at(record, F.lit(n))) for n in names], F.lit(""))


#: Fields and the names that their keys may have.
FIELDS = {
    "product_raw": PRODUCT, "brand_name": BRAND, "batch_raw": BATCH, "maker_raw": MAKER, "made_raw": MADE, "expires_raw": EXPIRES, "combined": COMBINED, "note": NOTIFICATION, "reason": REASON, "reporter_raw": REPORTER,
    "importer_raw": IMPORTER, "applicant_raw": APPLICANT, "holder_raw": HOLDER, "cas_raw": CAS,
}
#: Sets of keys that are sent to all tasks; more are met by a join.
SEND_SETS = 10_000


_decisions: dict[tuple[str, str], str] = {}


def _decided(spark: SparkSession, sets: list[list[str]]) -> DataFrame:
    """(_keys, _field...): the keys of each set that answer for each field, worked out once a session."""
    told = lambda text, kind: spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))
    at = (spark.sparkContext.applicationId, json.dumps(sets))
    if at not in _decisions:
        found = told(json.dumps([{"_keys": s} for s in sets]), "_keys:array<string>").select("_keys", *[records.candidates(F.col("_keys"), names).alias(f"_{f}") for f, names in FIELDS.items()])
        _decisions[at] = json.dumps([r.asDict() for r in found.collect()])
    return told(_decisions[at], ",".join(f"{c}:array<string>" for c in ["_keys", *[f"_{f}" for f in FIELDS]]))


def with_fields(rows: DataFrame, sets: list[list[str]] | None = None) -> DataFrame:
    """rows(..., record) with all FIELDS. Which key answers for a field is decided once for each set of keys.

    Without ``sets`` one pass over the rows finds them. Who knows all sets gives
    them and spares the pass; a record whose keys are none of these is an error.
    """
    given = sets is not None
    found = None if given else rows.select(F.map_keys("record").alias("_keys")).distinct()
    some = sets if given else [r[0] for r in found.limit(SEND_SETS + 1).collect()]
    if not given and len(some) > SEND_SETS:
        known = found.select("_keys", *[records.candidates(F.col("_keys"), names).alias(f"_{f}") for f, names in FIELDS.items()])
    else:
        known = F.broadcast(_decided(rows.sparkSession, some))
    met = rows.withColumn("_keys", F.map_keys("record")).join(known, "_keys", "left" if given else "inner")
    if given:
        unknown = F.raise_error(F.concat(F.lit("unknown set of keys: "), F.to_json("_keys")))
        met = met.withColumn("record", F.when(F.col(f"_{next(iter(FIELDS))}").isNotNull(), F.col("record")).otherwise(unknown))
    return met.select(*[F.col(c) for c in rows.columns], *[records.first_filled(F.col("record"), F.col(f"_{f}")).alias(f) for f in FIELDS])


def extracted(documents: DataFrame) -> DataFrame:
    """``extracted_rows`` of documents(..., records array<map>)."""
    return extracted_rows(documents.select("*", F.posexplode("records").alias("position", "record")).drop("records"))


def told(d: DataFrame, sets: list[list[str]] | None = None) -> DataFrame:
    """d(..., record) with what the record itself says: fields, parts of a combined cell, and the values that product and parties are made of, none of them null."""
    r = F.col("record")
    d = with_fields(d, sets)
    d = d.withColumn("combined", F.when((F.col("combined") == "") & F.col("batch_raw").rlike("(?i)\\b(?:mfg|exp|mfd\\s*by)\\b"), F.col("batch_raw")).otherwise(F.col("combined")))
    d = d.withColumn("parts", text.batch_details(F.col("combined")))
    better = lambda part, raw: F.when(F.col(f"parts.{part}") != "", F.col(f"parts.{part}")).otherwise(F.col(raw))
    spilled = (F.col("maker_raw") == "") | F.col("maker_raw").rlike("(?i)\\b(?:b\\.?\\s*no|batch\\s*no|mfg|exp|mfd\\s*by)\\b")
    d = d.withColumn("batch_number", better("batch_number", "batch_raw")).withColumn("manufacturing_date", better("made", "made_raw")).withColumn("expiry_date", better("expires", "expires_raw"))
    d = d.withColumn("maker_raw", F.when((F.col("parts.maker") != "") & spilled, F.col("parts.maker")).otherwise(F.col("maker_raw")))
    for name, names in (("strength_raw", ["strength"]), ("form_raw", ["dosage_form"]), ("raw_category", ["product_category"]), ("state", ["state", "state_name"])):
        d = d.withColumn(name, _any_of(r, *names))
    return d


#: What a record's product and its parties are made of; few sets of values, each shared by many records.
PRODUCT_VALUES = ["product_raw", "note", "cas_raw", "strength_raw", "form_raw", "raw_category"]
PARTY_VALUES = ["maker_raw", "reporter_raw", "importer_raw", "applicant_raw", "holder_raw", "state"]
PARTIES = ("maker", "reporter", "importer", "applicant", "holder")
#: Sets of values of products that are sent to all tasks, and how many times as many of parties, which are shorter.
SEND_VALUES, SEND_PARTIES = 50_000, 10


def product(d: DataFrame) -> DataFrame:
    """d(PRODUCT_VALUES) with the product's name, formulation, category and keys."""
    d = d.withColumn("product_name", text.product_with_notification(F.col("product_raw"), F.col("note")))
    d = d.withColumn("formulation", text.formulation(F.col("product_name")))
    d = d.withColumn("strength", F.coalesce(text.filled(F.col("strength_raw")), F.col("formulation.strength"))).withColumn("dosage_form", F.coalesce(text.filled(F.col("form_raw")), F.col("formulation.dosage_form")))
    single = F.size("formulation.ingredients") == 1
    item = lambda i: F.struct(i["name"].alias("name"), F.when(single & (i["strength"] == ""), F.trim(F.col("strength"))).otherwise(i["strength"]).alias("strength"), F.when(single, text.cas_number(F.col("cas_raw"))).otherwise("").alias("cas_number"), keys.ingredient_key(i["name"]).alias("ingredient_key"))
    d = d.withColumn("ingredients", F.transform("formulation.ingredients", item)).withColumn("product_category", category(F.col("raw_category"), F.size("ingredients")))
    d = d.withColumn("signature", keys.signature(F.transform("ingredients", lambda i: i["ingredient_key"])))
    return d.withColumn("product_key", F.when(F.col("product_name") != "", keys.product_key(F.col("product_name"), F.col("strength"), F.col("dosage_form"), F.col("product_category"), F.col("signature"))))


def parties(d: DataFrame) -> DataFrame:
    """d(PARTY_VALUES) with the name, address and key of each party."""
    for name in PARTIES:
        d = d.withColumn(name, text.organization_and_address(F.col(f"{name}_raw")))
    return d.select("*", *[F.when(F.col(f"{c}.name") != "", keys.organization_key(F.col(f"{c}.name"), F.col("state"))).alias(f"{c}_key") for c in PARTIES])


class Known:
    """Products and parties that are worked out once for each set of values that records tell.

    ``values`` holds all that ``values_of`` the same rows gives, as a written table: it is counted, then read again.
    Products too many to be sent are met by a join that shuffles; parties too many are worked out for each record.
    """

    def __init__(self, values: DataFrame):
        self.sides = []
        for kind, names, work, most in (("product", PRODUCT_VALUES, product, SEND_VALUES), ("parties", PARTY_VALUES, parties, SEND_VALUES * SEND_PARTIES)):
            own = values.filter(F.col("kind") == kind).select(*names)
            hint = "broadcast" if own.count() <= most else "merge" if kind == "product" else None
            self.sides.append((names, work, work(own).withColumn("_met", F.lit(True)).hint(hint) if hint else None))

    def meet(self, told: DataFrame) -> DataFrame:
        """told with its products and parties; a record whose values are none of these is an error."""
        for names, work, side in self.sides:
            if side is None:
                told = work(told)
                continue
            made = [c for c in side.columns if c not in [*names, "_met"]]
            unknown = F.raise_error(F.concat(F.lit("unknown set of values: "), F.to_json(F.struct(*names))))
            told = told.join(side, names, "left").select(*told.columns, *[F.when(F.col("_met"), F.col(c)).otherwise(unknown).alias(c) for c in made])
        return told


def values_of(rows: DataFrame, sets: list[list[str]] | None = None) -> DataFrame:
    """(kind, PRODUCT_VALUES, PARTY_VALUES) of rows(..., record): each set of values that tells a product or the parties, once."""
    every = [*PRODUCT_VALUES, *PARTY_VALUES]
    of = lambda kind, names: F.struct(F.lit(kind).alias("kind"), *[(F.col(c) if c in names else F.lit(None).cast("string")).alias(c) for c in every])
    return told(rows, sets).select(F.explode(F.array(of("product", PRODUCT_VALUES), of("parties", PARTY_VALUES))).alias("v")).select("v.*").distinct()


def products_of(rows: DataFrame, sets: list[list[str]] | None = None, last: bool = False) -> DataFrame:
    """Products of rows(..., record) in the shape of resolved records: for each set of values that tells one, its first or last record."""
    pick = F.max if last else F.min
    at = pick(F.struct("source_document_id", "position")).alias("at")
    return product(told(rows, sets).groupBy(*PRODUCT_VALUES, "brand_name").agg(at).select("*", "at.*"))


def made_by(rows: DataFrame, sets: list[list[str]] | None = None) -> DataFrame:
    """Products with their parties: one row for each set of values that tells both."""
    return parties(product(told(rows, sets).select(*PRODUCT_VALUES, *PARTY_VALUES).distinct()))


def extracted_rows(d: DataFrame, sets: list[list[str]] | None = None, known: Known | None = None, record: Column | None = None) -> DataFrame:
    """One row a record with its lineage id and its fields, whatever its keys are called; d has the document, position and record.

    ``sets``: see ``with_fields``. ``known``: the products and parties of these rows, made before and met here.
    ``record``: made of d's columns before and again after records are numbered, so that no whole record is sorted.
    """
    r = F.col("record") if record is None else record
    mark = keys.fingerprint(_any_of(r, "product_name", "drug_name", "title", "name"), _any_of(r, "batch_number", "batch_no", "lot_no"), _any_of(r, "manufactured_by", "manufacturer", "company_name"), _any_of(r, "reason", "nsq_result", "reason_for_nsq", "description"))
    d = d.withColumn("fingerprint", mark).withColumn("nth", F.row_number().over(Window.partitionBy("source_document_id", "filename", "fingerprint").orderBy("position")))
    d = d if record is None else d.withColumn("record", record)
    r = F.col("record")
    number = lambda *n: F.coalesce(F.nullif(_any_of(r, *n), F.lit("")).try_cast("int"), F.lit(1))  # noqa: E731  # a failed cast is costly, and most records name no page
    # values that are used more than once are columns: inlined, they make methods so large that the JVM only interprets them
    d = d.withColumn("page_number", number("page_number", "page")).withColumn("table_number", number("table_number", "table"))
    d = d.withColumn("source_record_id", keys.source_record_id(F.col("source_document_id"), F.col("page_number"), F.col("table_number"), F.col("fingerprint"), F.col("nth")))
    d = told(d, sets)
    d = known.meet(d) if known else parties(product(d))
    for name, names in (("raw_event_type", ["event_type"]), ("raw_scope", ["scope"]), ("raw_action", ["action"]), ("legal_status", ["legal_status", "notification_no_and_date", "Notification No & Date"])):
        d = d.withColumn(name, _any_of(r, *names))
    d = d.withColumn("country", F.coalesce(text.filled(_any_of(r, "country")), F.lit("India"))).withColumn("raw_status", F.coalesce(text.filled(_any_of(r, "status")), F.when(F.col("reason") != "", "NSQ").otherwise("")))
    d = d.withColumn("own_day", _any_of(r, "event_date", "date"))
    return d.withColumn("day", event_day(F.col("own_day"), F.col("publication_date"))).withColumn("source_text", F.coalesce(text.filled(_any_of(r, "source_text")), F.to_json(r))).withColumn("source_location", F.coalesce(text.filled(_any_of(r, "source_location")), F.format_string("Page %d, Row %d", "page_number", F.col("position") + 1))).withColumn("extraction_method", F.coalesce(text.filled(_any_of(r, "extraction_method")), F.lit("TEXT")))


def resolved(rows: DataFrame) -> DataFrame:
    """Keys, inferred values and review status of extracted rows (the rich profile)."""
    kind = event_type(F.col("raw_event_type"), F.col("raw_status"), F.col("document_type"))
    d = rows.withColumn("event_type", kind).withColumn("scope", scope(F.col("raw_scope"), F.col("raw_event_type"), F.col("document_type"), F.col("batch_number"), F.col("product_name")))
    d = d.withColumn("act", action(F.col("event_type"), F.col("raw_action")))
    d = d.withColumn("batch_key", F.when(F.col("product_key").isNotNull() & (F.col("batch_number") != ""), keys.batch_key(F.col("product_key"), F.col("maker_key"), F.col("batch_number"))))
    d = d.withColumn("event_key", keys.event_key(F.col("source_document_id"), F.col("source_record_id"), F.col("event_type"), F.col("day.day")))
    return d.withColumn("review", review(F.col("document_type"), F.col("product_name"), F.col("scope"), F.col("batch_number"), F.col("event_type"))).withColumn("status", F.when(F.col("raw_status") != "", F.col("raw_status")).otherwise(F.col("event_type")))
