"""Records assembled from table rows and lines in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank, clean_cell

ANCHOR = "^\\d+[.)]?$"
REMARK = "(?i)^(?:remark|remarks)\\s*:\\s*"
#: Columns of an alert with the names they go by, in order of priority.
ALERT_COLUMNS = {
    "S No": ("s no", "s.no", "s. no", "s n o", "sl no", "sr. no", "sl.no", "s n"), "Name of Drugs/medical device/cosmetics": ("name of drugs", "product/drug name", "name of product", "name of drug", "product name"), "Batch No": ("batch no", "batch no.", "b. no.", "b no", "batch number"),
    "Date of Manufacture": ("date of manufacture", "date of manu factur e", "manufacturing date", "manufact uring date", "manufa cturing date", "mfg date"), "Date of Expiry": ("date of expiry", "expiry date", "exp date"), "Manufactured By": ("manufactured by", "manufactured by as per label"),
    "Reason for failure": ("reason for failure", "reasons for failure", "nsq result", "sub-standard in"), "Drawn By": ("drawn by", "drawn by from state/cdsco zone", "reporting source"), "From": ("from", "from name of laboratory", "reported by cdsco laboratory", "reported by state laboratory"), "Remarks": ("remarks", "remark", "response of original manufacturer"),
}


def is_anchor(cell: Column) -> Column:
    return clean_cell(cell).rlike(ANCHOR)


def is_noise(cells: Column) -> Column:
    """Page counters, repeated headers and imprints."""
    t = F.lower(F.array_join(F.filter(F.transform(cells, clean_cell), lambda c: c != ""), " "))
    has = lambda *ks: F.array_contains(F.array(*[F.contains(t, F.lit(k)) for k in ks]), True)
    header = has("name of product", "product/drug name", "batch no") & has("manufacturing date", "expiry date", "nsq result")
    return (t == "") | t.rlike("^page\\s+\\d+\\s+of\\s+\\d+") | t.rlike("^\\d+\\s+of\\s+\\d+") | header | has("this report is issued", "confidential", "cdsco website")


def is_summary(rows: Column) -> Column:
    t = F.lower(F.array_join(F.flatten(rows), " "))
    return (F.size(rows) <= 6) & (F.contains(t, F.lit("total number of samples")) | F.contains(t, F.lit("samples declared")))


def assembled(rows: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """(doc, record, column, value, remark) of rows(doc, order..., cells).

    A row whose first cell is a number starts a record; other rows add their
    cells to the same columns; rows before the first number are dropped; a remark
    row sets the record's remark. Record numbers run over tables and pages.
    """
    clean = rows.withColumn("cells", F.transform("cells", clean_cell)).filter(~is_noise(F.col("cells")))
    first, second = F.coalesce(F.get("cells", 0), F.lit("")), F.coalesce(F.get("cells", 1), F.lit(""))
    text = F.array_join("cells", " ")
    noted = [c.rlike(REMARK) for c in (first, second, text)]
    strip = lambda c: F.trim(F.regexp_replace(c, REMARK, ""))
    remark = F.when(noted[0], strip(first)).when(noted[1], strip(second)).when(noted[2], strip(text))
    rest = F.trim(F.array_join(F.filter("cells", lambda c: (c != "") & ~F.startswith(F.lower(c), F.lit("remark"))), " "))
    anchored = first.rlike(ANCHOR)
    w = Window.partitionBy(doc).orderBy(*order)
    d = clean.withColumn("anchor", anchored).withColumn("remark", F.when(~anchored, F.when(remark == "", rest).otherwise(remark)))
    d = d.withColumn("record", F.sum(F.col("anchor").cast("int")).over(w)).withColumn("ord", F.row_number().over(w)).filter("record > 0")
    notes = d.filter("remark is not null").groupBy(doc, "record").agg(F.max_by("remark", "ord").alias("remark"))
    cells = d.filter("remark is null").select(doc, "record", "ord", "anchor", F.posexplode("cells").alias("column", "value")).filter("anchor or value <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), " ")
    values = cells.groupBy(doc, "record", "column").agg(F.trim(joined).alias("value"))
    return values.join(notes, [doc, "record"], "left")


def carried_header(tables: DataFrame, doc: str, order: str, header: str) -> DataFrame:
    """tables with ``inherited``: the last header before, where a table has none."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return tables.withColumn("inherited", F.coalesce(F.col(header), F.last(header, ignorenulls=True).over(w)))


def filled_forward(rows: DataFrame, doc: str, order: list[str], column: str, seed: str | None = None) -> DataFrame:
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.last(F.nullif(F.trim(blank(F.col(column))), F.lit("")), ignorenulls=True).over(w)
    return rows.withColumn(column, value if seed is None else F.coalesce(value, F.lit(seed)))


def gated(rows: DataFrame, doc: str, order: list[str], opens: Column, closes: Column) -> DataFrame:
    """Rows after one that opens and before one that closes; neither of those themselves."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gate = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(w)
    return rows.withColumn("_gate", gate).filter(F.coalesce("_gate", F.lit(False)) & ~opens).drop("_gate")


def alert_rows(records: DataFrame, key: list[str]) -> DataFrame:
    """Records (key..., position, name, value) as the ten columns of an alert; later columns overwrite."""
    low = F.trim(F.lower(F.col("name")))
    target = F.lit(None).cast("string")
    for column, names in reversed(ALERT_COLUMNS.items()):
        target = F.when(F.array_contains(F.array(*[F.contains(low, F.lit(n)) for n in names]), True), column).otherwise(target)
    number = F.regexp_extract(F.col("name"), "^Column_(\\d+)$", 1).try_cast("int")
    target = F.coalesce(target, F.when(number.isNotNull(), F.coalesce(F.get(F.array(*[F.lit(c) for c in ALERT_COLUMNS]), number - 1), F.lit("Remarks"))))
    named = records.withColumn("_to", target)
    pick = lambda c: F.coalesce(F.max_by(F.when(F.col("_to") == c, F.trim("value")), F.when(F.col("_to") == c, F.col("position"))), F.lit("")).alias(c)
    return named.groupBy(*key).agg(*[pick(c) for c in ALERT_COLUMNS])


#: What a document of drug safety alerts speaks of, and where its table begins and ends.
SUSPECTS, REACTIONS = "suspected drug", "adverse drug"
ENDINGS = ("healthcare professional", "disclaimer")
SAFETY_SECTION = r"(?is)(?:S\.?\s*No\.?\s+)?Suspected\s+Drugs.*?Adverse\s+Drug\s+Reactions\s*(.*?)(?=Healthcare\s+Professionals|$(?![\s\S]))"
SAFETY_ENTRY = r"(?ms)^\s*(\d+)\s+(.+?)(?=^\s*\d+\s+|\z)"
INDICATION = r"(?i)\b(?:chemotherapy|in\s+combination\s+with|for\s+the\s+treatment\s+of|treatment\s+of|used\s+for|indicated\s+for)\b"
ISSUED, FILED = r"(?i)\bDated\s*:?\s*([^\n\r]+)", r"(?i)\bFile\s*No\.?\s*:?\s*(.*?)(?=\s+\bDated\b|[\n\r]|$)"


def safety_alerts(documents: DataFrame, rows: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """(doc, position, number, suspected_drug, indications, reaction, issue_date, file_number, origin) of drug safety alerts.

    documents(doc, text) count if text or cells speak of such alerts. In
    rows(doc, order..., cells) a row of column names opens the table and a row
    of a closing section shuts it; a row that begins with a number is a record,
    the others go on with the last one, cell by cell. A document whose tables
    give no record is read from its text: numbered entries between the column
    names and the closing section, split where an indication and then a
    sentence begin; entries without an indication go.
    """
    clean = rows.withColumn("cells", F.transform("cells", clean_cell)).withColumn("_line", F.lower(F.array_join("cells", " ")))
    spoken = clean.groupBy(doc).agg(F.concat_ws(" ", F.collect_list("_line")).alias("_cells"))  # a document's own rows
    known = documents.select(doc, blank(F.col("text")).alias("text")).join(spoken, doc, "left")
    content = F.concat_ws(" ", F.lower("text"), F.coalesce("_cells", F.lit("")))
    says = lambda t: F.contains(content, F.lit(t))
    known = known.filter(says("pvpi") | says("drug safety alerts") | (says("suspected drugs") & says("adverse drug reactions"))).select(doc, "text")
    marks = known.select(
        doc, "text", clean_cell(F.regexp_extract("text", ISSUED, 1)).alias("issue_date"), clean_cell(F.regexp_extract("text", FILED, 1)).alias("file_number")
    )

    opens = F.contains("_line", F.lit(SUSPECTS)) & F.contains("_line", F.lit(REACTIONS))
    closes = F.startswith("_line", F.lit(ENDINGS[0])) | F.startswith("_line", F.lit(ENDINGS[1]))
    inside = gated(clean.join(known.select(doc), doc, "left_semi"), doc, order, opens, closes)
    w = Window.partitionBy(doc).orderBy(*order)
    first = F.coalesce(F.get("cells", 0), F.lit(""))
    inside = inside.withColumn("_record", F.sum(first.rlike(r"^\d+\.?$").cast("int")).over(w)).withColumn("_ord", F.row_number().over(w)).filter("_record > 0")
    joined = lambda i: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce(F.get("cells", i), F.lit("")) != "", F.struct("_ord", F.get("cells", i).alias("c"))))), lambda x: x["c"]), " ")
    number = F.regexp_replace(F.min_by(F.get("cells", 0), "_ord"), r"\.+$", "")
    from_rows = inside.groupBy(doc, "_record").agg(number.alias("number"), joined(1).alias("suspected_drug"), joined(2).alias("indications"), joined(3).alias("reaction"))
    from_rows = from_rows.select(doc, (F.col("_record") - 1).cast("int").alias("position"), "number", "suspected_drug", "indications", "reaction", F.lit("table").alias("origin"))

    section = F.regexp_extract("text", SAFETY_SECTION, 1)
    entries = F.regexp_extract_all(section, F.lit(SAFETY_ENTRY), F.lit(0))
    left = known.join(from_rows.select(doc).distinct(), doc, "left_anti").select(doc, F.posexplode(entries).alias("_at", "_entry"))
    body = clean_cell(F.regexp_replace("_entry", r"(?s)^\s*\d+\s+", ""))
    left = left.select(doc, "_at", F.regexp_extract("_entry", r"^\s*(\d+)", 1).alias("number"), body.alias("_body")).filter(F.col("_body").rlike(INDICATION))
    head = F.element_at(F.split("_body", INDICATION, 2), 1)
    parts = F.split(F.substr("_body", F.length(head) + 1), r"(?<=[.!?])\s+(?=[A-Z])", 2)
    from_text = left.select(
        doc, (F.row_number().over(Window.partitionBy(doc).orderBy("_at")) - 1).alias("position"), "number", F.regexp_replace(head, r"^[ .:\-]+|[ .:\-]+$", "").alias("suspected_drug"), F.trim(F.get(parts, 0)).alias("indications"),
        F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("reaction"), F.lit("text").alias("origin"),
    )
    found = from_rows.unionByName(from_text).join(marks.drop("text"), doc)
    return found.select(doc, "position", F.col("number").try_cast("long").alias("number"), "suspected_drug", "indications", "reaction", "issue_date", "file_number", "origin")


def sections(lines: DataFrame, doc: str, order: list[str], pattern: str) -> DataFrame:
    """lines with the heading they stand under; headings themselves go."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.when(F.col("text").rlike(pattern), F.trim("text"))
    return lines.withColumn("_own", name).withColumn("heading", F.last("_own", ignorenulls=True).over(w)).filter("_own is null").drop("_own")


