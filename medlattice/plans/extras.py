"""Queries of sources, sinks in select form, and the remaining functions and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codes, nested, text
from ..operators import assemble, classify, resolve, scanned
from ..sources import html
from ..sources.driver import Domain
from .registry import query


@query("S01_parsed_documents", """SELECT doc_id::VARCHAR AS source_document_id, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END::BIGINT AS broken, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 2 END::BIGINT AS records, 'BANNED_DRUGS' AS document_type FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT doc_id || '.json', 1, 0, 'UNKNOWN' FROM documents WHERE doc_id % 10 = 0""")
def parsed(d: Domain) -> DataFrame:
    k = F.col("doc_id").cast("string")
    good = F.to_json(F.struct(k.alias("document_id"), F.lit("Banned drugs").alias("document_type"), F.array(F.struct(F.col("lang").alias("name")), F.struct(F.col("source").alias("name"))).alias("items")))
    files = d.table("documents").select(F.concat(k, F.lit(".json")).alias("filename"), F.lit("p").alias("path"), F.when(F.col("doc_id") % 10 == 0, F.lit("{broken")).otherwise(good).alias("content"))
    return resolve.parsed_documents(files).select("source_document_id", F.col("error").isNotNull().cast("long").alias("broken"), F.size("records").cast("long").alias("records"), "document_type")


@query("S04_file_discovery", "SELECT page_id, url FROM pages WHERE NOT contains(url, '/de/') AND NOT contains(lower(url), 'casino') ORDER BY url")
def discovery(d: Domain) -> DataFrame:
    return d.table("pages").filter(~F.contains("url", F.lit("/de/")) & ~F.contains(F.lower("url"), F.lit("casino"))).select("page_id", "url")


@query("S08_summary_scan", "SELECT DISTINCT event_type AS key FROM events WHERE value > 100")
def summary_scan(d: Domain) -> DataFrame:
    bucket = F.when(F.col("value") > 100, " Event-Bearing ").otherwise("context-only")
    return d.table("events").withColumn("bucket", bucket).filter("lower(trim(bucket)) = 'event-bearing'").select(F.col("event_type").alias("key")).distinct()


@query("S14_table_rows", "SELECT p_partkey AS page_id, 1 AS position, p_name AS name, p_brand AS brand, p_partkey AS number FROM part")
def table_rows(d: Domain) -> DataFrame:
    link = F.concat(F.lit('<td><a href="view?num_id='), F.base64(F.col("p_partkey").cast("string").cast("binary")), F.lit('">pdf</a></td>'))
    body = F.concat(F.lit("<table><tr></tr><tr><td> "), F.col("p_name"), F.lit("</td><td><b>"), F.col("p_brand"), F.lit("</b></td>"), link, F.lit("</tr></table>"))
    r = html.table_rows(d.table("part").select(F.col("p_partkey").alias("page_id"), body.alias("html")))
    return r.select("page_id", "position", F.get("cells", 0).alias("name"), F.get("cells", 1).alias("brand"), "number")


@query("S15_year_links", "SELECT page_id, '2021' AS year, '/b' AS href FROM pages")
def year_links(d: Domain) -> DataFrame:
    body = F.lit('<a href="/a">Drug Alert 2019</a><a href="/b"><b>Drug Alerts 2021</b></a><a href="/c">other</a>')
    return html.year_links(d.table("pages").select("page_id", body.alias("html")))


@query("S16_frame_targets", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/doc/' || page_id ELSE url END AS target FROM pages")
def frames(d: Domain) -> DataFrame:
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<iframe src="/doc/'), F.col("page_id").cast("string"), F.lit('">'))).otherwise("<p>x</p>")
    return html.frame_targets(d.table("pages").select("page_id", "url", body.alias("html"))).select("page_id", "target")


@query("S19_heading_sections", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations QUALIFY role <> 'user'")
def heading_sections(d: Domain) -> DataFrame:
    c = d.table("conversations").withColumn("text", F.when(F.col("role") == "user", F.concat(F.lit("# "), F.trim("text"))).otherwise(F.concat(F.lit("- "), F.col("text"))))
    return assemble.sections(c, "conv_id", ["turn"], "^# ").select("conv_id", "turn", F.regexp_replace("heading", "^# ", "").alias("heading"))


@query("S21_key_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def key_lookup_whole(d: Domain) -> DataFrame:
    return d.table("orders").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("S23_inventory_index", "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS folder, regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1) AS name FROM pages")
def inventory_index(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("folder"), F.regexp_extract("url", "/([^/?#]*)([?#].*)?$", 1).alias("name"))


@query("S25_first_rows", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def first_rows(d: Domain) -> DataFrame:
    ids = d.table("documents").groupBy("source").agg(F.slice(F.array_sort(F.collect_list("doc_id")), 1, 3).alias("ids"))
    return ids.select("source", F.explode("ids").alias("doc_id"))


# Sinks in select form


@query("K09_json_artifacts", """SELECT doc_id, strlen(b)::BIGINT AS bytes, sha256(b) AS hash FROM (SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' AS b FROM documents)""")
def artifacts(d: Domain) -> DataFrame:
    b = F.to_json(F.struct("doc_id", "lang"))
    return d.table("documents").select("doc_id", F.octet_length(b).cast("long").alias("bytes"), F.sha2(b, 256).alias("hash"))


@query("K10_review_report", "SELECT doc_id, CASE WHEN quality = 0 THEN 'missing_product_name' ELSE 'nsq_without_batch' END AS review_reason FROM labels WHERE quality = 0 OR toxic = 1")
def review_report(d: Domain) -> DataFrame:
    r = resolve.review(F.lit("NSQ_STATE"), F.when(F.col("quality") == 0, "").otherwise("x"), F.lit("BATCH"), F.when(F.col("toxic") == 1, "").otherwise("b"), F.lit("NSQ"))
    return d.table("labels").withColumn("r", r).filter("r.status = 'NEEDS_REVIEW'").select("doc_id", F.col("r.reason").alias("review_reason"))


@query("K12_routing_status", "SELECT d.doc_id, lang AS folder, CASE WHEN l.doc_id IS NOT NULL THEN 'EXISTING' ELSE 'PLANNED' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def routing(d: Domain) -> DataFrame:
    have = d.table("labels").select("doc_id", F.lit(True).alias("have"))
    return d.table("documents").join(have, "doc_id", "left").select("doc_id", F.col("lang").alias("folder"), F.when(F.col("have"), "EXISTING").otherwise("PLANNED").alias("status"))


@query("K20_chunk_lines", """SELECT conv_id, turn, '{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}' AS line FROM conversations""")
def chunk_lines(d: Domain) -> DataFrame:
    return d.table("conversations").select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role")).alias("line"))


@query("K21_added_columns", "SELECT s_suppkey, s_name, '' AS phone, NULL::BIGINT AS rank FROM supplier")
def added_columns(d: Domain) -> DataFrame:
    df = d.table("supplier").select("s_suppkey", "s_name")
    for name, kind, default in (("phone", "string", ""), ("rank", "bigint", None), ("s_name", "string", "")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


@query("K22_csv_rows", """SELECT p_partkey, p_partkey || ',"' || p_name || ', x",' || p_size AS line FROM part""")
def csv_rows(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", F.to_csv(F.struct("p_partkey", F.concat("p_name", F.lit(", x")).alias("n"), "p_size")).alias("line"))


# Functions


@query("F03_folded_words", "SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS words FROM documents")
def folded_whole(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", text.ascii_words(F.col("text")).alias("words"))


@query("F04_lexicon_names", "SELECT p_partkey, p_name || ' ' || p_size || 'mg ab x12' AS name FROM part")
def lexicon_names(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", text.lexicon_name(F.concat(F.lit("7. "), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg a b x12"))).alias("name"))


@query("F06_addresses", "SELECT s_suppkey, s_name AS name, 'Street 7' AS address FROM supplier")
def addresses(d: Domain) -> DataFrame:
    v = text.organization_and_address(F.concat(F.col("s_name"), F.lit(", Street 7")))
    return d.table("supplier").select("s_suppkey", v["name"].alias("name"), v["address"].alias("address"))


@query("F09_notification_repair", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand || ' ' || p_name END AS product FROM part")
def notifications(d: Domain) -> DataFrame:
    own = F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_brand"))
    return d.table("part").select("p_partkey", text.product_with_notification(own, F.concat(F.lit("4. "), F.col("p_name"), F.lit(" S.O. 55(E)"))).alias("product"))


@query("F11_header_signatures", "SELECT p_partkey, 's no|' || p_name || '|batch' AS signature FROM part")
def signatures(d: Domain) -> DataFrame:
    cells = F.array(F.lit("S. No."), F.upper("p_name"), F.lit("Batch-No"))
    return d.table("part").select("p_partkey", text.header_signature(cells, {"batch no": "batch"}).alias("signature"))


@query("F12_trailing_blanks", "SELECT p_partkey, 'a||' || p_name AS cells FROM part")
def trailing(d: Domain) -> DataFrame:
    cells = F.array(F.lit("a"), F.lit(""), F.col("p_name"), F.lit(" "), F.lit(None).cast("string"))
    return d.table("part").select("p_partkey", F.array_join(text.without_trailing_blanks(cells), "|").alias("cells"))


@query("F13_junk_cells", "SELECT p_partkey, p_partkey % 3 <> 0 AS junk FROM part")
def junk(d: Domain) -> DataFrame:
    cell = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, " - 12 ").otherwise("ñéüöñéü x")
    return d.table("part").select("p_partkey", text.is_junk_cell(cell).alias("junk"))


@query("F15_batch_numbers", "SELECT p_partkey, 'AB-' || p_partkey AS batch FROM part")
def batch_numbers(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", text.batch_number(F.concat(F.lit("Batch No: ab-"), F.col("p_partkey").cast("string"), F.lit(" ."))).alias("batch"))


@query("F16_pack_fields", "SELECT p_partkey, p_name AS name, 'X' || p_partkey AS batch, '05/2025' AS expires, p_size || ' mg' AS dose FROM part")
def pack_fields(d: Domain) -> DataFrame:
    t = F.concat(F.lit("\n"), F.col("p_name"), F.lit("\nBatch No: X"), F.col("p_partkey").cast("string"), F.lit("\nExp 05/2025 "), F.col("p_size").cast("string"), F.lit(" mg"))
    return d.table("part").withColumn("f", text.pack_fields(t)).select("p_partkey", "f.name", "f.batch", "f.expires", "f.dose")


@query("F17_grounding", "SELECT p_partkey, p_partkey % 2 = 0 AS grounded FROM part")
def grounding(d: Domain) -> DataFrame:
    v = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise("absent thing")
    return d.table("part").select("p_partkey", text.grounded(v, F.concat(F.lit("A pack of "), F.col("p_name"), F.lit("!"))).alias("grounded"))


@query("F18_soft_wraps", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body, regexp_matches(rtrim(text), '[.!?:;][\"'')\\]]*$') AS ends FROM conversations")
def soft_wraps(d: Domain) -> DataFrame:
    return d.table("conversations").select("conv_id", "turn", text.joined_lines(F.col("text")).alias("body"), text.ends_sentence(F.col("text")).alias("ends"))


@query("F22_month_values", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') ELSE o_orderstatus END AS value FROM orders")
def month_values(d: Domain) -> DataFrame:
    from ..functions.dates import month_or_text

    return d.table("orders").select("o_orderkey", month_or_text(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMM yyyy")).otherwise(F.col("o_orderstatus"))).alias("value"))


@query("F37_photo_rectangles", "SELECT p_partkey, round(p_size * 2.0, 6) AS x, round(100 + p_size * 2.0, 6) AS y FROM part")
def rectangles(d: Domain) -> DataFrame:
    v = [F.lit(float(x)) for x in (10, 10, 100, 100, 200, 300)]
    r = codes.photo_rectangle(F.col("p_size").cast("double"), F.col("p_size").cast("double") + 25, v[0], v[1], F.lit(100.0), F.lit(150.0), F.lit(200.0), F.lit(400.0))
    return d.table("part").select("p_partkey", F.round(r["x"], 6).alias("x"), F.round(r["y"], 6).alias("y"))


@query("F40_flattened_rows", "SELECT p_partkey, 'b|' || p_name AS rows FROM part")
def flattened(d: Domain) -> DataFrame:
    t = lambda i, c: F.struct(F.lit(i).alias("table_index"), F.array(F.array(c)).alias("rows"))
    rows = nested.table_rows(F.array(t(2, F.col("p_name")), t(1, F.lit("b"))))
    return d.table("part").select("p_partkey", F.array_join(F.transform(rows, lambda r: r[0]), "|").alias("rows"))


@query("F50_flat_lines", "SELECT p_partkey, p_name || '!' AS text, 12.0::DOUBLE AS size, 3 AS flags FROM part")
def flat_lines(d: Domain) -> DataFrame:
    span = lambda t, s, f: F.struct(t.alias("text"), F.lit(s).alias("size"), F.lit(f).alias("flags"))
    line = F.struct(F.array(span(F.col("p_name"), 12.0, 1), span(F.lit("!"), 9.0, 2)).alias("spans"))
    pages = F.array(F.struct(F.array(F.struct(F.array(line).alias("lines"))).alias("blocks")))
    return d.table("part").select("p_partkey", F.explode(nested.flat_lines(pages)).alias("l")).select("p_partkey", "l.text", "l.size", "l.flags")


@query("P15_proximity", "SELECT p_partkey, p_size <= 20 AS near FROM part")
def proximity(d: Domain) -> DataFrame:
    t = F.concat(F.lit("alpha"), F.repeat(F.lit("."), (F.col("p_size") - 1) * 10), F.lit("omega"))
    return d.table("part").select("p_partkey", text.near(t, ["alpha", "omega"]).alias("near"))


# Scanned documents


@query("R11_paragraph_archetype", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') AND contains(p_name, 'small') THEN 'rings' WHEN contains(p_name, 'bolt') THEN 'bolts' WHEN contains(p_name, 'ring') THEN 'rings' END AS archetype FROM part")
def paragraph_archetype(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", scanned.archetype(F.col("p_name"), {"rings": ("ring", "small ring"), "bolts": ("bolt",)}).alias("archetype"))


#: Paragraphs with the archetype and product type that the signatures and the overrides of product types give.
_PARAGRAPHS = (
    ("Veterinary use only, banned", "P16", "veterinary"), ("For vet shops: recall", "P16", "veterinary"), ("medicalDevice Alert: catheter recalled", "P9", "device"), ("stent among approved products", "P10", "device"), ("WHO alert on spurious, misbranded and falsified goods", "P6", "medicine"),
    ("a spurious drug", "P1", "medicine"), ("cosmetic banned", "P4", "cosmetic"), ("nothing to see", None, "medicine"), ("corvette recall", "P5", "medicine"), ("Infusion-Pump safety", "P9", "device"), ("DiagnosticKit found", None, "device"), ("amendment by S.O. 5", "P29", "medicine"),
    ("prohibited and restricted", "P3", "medicine"), ("Adverse drug reaction, ADR of a spurious drug", "P7", "medicine"), ("pröhibited", "P3", "medicine"),
)


@query("R11_product_overrides", "SELECT p_partkey, a AS archetype, k AS product_type FROM part JOIN (VALUES " + ", ".join(f"({i}, {repr(a) if a else 'NULL'}, '{k}')" for i, (_, a, k) in enumerate(_PARAGRAPHS)) + f") t(m, a, k) ON p_partkey % {len(_PARAGRAPHS)} = m")
def product_overrides(d: Domain) -> DataFrame:
    t = F.element_at(F.array(*[F.lit(x[0]) for x in _PARAGRAPHS]), (F.col("p_partkey") % len(_PARAGRAPHS) + 1).cast("int"))
    r = scanned.paragraph(F.concat(t, F.lit(" "), F.col("p_name")))
    return d.table("part").select("p_partkey", r.alias("r")).select("p_partkey", "r.archetype", "r.product_type")


@query("W03_remarks", "SELECT conv_id, max(turn) FILTER (role = 'assistant') AS turn FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0")
def remarks(d: Domain) -> DataFrame:
    rows = d.table("conversations").withColumn("ord", F.col("turn") + 1)
    anchor = rows.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("ord"), F.array(F.lit("1."), F.lit("x")).alias("cells"))
    notes = rows.filter("role = 'assistant'").select("conv_id", "ord", F.array(F.concat(F.lit("Remarks: "), F.col("turn").cast("string"))).alias("cells"))
    made = assemble.assembled(anchor.unionByName(notes), "conv_id", ["ord"])
    return made.filter("column = 0 and remark is not null").select("conv_id", F.col("remark").cast("long").alias("turn"))


@query("J16_whole_terms", "SELECT doc_id, len(list_filter(['license', 'version', 'under the'], lambda k: contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || k || ' ')))::BIGINT AS n FROM documents")
def whole_terms(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id", F.size(classify.whole_terms(F.col("text"), ("license", "version", "under the"))).cast("long").alias("n"))


@query("W21_event_index", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS n FROM events")
def event_index(d: Domain) -> DataFrame:
    return d.table("events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("n"))
