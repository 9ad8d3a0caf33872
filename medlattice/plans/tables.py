"""Queries of tables, page profiles, parts of documents and their classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import layout, parts, reports, sinks, tables
from ..sources import payload
from ..sources.driver import SMALL_TASK_BYTES, Domain
from .registry import query

ROWS = "array<array<string>>"
#: Folded words in SQL: camel case split, accents stripped, other characters than ASCII left out.
_FOLDED = r"trim(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def lit_rows(*rows: tuple) -> Column:
    return F.array(*[F.array(*[c if isinstance(c, Column) else F.lit(c) for c in r]) for r in rows])


# Payloads

def _files(d: Domain) -> DataFrame:
    """Files of one, two and three pages: text, a table, nothing; some are empty."""
    k = F.col("p_partkey")
    three = F.concat(F.col("p_name"), F.lit("\fa\tb\n"), F.col("p_brand"), F.lit("\tc\f"))
    return d.table("part").select(k.cast("string").alias("path"), F.when(k % 5 != 0, F.when(k % 7 == 0, F.concat(F.lit(" \f"), F.col("p_type"))).otherwise(three)).cast("binary").alias("content"))


@query("S09_payload_pages", """SELECT p_partkey::VARCHAR AS path, n AS page, CASE WHEN p_partkey % 5 = 0 OR (p_partkey % 7 = 0 AND n = 1) OR n = 3 THEN 'empty' WHEN p_partkey % 7 = 0 THEN 'text' WHEN n = 1 THEN 'text' ELSE 'table' END AS type,
 CASE WHEN p_partkey % 5 = 0 OR n = 3 THEN '' WHEN p_partkey % 7 = 0 THEN CASE WHEN n = 1 THEN '' ELSE p_type END WHEN n = 1 THEN p_name ELSE '' END AS text, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND n = 2 THEN 'a|b|' || p_brand || '|c' ELSE '' END AS cells
 FROM part, (VALUES (1), (2), (3)) t(n) WHERE n <= CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 7 = 0 THEN 2 ELSE 3 END""")
def payload_pages(d: Domain) -> DataFrame:
    p = payload.payloads(_files(d))
    return p.select("path", "page", "type", "text", F.array_join(F.flatten(F.flatten("tables")), "|").alias("cells"))


def _recognized(content: bytes, page: int) -> str:
    """A stand-in for a recognizer: what it gives depends on the file and the page alone."""
    return f"page {page} of {len(content)} bytes" if content else ""


@query("S11_recognized_pages", "SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 3 END AS page, 'page ' || CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 3 END || ' of ' || CASE WHEN p_partkey % 7 = 0 THEN strlen(p_type) + 2 ELSE strlen(p_name) + strlen(p_brand) + 8 END || ' bytes' AS text FROM part WHERE p_partkey % 5 <> 0")
def recognized_pages(d: Domain) -> DataFrame:
    return payload.payloads(_files(d), ocr=_recognized).filter("method = 'ocr'").select("path", "page", "text")


_ANSWERS = ('{"aaData": [{"k": "a"}, 2, {"k": "b"}], "n": 3}', '{"aaData": {"k": "a"}}', '[{"k": "a"}]', '{"aaData": []}', '{"aaData": [{"k": "c"}]', None)


@query("S17_api_records", "SELECT event_id::VARCHAR AS path, k, CASE WHEN event_id % 6 IN (1, 2, 4, 5) THEN 'unexpected shape: no list of aaData' END AS error FROM events LEFT JOIN (VALUES (0, 'a'), (0, 'b')) t(m, k) ON event_id % 6 = m WHERE event_id % 6 <> 3")
def api_records(d: Domain) -> DataFrame:
    answer = F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (F.col("event_id") % 6 + 1).cast("int"))
    r = payload.api_records(d.table("events").select(F.col("event_id").cast("string").alias("path"), answer.alias("content")))
    return r.select("path", F.try_element_at("record", F.lit("k")).alias("k"), "error")


@query("P04_api_rows", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'spurious ' || o_orderkey ELSE 'drug ' || o_orderkey END AS product, CASE WHEN o_orderkey % 2 = 1 THEN strftime(o_orderdate, '%b-%Y') END AS made,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Manufacturing Date: ' || strftime(o_orderdate, '%b-%Y') || ' Expiry Date: None' END AS dates, CASE WHEN o_orderkey % 2 = 0 THEN trim('fake ' || CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority ELSE '' END) END AS remarks,
 CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS result, CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 10 END::BIGINT - CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n_columns FROM orders""")
def api_rows(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    fields = {"product_name_from_dtl": F.concat_ws(" ", F.lit("spurious"), k), "str_product_name": F.concat_ws(" ", F.lit("drug"), k), "dt_manufacturing_date": F.date_format("o_orderdate", "MMM-yyyy"), "str_nsq_remarks": F.lit("fake"), "str_firm_reply": F.when(k % 4 == 0, F.col("o_orderpriority")), "str_nsq_result": F.col("o_orderstatus")}
    record = F.create_map(*[x for n, c in fields.items() for x in (F.lit(n), c)])
    row = payload.api_row(record, k, k % 2 == 0)
    get = lambda n: F.try_element_at("row", F.lit(n))
    return d.table("orders").withColumn("row", row).select("o_orderkey", get("Name of Product").alias("product"), get("Manufacturing Date").alias("made"), get("Manufacturing Dates").alias("dates"), get("Remarks").alias("remarks"), get("NSQ Result").alias("result"), F.size(F.map_keys("row")).cast("long").alias("n_columns"))


# Tables


@query("S10_strategy_cascade", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'default' WHEN p_size % 3 = 1 AND p_size % 6 <> 4 THEN 'text' WHEN p_size % 2 = 0 THEN 'mixed_v_text' ELSE 'none' END AS strategy, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 3 = 1 AND p_size % 6 <> 4 THEN 1 WHEN p_size % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS tables FROM part")
def cascade(d: Domain) -> DataFrame:
    k = F.col("p_size")
    good, narrow = lit_rows(("name", "batch"), (F.col("p_name"), "1"), (F.col("p_type"), "2")), lit_rows(("only",), (F.col("p_name"),))
    sentence = lit_rows(("A sentence.", "batch"), (F.col("p_name"), "1"), ("x", "2"))
    found = {"default": F.when(k % 3 == 0, F.array(good, narrow)).otherwise(F.array(narrow)), "text": F.when(k % 6 == 4, F.array(sentence)).when(k % 3 == 1, F.array(good)).otherwise(F.array(narrow)), "mixed_v_text": F.when(k % 2 == 0, F.array(sentence, good)).otherwise(F.array().cast(f"array<{ROWS}>"))}
    each = F.array(*[F.struct(F.lit(s).alias("strategy"), t.alias("tables")) for s, t in found.items()])
    c = tables.cascade(d.dealt("part", "p_partkey", size=SMALL_TASK_BYTES).select("p_partkey", F.explode(each).alias("c")).select("p_partkey", "c.*"), "p_partkey")
    return c.select("p_partkey", "strategy", F.size("tables").cast("long").alias("tables"))


@query("S12_structural_profile", r"""WITH p AS (SELECT conv_id, CASE WHEN turn % 3 = 1 OR conv_id % 4 = 0 THEN ' ' ELSE text END AS t, role = 'user' AND conv_id % 3 > 0 AS img, turn % 5 = 4 AS tab FROM conversations),
 k AS (SELECT conv_id, tab, CASE WHEN trim(t) <> '' THEN 'text' WHEN img THEN 'image' ELSE 'empty' END AS kind, len(regexp_extract_all(t, '[^\s\x1c-\x1f\x{85}\p{Z}]+')) AS n FROM p),
 g AS (SELECT conv_id, count(*)::BIGINT AS total_pages, count(*) FILTER (kind = 'text')::BIGINT AS text_pages, count(*) FILTER (kind = 'image')::BIGINT AS image_pages, count(*) FILTER (kind = 'empty')::BIGINT AS empty_pages, bool_or(tab) AS has_tables, sum(n)::BIGINT AS entity_total FROM k GROUP BY conv_id)
 SELECT *, CASE WHEN text_pages > 0 AND image_pages > 0 THEN 'mixed' WHEN text_pages > 0 THEN 'text' WHEN image_pages > 0 THEN 'scanned' ELSE 'empty' END AS primary_type FROM g""")
def structural_profile(d: Domain) -> DataFrame:
    t = F.when((F.col("turn") % 3 == 1) | (F.col("conv_id") % 4 == 0), " ").otherwise(F.col("text"))
    pages = d.table("conversations").select("conv_id", t.alias("text"), ((F.col("role") == "user") & (F.col("conv_id") % 3 > 0)).alias("has_images"), (F.col("turn") % 5 == 4).alias("has_table"))
    return tables.structural_profile(pages, "conv_id")


_BODIES = {
    "props": "('object', 'k', '', 0, '', 'object-no-record-array')", '[{"a": 1}, {"b": 2}]': "('array', '', '', 2, 'object', 'record-array')", "[]": "('array', '', '', 0, 'empty', 'empty-array')", '[1, {"a": 2}]': "('array', '', '', 2, 'mixed', 'mixed-array')",
    '{"t": 1, "Records": [{"a": 1}, {"a": 2}], "n": [1]}': "('object', 't|Records|n', 'Records', 2, 'object', 'object-with-record-arrays')", '{"x": [[1], [2]], "items": [1, 2, 3]}': "('object', 'x|items', 'items', 3, 'value', 'object-with-arrays')",
    '{"rows": [], "y": [{"z": null}]}': "('object', 'rows|y', 'rows|y', 1, 'object', 'object-with-record-arrays')", "7": "('null', '', '', 0, '', 'json-scalar')", "{oops": "(NULL, NULL, NULL, NULL, NULL, NULL)",
}


@query("S13_json_profile", "SELECT event_id, root, keys, array_keys, records::BIGINT AS records, item_type, class FROM events JOIN (VALUES " + ", ".join(f"({i}, {v[1:]}" for i, v in enumerate(_BODIES.values())) + ") t(m, root, keys, array_keys, records, item_type, class) ON event_id % 9 = m")
def json_profile(d: Domain) -> DataFrame:
    body = F.element_at(F.array(*[F.col("props") if b == "props" else F.lit(b) for b in _BODIES]), (F.col("event_id") % 9 + 1).cast("int"))
    return d.table("events").select("event_id", tables.json_profile(body).alias("p")).select("event_id", *[f"p.{c}" for c in ("root", "keys", "array_keys", "records", "item_type", "class")])


@query("S26_grids", "SELECT p_partkey, p_partkey % 4 < 2 AS grid FROM part")
def grids(d: Domain) -> DataFrame:
    line = lambda kind, *x: F.struct(F.lit(kind).alias("kind"), *[F.lit(float(v)).alias(n) for v, n in zip(x, ("x0", "y0", "x1", "y1"), strict=True)])
    flat, tall = [line("l", 10, y, 90, y + 1) for y in (10, 60)], [line("l", x, 10, x, 60) for x in (10, 90)]
    k = F.col("p_partkey") % 4
    drawn = F.when(k == 0, F.array(*flat, *tall)).when(k == 1, F.array(line("re", 10, 10, 90, 60))).when(k == 2, F.array(*flat, tall[0])).otherwise(F.array(*flat, line("l", 10, 10, 10, 21), line("l", 90, 10, 90, 20)))
    return layout.has_grid(d.table("part").select("p_partkey", F.explode(drawn).alias("x")).select("p_partkey", "x.*"), ["p_partkey"])


@query("S26_text_tables", "SELECT p_partkey, 0.0::DOUBLE AS y0, (p_size % 5 - 1) * 20.0::DOUBLE + 10 AS y1, (p_size % 5)::BIGINT AS n FROM part WHERE p_partkey % 2 = 0 AND p_size % 5 >= 3")
def text_tables(d: Domain) -> DataFrame:
    second = F.when(F.col("p_partkey") % 2 == 0, 60.0).otherwise(50.0)
    lines = F.when(F.col("p_size") % 5 > 0, F.sequence(F.lit(0), F.col("p_size") % 5 - 1)).otherwise(F.array().cast("array<int>"))
    words = d.table("part").select("p_partkey", second.alias("second"), F.explode(lines).alias("line"))
    boxes = F.array(*[F.struct(x.alias("x0"), (x + 30).alias("x1")) for x in (F.lit(10.0) + F.col("line") * 2, F.col("second") + F.col("line") * 2, F.lit(150.0))])
    words = words.select("p_partkey", "line", F.explode(boxes).alias("b"), (F.col("line") * 20.0).alias("y0"), (F.col("line") * 20.0 + 10).alias("y1")).select("p_partkey", "line", "b.*", "y0", "y1")
    # the wide second gap would part columns in any line; leave it out where columns are too close
    return layout.text_table(words.filter("x0 < 100"), ["p_partkey"])


_CELLS = "CASE turn % 3 WHEN 0 THEN ['S. No.', 'Name of drug', 'Batch No.', 'Reason for failure'] WHEN 1 THEN [(turn)::VARCHAR || '.', 'paracetamol', 'batch-' || conv_id, 'failed in assay'] ELSE ['lot of drug', 'lot ' || conv_id, '12', ''] END"


def _table_rows(d: Domain) -> DataFrame:
    c, t = F.col("conv_id").cast("string"), F.col("turn")
    cells = F.when(t % 3 == 0, F.array(*[F.lit(x) for x in ("S. No.", "Name of drug", "Batch No.", "Reason for failure")])).when(t % 3 == 1, F.array(F.concat(t.cast("string"), F.lit(".")), F.lit("paracetamol"), F.concat(F.lit("batch-"), c), F.lit("failed in assay"))).otherwise(F.array(F.lit("lot of drug"), F.concat(F.lit("lot "), c), F.lit("12"), F.lit("")))
    return d.table("conversations").filter("conv_id % 3 <> 0 or turn > 0").select("conv_id", t.cast("int").alias("idx"), cells.alias("cells"))


_TABLE_SCORE = f"len(list_filter(k, lambda c: len(list_filter({list(tables.TABLE_WORDS)}, lambda w: contains(lower(c), w))) > 0)) * 10 + len(k) * 2 + least(list_sum(list_transform(k, lambda c: length(c))) / len(k), 20) * 0.1"
_TEXT_SCORE = f"len(list_filter(flatten(list_transform(f, lambda c: regexp_extract_all(c, '[a-z]+'))), lambda w: list_contains({list(tables.PARAGRAPH_WORDS)}, w))) * 5 + len(list_filter(f, lambda c: regexp_matches(c, '[A-Za-z]'))) * 2 + len(list_distinct(list_transform(f, lambda c: lower(c)))) / len(f) + least(list_sum(list_transform(f, lambda c: length(c))) / len(f), 20) / 20"


@query("W06_best_header_row", rf"""WITH r AS (SELECT conv_id, turn::INT AS idx, {_CELLS} AS cells FROM conversations WHERE conv_id % 3 <> 0 OR turn > 0), k AS (SELECT *, list_filter(cells, lambda c: c <> '' AND NOT regexp_full_match(c, '[\W\d_]+')) AS k, list_filter(cells, lambda c: c <> '') AS f FROM r),
 s AS (SELECT conv_id, idx, cells, CASE WHEN idx < 12 THEN {_TABLE_SCORE} END AS a, CASE WHEN idx < 10 THEN {_TEXT_SCORE} END AS b FROM k),
 a AS (SELECT conv_id, arg_max(idx, [a, -idx]) AS idx FROM s WHERE a IS NOT NULL GROUP BY conv_id), b AS (SELECT conv_id, arg_max(idx, [b, -idx]) AS idx FROM s WHERE b IS NOT NULL GROUP BY conv_id),
 u AS (SELECT 'table' AS variant, * FROM a UNION ALL SELECT 'schema', * FROM a UNION ALL SELECT 'paragraph', * FROM b)
 SELECT u.variant, u.conv_id, u.idx, array_to_string(h.cells, '|') AS header, coalesce(regexp_replace(array_to_string(n.cells, '|'), '\|+$', ''), '') AS first_row FROM u JOIN r h ON h.conv_id = u.conv_id AND h.idx = u.idx LEFT JOIN r n ON n.conv_id = u.conv_id AND n.idx = u.idx + 1""".replace("array_to_string(h.cells, '|')", r"regexp_replace(array_to_string(h.cells, '|'), '\|+$', '')"))
def best_header(d: Domain) -> DataFrame:
    rows, c = _table_rows(d), F.col("cells")
    found = {"table": (tables.table_header_score(c), 12), "schema": (tables.table_header_score(c, serial=False), 12), "paragraph": (tables.paragraph_header_score(c), 10)}
    out = None
    for name, (score, first) in found.items():
        b = tables.best_header(rows, "conv_id", score, first).select(F.lit(name).alias("variant"), "conv_id", "idx", F.array_join("header", "|").alias("header"), F.coalesce(F.array_join("first_row", "|"), F.lit("")).alias("first_row"))
        out = b if out is None else out.unionByName(b)
    return out


@query("W06_best_candidate", "SELECT o_custkey, arg_max(o_orderkey, [(o_orderkey % 4)::BIGINT, -(o_orderkey % 3)::BIGINT, -o_orderkey]) AS \"offset\" FROM orders GROUP BY o_custkey")
def best_candidate(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    return tables.best_candidate(d.table("orders").select("o_custkey", (k % 4).alias("categories"), (k % 3).alias("skipped"), k.alias("offset")), "o_custkey").select("o_custkey", "offset")


@query("W04_header_carry", """WITH m AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations) SELECT conv_id, turn, CASE WHEN f % 2 = 0 THEN 'S. No.|Name of drug|Batch No' WHEN f % 4 = 1 THEN 's no|product|batch no' ELSE '3|y|z' END AS header,
 CASE WHEN turn % 2 = 0 THEN CASE WHEN turn = f THEN '1|x|' || conv_id ELSE 'Report||S. No.|Name of drug|Batch No|1|x|' || conv_id END WHEN turn % 4 = 1 THEN '2|y|z' WHEN turn = f THEN '' ELSE '3|y|z' END AS data FROM m""")
def header_carry(d: Domain) -> DataFrame:
    t = F.col("turn")
    rows = F.when(t % 2 == 0, lit_rows(("Report", ""), ("S. No.", "Name of drug", "Batch No"), ("1", "x", F.col("conv_id").cast("string")))).when(t % 4 == 1, lit_rows(("s no", "product", "batch no"), ("2", "y", "z"))).otherwise(lit_rows(("3", "y", "z")))
    c = tables.carried_headers(d.table("conversations").select("conv_id", t.alias("position"), rows.alias("rows")), "conv_id")
    return c.select("conv_id", F.col("position").alias("turn"), F.array_join("header", "|").alias("header"), F.array_join(F.flatten("data"), "|").alias("data"))


_MADE = "SELECT p_partkey, p_type AS signature, p_brand AS document, p_size AS n_rows, p_name AS variant, CASE WHEN p_size % 10 = 0 THEN 'too few rows' WHEN p_size % 10 = 9 THEN 'no header' END AS reason FROM part"
_RANKED = f"WITH t AS ({_MADE}), i AS (SELECT signature, 'T' || lpad((row_number() OVER (ORDER BY count(DISTINCT document) DESC, sum(n_rows) DESC, signature))::VARCHAR, 3, '0') AS schema_id, count(DISTINCT document) AS documents, sum(n_rows) AS total_rows FROM t WHERE reason IS NULL GROUP BY signature)"


def _made(d: Domain) -> DataFrame:
    reason = F.when(F.col("p_size") % 10 == 0, "too few rows").when(F.col("p_size") % 10 == 9, "no header")
    return d.table("part").select("p_partkey", F.col("p_type").alias("signature"), F.col("p_brand").alias("document"), F.col("p_size").alias("n_rows"), F.col("p_name").alias("variant"), reason.alias("reason"))


@query("K11_schema_outputs", f"{_RANKED} SELECT p_partkey, schema_id, NULL AS reason FROM t JOIN i USING (signature) WHERE reason IS NULL UNION ALL SELECT p_partkey, NULL, reason FROM t WHERE reason IS NOT NULL")
def schema_outputs(d: Domain) -> DataFrame:
    made = _made(d)
    occurrences, rejected = sinks.schema_outputs(made, reports.schema_inventory(made.filter("reason is null")))
    null = F.lit(None).cast("string")
    return occurrences.select("p_partkey", "schema_id", null.alias("reason")).unionByName(rejected.select("p_partkey", null.alias("schema_id"), "reason"))


@query("T06_schema_ranking", f"{_RANKED} SELECT schema_id, signature, documents::BIGINT AS documents, total_rows::BIGINT AS total_rows FROM i ORDER BY schema_id LIMIT 20")
def schema_ranking(d: Domain) -> DataFrame:
    return reports.schema_inventory(_made(d).filter("reason is null")).orderBy("schema_id").limit(20).select("schema_id", "signature", "documents", "total_rows")


@query("A15_strategy_counters", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counters FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def counters(d: Domain) -> DataFrame:
    c = tables.strategy_counters(d.table("events"), "user_id", "event_type")
    return c.select("user_id", F.array_join(F.transform(F.map_entries("counters"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("counters"))


@query("A16_ingest_totals", "SELECT relation, sum(n)::BIGINT AS rows, count(*)::BIGINT AS documents, count(*) FILTER (failed)::BIGINT AS failures FROM (SELECT 'orders' AS relation, count(*) AS n, bool_or(o_orderstatus = 'P') AS failed FROM orders GROUP BY o_custkey UNION ALL SELECT 'lines', count(*), false FROM lineitem GROUP BY l_suppkey) GROUP BY relation")
def totals(d: Domain) -> DataFrame:
    o = d.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("o_orderstatus") == "P").alias("failed")).select(F.lit("orders").alias("relation"), "n", "failed")
    li = d.table("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).select(F.lit("lines").alias("relation"), "n", F.lit(False).alias("failed"))
    return reports.ingest_totals(o.unionByName(li))


# Parts of documents


@query("P09_language_filter", r"""WITH l AS (SELECT doc_id, text, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS a FROM (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN chr(10) || ' दवा  2 ' ELSE '' END AS text FROM documents)),
 c AS (SELECT *, n > 0 AND a / n::DOUBLE >= 0.85 AS kept, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\p{Devanagari}', '', 'g'), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(x, '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))), lambda x: x <> '') AS b FROM l)
 SELECT doc_id, kept, CASE WHEN kept THEN sha256(array_to_string(b, chr(10))) END AS hash FROM c""")
def language_filter(d: Domain) -> DataFrame:
    t = F.concat(F.col("text"), F.when(F.col("doc_id") % 4 == 0, "\n दवा  2 ").otherwise(""))
    return d.table("documents").select("doc_id", parts.english_block(t).alias("block")).select("doc_id", F.col("block").isNotNull().alias("kept"), F.sha2("block", 256).alias("hash"))


@query("P14_boilerplate", f"""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Page ' || turn || ' of 9' WHEN 1 THEN text || ' Printed by the Manager, Govt.' WHEN 2 THEN 'Püblished, by theController' ELSE text END AS t FROM conversations), w AS (SELECT conv_id, turn, {_FOLDED.format('t')} AS w FROM t)
 SELECT conv_id, turn, (contains(w, 'page') AND contains(' ' || w || ' ', ' of ') AND length(w) < 25) OR contains(w, 'printed by the manager') OR contains(w, 'published by the controller') AS boilerplate FROM w""")
def boilerplate(d: Domain) -> DataFrame:
    t = F.col("turn") % 4
    text = F.when(t == 0, F.concat(F.lit("Page "), F.col("turn").cast("string"), F.lit(" of 9"))).when(t == 1, F.concat("text", F.lit(" Printed by the Manager, Govt."))).when(t == 2, "Püblished, by theController").otherwise(F.col("text"))
    return d.table("conversations").select("conv_id", "turn", parts.is_boilerplate(text).alias("boilerplate"))


#: Parts that speak of nothing, of some fields, of all, and of fields far apart.
_SPOKEN = (
    "", " Product name: X tablet, Batch No. 77, recall of stock. Manufactured by M/s Z; failed in assay.", " Notification S.O. 55(E): banned, subject to conditions. Suspected drug: adverse reaction reported on 1-2-2020.",
    " product name" + " far" * 80 + " batch 9 withdrawn, spurious, not to be used", " Brand name Y batch details: prohibited, NSQ; restricted to hospitals",
    " BatchNo12 tablet recall", " Suspected drug X caused an adverse reaction in patients.", " Suspécted drug. Nothing else",
)
_BATCH_GIVEN = 7


def _spoken_sql(given: str) -> dict[str, str]:
    says = lambda p: f"regexp_matches(w, '{p}')"
    out = {n: says(p) for n, p in parts.SIGNALS.items()}
    numbered = f"({given} OR {says(parts.BATCH)})"
    at = lambda p: f"length(regexp_split_to_array(w, '{p}')[1])"
    wide = [parts.NAMED, parts.BATCH, parts.ACTION]
    ends = ", ".join(f"{at(p)} + length(regexp_extract(w, '({p})', 1))" for p in wide)
    near = " AND ".join(says(p) for p in wide) + f" AND greatest({ends}) - least({', '.join(at(p) for p in wide)}) <= 200"
    return out | {
        "batch_no": numbered, "specific_batch": numbered, "notification_no": f"regexp_matches(t, '{parts.NOTIFIED}')", "current_check_match": f"{given} AND {says(parts.CHECKED)}", "alert_format": f"{out['suspected_drug']} AND {out['adverse_reaction']}",
        "specific_action": f"({numbered} OR {out['specific_product']}) AND {out['action_verb']} OR ({near})",
    }


_SIGNAL_NAMES = sorted(_spoken_sql("g"))
_PARTS_SQL = f"SELECT doc_id, text || [{', '.join(repr(s) for s in _SPOKEN)}][(doc_id % {len(_SPOKEN)} + 1)::INT] AS t, doc_id % {_BATCH_GIVEN} = 0 AS g FROM documents"


@query("P16_field_signals", f"WITH p AS ({_PARTS_SQL}), w AS (SELECT *, {_FOLDED.format('t')} AS w FROM p) SELECT doc_id, " + ", ".join(f"{c} AS {n}" for n, c in sorted(_spoken_sql("g").items())) + " FROM w")
def field_signals(d: Domain) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat("text", F.element_at(F.array(*[F.lit(s) for s in _SPOKEN]), (k % len(_SPOKEN) + 1).cast("int")))
    s = parts.field_signals(text, F.when(k % _BATCH_GIVEN == 0, k.cast("string")))
    return d.table("documents").select("doc_id", s.alias("s")).select("doc_id", *[f"s.{n}" for n in _SIGNAL_NAMES])


_ARCHETYPES = ("A", "K", "AQ", "Z", "AV", "D", "XX", "P1", "P3", "P3b", "P3c", "P5", "P7", "P8", "P20", None)
_CLASSES = {a: (parts.TABLE_CLASS | parts.TEXT_CLASS).get(a, (parts.UNUSABLE, "P3")) for a in _ARCHETYPES if a}
_NEEDS = {a: ",".join((parts.TABLE_FIELDS | parts.TEXT_FIELDS).get(a, ())) for a in _CLASSES}


@query("R12_usability", "WITH m(i, a, c, p, f) AS (VALUES " + ", ".join(f"({i}, '{a}', '{_CLASSES[a][0]}', '{_CLASSES[a][1]}', '{_NEEDS[a]}')" for i, a in enumerate(_ARCHETYPES) if a) + f"""), x AS (SELECT p_partkey, a, c, p, f, p_partkey % 3 = 0 AS spoken, p_partkey % 5 = 0 AS device, p_partkey % 7 = 0 AS weak, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS win FROM part LEFT JOIN m ON p_partkey % {len(_ARCHETYPES)} = i),
 y AS (SELECT *, CASE WHEN a = 'P1' THEN CASE WHEN NOT win THEN 'missing:product_name,batch_no,manufacturer,failure_reason_window' END WHEN a = 'P5' THEN CASE WHEN NOT spoken THEN 'missing:specific_action' END WHEN a = 'A' AND spoken THEN 'missing:batch_no' WHEN f <> '' AND NOT spoken THEN 'missing:' || f END AS miss FROM x),
 z AS (SELECT *, CASE WHEN miss IS NOT NULL THEN 'Future-usable' ELSE c END AS c1 FROM y), v AS (SELECT *, device AND c1 = 'Usable' AS o, CASE WHEN device AND c1 = 'Usable' THEN 'Future-usable' ELSE c1 END AS c2 FROM z)
 SELECT p_partkey, CASE WHEN a IS NULL THEN 'Non-usable' WHEN weak AND c2 = 'Usable' THEN 'Future-usable' ELSE c2 END AS class, CASE WHEN a IS NULL THEN 'P3' WHEN miss IS NOT NULL OR o OR weak AND c2 = 'Usable' THEN 'P2' ELSE p END AS priority,
 CASE WHEN a IS NULL THEN 'unmapped_taxonomy' ELSE concat_ws('|', miss, CASE WHEN o THEN 'out_of_medicine_scope:device' END, CASE WHEN weak THEN 'low_ocr_confidence' END, CASE WHEN weak AND c2 = 'Usable' THEN 'deferred_pending_ocr_review' END, CASE WHEN NOT weak AND c2 = 'Usable' THEN 'evidence_review_required' END) END AS flags FROM v""")
def usability(d: Domain) -> DataFrame:
    """Texts that say nothing, all fields close together, and all fields with the product far from the others."""
    k = F.col("p_partkey")
    a = F.element_at(F.array(*[F.lit(x) for x in _ARCHETYPES]), (k % len(_ARCHETYPES) + 1).cast("int"))
    rest = ", batch no 7, manufactured by Z, failed: spurious. S.O. 5, prohibited, only for hospitals, subject to review, recall; suspected drug adverse reaction reported"
    text = F.when(k % 3 == 0, F.concat(F.lit("product name tablet"), F.when(k % 2 == 1, " far" * 60).otherwise(""), F.lit(rest))).otherwise("")
    table = ~F.startswith(F.col("a"), F.lit("P"))
    rows = d.table("part").withColumns({"a": a, "t": text}).withColumn("f", parts.field_signals(F.col("t")))
    u = parts.usability(F.col("a"), table, F.col("f"), F.when(k % 5 == 0, "device").otherwise("medicine"), F.when(k % 7 == 0, 0.3).otherwise(0.9), parts.quality_window(F.col("t"), F.col("f")), F.when(~table, parts.batch_of(F.col("t"))))
    return rows.withColumn("u", u).select("p_partkey", F.col("u.class").alias("class"), F.col("u.priority").alias("priority"), F.array_join("u.flags", "|").alias("flags"))


#: Source, file name, archetype.
_NAMED = (
    ("cdsco", "Banned_Drugs_2018.pdf", "AR"), ("cdsco", "Countrywide survey of spurious drugs.pdf", "C"), ("nsq", "List of spurious drug samples.pdf", "C"), ("nsq", "Vaccine results.pdf", "A"), ("nsq", "State vaccine results.pdf", None), ("cdsco", "Medical Device Alert 3.pdf", "AS"), ("cdsco", "Drugs Alert, list of May.pdf", "A"),
    ("cdsco", "State drug alert list.pdf", None), ("cdsco", "Approved for Marketing in 2020.pdf", "AT"), ("cdsco", "RC holders with RC issued.xlsx", "AU"), ("fda", "Recall notice.pdf", "AV"), ("cdsco", "NLEM 2022.pdf", "AC"), ("cdsco", "BA-BE study centre.pdf", "O"), ("cdsco", "FDC permitted for manufacturing.pdf", "K"),
    ("cdsco", "List of laboratories, performance evaluation of IVD.pdf", "F"), (None, "minutes.pdf", None),
)


@query("R13_document_context", "SELECT p_partkey, a AS archetype FROM part JOIN (VALUES " + ", ".join(f"({i}, {repr(a) if a else 'NULL'})" for i, (_, _, a) in enumerate(_NAMED)) + f") t(m, a) ON p_partkey % {len(_NAMED)} = m")
def document_context(d: Domain) -> DataFrame:
    pick = lambda j: F.element_at(F.array(*[F.lit(x[j]) for x in _NAMED]), (F.col("p_partkey") % len(_NAMED) + 1).cast("int"))
    return d.table("part").select("p_partkey", parts.context_archetype(pick(0), pick(1)).alias("archetype"))


@query("R13_context_archetype", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'forced' WHEN p_size % 3 = 1 THEN 'from_table' ELSE 'AV' END AS archetype, CASE WHEN p_size % 3 = 0 THEN 'FORCED' WHEN p_size % 3 = 1 THEN 'TABLE' ELSE 'CONTEXT' END AS status FROM part")
def decided(d: Domain) -> DataFrame:
    from ..operators import scanned

    k = F.col("p_size") % 3
    r = scanned.decided(F.when(k == 0, "forced"), F.when(k == 1, "from_table"), parts.context_archetype(F.lit("fda"), F.concat(F.lit("Recall of "), F.col("p_name"), F.lit(".pdf"))))
    return d.table("part").select("p_partkey", r["archetype"].alias("archetype"), r["status"].alias("status"))
