"""Queries of documents, pages and tables: functions, classifiers, assembly, reports, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codes, dates, nested, text
from ..operators import assemble, classify, listings, reports, resolve
from ..sources import html
from ..sources.driver import SMALL_TASK_BYTES, Domain
from .registry import query


def docs(d: Domain) -> DataFrame:
    return d.table("documents")


# Sources


@query("S02_record_arrays", "SELECT event_id, 'aaData' AS found, (props->>'$.k')::VARCHAR AS k FROM events")
def record_arrays(d: Domain) -> DataFrame:
    from ..functions.records import records_of

    body = F.concat(F.lit('{"title": "t", "aaData": ['), F.col("props"), F.lit("]}"))
    return d.table("events").select("event_id", F.lit("aaData").alias("found"), F.explode(records_of(body)).alias("r")).select("event_id", "found", F.col("r")["k"].alias("k"))


@query("S03_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(d: Domain) -> DataFrame:
    return docs(d).select("doc_id", F.sha2("text", 256).alias("hash"))


@query("S05_suffix_scan", "SELECT page_id, lower(url) AS key FROM pages WHERE ends_with(lower(url), '.html')")
def suffix_scan(d: Domain) -> DataFrame:
    return d.table("pages").filter(F.endswith(F.lower("url"), F.lit(".html"))).select("page_id", F.lower("url").alias("key"))


@query("S06_manifest_scan", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def manifest_scan(d: Domain) -> DataFrame:
    return docs(d).join(d.table("labels").filter("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "source")


@query("S15_page_links", r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\s+href="([^"]*)"', 1) AS links FROM pages), u AS (SELECT page_id, unnest(links) AS href, generate_subscripts(links, 1) AS n FROM a)
SELECT page_id, href, min(n)::BIGINT AS position FROM u WHERE NOT regexp_matches(lower(href), 'login|master') GROUP BY ALL""")
def page_links(d: Domain) -> DataFrame:
    return html.links(d.table("pages"), drop=("login", "master"))


@query("S18_page_sample", "SELECT conv_id, turn FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn IN (0, 1, m)")
def page_sample(d: Domain) -> DataFrame:
    w = Window.partitionBy("conv_id")
    return d.table("conversations").withColumn("m", F.max("turn").over(w)).filter("turn in (0, 1) or turn = m").select("conv_id", "turn")


@query("S22_last_record_wins", "SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY user_id")
def last_wins(d: Domain) -> DataFrame:
    return d.table("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


# Classifiers


_KW_SQL = "[" + ", ".join(f"{{'w': {w}, 'n': (length(t) - length(replace(t, '{k}', ''))) // {len(k)}}}" for k, w in classify.KEYWORDS.items()) + "]"
#: Documents with words of alerts mixed in, so that keywords occur, some often.
_ALERTS = ("", " Recall of spurious drugs", " Batch No. 7, not of standard quality" + " NSQ" * 7, " adverse drug reactions: PvPI drug alerts")
_SCORED = f"WITH l AS (SELECT doc_id, lower(trim(regexp_replace(text || [{', '.join(repr(a) for a in _ALERTS)}][doc_id % 4 + 1], '\\s+', ' ', 'g'))) AS t FROM documents), s AS (SELECT doc_id, list_filter({_KW_SQL}, lambda x: x.n > 0) AS k FROM l), r AS (SELECT doc_id, least(1.0, coalesce(list_sum(list_transform(k, lambda x: x.w * least(x.n, 5))), 0) / 40.0)::DOUBLE AS score, len(k)::BIGINT AS matched FROM s)"


def _scored(d: Domain) -> DataFrame:
    alert = F.element_at(F.array(*[F.lit(a) for a in _ALERTS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(d).withColumn("s", classify.keyword_score(F.concat("text", alert)))


@query("A10_keyword_score", f"{_SCORED} SELECT doc_id, score, matched FROM r")
def keyword_score(d: Domain) -> DataFrame:
    return _scored(d).select("doc_id", F.col("s.score").alias("score"), F.size("s.matched").cast("long").alias("matched"))


@query("R08_score_band", f"{_SCORED} SELECT doc_id, CASE WHEN score BETWEEN 0.28 AND 0.32 THEN 'borderline' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS band FROM r")
def score_band(d: Domain) -> DataFrame:
    return _scored(d).select("doc_id", classify.band(F.col("s.score")).alias("band"))


# to RE2 a word is ASCII, so letters beyond it become one that is in no code
_PLAIN_LETTERS = r"regexp_replace(t, '[\x{80}-\x{10FFFF}]', 'z', 'g')"


@query("A11_entities", rf"""WITH b AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' Batch AB' || (1000 + doc_id) || ' and CD5678 far' WHEN doc_id % 3 = 1 THEN ' AB1234 ' || repeat('x ', 30) || 'CD5678 lot ' || lower('Nimesulide') ELSE '' END AS text FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')) AS t FROM b), z AS (SELECT *, {_PLAIN_LETTERS} AS u FROM n),
p AS (SELECT doc_id, t, u, regexp_extract_all(u, '\b[A-Z]{{1,4}}\d{{3,8}}[A-Z]?\b') AS c, regexp_split_to_array(u, '\b[A-Z]{{1,4}}\d{{3,8}}[A-Z]?\b') AS s FROM z),
q AS (SELECT *, list_transform(range(1, len(c) + 1), lambda i: list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(c[1:i-1], lambda x: length(x))), 0)) AS a FROM p),
k AS (SELECT doc_id, t, list_distinct(list_transform(list_filter(range(1, len(c) + 1), lambda i: regexp_matches(substr(t, (greatest(a[i] - 50, 0) + 1)::INT, (a[i] + length(c[i]) + 50 - greatest(a[i] - 50, 0))::INT), '(?i)batch|b\.?\s*no|lot')), lambda i: c[i])) AS batches FROM q)
SELECT doc_id, len(batches)::BIGINT AS batches, (""" + " + ".join(rf"len(list_distinct(regexp_extract_all(t, '(?i)([\p{{L}}\p{{N}}_]+ {n})(?:[^\p{{L}}\p{{N}}_]|$)', 1)))" for n in ("ing", "pharma", "labs")) + rf""")::BIGINT AS makers, len(list_filter([{", ".join(repr(x) for x in classify.DRUG_NAMES)}], lambda x: contains(lower(t), x)))::BIGINT AS drugs FROM k""")
def entities(d: Domain) -> DataFrame:
    k = F.col("doc_id")
    added = F.when(k % 3 == 0, F.concat(F.lit(" Batch AB"), (k + 1000).cast("string"), F.lit(" and CD5678 far"))).when(k % 3 == 1, F.lit(" AB1234 " + "x " * 30 + "CD5678 lot nimesulide")).otherwise("")
    e = classify.entities(F.concat("text", added), ("ing", "pharma", "labs"))
    return docs(d).withColumn("e", e).select("doc_id", *[F.size(f"e.{c}").cast("long").alias(c) for c in ("batches", "makers", "drugs")])


@query("A19_distinct_terms")
def distinct_terms(d: Domain) -> DataFrame:
    """Every third text speaks of the programme, every second of a reaction."""
    k = F.col("doc_id")
    said = F.concat("text", F.when(k % 3 == 0, " PvPI").otherwise(""), F.when(k % 2 == 0, " an ADR of the drug").otherwise(""))
    return classify.distinct_event_terms(docs(d).withColumn("text", said), ("the", "of the", "license", "in the", "adr"))


_W = "' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query("J16_lexicon_containment", f"""WITH t AS (SELECT doc_id, {_W.format('text')} AS t FROM documents), n(name) AS (VALUES ('in the'), ('the'), ('of'), ('license version'), ('apache license'), ('the apache license'), ('under the')),
h AS (SELECT doc_id, name FROM t, n WHERE contains(t, ' ' || name || ' ')) SELECT doc_id, name FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = a.doc_id AND b.name <> a.name AND contains(' ' || b.name || ' ', ' ' || a.name || ' '))""")
def lexicon(d: Domain) -> DataFrame:
    names = d.spark.createDataFrame([(n,) for n in ("in the", "the", "of", "license version", "apache license", "the apache license", "under the")], "name string")
    return classify.lexicon_matches(docs(d), names)


@query("J17_fuzzy_lexicon")
def fuzzy_lexicon(d: Domain) -> DataFrame:
    values = d.table("part").select(F.concat(F.col("p_name"), F.lit("s")).alias("value"))
    return classify.fuzzy_lexicon(values, d.table("part").select(F.col("p_name").alias("name")))


@query("F46_header_category")
def header_category(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", classify.header_category(F.concat(F.lit("Name of "), F.col("p_name"))).alias("category"))


@query("F46_table_hints", f"SELECT doc_id, CASE WHEN contains({_W.format('text')}, ' order ') THEN 'order' WHEN contains({_W.format('text')}, ' advisory ') THEN 'advisory' END AS hint FROM documents")
def hints(d: Domain) -> DataFrame:
    return docs(d).select("doc_id", classify.document_hint(F.col("text")).alias("hint"))


@query("R01_document_type", """SELECT page_id, CASE WHEN contains(u, 'banned') THEN 'BANNED_DRUGS' WHEN contains(u, 'pvpi') OR contains(u, 'adr') THEN 'PVPI_ADR' WHEN contains(u, 'spurious') THEN 'SPURIOUS' WHEN contains(u, 'nsq') THEN 'NSQ_STATE' WHEN contains(u, 'device') OR contains(u, 'ivd') THEN 'MEDICAL_DEVICE' WHEN contains(u, 'approved') THEN 'APPROVED_DRUGS'
WHEN contains(u, 'noc') OR contains(u, 'import') OR contains(u, 'fdc') THEN 'NOC_IMPORT_FDC' ELSE 'UNKNOWN' END AS document_type FROM (SELECT page_id, lower(url) AS u FROM pages)""")
def document_type(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", resolve.document_type(F.lit(""), F.lit(""), F.lit(""), F.col("url")).alias("document_type"))


@query("R02_document_family", """SELECT doc_id, CASE WHEN contains(t, 'spurious') THEN 'Doc 4' WHEN contains(t, 'pvpi') THEN 'Doc 2' WHEN (contains(t, 'prohibited') OR contains(t, 'banned')) AND (contains(t, 'notification') OR contains(t, '26a')) THEN 'Doc 1' WHEN contains(t, 'device') OR contains(t, 'catheter') OR contains(t, 'implant') THEN 'Doc 7'
WHEN contains(t, 'approved') AND contains(t, 'indication') THEN 'Doc 8' WHEN contains(t, 'fdc') AND (contains(t, 'irrational') OR contains(t, 'prohibition')) THEN 'Doc 9' WHEN contains(t, 'sec') OR contains(t, 'tentative schedule') THEN 'Doc 10' WHEN contains(t, 'noc') OR contains(t, 'import') THEN 'Doc 11' WHEN contains(t, 'vaccine') AND contains(t, 'inspection') THEN 'Doc 12'
WHEN contains(t, 'pcr') OR contains(t, 'testing kit') THEN 'Doc 13' WHEN contains(t, 'laboratory') AND contains(t, 'ivd') THEN 'Doc 14' WHEN contains(t, 'fee') OR contains(t, 'faq') THEN 'Doc 15' WHEN contains(t, 'g.s.r') OR contains(t, 's.o.') THEN 'Doc 16' ELSE 'General' END AS family FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def family(d: Domain) -> DataFrame:
    return docs(d).select("doc_id", classify.document_family(F.lit(""), F.col("text")).alias("family"))


@query("R03_event_type", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'RECALL' WHEN o_orderstatus = 'P' THEN 'APPROVAL' WHEN o_orderpriority = '1-URGENT' THEN 'SPURIOUS' WHEN o_orderpriority = '2-HIGH' THEN 'BANNED' WHEN o_orderkey % 2 = 0 THEN 'ADR' ELSE 'NSQ' END AS event_type FROM orders")
def event_type(d: Domain) -> DataFrame:
    declared = F.when(F.col("o_orderstatus") == "F", "recall").when(F.col("o_orderstatus") == "P", "marketing_approval")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "Spurious drug").when(F.col("o_orderpriority") == "2-HIGH", "prohibited")
    return d.table("orders").select("o_orderkey", resolve.event_type(declared, status, F.when(F.col("o_orderkey") % 2 == 0, "PVPI_ADR")).alias("event_type"))


@query("R04_scope_and_action", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'INGREDIENT' WHEN o_orderstatus = 'P' THEN 'BATCH' WHEN o_orderkey % 3 = 0 THEN 'PRODUCT' ELSE 'DOCUMENT' END AS scope, CASE WHEN o_orderkey % 5 = 0 THEN 'seize' WHEN o_orderstatus = 'F' THEN 'BAN' ELSE '' END AS action, CASE WHEN o_orderkey % 5 = 0 THEN 'EXTRACTED' WHEN o_orderstatus = 'F' THEN 'INFERRED' ELSE 'MISSING' END AS action_source FROM orders")
def scope_and_action(d: Domain) -> DataFrame:
    s = F.col("o_orderstatus")
    scope = resolve.scope(F.when(s == "F", "ingredient"), F.when(s == "P", "nsq"), F.lit("UNKNOWN"), F.lit(""), F.when(F.col("o_orderkey") % 3 == 0, "x"))
    a = resolve.action(F.when(s == "F", "BANNED").otherwise("OTHER"), F.when(F.col("o_orderkey") % 5 == 0, " seize "))
    return d.table("orders").select("o_orderkey", scope.alias("scope"), a["action"].alias("action"), a["source"].alias("action_source"))


_COUNTS = "SELECT o_orderkey AS k, o_orderkey % 11 = 0 AS pending, o_orderkey % 7 = 0 AS tbl, o_orderkey % 13 = 0 AS fdc, o_orderkey % 5 AS drugs, o_orderkey % 3 AS batches, o_orderkey % 2 AS makers, o_orderkey % 17 % 4 AS events, o_orderkey % 19 % 3 AS context FROM orders"
_RULE = "CASE WHEN pending THEN 'D7' WHEN tbl THEN 'D2' WHEN fdc THEN 'D3' WHEN drugs > 0 AND (batches > 0 OR makers > 0 OR events > 0) THEN 'D4' WHEN context >= 2 OR (context = 1 AND drugs >= 2) THEN 'D5' ELSE 'D6' END"


def _verdicts(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    v = classify.verdict(k % 11 == 0, F.when(k % 7 == 0, 1).otherwise(0), F.when(k % 13 == 0, 1).otherwise(0), F.lit(False), k % 5, k % 3, k % 2, k % 17 % 4, k % 19 % 3, F.lit(False), F.lit(None).cast("string"))
    return d.table("orders").withColumn("v", v)


@query("R07_ordered_verdict", f"SELECT k AS o_orderkey, {_RULE} AS rule, CASE {_RULE} WHEN 'D5' THEN 'context-only' WHEN 'D6' THEN 'unimportant' ELSE 'event-bearing' END AS bucket FROM ({_COUNTS})")
def verdicts(d: Domain) -> DataFrame:
    return _verdicts(d).select("o_orderkey", F.col("v.rule").alias("rule"), F.col("v.bucket").alias("bucket"))


@query("R08_completed_verdict", f"""WITH v AS (SELECT *, {_RULE} AS rule FROM ({_COUNTS})), b AS (SELECT *, CASE rule WHEN 'D5' THEN 'context-only' WHEN 'D6' THEN 'unimportant' ELSE 'event-bearing' END AS bucket, events >= 2 AS strong, events >= 1 AS has_context FROM v),
f AS (SELECT *, rule = 'D4' AND makers > 0 AND batches = 0 AND NOT has_context AS demoted FROM b), g AS (SELECT *, NOT demoted AND strong AND bucket <> 'event-bearing' AS promoted, NOT demoted AND NOT strong AND rule = 'D4' AS weak FROM f)
SELECT k AS o_orderkey, CASE WHEN demoted OR weak THEN 'context-only' WHEN promoted THEN 'event-bearing' ELSE bucket END AS bucket, weak OR (NOT demoted AND NOT promoted AND NOT weak AND has_context AND bucket = 'context-only') AS needs_review FROM g""")
def completed(d: Domain) -> DataFrame:
    k = F.col("o_orderkey")
    c = classify.completed(F.col("v.rule"), F.col("v.bucket"), F.col("v.reason"), k % 2, k % 3, k % 17 % 4 >= 1, k % 17 % 4 >= 2)
    return _verdicts(d).select("o_orderkey", c["bucket"].alias("bucket"), c["needs_review"].alias("needs_review"))


@query("R09_ensemble", """SELECT l.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'event-bearing' WHEN l.doc_id % 3 = 0 AND l.doc_id % 100 >= 70 THEN 'event-bearing' WHEN l.doc_id % 3 = 0 AND l.doc_id % 100 >= 50 THEN 'needs_review' WHEN toxic = 1 THEN 'context-only' ELSE 'unimportant' END AS bucket,
CASE WHEN quality = 1 AND toxic = 0 THEN 'deterministic_event_signal' WHEN l.doc_id % 3 = 0 AND l.doc_id % 100 >= 70 THEN CASE WHEN toxic = 1 THEN 'context' ELSE 'unimportant' END || '_override_model_strong' WHEN l.doc_id % 3 = 0 AND l.doc_id % 100 >= 50 THEN CASE WHEN toxic = 1 THEN 'context' ELSE 'unimportant' END || '_model_uncertain' WHEN toxic = 1 THEN 'context_confirmed' ELSE 'unimportant' END AS reason FROM labels l""")
def ensemble(d: Domain) -> DataFrame:
    b = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "event-bearing").when(F.col("toxic") == 1, "context-only").otherwise("unimportant")
    e = classify.ensemble(b, F.when(F.col("doc_id") % 3 == 0, "relevant").otherwise("not_relevant"), (F.col("doc_id") % 100) / 100)
    return d.table("labels").select("doc_id", e["bucket"].alias("bucket"), e["reason"].alias("reason"))


@query("R10_priority", "SELECT doc_id, CASE WHEN n_chars = 0 THEN 'Review' WHEN contains(lower(text), 'license') THEN 'Important' WHEN contains(lower(text), 'the') THEN 'Unimportant' ELSE 'Review' END AS priority FROM documents")
def priority(d: Domain) -> DataFrame:
    return docs(d).select("doc_id", classify.priority(F.col("text"), ("license",), ("the",), F.col("n_chars") > 0).alias("priority"))


@query("A18_mean_label_score", "WITH m AS (SELECT user_id, event_type, avg(value) AS s FROM events GROUP BY ALL), t AS (SELECT user_id, arg_max({'l': event_type, 's': s}, {'s': s, 'l': event_type}) AS t FROM m GROUP BY user_id) SELECT user_id, t.l AS top_label, CASE WHEN t.s <= 60 THEN 'needs_review' WHEN t.l IN ('purchase', 'view') THEN 'relevant' ELSE 'not_relevant' END AS verdict FROM t")
def mean_label(d: Domain) -> DataFrame:
    e = d.table("events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("label"), F.col("value").alias("score"))
    return classify.averaged(e, ("purchase", "view"), 60).select(F.col("doc_id").alias("user_id"), "top_label", "verdict")


# Aggregations and reports


@query("A02_category_metrics", "SELECT coalesce(lang, 'TOTAL') AS category, count(*)::BIGINT AS records, count(*) FILTER (n_chars >= 1000)::BIGINT AS complete, count(*) FILTER (n_chars < 1000)::BIGINT AS needs_review FROM documents GROUP BY ROLLUP(lang)")
def metrics(d: Domain) -> DataFrame:
    return reports.category_metrics(docs(d), "lang", {"complete": F.col("n_chars") >= 1000, "needs_review": F.col("n_chars") < 1000})


@query("A03_alias_candidates", "SELECT p_type AS normalized_name, count(DISTINCT p_name)::BIGINT AS raw_name_count, string_agg(DISTINCT p_name, ' | ' ORDER BY p_name) AS raw_names FROM part GROUP BY p_type HAVING count(DISTINCT p_name) > 1")
def aliases(d: Domain) -> DataFrame:
    return reports.alias_candidates(d.table("part"), "p_type", "p_name")


@query("A06_document_rollup", "SELECT user_id, count(*) FILTER (event_type = 'purchase')::BIGINT AS usable, CASE WHEN bool_or(event_type = 'purchase') THEN 'Usable' WHEN bool_or(event_type = 'view') THEN 'Partial' ELSE 'Unusable' END AS label, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, min(value) FILTER (event_type = 'purchase') AS best, bool_or(value > 200) AS flagged FROM events GROUP BY user_id")
def rollup(d: Domain) -> DataFrame:
    return reports.part_rollup(d.table("events"), "user_id", "event_type", "value", "purchase", "view", F.col("value") > 200)


@query("A07_mean_confidence", "SELECT user_id, round(avg(value), 6) AS mean_value, count(*) FILTER (value < 30)::BIGINT AS low FROM events GROUP BY user_id")
def confidence(d: Domain) -> DataFrame:
    return d.table("events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("value") < 30).alias("low"))


@query("A08_schema_inventory", """WITH g AS (SELECT p_type AS signature, count(*) AS tables, count(DISTINCT p_brand) AS documents, sum(p_size) AS total_rows, max(p_size) AS max_rows FROM part GROUP BY p_type), v AS (SELECT p_type, p_name, count(*) AS n, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_name) AS r FROM part GROUP BY p_type, p_name),
t AS (SELECT p_type, string_agg(p_name, ' | ' ORDER BY r) AS variants FROM v WHERE r <= 3 GROUP BY p_type) SELECT 'T' || lpad((row_number() OVER (ORDER BY g.documents DESC, g.total_rows DESC, signature))::VARCHAR, 3, '0') AS schema_id, signature, g.tables::BIGINT AS tables, g.documents::BIGINT AS documents, g.total_rows::BIGINT AS total_rows, g.max_rows::BIGINT AS max_rows, variants FROM g JOIN t ON p_type = signature""")
def inventory(d: Domain) -> DataFrame:
    p = d.table("part").select(F.col("p_type").alias("signature"), F.col("p_brand").alias("document"), F.col("p_size").alias("n_rows"), F.col("p_name").alias("variant"))
    return reports.schema_inventory(p)


@query("A09_frequencies", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def frequencies(d: Domain) -> DataFrame:
    return d.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("A12_medians", "SELECT event_type, round(median(value), 6) AS median_value, max(value) AS largest FROM events GROUP BY event_type")
def medians(d: Domain) -> DataFrame:
    return d.table("events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"), F.max("value").alias("largest"))


@query("A13_extraction_quality", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, sum(length(line))::BIGINT AS chars, count(*) FILTER (length(line) >= 20 AND regexp_matches(line, '^[A-Z]'))::BIGINT AS good, CASE WHEN sum(length(line)) >= 200 AND count(*) FILTER (length(line) >= 20 AND regexp_matches(line, '^[A-Z]')) >= 2 THEN 'GOOD' ELSE 'POOR' END AS quality FROM l GROUP BY doc_id")
def extraction_quality(d: Domain) -> DataFrame:
    blocks = docs(d).select("doc_id", F.explode(F.split("text", "\n")).alias("block"))
    return reports.extraction_quality(blocks, "doc_id", "block")


@query("A14_document_kind", "SELECT user_id, CASE WHEN t > 0 AND i > 0 THEN 'mixed' WHEN t > 0 THEN 'text' WHEN i > 0 THEN 'image' ELSE 'empty' END AS kind FROM (SELECT user_id, count(*) FILTER (event_type = 'signup') AS t, count(*) FILTER (event_type = 'error') AS i FROM events GROUP BY user_id)")
def kind(d: Domain) -> DataFrame:
    return reports.page_mix(d.table("events"), "user_id", F.col("event_type") == "signup", F.col("event_type") == "error")


@query("A17_artifact_counts", "SELECT coalesce(source, 'all') AS file, count(*)::BIGINT AS records FROM documents GROUP BY ROLLUP(source)")
def artifacts(d: Domain) -> DataFrame:
    return docs(d).rollup("source").agg(F.count(F.lit(1)).alias("records")).select(F.coalesce("source", F.lit("all")).alias("file"), "records")


@query("A32_stat_tiles", "SELECT count(*)::BIGINT AS total, count(*) FILTER (lang = 'en')::BIGINT AS english, count(*) FILTER (n_chars > 5000)::BIGINT AS long FROM documents")
def tiles(d: Domain) -> DataFrame:
    return docs(d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 5000).alias("long"))


@query("A33_character_shares", r"SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE round((length(text) - length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))) / length(text)::DOUBLE, 9) END::DOUBLE AS ascii_share, CASE WHEN length(text) = 0 THEN 0.0 ELSE round((length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) / length(text)::DOUBLE, 9) END::DOUBLE AS latin_share FROM documents")
def shares(d: Domain) -> DataFrame:
    r = lambda p: F.round(text.share_of(F.col("text"), p), 9)
    return docs(d).select("doc_id", r(r"[\x00-\x7F]").alias("ascii_share"), r("[A-Za-z]").alias("latin_share"))


# Joins


@query("J11_two_sided", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left only' WHEN d.doc_id IS NULL THEN 'right only' WHEN (n_chars >= 1000)::INT <> quality THEN 'mismatch' ELSE 'equal' END AS state FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def two_sided(d: Domain) -> DataFrame:
    a = docs(d).select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("value"))
    return reports.reconciled(a, d.table("labels").select("doc_id", F.col("quality").alias("value")), "doc_id", "value")


@query("J12_full_merge", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(l.quality::VARCHAR, d.lang) AS value, CASE WHEN l.doc_id IS NULL THEN 'left only' WHEN d.doc_id IS NULL THEN 'right only' ELSE 'merged' END AS audit FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def full_merge(d: Domain) -> DataFrame:
    r = d.table("labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    return reports.merged(docs(d).select("doc_id", F.col("lang").alias("value")), r, "doc_id", "value")


@query("J13_enrichment", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.lang END, l.quality::VARCHAR, '') AS title FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def enrichment(d: Domain) -> DataFrame:
    own = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return docs(d).join(d.table("labels"), "doc_id", "left").select("doc_id", F.coalesce(own, F.col("quality").cast("string"), F.lit("")).alias("title"))


@query("J14_event_bearing", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def event_bearing(d: Domain) -> DataFrame:
    return docs(d).select("doc_id").join(d.table("labels").filter("toxic = 1"), "doc_id", "left_semi")


@query("J15_title_join", "SELECT page_id, coalesce(d.source, '') AS title FROM pages p LEFT JOIN documents d ON p.page_id = d.doc_id")
def title_join(d: Domain) -> DataFrame:
    t = docs(d).select(F.col("doc_id").alias("page_id"), "source")
    return d.table("pages").join(t, "page_id", "left").select("page_id", F.coalesce("source", F.lit("")).alias("title"))


@query("J19_phrase_match", f"""WITH t AS (SELECT doc_id, {_W.format('text')} AS t FROM documents), p(archetype, grp, phrase) AS (VALUES ('licence', 1, 'apache license'), ('licence', 2, 'version 2'), ('prose', 1, 'of the'), ('prose', 2, 'in the'), ('prose', 3, 'and the')), n AS (SELECT archetype, count(DISTINCT grp) AS groups FROM p GROUP BY 1),
h AS (SELECT doc_id, archetype, count(DISTINCT grp) AS hits FROM t, p WHERE contains(t, ' ' || phrase || ' ') GROUP BY ALL), r AS (SELECT doc_id, archetype, hits, hits / groups AS ratio FROM h JOIN n USING (archetype) WHERE hits >= 2 AND hits / groups >= 0.6) SELECT doc_id, arg_max(archetype, {{'r': ratio, 'h': hits, 'a': archetype}}) AS archetype FROM r GROUP BY doc_id""")
def phrases(d: Domain) -> DataFrame:
    p = d.spark.createDataFrame([("licence", 1, "apache license"), ("licence", 2, "version 2"), ("prose", 1, "of the"), ("prose", 2, "in the"), ("prose", 3, "and the")], "archetype string, grp int, phrase string")
    return reports.phrase_archetypes(docs(d), p, 0.6)


@query("J22_duplicate_paths", "SELECT sha256(text) AS path, count(*)::BIGINT AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_paths(d: Domain) -> DataFrame:
    return docs(d).groupBy(F.sha2("text", 256).alias("path")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("J24_manifest_with_results", "SELECT d.doc_id, coalesce(s.status, 'NOT_PROCESSED') AS status, coalesce(s.kinds, '') AS kinds FROM documents d LEFT JOIN (SELECT conv_id, 'DONE' AS status, string_agg(DISTINCT role, ',' ORDER BY role) AS kinds FROM conversations GROUP BY conv_id) s ON d.doc_id = s.conv_id")
def manifest_results(d: Domain) -> DataFrame:
    s = d.table("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("kinds"))
    return docs(d).join(s, "doc_id", "left").select("doc_id", F.when(F.col("kinds").isNull(), "NOT_PROCESSED").otherwise("DONE").alias("status"), F.coalesce("kinds", F.lit("")).alias("kinds"))


# Windows and assembly


@query("W02_assembled_records", r"""WITH c AS (SELECT *, role = 'user' AS anchor FROM conversations), r AS (SELECT *, sum(anchor::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS rec FROM c) SELECT conv_id, rec::BIGINT AS record, string_agg(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ' ORDER BY turn) AS value FROM r WHERE rec > 0 GROUP BY ALL""")
def records(d: Domain) -> DataFrame:
    rows = d.table("conversations").select("conv_id", "turn", F.array(F.when(F.col("role") == "user", F.concat(F.col("turn").cast("string"), F.lit("."))).otherwise(""), F.col("text")).alias("cells"))
    made = assemble.assembled(rows, "conv_id", ["turn"])
    return made.filter("column = 1").select("conv_id", "record", "value")


@query("W05_header_inheritance", "SELECT conv_id, turn, coalesce(CASE WHEN role = 'user' THEN text END, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS inherited FROM conversations")
def inheritance(d: Domain) -> DataFrame:
    t = d.table("conversations").withColumn("header", F.when(F.col("role") == "user", F.col("text")))
    return assemble.carried_header(t, "conv_id", "turn", "header").select("conv_id", "turn", F.coalesce("inherited", F.lit("")).alias("inherited"))


@query("W07_forward_fill", "SELECT conv_id, turn, coalesce(last_value(CASE WHEN turn % 3 = 0 AND turn > 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'seed') AS role FROM conversations")
def forward_fill(d: Domain) -> DataFrame:
    t = d.table("conversations").withColumn("role", F.when((F.col("turn") % 3 == 0) & (F.col("turn") > 0), F.col("role")).otherwise(" "))
    return assemble.filled_forward(t, "conv_id", ["turn"], "role", "seed").select("conv_id", "turn", "role")


@query("W08_gated_rows", "WITH g AS (SELECT *, last_value(CASE role WHEN 'user' THEN true WHEN 'system' THEN false END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS gate FROM conversations) SELECT conv_id, turn FROM g WHERE gate AND role <> 'user'")
def gated(d: Domain) -> DataFrame:
    return assemble.gated(d.table("conversations"), "conv_id", ["turn"], F.col("role") == "user", F.col("role") == "system").select("conv_id", "turn")


def numbered_lines(d: Domain, *ends: str) -> DataFrame:
    """Every turn as lines of a list: most begin with a number one up, some skip, repeat or have none; ``ends`` go on in turn."""
    t = F.col("turn")
    number = F.when(t % 5 == 3, "").when(t % 7 == 6, F.concat((t + 40).cast("string"), F.lit(". "))).otherwise(F.concat((t - F.floor(t / 5) + 4).cast("string"), F.lit(". ")))
    more = F.element_at(F.array(*[F.lit(e) for e in ends]), (t % len(ends) + 1).cast("int"))
    return d.table("conversations").select("conv_id", "turn", F.concat(number, "text", more).alias("text"))


@query("W08_pvpi_alerts")
def pvpi_alerts(d: Domain) -> DataFrame:
    """Conversations as alerts: a third as tables of their turns, a third as plain text, a third as both."""
    t, kind = d.table("conversations"), F.col("conv_id") % 3
    head = F.array(F.lit("S No"), F.lit("Suspected Drugs"), F.lit("Indication(s)"), F.lit("Adverse Drug Reactions"))
    words = F.split("text", " ")
    cell = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    record = F.when(F.col("turn") % 3 == 2, F.array(F.lit(""), cell(0), F.lit(""), F.col("text"))).otherwise(F.array(F.concat((F.col("turn") + 1).cast("string"), F.lit(".")), cell(0), cell(1), F.col("text")))
    shut = F.array(F.lit("Healthcare professionals are advised"))
    rows = t.filter(kind != 1).select("conv_id", "turn", F.explode(F.when(F.col("turn") == 0, F.array(F.array(F.lit("9"), F.lit("too early")), head, record)).when(F.col("turn") % 6 == 5, F.array(shut, record, head)).otherwise(F.array(record))).alias("cells"))
    rows = rows.withColumn("nth", F.when(F.array_contains("cells", "too early"), 0).when(F.size("cells") == 1, 0).when(F.get("cells", 0) == "S No", F.when(F.col("turn") == 0, 1).otherwise(2)).otherwise(F.when(F.col("turn") == 0, 2).otherwise(1)))
    entry = F.concat((F.col("turn") + 1).cast("string"), F.lit(" "), cell(0), F.when(F.col("turn") % 4 == 3, " ").otherwise(" used for pain. "), F.regexp_replace("text", "(?m)^\\s*\\d+", ""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"]), "\n")
    texts = t.groupBy("conv_id").agg(F.concat(F.lit("PvPI File No. 7/2 Dated: 3 May\nS. No Suspected Drugs Indication Adverse Drug Reactions\n"), body, F.lit("\nHealthcare Professionals, report.")).alias("text"))
    return assemble.safety_alerts(texts, rows, "conv_id", ["turn", "nth"])


@query("W09_sequence_records")
def sequence(d: Domain) -> DataFrame:
    """Bans: what holds a digit or speaks of a notification is the notification, what comes before is the name."""
    return listings.listed(numbered_lines(d, "\n=====\nSr. No.", "\nGSR 578 Dated3 . 05 . 20 04", "\n\n  and others"), "conv_id", "turn", "bans")


@query("W09_approval_records")
def approvals(d: Domain) -> DataFrame:
    return listings.listed(numbered_lines(d, "\nfor treatment of pain\n12.05.2020.", "\n7/8/99\nlater on", "\nName Of Drug\nand more"), "conv_id", "turn", "approvals")


@query("W09_notice_records")
def notices(d: Domain) -> DataFrame:
    number = F.concat((F.col("turn") % 4).cast("string"), F.lit(".\n"))
    more = F.when(F.col("turn") % 3 == 0, "\nX Pharma 2 Letters\nnot read").when(F.col("turn") % 3 == 1, "\nNAME OF COMPANY\n1letter").otherwise("")
    return listings.listed(d.table("conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, number).otherwise(""), "text", more).alias("text")), "conv_id", "turn", "notices")


@query("W10_context", "SELECT conv_id, turn, coalesce(substr(lag(text) OVER w, 1, 500), '') AS before, coalesce(substr(lead(text) OVER w, 1, 500), '') AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def context(d: Domain) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = lambda c: F.coalesce(F.substring(c, 1, 500), F.lit(""))
    return d.table("conversations").select("conv_id", "turn", near(F.lag("text").over(w)).alias("before"), near(F.lead("text").over(w)).alias("after"))


@query("W21_running_rows", "SELECT conv_id, turn, 'Page ' || conv_id || ', Row ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS location FROM conversations")
def running_rows(d: Domain) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return d.table("conversations").select("conv_id", "turn", F.format_string("Page %d, Row %d", "conv_id", F.row_number().over(w)).alias("location"))


# Set operations


@query("U01_keyed_union", "SELECT k, arg_max(src, rank) AS src FROM (SELECT o_orderkey AS k, 'a' AS src, 1 AS rank FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'b', 2 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'c', 3 FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'rest', 0 FROM orders) GROUP BY k")
def keyed_union(d: Domain) -> DataFrame:
    part = lambda m, s, r: d.table("orders").filter(F.col("o_orderkey") % m == 0).select(F.col("o_orderkey").alias("k"), F.lit(s).alias("src"), F.lit(r).alias("rank"))
    return part(2, "a", 1).unionByName(part(3, "b", 2)).unionByName(part(5, "c", 3)).unionByName(part(1, "rest", 0)).groupBy("k").agg(F.max_by("src", "rank").alias("src"))


@query("U02_except_intersect", "(SELECT 'except' AS op, c_custkey AS k FROM customer EXCEPT SELECT 'except', o_custkey FROM orders) UNION ALL (SELECT 'both', c_custkey FROM customer INTERSECT SELECT 'both', o_custkey FROM orders)")
def except_intersect(d: Domain) -> DataFrame:
    c, o = d.table("customer").select(F.col("c_custkey").alias("k")), d.table("orders").select(F.col("o_custkey").alias("k"))
    return c.subtract(o).select(F.lit("except").alias("op"), "k").unionByName(c.intersect(o).select(F.lit("both").alias("op"), "k"))


@query("U03_unmatched_both", "SELECT 'left' AS side, doc_id AS k FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations) UNION ALL SELECT 'right', conv_id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT doc_id FROM documents)")
def unmatched(d: Domain) -> DataFrame:
    a, b = docs(d).select(F.col("doc_id").alias("k")), d.table("conversations").select(F.col("conv_id").alias("k")).distinct()
    return a.join(b, "k", "left_anti").select(F.lit("left").alias("side"), "k").unionByName(b.join(a, "k", "left_anti").select(F.lit("right").alias("side"), "k"))


@query("U04_token_overlap", "SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['small', 'ring', 'bolt']))::BIGINT AS shared FROM part")
def token_overlap(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", F.size(F.array_intersect(F.split("p_name", " "), F.array(*[F.lit(x) for x in ("small", "ring", "bolt")]))).cast("long").alias("shared"))


@query("U05_entity_union", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), ['ring', lower(p_type)]))), ',') AS names FROM part")
def entity_union(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", F.array_join(F.array_sort(F.array_union(F.split("p_name", " "), F.array(F.lit("ring"), F.lower("p_type")))), ",").alias("names"))


@query("U06_ordered_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY t) AS kinds FROM (SELECT user_id, event_type, min({'ts': ts, 'e': event_id}) AS t FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_distinct(d: Domain) -> DataFrame:
    first = d.table("events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("t"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("U07_union_all", "SELECT 'doc' AS src, doc_id AS k FROM documents UNION ALL SELECT 'page', page_id FROM pages UNION ALL SELECT 'item', item_id FROM benchmark")
def union_all(d: Domain) -> DataFrame:
    part = lambda t, k, s: d.table(t).select(F.lit(s).alias("src"), F.col(k).alias("k"))
    return part("documents", "doc_id", "doc").unionByName(part("pages", "page_id", "page")).unionByName(part("benchmark", "item_id", "item"))


# Filters and projections


@query("P03_alert_columns", "SELECT p_partkey, p_partkey::VARCHAR AS s_no, p_name AS product, 'B-' || p_partkey AS batch, p_brand AS maker, p_type AS reason FROM part")
def alert_columns(d: Domain) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), v.alias("value")) for i, (n, v) in enumerate([("Sl No.", F.col("p_partkey").cast("string")), ("Name of Drug", F.lit("old")), ("Product Name", F.col("p_name")), ("Column_3", F.concat(F.lit("B-"), F.col("p_partkey").cast("string"))), ("Manufactured By as per label", F.col("p_brand")), ("Reasons for failure", F.col("p_type"))])])
    rows = d.dealt("part", "p_partkey", size=SMALL_TASK_BYTES).select("p_partkey", F.explode(pairs).alias("x")).select("p_partkey", "x.*")
    a = assemble.alert_rows(rows, ["p_partkey"])
    return a.select("p_partkey", F.col("S No").alias("s_no"), F.col("Name of Drugs/medical device/cosmetics").alias("product"), F.col("Batch No").alias("batch"), F.col("Manufactured By").alias("maker"), F.col("Reason for failure").alias("reason"))


@query("P08_noise_rows", r"SELECT doc_id, regexp_matches(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '^page\s+\d+\s+of\s+\d+') OR trim(regexp_replace(text, '\s+', ' ', 'g')) = '' OR contains(lower(text), 'confidential') AS noise FROM documents")
def noise(d: Domain) -> DataFrame:
    return docs(d).select("doc_id", assemble.is_noise(F.array(F.col("text"))).alias("noise"))


@query("P20_composite_keys", "SELECT o_orderkey, 'cdsco:' || lower(o_orderstatus) || ':' || lower(o_orderpriority) AS source_key FROM orders")
def composite_keys(d: Domain) -> DataFrame:
    part = lambda c: F.lower(text.collapse(text.blank(F.col(c))))
    return d.table("orders").select("o_orderkey", F.concat_ws(":", F.lit("cdsco"), part("o_orderstatus"), part("o_orderpriority")).alias("source_key"))


@query("P21_long_parts", "SELECT conv_id, turn FROM conversations WHERE length(text) >= 40 OR role = 'system'")
def long_parts(d: Domain) -> DataFrame:
    return d.table("conversations").filter((F.length("text") >= 40) | (F.col("role") == "system")).select("conv_id", "turn")


# Functions


_FOLDED = "replace(" * 11 + "text" + "".join(f", '{a}', '{b}')" for a, b in zip("ßẞſŉǰﬀﬁﬂﬃﬄﬆ", ("ss", "ss", "s", "ʼn", "ǰ", "ff", "fi", "fl", "ffi", "ffl", "st"), strict=True))


@query("F02_normalized_words", f"SELECT doc_id, trim(regexp_replace(lower({_FOLDED}), '[^a-z0-9]+', ' ', 'g')) AS words FROM documents")
def normalized_whole(d: Domain) -> DataFrame:
    return docs(d).select("doc_id", text.casefold_words(F.col("text")).alias("words"))


@query("F05_organization_names", "SELECT s_suppkey, s_name AS name, 'Plot 5, ' || n_name AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def organization_names(d: Domain) -> DataFrame:
    s = d.table("supplier").join(F.broadcast(d.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    v = text.organization_and_address(F.concat(F.lit("M/s. "), F.col("s_name"), F.lit(",  P No. 5, "), F.col("n_name"), F.lit(" Batch No: 7")))
    return s.select("s_suppkey", v["name"].alias("name"), F.regexp_replace(v["address"], "^P No\\. ", "Plot ").alias("address"))


@query("F07_formulation", "SELECT p_partkey, p_name || ',' || lower(p_type) AS ingredients, 'TABLETS' AS dosage_form, p_size || ' mg' AS strength FROM part")
def formulations(d: Domain) -> DataFrame:
    f = text.formulation(F.concat(F.lit("FDC of "), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" mg + "), F.lower("p_type"), F.lit(" IP Tablets")))
    return d.table("part").select("p_partkey", F.array_join(F.transform(f["ingredients"], lambda i: i["name"]), ",").alias("ingredients"), f["dosage_form"].alias("dosage_form"), f["strength"].alias("strength"))


@query("F08_batch_details", "SELECT p_partkey, 'B' || p_partkey AS batch_number, '08/2022' AS made, '07/2024' AS expires, p_brand AS maker FROM part")
def batch_details(d: Domain) -> DataFrame:
    b = text.batch_details(F.concat(F.lit("B.No. B"), F.col("p_partkey").cast("string"), F.lit(" Mfg dt: 08/2022 Exp dt: 07/2024 Mfd by: "), F.col("p_brand")))
    return d.table("part").withColumn("b", b).select("p_partkey", "b.*")


@query("F10_cas_numbers", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '103-90-2' ELSE '' END AS cas FROM part")
def cas(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", text.cas_number(F.when(F.col("p_partkey") % 2 == 0, "CAS 103-90-2 x").otherwise("unknown")).alias("cas"))


@query("F14_output_keys", "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')[1:120] AS name FROM pages")
def output_keys(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", text.safe_file_name(F.col("url")).alias("name"))


@query("F19_content_tokens", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')))::BIGINT AS tokens FROM documents")
def tokens_whole(d: Domain) -> DataFrame:
    return docs(d).select("doc_id", F.size(text.content_tokens(F.col("text"))).cast("long").alias("tokens"))


@query("F19_sample_text", "SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text ELSE array_to_string([substr(text, round_even(i * (length(text) - 800) / 4.0, 0)::INT + 1, 800) for i in [0, 1, 2, 3, 4]], chr(10) || '...' || chr(10)) END AS sample FROM documents")
def samples(d: Domain) -> DataFrame:
    return docs(d).select("doc_id", text.sample_text(F.col("text")).alias("sample"))


@query("F20_load_dates", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_day, strftime(o_orderdate, '%Y-%m-%d') AS full_day FROM orders")
def load_dates(d: Domain) -> DataFrame:
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    return d.table("orders").select("o_orderkey", iso(dates.load_date(F.date_format("o_orderdate", "MM/yyyy"))).alias("month_day"), iso(dates.load_date(F.date_format("o_orderdate", "d-M-yyyy"))).alias("full_day"))


@query("F21_strict_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def strict_dates(d: Domain) -> DataFrame:
    t = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "MMM yyyy"))
    return d.table("orders").select("o_orderkey", F.date_format(dates.strict_date(t), "yyyy-MM-dd").alias("day"))


@query("F23_release_dates", "SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE date_trunc('month', o_orderdate) END, '%Y-%m-%d') AS day FROM orders")
def release_dates(d: Domain) -> DataFrame:
    t = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MMM-dd")).otherwise(F.upper(F.date_format("o_orderdate", "MMMM yyyy")))
    return d.table("orders").select("o_orderkey", F.date_format(dates.release_date(t), "yyyy-MM-dd").alias("day"))


@query("F24_file_periods", "SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') ELSE '' END AS day, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%B %Y') ELSE '' END AS label FROM orders")
def periods(d: Domain) -> DataFrame:
    p = dates.period_of_file(F.concat(F.lit("alert_"), F.date_format("o_orderdate", "MMMM_yyyy"), F.lit(".pdf")))
    return d.table("orders").select("o_orderkey", p["day"].alias("day"), p["label"].alias("label"))


@query("F25_barcode_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def barcode_dates(d: Domain) -> DataFrame:
    t = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyMM"), F.lit("00"))).otherwise(F.date_format("o_orderdate", "yyMMdd"))
    return d.table("orders").select("o_orderkey", dates.barcode_date(t).alias("day"))


@query("F26_utc_times", "SELECT event_id, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def utc_times(d: Domain) -> DataFrame:
    t = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))
    return d.table("events").select("event_id", F.date_format(dates.utc_time(t), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("F31_base64_ids", "SELECT o_orderkey, o_orderkey AS decoded FROM orders")
def base64_ids(d: Domain) -> DataFrame:
    return d.table("orders").select("o_orderkey", codes.decoded_number(F.base64(F.col("o_orderkey").cast("string").cast("binary"))).alias("decoded"))


@query("F32_gtin_check", "WITH g AS (SELECT p_partkey, lpad((400000000000 + p_partkey * 7919)::VARCHAR, 13, '0') AS c FROM part) SELECT p_partkey, list_sum([substr(c, 14 - i, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END for i in range(1, 14)]) % 10 = 0 AS valid FROM g")
def gtin(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", codes.gtin_is_valid(F.lpad((F.lit(400000000000) + F.col("p_partkey") * 7919).cast("string"), 13, "0")).alias("valid"))


@query("F33_bracketed_elements", "SELECT p_partkey, 'L' || p_partkey AS lot, '251231' AS expires FROM part")
def elements(d: Domain) -> DataFrame:
    m = codes.bracketed_elements(F.concat(F.lit("(01)04006381333931(17)251231(10)L"), F.col("p_partkey").cast("string")))
    return d.table("part").select("p_partkey", F.try_element_at(m, F.lit("10")).alias("lot"), F.try_element_at(m, F.lit("17")).alias("expires"))


@query("F33_element_strings")
def element_strings(d: Domain) -> DataFrame:
    return d.table("part").select("p_partkey", F.to_json(codes.element_string(F.concat(F.lit("010400638133393117251231" + "10L"), F.col("p_partkey").cast("string")))).alias("elements"))


@query("F41_document_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def document_text(d: Domain) -> DataFrame:
    turns = d.table("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("pages"))
    return turns.select("conv_id", nested.document_text(F.lit(""), F.col("pages"), F.array().cast("array<array<string>>")).alias("body"))


@query("F42_tolerant_json", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props END AS body FROM events")
def tolerant(d: Domain) -> DataFrame:
    broken = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("{"), F.col("props")))
    return d.table("events").select("event_id", nested.json_or_null(broken).alias("body"))


@query("F43_repaired_messages")
def repaired(d: Domain) -> DataFrame:
    body = F.concat(F.lit("{source: aws.ecs, kind: "), F.col("event_type"), F.lit(", n: "), F.col("user_id").cast("string"), F.lit("}"))
    return d.table("events").select("event_id", nested.repaired_json(body).alias("body"))


@query("F45_provenance", """SELECT p_partkey, '{"name":"' || p_name || '","_pipeline":"{\\"event_type_source\\":\\"INFERRED\\",\\"event_date_source\\":\\"MISSING\\",\\"action_source\\":\\"EXTRACTED\\"}"}' AS body FROM part""")
def provenance(d: Domain) -> DataFrame:
    rec = F.create_map(F.lit("name"), F.col("p_name"), F.lit("empty"), F.lit(" "))
    return d.table("part").select("p_partkey", nested.with_provenance(rec, F.lit("INFERRED"), F.lit("MISSING"), F.lit("EXTRACTED")).alias("body"))


@query("F48_coalesced_titles", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS title FROM documents")
def titles(d: Domain) -> DataFrame:
    return docs(d).select("doc_id", nested.first_filled(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("  "), F.col("source")).alias("title"))


@query("F49_clipped_text", "SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || ' [...]' ELSE text END AS body FROM documents")
def clipped(d: Domain) -> DataFrame:
    return docs(d).select("doc_id", text.clip(F.col("text"), 300).alias("body"))
