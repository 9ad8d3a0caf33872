"""Queries of layout, chunks, archetypes and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from ..sources.driver import Domain
from ..streaming import events
from .registry import query


def boxes(d: Domain) -> DataFrame:
    """Rectangles from order lines: a page an order."""
    li = d.table("lineitem")
    x0, y0 = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    return li.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).cast("int").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + F.col("l_linenumber") * 3).cast("double").alias("y1"), F.col("l_shipdate").cast("string").alias("text")).distinct()


_B = "SELECT DISTINCT l_orderkey AS doc, (l_linenumber % 2)::INT AS page, (l_partkey % 50)::DOUBLE AS x0, (l_suppkey % 40)::DOUBLE AS y0, (l_partkey % 50)::DOUBLE + l_quantity AS x1, (l_suppkey % 40 + l_linenumber * 3)::DOUBLE AS y1 FROM lineitem"


@query("A20_covered_area", f"""WITH b AS ({_B}), xs AS (SELECT DISTINCT doc, page, unnest([x0, x1]) AS x FROM b), s AS (SELECT *, lead(x) OVER (PARTITION BY doc, page ORDER BY x) AS nxt FROM xs), ys AS (SELECT DISTINCT doc, page, unnest([y0, y1]) AS y FROM b), t AS (SELECT *, lead(y) OVER (PARTITION BY doc, page ORDER BY y) AS nxt FROM ys),
 c AS (SELECT s.doc, s.page, (s.nxt - s.x) * (t.nxt - t.y) AS a FROM s JOIN t ON s.doc = t.doc AND s.page = t.page WHERE s.nxt > s.x AND t.nxt > t.y AND EXISTS (SELECT 1 FROM b WHERE b.doc = s.doc AND b.page = s.page AND b.x0 <= s.x AND b.x1 >= s.nxt AND b.y0 <= t.y AND b.y1 >= t.nxt)) SELECT doc, page, round(sum(a), 3) AS area FROM c GROUP BY ALL""")
def area(d: Domain) -> DataFrame:
    return layout.coverage(boxes(d), ["doc", "page"]).withColumn("area", F.round("area", 3))


@query("J20_spatial_overlap", f"WITH b AS ({_B}), t AS (SELECT * FROM b WHERE x1 - x0 > 30) SELECT b.doc, b.page, b.x0, b.y0, b.x1, b.y1, coalesce(bool_or(least(b.x1, t.x1) > greatest(b.x0, t.x0) AND least(b.y1, t.y1) > greatest(b.y0, t.y0) AND (least(b.x1, t.x1) - greatest(b.x0, t.x0)) * (least(b.y1, t.y1) - greatest(b.y0, t.y0)) >= 0.35 * (b.x1 - b.x0) * (b.y1 - b.y0)), false) AS in_table FROM b LEFT JOIN t ON b.doc = t.doc AND b.page = t.page GROUP BY ALL")
def overlap(d: Domain) -> DataFrame:
    b = boxes(d).drop("text").distinct()
    return layout.blocks_in_tables(b, b.filter("x1 - x0 > 30"), ["doc", "page"])


@query("J21_continued_tables", "WITH t AS (SELECT user_id AS doc, event_id AS page, [value, value + 10] AS starts, lead(event_id) OVER w AS p, lead(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT doc, page, coalesce(p = page + 1 AND abs(starts[1] - v) <= 25, false) AS continues FROM t")
def continued(d: Domain) -> DataFrame:
    t = d.table("events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("page"), F.array(F.col("value"), F.col("value") + 10).alias("starts"))
    return layout.continued_tables(t, "doc").select("doc", "page", "continues")


#: Archetypes of the shape that alert tables have, and headers that fill them whole, in part, twice, with OCR faults, and not at all.
ARCHETYPES = [
    layout.Archetype("failed samples", (("s no", "sr no"), ("name of drug", "product name"), ("batch no", "batch number"), ("reason for failure", "reasons for failure")), (("manufactured by", "manufacturer"), ("date of expiry", "expiry date"))),
    layout.Archetype("state alert", (("s no", "sr no"), ("product name", "drug name"), ("batch no", "batch number"), ("nsq result",)), (("manufactured by", "manufacturer"),)),
    layout.Archetype("recall", (("product name", "name of drug"), ("lot no", "batch no"), ("recall date",))),
    layout.Archetype("contacts", (("ministry or state",), ("contact directory", "laboratory name"))),
]
_HEADERS = (
    ("S. No.", "Name of drug", "Batch No", "Reason for failure", "Manufactured by"), ("Sr No", "Product Name", "Batch number", "NSQ Result", None), ("s no", "product name", "batch no"), ("Name of drug", "Lot No.", "Recall date"),
    ("S No", "Name of drvg", "Batch No.", "Reasons for fai1ure", "Expiry date"), ("Product name", "Product name", "Batch no", "NSQ result"), ("Ministry or State", "Contact directory"), ("batch no",), ("क्रम", "दवा", "batch no", "product name"), (),
)


@query("J18_header_archetypes")
def archetypes(d: Domain) -> DataFrame:
    """A table a part; its cells come from the headers above, the last one is the part's own name."""
    k = (F.col("p_partkey") % len(_HEADERS) + 1).cast("int")
    cells = F.concat(F.element_at(F.array(*[F.array(*[F.lit(c) for c in h]).cast("array<string>") for h in _HEADERS]), k), F.array("p_name"))
    h = d.table("part").select(F.col("p_partkey").alias("table_id"), F.when(F.col("p_size") % 5 == 0, F.reverse(cells)).otherwise(cells).alias("cells"))
    return layout.header_archetypes(h, ARCHETYPES)


@query("S18_selected_pages", "SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([0, 1, n - 1], lambda i: i >= 0 AND i < n))), ',') AS pages FROM (SELECT o_orderkey, (o_orderkey % 5)::INT AS n FROM orders)")
def selected(d: Domain) -> DataFrame:
    n = (F.col("o_orderkey") % 5).cast("int")
    return d.table("orders").select("o_orderkey", F.array_join(F.array_sort(layout.selected_pages(n)).cast("array<string>"), ",").alias("pages"))


@query("S26_aligned_columns")
def aligned(d: Domain) -> DataFrame:
    return layout.aligned_columns(boxes(d), ["doc", "page"])


def lines(d: Domain) -> DataFrame:
    """Every line of every document as a line of a page of 60, larger, indented or in the middle now and then."""
    each = d.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    place = F.col("n") % 60
    x0 = F.when(F.col("n") % 11 == 0, 60.0).otherwise(50.0) + F.when(F.col("n") % 13 == 0, 150.0).otherwise(0.0)
    y0 = 20.0 + place * 13.0 + F.when(place % 9 == 0, 9.0).otherwise(0.0)
    x1 = F.least(x0 + F.length("text") * 5.0, F.lit(560.0))
    size = F.when(F.col("n") % 17 == 0, 14.0).when(F.col("n") % 19 == 0, 0.0).otherwise(10.0)
    return each.select("doc_id", (F.col("n") / 60).cast("int").alias("page"), "n", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 11.0).alias("y1"), size.alias("size"), "text")


_L = """l AS (SELECT doc_id, n, text, n % 60 AS place FROM (SELECT doc_id, unnest(range(0, len(x)))::INT AS n, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
 b AS (SELECT *, (n // 60)::INT AS page, CASE WHEN n % 11 = 0 THEN 60.0 ELSE 50.0 END + CASE WHEN n % 13 = 0 THEN 150.0 ELSE 0.0 END AS x0, 20.0 + place * 13.0 + CASE WHEN place % 9 = 0 THEN 9.0 ELSE 0.0 END AS y0, CASE WHEN n % 17 = 0 THEN 14.0 WHEN n % 19 = 0 THEN 0.0 ELSE 10.0 END AS size,
 trim(regexp_replace(regexp_replace(text, '([\\p{L}\\p{N}_]+)-\\n([\\p{L}\\p{N}_]+)', '\\1\\2', 'g'), '[\\s\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')) AS t FROM l),
 c AS (SELECT *, least(x0 + length(text) * 5.0, 560.0) AS x1, y0 + 11.0 AS y1 FROM b),
 m AS (SELECT doc_id, coalesce(median(CASE WHEN size > 0 THEN size END), 10.0) AS m FROM c WHERE t <> '' GROUP BY doc_id), p AS (SELECT doc_id, page, max(y1) AS deep, max(x1) AS wide FROM c WHERE t <> '' GROUP BY doc_id, page)"""


@query("R14_line_labels", f"""WITH {_L} SELECT doc_id, n, CASE WHEN y0 < 0.08 * deep THEN 'HEADER' WHEN y1 > 0.92 * deep THEN 'FOOTER' WHEN size > 1.2 * m OR abs((x0 + x1) / 2 - wide / 2) < 0.15 * wide AND length(t) < 60 AND NOT ends_with(t, '.') THEN 'TITLE' ELSE 'PARAGRAPH' END AS label
 FROM c JOIN m USING (doc_id) JOIN p USING (doc_id, page) WHERE t <> ''""")
def labels(d: Domain) -> DataFrame:
    return layout.line_labels(layout.lines_of_text(lines(d)), "doc_id").select("doc_id", "n", "label")


@query("W11_paragraphs")
def paragraphs(d: Domain) -> DataFrame:
    return layout.paragraphs(layout.line_labels(layout.lines_of_text(lines(d)), "doc_id"), "doc_id")


def blocks(d: Domain) -> DataFrame:
    """Order lines as recognized blocks: a page a supplier and month; rows lean, overlap and share centres."""
    li = d.table("lineitem")
    k, day = F.col("l_orderkey"), F.col("l_shipdate")
    y0 = (F.col("l_partkey") * 7 % 160) * 2.5 + F.col("l_linenumber")
    words = F.element_at(F.array(*[F.lit(x) for x in ("BATCH NO", "Remarks:", "Page 3 of 9", "tablets of", "not of standard quality", "Printed by the Manager, Press", "assay", "")]), (k % 8 + 1).cast("int"))
    return li.select(
        F.col("l_suppkey").alias("doc"), (F.year(day) * 100 + F.month(day)).alias("page"), (k * 10 + F.col("l_linenumber")).alias("id"), (k % 23 * 20).cast("double").alias("x0"), y0.cast("double").alias("y0"), (k % 23 * 20 + 15).cast("double").alias("x1"),
        (y0 + 6 + F.col("l_quantity") % 12).cast("double").alias("y1"), words.alias("text"), (F.col("l_discount") * 10).cast("double").alias("confidence"),
    )


@query("W12_visual_rows")
def visual_rows(d: Domain) -> DataFrame:
    return layout.ocr_rows(blocks(d), "doc")


@query("W12_photographed_rows")
def photographed_rows(d: Domain) -> DataFrame:
    return layout.reading_rows(blocks(d), "doc")


@query("W13_block_paragraphs")
def block_paragraphs(d: Domain) -> DataFrame:
    """Blocks of odd rows whose text speaks of batches have gone into tables."""
    b = blocks(d)
    return layout.ocr_paragraphs(b, "doc", b.filter("text = 'BATCH NO' and id % 2 = 1").select("doc", "page", "id"))


@query("W14_markdown_chunks")
def chunks(d: Domain) -> DataFrame:
    """Whole texts; every fifth line is a heading of one of four levels, and a block may go on over a line."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), (i / 5 % 4 + 1).cast("int")), F.lit(" "), x, F.lit(" ##"))).otherwise(x))
    marked = F.array_join(F.transform(line, lambda x, i: F.concat(x, F.when(i % 7 == 3, "\n").otherwise("\n \n"))), "")
    return layout.chunk_markdown(d.table("documents").select("doc_id", marked.alias("text")), "doc_id")


@query("X01_parsed_messages", "SELECT event_id::VARCHAR AS event_id, 'ecs.task_state_change' AS event_type, 'run-' || user_id AS run_id, event_type AS status FROM events")
def messages(d: Domain) -> DataFrame:
    e = d.table("events")
    body = F.to_json(F.struct(F.lit("aws.ecs").alias("source"), F.struct(F.col("event_type").alias("status"), F.array(F.struct(F.array(F.lit("--run-id"), F.concat(F.lit("run-"), F.col("user_id").cast("string"))).alias("command"))).alias("containers")).alias("detail")))
    return events.parsed(e.select(F.col("event_id").cast("string").alias("message_id"), body.alias("body"), F.lit(1).alias("attempts"))).select("event_id", "event_type", "run_id", "status")


@query("X03_poison_messages", "SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 10 = 0 THEN CASE WHEN event_id % 20 = 0 THEN 'dropped' ELSE 'retried' END ELSE 'good' END AS fate FROM events")
def poison(d: Domain) -> DataFrame:
    e = d.table("events").select(F.col("event_id").cast("string").alias("message_id"), F.when(F.col("event_id") % 10 == 0, "@@").otherwise(F.col("props")).alias("body"), F.when(F.col("event_id") % 20 == 0, 3).otherwise(1).alias("attempts"))
    parts = [p.select("event_id", F.lit(f).alias("fate")) for p, f in zip(events.split_poison(events.parsed(e)), ("good", "retried", "dropped"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("X07_replay_then_live", "WITH h AS (SELECT event_id FROM events WHERE event_id % 2 = 0 ORDER BY ts DESC, event_id DESC LIMIT 20) SELECT event_id, 'history' AS kind FROM h UNION ALL SELECT event_id, 'live' FROM events WHERE event_id NOT IN (SELECT event_id FROM h)")
def replay(d: Domain) -> DataFrame:
    """Even events are stored, and all come live."""
    e = d.table("events").select("event_id", F.col("ts").alias("event_time"))
    return events.replay_then_live(e.filter("event_id % 2 = 0"), e).select("event_id", "kind")


@query("X11_worker_status", "SELECT user_id AS worker, arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'idle' END, {'t': ts, 's': CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'idle' END}) AS status FROM events GROUP BY user_id")
def workers(d: Domain) -> DataFrame:
    s = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("idle")
    u = d.table("events").select(F.col("user_id").alias("worker"), F.col("ts").alias("at"), s.alias("status"), F.col("props").alias("error"))
    return events.latest_status(u).select("worker", "status")


@query("X12_windowed_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def windows(d: Domain) -> DataFrame:
    e = d.table("events").select(F.col("ts").cast("timestamp").alias("event_time"), "event_type")
    return events.windowed_counts(e).select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
