"""Queries of sinks: loads, replacements, manifests, live delivery."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest, sinks, stage
from ..sources import history
from ..sources.driver import Domain
from ..sources.store import shared_folder
from ..streaming import approvals
from ..streaming import events as streaming
from .registry import query
from .runs import APPROVALS_SQL, approval_actions
from .staging import RESOLVED, C, stored


def _folder(d: Domain, name: str) -> str:
    """A folder of its own for every call, under the shared one."""
    return f"{shared_folder(d.spark)}/{name}-{uuid.uuid4().hex[:8]}"


#: Entity tables with the key that the key map has; bridges and rows of a document have no entry in it.
_MAPPED = {"organizations": "organization_key", "ingredients": "ingredient_key", "products": "product_key", "batches": "batch_key"}


@query("K03_idempotent_load", RESOLVED + f""", n AS (SELECT 'organizations' AS relation, count(*) AS n FROM (SELECT organization_key FROM resolved UNION SELECT sha256('org|' || {C('state')} || '|' || {C('state')}) FROM resolved) UNION ALL SELECT 'ingredients', count(DISTINCT ingredient_key) FROM resolved
 UNION ALL SELECT 'products', count(DISTINCT product_key) FROM resolved UNION ALL SELECT 'batches', count(DISTINCT batch_key) FROM resolved UNION ALL SELECT 'regulatory_documents', count(DISTINCT k) FROM resolved UNION ALL SELECT 'raw_source_records', count(DISTINCT source_record_id) FROM resolved
 UNION ALL SELECT 'product_ingredients', count(DISTINCT product_key || ingredient_key) FROM resolved UNION ALL SELECT 'product_organizations', count(DISTINCT product_key || organization_key) FROM resolved UNION ALL SELECT 'regulatory_events', count(DISTINCT event_key) FROM resolved)
 SELECT relation, n::BIGINT AS first_added, 0::BIGINT AS then_added, n::BIGINT AS mapped FROM n""", domain=True)
def idempotent_load(d: Domain) -> DataFrame:
    """All nine relations, loaded twice; ``mapped`` counts the pairs of key and id in the key map, or the stored ids."""
    rows = {n: r for n, r in stage.staging(stored(d, "resolved", stage.COLUMNS)).items() if n in ingest.CONFLICT}
    folder = _folder(d, "load")
    first, then = ingest.load(rows, folder), ingest.load(rows, folder)
    keys = ingest.key_map(folder, d.spark, _MAPPED)
    mapped = keys.groupBy(F.col("entity_type").alias("relation")).agg(F.countDistinct("staging_key", "entity_id").alias("mapped"))
    for n in ingest.CONFLICT:
        if n not in _MAPPED:
            mapped = mapped.unionByName(ingest.loaded(d.spark, folder, n).agg(F.countDistinct("id").alias("mapped")).withColumn("relation", F.lit(n)))
    counts = d.spark.createDataFrame([(n, first[n], then[n]) for n in ingest.CONFLICT], "relation string, first_added long, then_added long")
    return counts.join(mapped, "relation")


@query("K04_guarded_replace", "SELECT 'region' AS relation, 0 AS refused, count(*)::BIGINT AS deleted, count(*)::BIGINT AS written FROM region UNION ALL SELECT 'nation', 0, count(*), count(*) FROM nation UNION ALL SELECT 'supplier', 0, count(*), count(*) FROM supplier UNION ALL SELECT 'refused', 2, 0, 0")
def guarded_replace(d: Domain) -> DataFrame:
    rows, folder = {n: d.table(n) for n in ("region", "nation", "supplier")}, _folder(d, "replace")
    none, refused = d.spark.createDataFrame([], "finding string"), 0
    for findings, confirmed in ((none, False), (d.spark.createDataFrame([("orphan",)], "finding string"), True)):
        try:
            sinks.replace_all(rows, folder, findings, confirmed, rows)
        except (PermissionError, ValueError):
            refused += 1
    sinks.replace_all(rows, folder, none, True, rows)
    out = [(n, 0, a, b) for n, a, b in sinks.replace_all(rows, folder, none, True, rows)]
    return d.spark.createDataFrame([*out, ("refused", refused, 0, 0)], "relation string, refused int, deleted long, written long")


@query("K06_verdict_rows", """SELECT doc_id::VARCHAR AS doc_id, '' AS "Evidence", quality::VARCHAR AS quality, '' AS roles, toxic::VARCHAR AS toxic FROM labels UNION ALL SELECT conv_id::VARCHAR, '{"turns":' || count(*) || ',"last":' || max(turn) || '}', '', '["' || string_agg(DISTINCT role, '","' ORDER BY role) || '"]', '' FROM conversations GROUP BY conv_id""")
def verdict_rows(d: Domain) -> DataFrame:
    c = d.table("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_set("role")).alias("roles"), F.struct(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last")).alias("Evidence"))
    return sinks.verdict_rows([d.table("labels"), c])


@query("K07_run_manifest", """SELECT *, '{"run_id":' || run_id || ',"documents_count":' || documents_count || ',"has_pdfs":' || has_pdfs || ',"triggered_on":"' || triggered_on || '"}' AS body FROM (SELECT user_id AS run_id, count(*)::BIGINT AS documents_count, bool_or(value > 100) AS has_pdfs, strftime(max(ts), '%Y-%m-%d') AS triggered_on FROM events GROUP BY user_id)""")
def run_manifest(d: Domain) -> DataFrame:
    return sinks.run_manifest(d.table("events"), "user_id", "ts", F.col("value") > 100)


_STAGES = {"view": "processor", "click": "extractor", "purchase": "ingester", "signup": "classifier"}


@query("K07_stage_results", "WITH r AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'processor' WHEN 'click' THEN 'extractor' WHEN 'purchase' THEN 'ingester' WHEN 'signup' THEN 'classifier' ELSE event_type END AS stage, count(*) AS n FROM events GROUP BY ALL) SELECT CASE WHEN user_id % 10 = 0 THEN 'a/' || user_id ELSE user_id::VARCHAR END AS run_id, stage, CASE WHEN user_id % 10 > 0 AND stage <> 'error' THEN 'out/runs/' || user_id || '/results/' || CASE stage WHEN 'processor' THEN 'processor' WHEN 'extractor' THEN 'extracted' WHEN 'ingester' THEN 'ingested' ELSE 'classified' END || '.json' END AS key, CASE WHEN user_id % 10 > 0 AND stage <> 'error' THEN '{\"events\":' || n || ',\"note\":null}' END AS body, CASE WHEN user_id % 10 = 0 THEN 'run_id must be a non-empty path segment' WHEN stage = 'error' THEN 'unsupported result stage: error' END AS error FROM r")
def stage_results(d: Domain) -> DataFrame:
    """What each stage of a run leaves; runs whose name has a slash, and events without a stage, give errors."""
    stage = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _STAGES.items() for x in kv]), F.col("event_type")), F.col("event_type"))
    run = F.concat(F.when(F.col("user_id") % 10 == 0, "a/").otherwise(""), F.col("user_id").cast("string"))
    counts = d.table("events").groupBy(run.alias("run_id"), stage.alias("stage")).agg(F.count(F.lit(1)).alias("events"), F.lit(None).cast("string").alias("note"))
    return sinks.stage_results(counts, "out")


@query("K08_atomic_rewrite", "SELECT 'now' AS version, n_nationkey FROM nation WHERE n_regionkey > 1 UNION ALL SELECT 'kept', n_nationkey FROM nation")
def atomic_rewrite(d: Domain) -> DataFrame:
    path, nation = f"{_folder(d, 'rewrite')}/nation", d.table("nation")
    assert sinks.rewrite(nation, path, "1") is None
    backup = sinks.rewrite(sinks.stored(d.spark, path).filter("n_regionkey > 1"), path, "2")
    read = lambda p, v: sinks.stored(d.spark, path, p).select(F.lit(v).alias("version"), "n_nationkey")
    return read(None, "now").unionByName(read(backup, "kept"))


@query("K19_scan_records", "SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'processing' WHEN value > 200 THEN 'unsafe' WHEN value > 100 THEN 'safe' ELSE 'failed' END AS status FROM events")
def scan_records(d: Domain) -> DataFrame:
    e = d.table("events")
    status = F.when(F.col("value") > 200, "unsafe").when(F.col("value") > 100, "safe")
    return sinks.recorded(e.select("event_id", "user_id"), e.filter("event_id % 3 <> 0"), "event_id", status)


@query("S07_staging_csv", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_suppkey % 3 > 0 THEN 'a \"b\", ' || s_nationkey END AS note FROM supplier")
def staging_csv(d: Domain) -> DataFrame:
    k = F.col("s_suppkey")
    rows = d.table("supplier").select(k.cast("string").alias("﻿s_suppkey"), F.concat(F.lit("  "), F.col("s_name"), F.lit(" ")).alias("s_name"), F.when(k % 3 > 0, F.concat(F.lit('a "b", '), F.col("s_nationkey").cast("string"))).otherwise(" ").alias("note"))
    path = _folder(d, "csv")
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return stage.read_csv(d.spark, path)


@query("S24_metadata_override", "SELECT doc_id, CASE doc_id WHEN 3 THEN 'fixed title' WHEN 5 THEN 'other' ELSE source END AS title, CASE doc_id WHEN 5 THEN 'en' ELSE lang END AS lang FROM documents")
def metadata_override(d: Domain) -> DataFrame:
    fixed = d.spark.createDataFrame([(3, "fixed title", ""), (5, "other", "en"), (-1, "no such document", None)], "doc_id long, title string, lang string")
    return sinks.overridden(d.table("documents").select("doc_id", F.col("source").alias("title"), "lang"), fixed, "doc_id")


@query("S17_paged_history", "SELECT 'orders' AS kind, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, o_orderkey::VARCHAR AS k, NULL::VARCHAR AS error FROM orders WHERE month(o_orderdate) <> 2 UNION ALL SELECT DISTINCT 'orders', year(o_orderdate)::INT, 2, NULL, 'unexpected shape: no list of aaData' FROM orders WHERE month(o_orderdate) = 2 UNION ALL SELECT 'parts', 2000, p_size::INT, p_partkey::VARCHAR, NULL FROM part")
def paged_history(d: Domain) -> DataFrame:
    """Orders as answers of their months, those of February in another shape, and parts as a second kind."""
    folder = _folder(d, "history")
    answer = lambda list_, bad: F.to_json(F.when(bad, F.struct(F.lit(None).cast("array<struct<k:string>>").alias("aaData"), F.lit("down").alias("state"))).otherwise(F.struct(list_.alias("aaData"), F.lit(None).cast("string").alias("state"))))
    listed = F.collect_list(F.struct("k"))  # an answer is a month's page
    o = d.table("orders").select(F.lit("orders").alias("kind"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_orderkey").cast("string").alias("k"))
    p = d.table("part").select(F.lit("parts").alias("kind"), F.lit(2000).alias("year"), F.col("p_size").cast("int").alias("month"), F.col("p_partkey").cast("string").alias("k"))
    pages = o.unionByName(p).groupBy("kind", "year", "month").agg(answer(listed, (F.first("kind") == "orders") & (F.first("month") == 2)).alias("value"))
    pages.write.partitionBy("kind", "year", "month").text(folder)
    r = history.records(history.answers(d.spark, folder, ["orders", "parts"]))
    return r.select("kind", "year", "month", F.try_element_at("record", F.lit("k")).alias("k"), "error")


@query("S25_inspection", """SELECT 'nation' AS relation, 0 AS line, 'n_nationkey,n_name,n_regionkey' AS content UNION ALL SELECT 'region', 0, 'r_regionkey,r_name' UNION ALL (SELECT 'nation', row_number() OVER (ORDER BY n_nationkey, n_name, n_regionkey)::INT AS line, n_nationkey || ',' || n_name || ',' || n_regionkey FROM nation QUALIFY line <= 3)
 UNION ALL (SELECT 'region', row_number() OVER (ORDER BY r_regionkey, r_name)::INT AS line, r_regionkey || ',' || r_name FROM region QUALIFY line <= 3)""")
def inspection(d: Domain) -> DataFrame:
    return sinks.inspected({"nation": d.table("nation"), "region": d.table("region")})


_LISTED = "(SELECT '{0}/{1}' AS relation, 0 AS line, '{2}' AS content) UNION ALL (SELECT '{0}/{1}', row_number() OVER (ORDER BY {3})::INT AS line, {4} FROM {1} QUALIFY line <= 2)"


@query("S25_folder_inspection", _LISTED.format("a", "nation", "n_nationkey,n_name,n_regionkey", "n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR", "n_nationkey || ',' || n_name || ',' || n_regionkey") + " UNION ALL " + _LISTED.format("b", "region", "r_regionkey,r_name", "r_regionkey::VARCHAR, r_name", "r_regionkey || ',' || r_name"))
def folder_inspection(d: Domain) -> DataFrame:
    """Two tables as CSV in folders of folders, beside one that has other files."""
    folder = _folder(d, "listed")
    for name, kind in (("a/nation", "csv"), ("b/region", "csv"), ("b/other", "json")):
        d.table("nation" if "nation" in name else "region").write.format(kind).option("header", True).save(f"{folder}/{name}")
    return sinks.inspected_folder(d.spark, folder, 2)


@query("F47_role_rows", "SELECT p_partkey, p_brand AS organization, 'MANUFACTURER' AS role FROM part UNION ALL SELECT p_partkey, p_type, 'IMPORTER' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, p_name, 'APPLICANT' FROM part WHERE p_size > 25")
def role_rows(d: Domain) -> DataFrame:
    roles = {"MANUFACTURER": F.col("p_brand"), "IMPORTER": F.when(F.col("p_size") % 2 == 0, F.col("p_type")), "APPLICANT": F.when(F.col("p_size") > 25, F.col("p_name")), "MARKETING_AUTHORIZATION_HOLDER": F.lit(None).cast("string")}
    return sinks.role_rows(d.table("part"), ["p_partkey"], roles)


@query("X09_claimable_work", "SELECT event_id, event_type <> 'purchase' AND (event_id % 3 = 0 OR epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(date_trunc('second', ts)) > 900) AS free FROM events")
def claimable(d: Domain) -> DataFrame:
    work = d.table("events").select("event_id", F.col("event_id").alias("item"), F.when(F.col("event_id") % 3 != 0, "worker").alias("claimed_by"), F.col("ts").cast("timestamp").alias("claimed_at"), (F.col("event_type") == "purchase").alias("done"))
    return sinks.claimed(work, 2, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("event_id", F.col("worker").isNotNull().alias("free"))


# Streams


def _messages(d: Domain) -> DataFrame:
    """Each event as a message of a run; one of five is sent twice, one of eleven is broken."""
    body = F.to_json(F.struct(F.lit("aws.cloudwatch").alias("source"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.col("user_id").cast("string").alias("run_id"), F.struct(F.col("event_type").alias("status")).alias("detail")))
    e = d.table("events").select(F.col("event_id").cast("string").alias("message_id"), F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(body).alias("body"), F.when(F.col("event_id") % 2 == 0, 3).otherwise(1).alias("attempts"))
    return e.unionByName(e.filter("cast(message_id as long) % 5 = 0"))


def _consumed(d: Domain, publish=None) -> DataFrame:
    folder, m = _folder(d, "queue"), _messages(d)
    # three batches, each of as many files as there are tasks to parse them
    files = min(d.spark.sparkContext.defaultParallelism, 32)
    m.repartition(3 * files).write.parquet(f"{folder}/in")
    stream = streaming.parsed(streaming.file_stream(d.spark, f"{folder}/in", m.schema, files))
    streaming.consume(stream.filter("not bad"), f"{folder}/out", f"{folder}/state", publish).awaitTermination()
    return d.spark.read.parquet(f"{folder}/out")


@query("S20_queue_messages", "SELECT event_id::VARCHAR AS event_id, 'alarm.state_change' AS event_type, user_id::VARCHAR AS run_id, event_type AS status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_id % 11 <> 0")
def queue_messages(d: Domain) -> DataFrame:
    return _consumed(d).select("event_id", "event_type", "run_id", "status", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("at"))


def _spans(rows: DataFrame, at: str, n: int) -> list[DataFrame]:
    """rows in n spans of equal time, the earliest first."""
    low, high = rows.agg(F.min(at).cast("timestamp"), F.max(at).cast("timestamp")).first()
    if low is None:
        return [rows]
    part = F.least(F.floor((F.col(at).cast("timestamp").cast("double") - low.timestamp()) / max((high - low).total_seconds(), 1e-6) * n), F.lit(n - 1))
    return [rows.filter(part == i) for i in range(n)]


@query("X02_streamed_once", "SELECT event_id, user_id FROM events")
def streamed_once(d: Domain) -> DataFrame:
    """Events in three rounds, each a stream that starts anew from its checkpoint; some come twice in a round, some again in a later one."""
    folder, e, before = _folder(d, "once"), d.table("events").select("event_id", "user_id", "ts"), None
    for span in _spans(e, "ts", 3):
        sent = span.unionByName(span.filter("event_id % 3 = 0"))
        sent = sent if before is None else sent.unionByName(before.filter("event_id % 5 = 0"))
        sent.write.mode("append").parquet(f"{folder}/in")
        streaming.consume(d.spark.readStream.schema(e.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
        before = span if before is None else before.unionByName(span)
    return d.spark.read.parquet(f"{folder}/out").select("event_id", "user_id")


@query("X06_streamed_approvals", APPROVALS_SQL)
def streamed_approvals(d: Domain) -> DataFrame:
    """The actions of all runs in four rounds; the machine's state lives on in the checkpoint between them."""
    folder, a = _folder(d, "approvals"), approval_actions(d).withColumn("run_id", F.col("run_id").cast("string"))
    for span in _spans(a, "at", 4):
        span.write.mode("append").parquet(f"{folder}/in")
        approvals.run(d.spark.readStream.schema(a.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
    out = approvals.states(d.spark, f"{folder}/out")
    return out.select(F.col("run_id").cast("long").alias("run_id"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("decided_by", F.lit("")).alias("decided_by"))


@query("K13_live_delivery", "SELECT * FROM (VALUES ('gone', 0::BIGINT, false), ('there', 3::BIGINT, true)) t(client, received, live)")
def live_delivery(d: Domain) -> DataFrame:
    got: dict[str, list[str]] = {"there": [], "gone": []}

    def gone(_: str) -> None:
        raise ConnectionError("closed")

    clients = {"there": got["there"].append, "gone": gone}
    _consumed(d, lambda batch: sinks.deliver([str(batch.count())], clients))  # one message a batch
    return d.spark.createDataFrame([(n, len(m), n in clients) for n, m in got.items()], "client string, received long, live boolean")


@query("X08_envelopes", """SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'alarm.state_change' END AS event_type, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'aws.cloudwatch' END AS source, CASE WHEN event_id % 11 <> 0 THEN user_id::VARCHAR END AS run_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS status, event_id % 11 = 0 AS bad,
 CASE WHEN event_id % 11 <> 0 THEN 'good' WHEN event_id % 2 = 0 THEN 'dropped' ELSE 'retried' END AS fate FROM events""")
def envelopes(d: Domain) -> DataFrame:
    parsed = streaming.parsed(_messages(d).dropDuplicates(["message_id"]))
    out = None
    for fate, part in zip(("good", "retried", "dropped"), streaming.split_poison(parsed), strict=True):
        p = part.select("event_id", "event_type", "source", "run_id", "status", "bad", F.lit(fate).alias("fate"))
        out = p if out is None else out.unionByName(p)
    return out
