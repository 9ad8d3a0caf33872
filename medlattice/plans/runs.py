"""Queries of runs, events and orders of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import runs
from ..sources.driver import Domain
from .registry import query


def run_events(d: Domain) -> DataFrame:
    """The event table read as task and machine events of runs."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = d.table("events").withColumn("k", k)
    family = F.when(F.col("event_type") == "click", "data-scraper-task").when(F.col("event_type") == "purchase", "data-extractor-task").when(F.col("event_type") == "signup", "data-classifier-task").when(F.col("event_type") == "view", "data-processor-task")
    machine = F.col("event_type") == "error"
    status = F.when(machine, F.when(F.col("k") % 3 == 0, "RUNNING").when(F.col("k") % 3 == 1, "SUCCEEDED").otherwise("FAILED"))
    return e.select(
        F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("event_time"), "event_id", F.when(machine, "sfn.state_change").otherwise("ecs.task_state_change").alias("event_type"), status.alias("status"), family.alias("family"),
        F.when(~machine, F.when(F.col("value") < 60, "RUNNING").otherwise("STOPPED")).alias("last_status"), F.lit("EssentialContainerExited").alias("stop_code"), F.when(F.col("k") % 4 == 0, 1).otherwise(0).alias("exit_code"), (F.col("k") % 2 == 0).alias("has_pdfs"), "value",
    )


_E = """WITH e AS (SELECT user_id AS run_id, ts AS event_time, event_id, CASE event_type WHEN 'error' THEN 'sfn.state_change' ELSE 'ecs.task_state_change' END AS event_type,
  CASE WHEN event_type = 'error' THEN ['RUNNING', 'SUCCEEDED', 'FAILED'][(k % 3 + 1)::INT] END AS status, CASE event_type WHEN 'click' THEN 'data-scraper-task' WHEN 'purchase' THEN 'data-extractor-task' WHEN 'signup' THEN 'data-classifier-task' WHEN 'view' THEN 'data-processor-task' END AS family,
  CASE WHEN event_type <> 'error' THEN CASE WHEN value < 60 THEN 'RUNNING' ELSE 'STOPPED' END END AS last_status, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS exit_code, k % 2 = 0 AS has_pdfs, value FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))"""
_M = _E + """, o AS (SELECT *, CASE last_status WHEN 'RUNNING' THEN 'running' WHEN 'STOPPED' THEN CASE WHEN exit_code = 0 THEN 'success' ELSE 'failed' END END AS outcome FROM e),
f(family, nodes) AS (VALUES ('data-scraper-task', ['scraper']), ('data-extractor-task', ['extractor', 'sfn-extractor']), ('data-classifier-task', ['classifier', 'sfn-classifier']), ('data-processor-task', ['processor', 'sfn-processor'])),
m AS (SELECT run_id, event_time, event_id, unnest(nodes) AS node, outcome AS state FROM o JOIN f USING (family)
 UNION ALL SELECT run_id, event_time, event_id, unnest(['scheduler', 'source-queue', 'data-source-1', 'data-source-2', 'data-source-3', 'data-source-4', 'data-source-5']), unnest(['success', 'running', 'running', 'running', 'running', 'running', 'running']) FROM o WHERE family = 'data-scraper-task' AND outcome = 'running'
 UNION ALL SELECT run_id, event_time, event_id, unnest(['source-queue', 'data-source-1', 'data-source-2', 'data-source-3', 'data-source-4', 'data-source-5', 's3', 'scraperdb']), outcome FROM o WHERE family = 'data-scraper-task' AND outcome <> 'running'
 UNION ALL SELECT run_id, event_time, event_id, unnest(['sfn', 'sfn-start', 'sfn-check']), unnest(['running', 'success', 'running']) FROM o WHERE status = 'RUNNING'
 UNION ALL SELECT run_id, event_time, event_id, unnest(['sfn-extractor', 'extractor']), 'skipped' FROM o WHERE status = 'RUNNING' AND NOT has_pdfs
 UNION ALL SELECT run_id, event_time, event_id, unnest(['sfn', 'sfn-check', 'sfn-processor', 'sfn-success', 'sfn-end', 'processor']), 'success' FROM o WHERE status = 'SUCCEEDED'
 UNION ALL SELECT run_id, event_time, event_id, unnest(['sfn', 'sfn-failed', 'sfn-end']), unnest(['failed', 'failed', 'success']) FROM o WHERE status = 'FAILED'),
s AS (SELECT run_id, node, arg_max(state, {'t': event_time, 'e': event_id}) AS state FROM m GROUP BY ALL)"""


@query("W15_latest_task_event", _E + " SELECT run_id, family, arg_max(event_id, {'t': event_time, 'e': event_id}) AS event_id, arg_max(last_status, {'t': event_time, 'e': event_id}) AS last_status FROM e WHERE event_type = 'ecs.task_state_change' GROUP BY ALL")
def latest(d: Domain) -> DataFrame:
    return runs.latest_task_events(run_events(d)).select("run_id", "family", "event_id", "last_status")


@query("W16_node_states", _M + " SELECT run_id, node, state FROM s")
def states(d: Domain) -> DataFrame:
    return runs.node_states(runs.transitions(run_events(d)))


_EDGE_ROWS = ", ".join(f"('{e}', '{s}', '{t}')" for e, (s, t) in runs.EDGES.items())


@query("W16_active_edges", _M + f", g(edge, src, tgt) AS (VALUES {_EDGE_ROWS}) SELECT t.run_id, edge FROM g JOIN s t ON t.node = g.tgt LEFT JOIN s a ON a.run_id = t.run_id AND a.node = g.src WHERE t.state = 'running' OR a.state = 'success' UNION ALL SELECT run_id, unnest({list(runs.SCRAPER_EDGES)}) FROM s WHERE node = 'scraper' AND state = 'running'")
def edges(d: Domain) -> DataFrame:
    return runs.active_edges(runs.node_states(runs.transitions(run_events(d))))


@query("W18_replay_prefix", _M + ", r AS (SELECT *, dense_rank() OVER (PARTITION BY run_id ORDER BY event_time, event_id) AS n FROM m) SELECT run_id, node, arg_max(state, {'t': event_time, 'e': event_id}) AS state FROM r WHERE n <= 5 GROUP BY ALL")
def replayed(d: Domain) -> DataFrame:
    return runs.replay(runs.transitions(run_events(d)), 5)


_LAST = "arg_max({0}, {{'t': event_time, 'e': event_id}}) FILTER ({1})"


@query("W17_status_feed", _M + f""", r AS (SELECT run_id, {_LAST.format('outcome', "family = 'data-scraper-task'")} AS scraper, {_LAST.format('outcome', "family = 'data-extractor-task'")} AS extractor, {_LAST.format('outcome', "family = 'data-classifier-task'")} AS classifier, {_LAST.format('outcome', "family = 'data-processor-task'")} AS processor,
 {_LAST.format("CASE status WHEN 'RUNNING' THEN 'running' WHEN 'SUCCEEDED' THEN 'success' ELSE 'failed' END", "event_type = 'sfn.state_change'")} AS machine, bool_or(coalesce(family = 'data-scraper-task' AND last_status = 'RUNNING', false)) AS started, bool_or(coalesce(family = 'data-scraper-task' AND last_status = 'STOPPED', false)) AS stopped FROM o GROUP BY run_id),
q AS (SELECT *, stopped AND coalesce(scraper, '') <> 'success' AS bad_scrape FROM r), z AS (SELECT *, NOT bad_scrape AND coalesce(machine = 'failed', false) AS bad_run FROM q),
t AS (SELECT run_id, unnest([{{'p': 0, 'k': 'scraper-start', 't': CASE WHEN started THEN 'success' END}}, {{'p': 1, 'k': 'scraping-end', 't': CASE WHEN stopped THEN 'success' END}}, {{'p': 2, 'k': 'documents-saved', 't': CASE WHEN bad_scrape THEN 'idle' WHEN stopped THEN 'success' END}}, {{'p': 3, 'k': 'scraper-failed', 't': CASE WHEN bad_scrape THEN 'failed' END}},
 {{'p': 4, 'k': 'orchestrator', 't': CASE WHEN bad_scrape THEN 'idle' WHEN machine IS NOT NULL THEN 'success' END}}, {{'p': 5, 'k': 'extracting', 't': CASE WHEN bad_scrape THEN 'idle' WHEN bad_run THEN coalesce(extractor, 'idle') ELSE extractor END}}, {{'p': 6, 'k': 'workflow-failed', 't': CASE WHEN bad_run THEN 'failed' END}},
 {{'p': 7, 'k': 'classifying', 't': CASE WHEN bad_scrape OR bad_run THEN 'idle' ELSE classifier END}}, {{'p': 8, 'k': 'processing', 't': CASE WHEN bad_scrape OR bad_run THEN 'idle' ELSE processor END}}, {{'p': 9, 'k': 'processing-completed', 't': CASE WHEN bad_scrape OR bad_run THEN 'idle' WHEN processor = 'success' THEN 'success' END}},
 {{'p': 10, 'k': 'workflow-completed', 't': CASE WHEN bad_scrape OR bad_run THEN 'idle' WHEN machine = 'success' THEN 'success' END}}, {{'p': 11, 'k': 'approval', 't': CASE WHEN bad_scrape OR bad_run THEN 'idle' WHEN machine = 'success' THEN 'running' END}}]) AS x FROM z)
SELECT run_id, x.p::INT AS position, x.k AS key, x.t AS tone FROM t WHERE x.t IS NOT NULL""")
def feed(d: Domain) -> DataFrame:
    return runs.status_feed(run_events(d)).drop("label")


@query("T02_newest_events", "SELECT event_id, event_type, user_id AS run_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest(d: Domain) -> DataFrame:
    return d.table("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type", F.col("user_id").alias("run_id"))


@query("T03_newest_approvals", "SELECT user_id AS run_id, max(event_id) AS last_event FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 50")
def newest_approvals(d: Domain) -> DataFrame:
    return d.table("events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("event_id").alias("last_event"), F.max("ts").alias("t")).orderBy(F.desc("t"), "run_id").limit(50).drop("t")


@query("T04_history_page", "SELECT event_id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 20 OFFSET 10")
def history(d: Domain) -> DataFrame:
    return d.table("events").filter("user_id = 7").orderBy(F.desc("ts"), "event_id").offset(10).limit(20).select("event_id")


@query("T05_date_then_id", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN DATE '0001-01-01' ELSE o_orderdate::DATE END DESC, o_orderkey)::BIGINT AS position FROM orders")
def date_then_id_whole(d: Domain) -> DataFrame:
    """The position of every order; a day, and the orders without one, are split by ranges of keys."""
    parts = 64
    day = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")), F.lit("0001-01-01").cast("date"))
    o = d.table("orders").select("o_orderkey", day.alias("day"))
    lo, hi = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    width = (hi - lo) // parts + 1 if lo is not None else 1
    part = F.coalesce(F.floor((F.col("o_orderkey") - F.lit(lo or 0)) / width), F.lit(-1))
    return runs.positions(o, -F.unix_date("day").cast("long") * (parts + 1) + part, [F.desc("day"), F.col("o_orderkey")], "position").drop("day")


@query("T07_filter_sort_page", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '7') AND c_mktsegment = 'MACHINERY' ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 25")
def page(d: Domain) -> DataFrame:
    c = d.table("customer").filter(F.contains(F.lower("c_name"), F.lit("7")) & (F.col("c_mktsegment") == "MACHINERY"))
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").offset(25).limit(25).select("c_custkey", "c_name")


@query("T08_limit_and_id", "(SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10) UNION ALL SELECT doc_id FROM documents WHERE doc_id = 55")
def limit_and_id(d: Domain) -> DataFrame:
    docs = d.table("documents").select("doc_id")
    return docs.orderBy("doc_id").limit(10).unionByName(docs.filter("doc_id = 55"))


@query("T09_top_label", "SELECT user_id, arg_max(event_type, {'v': value, 'e': event_type}) AS top_label FROM events GROUP BY user_id")
def top_label(d: Domain) -> DataFrame:
    return d.table("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_type")).alias("top_label"))


_DOCS = "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'discovered' WHEN 'F' THEN 'downloaded' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'skipped' END END AS status, o_orderdate AS updated_at FROM orders"


def ledger(d: Domain) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "O", "discovered").when(F.col("o_orderstatus") == "F", "downloaded").when(F.col("o_orderkey") % 2 == 0, "failed").otherwise("skipped")
    return d.table("orders").select("o_orderkey", s.alias("status"), F.col("o_orderdate").alias("updated_at"))


@query("A04_dashboard", f"SELECT count(*)::BIGINT AS total, count(*) FILTER (status = 'discovered')::BIGINT AS new, count(*) FILTER (status = 'downloaded')::BIGINT AS downloaded, count(*) FILTER (status = 'failed')::BIGINT AS failed, count(*) FILTER (status = 'skipped')::BIGINT AS skipped FROM ({_DOCS})")
def counters(d: Domain) -> DataFrame:
    return runs.dashboard(ledger(d)).drop("last_run", "last_success")


@query("A05_latest_records", f"SELECT strftime(max(updated_at), '%Y-%m-%d') AS last_run, strftime(max(updated_at) FILTER (status = 'downloaded'), '%Y-%m-%d') AS last_success FROM ({_DOCS})")
def newest_records(d: Domain) -> DataFrame:
    return runs.dashboard(ledger(d)).select(F.date_format("last_run", "yyyy-MM-dd").alias("last_run"), F.date_format("last_success", "yyyy-MM-dd").alias("last_success"))


@query("X02_unique_events", "SELECT event_id, user_id FROM events")
def unique_events(d: Domain) -> DataFrame:
    e = d.table("events").select("event_id", "user_id")
    return e.unionByName(e.filter("event_id % 3 = 0")).dropDuplicates(["event_id"])


@query("X04_watermark", "WITH w AS (SELECT c_nationkey, max(o_orderdate) AS mark FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN w USING (c_nationkey) WHERE o_orderkey % 2 = 0 OR mark IS NULL OR o_orderdate > mark")
def watermark(d: Domain) -> DataFrame:
    o = d.table("orders").join(d.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return runs.after_watermark(o, o.filter("o_orderkey % 2 = 0"), "c_nationkey", "o_orderdate", "o_orderkey").select("o_orderkey")


@query("X05_changed_content", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0")
def changed_content(d: Domain) -> DataFrame:
    docs = d.table("documents").select("doc_id", "text")
    before = docs.withColumn("hash", F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise("old"))
    return runs.changed(docs, before, "doc_id", F.col("text")).select("doc_id", "hash")


_ACT = "SELECT user_id AS run_id, ts AS ts_, event_id, CASE event_type WHEN 'signup' THEN 'request' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'ingest' ELSE 'request' END AS action, event_id::VARCHAR AS actor FROM events"


APPROVALS_SQL = f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_, action, actor) AS n FROM ({_ACT})),
 f AS (SELECT DISTINCT run_id, 0::BIGINT AS n, NULL::VARCHAR AS status, NULL::VARCHAR AS who FROM a UNION ALL SELECT f.run_id, a.n, CASE WHEN a.action = 'request' AND f.status IS NULL THEN 'pending' WHEN a.action = 'approve' AND f.status IN ('pending', 'rejected') THEN 'approved' WHEN a.action = 'reject' AND f.status IN ('pending', 'approved') THEN 'rejected' WHEN a.action = 'ingest' AND f.status = 'approved' THEN 'ingested' ELSE f.status END,
  CASE WHEN a.action = 'approve' AND f.status IN ('pending', 'rejected') OR a.action = 'reject' AND f.status IN ('pending', 'approved') THEN a.actor ELSE f.who END FROM f JOIN a ON a.run_id = f.run_id AND a.n = f.n + 1)
 SELECT run_id, arg_max(coalesce(status, ''), n) AS status, arg_max(coalesce(who, ''), n) AS decided_by FROM f GROUP BY run_id"""


def approval_actions(d: Domain) -> DataFrame:
    """Every event as an action on its user's run; a click asks again for what may be asked already."""
    kinds = {"purchase": "approve", "error": "reject", "view": "ingest"}
    act = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.lit("request"))
    return d.table("events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), act.alias("action"), F.col("event_id").cast("string").alias("actor"))


@query("X06_approvals", APPROVALS_SQL)
def approval_states(d: Domain) -> DataFrame:
    out = runs.approvals(approval_actions(d))
    return out.select("run_id", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("decided_by", F.lit("")).alias("decided_by"))


@query("X10_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(d: Domain) -> DataFrame:
    return d.table("documents").select("doc_id").join(d.table("labels"), "doc_id", "left_anti")


@query("W19_newest_period", "SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) = (SELECT date_trunc('month', max(o_orderdate)) FROM orders)")
def newest_period(d: Domain) -> DataFrame:
    return runs.period_rows(d.table("orders"), "o_orderdate").select("o_orderkey")


@query("A21_previous_period", "SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) = (SELECT date_trunc('month', max(o_orderdate)) - INTERVAL 1 MONTH FROM orders)")
def previous_period(d: Domain) -> DataFrame:
    return runs.period_rows(d.table("orders"), "o_orderdate", 1).select("o_orderkey")


@query("W20_positional_pick", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IN (1, 3)")
def positions(d: Domain) -> DataFrame:
    return d.table("events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("n in (1, 3)").select("user_id", "event_id")


@query("J23_sources_of_run", "SELECT user_id AS run_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources, count(*)::BIGINT AS documents_count FROM events GROUP BY user_id")
def sources_of_run(d: Domain) -> DataFrame:
    return d.table("events").groupBy(F.col("user_id").alias("run_id")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("sources"), F.count(F.lit(1)).alias("documents_count"))


@query("P13_owned_rows", "SELECT event_id FROM events WHERE user_id = 12")
def owned(d: Domain) -> DataFrame:
    return d.table("events").filter("user_id = 12").select("event_id")


@query("P19_node_events", _E + " SELECT run_id, event_id FROM e WHERE family = 'data-extractor-task'")
def node_events(d: Domain) -> DataFrame:
    return run_events(d).filter("family = 'data-extractor-task'").select("run_id", "event_id")


@query("F44_run_ids", "SELECT event_id, 'run-' || user_id AS run_id FROM events")
def run_ids(d: Domain) -> DataFrame:
    from ..functions.nested import run_id

    name = F.concat(F.lit("run-"), F.col("user_id").cast("string"))
    states = F.to_json(F.struct(F.to_json(F.struct(name.alias("run_id"))).alias("input")))
    arn = F.to_json(F.struct(F.concat(F.lit("arn:aws:states:x:1:execution:pipe:"), name).alias("executionArn")))
    task = F.to_json(F.struct(F.array(F.struct(F.array(F.lit("--bucket"), F.lit("b"), F.lit("--run-id"), name).alias("command"))).alias("containers")))
    detail = F.when(F.col("event_id") % 3 == 0, states).when(F.col("event_id") % 3 == 1, arn).otherwise(task)
    source = F.when(F.col("event_id") % 3 < 2, "aws.states").otherwise("aws.ecs")
    return d.table("events").select("event_id", run_id(source, detail).alias("run_id"))
