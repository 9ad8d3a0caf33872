"""State of pipeline runs, folded from their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Task families with their nodes, and the edges between nodes.
FAMILIES = {"data-scraper-task": ("scraper", None), "data-extractor-task": ("extractor", "sfn-extractor"), "data-classifier-task": ("classifier", "sfn-classifier"), "data-processor-task": ("processor", "sfn-processor"), "data-ingester-task": ("ingestor", None)}
SCRAPER_RUNNING = {"scheduler": "success", "source-queue": "running", **{f"data-source-{i}": "running" for i in range(1, 6)}}
SCRAPER_STOPPED = ("source-queue", *[f"data-source-{i}" for i in range(1, 6)], "s3", "scraperdb")
INGESTER_NODES = ("meddb", "scraperdb2")
MACHINE = {
    "RUNNING": {"sfn": "running", "sfn-start": "success", "sfn-check": "running"},
    "SUCCEEDED": {"sfn": "success", "sfn-check": "success", "sfn-processor": "success", "sfn-success": "success", "sfn-end": "success", "processor": "success"},
    "FAILED": {"sfn": "failed", "sfn-failed": "failed", "sfn-end": "success"},
}
EDGES = {
    "e-sch-scr": ("scheduler", "scraper"), "e-s3-sfn": ("s3", "sfn"), "e-sfn-ext": ("sfn", "extractor"), "e-sfn-cls": ("sfn", "classifier"), "e-sfn-prc": ("sfn", "processor"), "e-ext-ing": ("extractor", "ingestor"), "e-cls-ing": ("classifier", "ingestor"), "e-prc-ing": ("processor", "ingestor"),
    "e-ing-med": ("ingestor", "meddb"), "e-ing-scdb": ("ingestor", "scraperdb2"), "s1": ("sfn-start", "sfn-check"), "s2": ("sfn-check", "sfn-extractor"), "s3": ("sfn-check", "sfn-classifier"), "s5": ("sfn-extractor", "sfn-processor"), "s6": ("sfn-classifier", "sfn-processor"), "s7": ("sfn-processor", "sfn-success"), "s9": ("sfn-success", "sfn-end"),
}
SCRAPER_EDGES = ("e-source-1-queue", "e-source-2-queue", "e-source-3-queue", "e-source-4-queue", "e-source-5-queue", "e-queue-scraper", "e-scr-s3", "e-scr-db")


def _pairs(states: dict[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("node"), F.lit(s).alias("state")) for n, s in states.items()])


def task_outcome(last_status: Column, stop_code: Column, exit_code: Column) -> Column:
    good = F.coalesce((stop_code == "EssentialContainerExited") & (exit_code == 0), F.lit(False))
    return F.when(last_status == "RUNNING", "running").when(last_status == "STOPPED", F.when(good, "success").otherwise("failed"))


def transitions(events: DataFrame) -> DataFrame:
    """(run_id, event_time, event_id, node, state) that events bring about.

    events(run_id, event_time, event_id, event_type, status, family, last_status,
    stop_code, exit_code, has_pdfs).
    """
    none = F.array().cast("array<struct<node:string,state:string>>")
    outcome = task_outcome(F.col("last_status"), F.col("stop_code"), F.col("exit_code"))
    same = lambda nodes: F.array(*[F.struct(F.lit(n).alias("node"), outcome.alias("state")) for n in nodes])
    task = none
    for family, (node, step) in FAMILIES.items():
        own = same([n for n in (node, step) if n])
        if node == "scraper":
            own = F.concat(own, F.when(outcome == "running", _pairs(SCRAPER_RUNNING)).otherwise(same(SCRAPER_STOPPED)))
        elif node == "ingestor":
            own = F.concat(own, same(INGESTER_NODES))
        task = F.when(F.col("family") == family, own).otherwise(task)
    skipped = F.when(F.col("has_pdfs") == F.lit(False), _pairs({"sfn-extractor": "skipped", "extractor": "skipped"})).otherwise(none)
    machine = F.when(F.col("status") == "RUNNING", F.concat(_pairs(MACHINE["RUNNING"]), skipped)).when(F.col("status") == "SUCCEEDED", _pairs(MACHINE["SUCCEEDED"])).when(F.col("status").isin("FAILED", "TIMED_OUT", "ABORTED"), _pairs(MACHINE["FAILED"])).otherwise(none)
    made = F.when(F.col("event_type") == "sfn.state_change", machine).when((F.col("event_type") == "ecs.task_state_change") & outcome.isNotNull(), task).otherwise(none)
    return events.select("run_id", "event_time", "event_id", F.explode(made).alias("m")).select("run_id", "event_time", "event_id", "m.node", "m.state")


def node_states(moves: DataFrame) -> DataFrame:
    """(run_id, node, state): the last transition of each node."""
    return moves.groupBy("run_id", "node").agg(F.max_by("state", F.struct("event_time", "event_id")).alias("state"))


def active_edges(states: DataFrame) -> DataFrame:
    """(run_id, edge): those that lead to a running node, or from a success to a node that has begun."""
    at = states.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("node", "state"))).alias("s"))  # at most one entry a node
    state = lambda n: F.try_element_at(F.col("s"), F.lit(n))
    on = [F.when((state(t) == "running") | ((state(s) == "success") & state(t).isNotNull() & (state(t) != "idle")), F.lit(e)) for e, (s, t) in EDGES.items()]
    scraping = [F.when(state("scraper") == "running", F.lit(e)) for e in SCRAPER_EDGES]
    return at.select("run_id", F.explode(F.array_compact(F.array(*on, *scraping))).alias("edge"))


def replay(moves: DataFrame, k: int) -> DataFrame:
    """Node states as of the k-th event of each run."""
    order = Window.partitionBy("run_id").orderBy("event_time", "event_id")
    return node_states(moves.withColumn("_n", F.dense_rank().over(order)).filter(F.col("_n") <= k))


def latest_task_events(events: DataFrame) -> DataFrame:
    """(run_id, family, event_id, last_status, event_time): the newest task event of each family."""
    tasks = events.filter("event_type = 'ecs.task_state_change'")
    return tasks.groupBy("run_id", "family").agg(F.max_by(F.struct("event_id", "last_status", "event_time"), F.struct("event_time", "event_id")).alias("e")).select("run_id", "family", "e.event_id", "e.last_status", "e.event_time")


#: Milestones of the feed in their order.
MILESTONES = (("scraper-start", "Scraper started"), ("scraping-end", "Scraping end"), ("documents-saved", "Docs saved in DB and S3"), ("scraper-failed", "Scraper failed"), ("orchestrator", "Pipeline started"), ("extracting", "Extracting docs"), ("workflow-failed", "Workflow failed"), ("classifying", "Classifying docs"), ("processing", "Processing docs"), ("processing-completed", "Processing completed"), ("workflow-completed", "Workflow completed"), ("approval", "Waiting for approval"))
TAIL = ("classifying", "processing", "processing-completed", "workflow-completed", "approval")


def status_feed(events: DataFrame) -> DataFrame:
    """(run_id, position, key, label, tone): milestones of each run; after a failure the rest is idle."""
    ecs = lambda fam: (F.col("event_type") == "ecs.task_state_change") & (F.col("family") == fam)
    order = F.struct("event_time", "event_id")
    outcome = task_outcome(F.col("last_status"), F.col("stop_code"), F.col("exit_code"))
    last = lambda cond, c: F.max_by(F.when(cond, c), F.when(cond, order))
    fam = {"scraper": "data-scraper-task", "extractor": "data-extractor-task", "classifier": "data-classifier-task", "processor": "data-processor-task"}
    machine = F.when(F.col("status") == "RUNNING", "running").when(F.col("status") == "SUCCEEDED", "success").when(F.col("status").isin("FAILED", "TIMED_OUT", "ABORTED"), "failed")
    r = events.groupBy("run_id").agg(
        *[last(ecs(f), outcome).alias(n) for n, f in fam.items()], last(F.col("event_type") == "sfn.state_change", machine).alias("machine"), F.bool_or(ecs(fam["scraper"]) & (F.col("last_status") == "RUNNING")).alias("started"),
        F.bool_or(ecs(fam["scraper"]) & (F.col("last_status") == "STOPPED")).alias("stopped"), F.bool_or(ecs("data-ingester-task")).alias("ingested"),
    )
    failed_scrape = F.col("stopped") & (F.coalesce("scraper", F.lit("")) != "success")
    failed_run = ~failed_scrape & F.coalesce(F.col("machine") == "failed", F.lit(False))
    ok = ~failed_scrape & ~failed_run
    tone = {
        "scraper-start": F.when(F.col("started"), "success"), "scraping-end": F.when(F.col("stopped"), "success"), "documents-saved": F.when(F.col("stopped"), F.when(failed_scrape, "idle").otherwise("success")), "scraper-failed": F.when(failed_scrape, "failed"),
        "orchestrator": F.when(failed_scrape, "idle").when(F.col("machine").isNotNull(), "success"), "extracting": F.when(failed_scrape, "idle").when(failed_run, F.coalesce("extractor", F.lit("idle"))).otherwise(F.col("extractor")), "workflow-failed": F.when(failed_run, "failed"),
        "classifying": F.when(~ok, "idle").otherwise(F.col("classifier")), "processing": F.when(~ok, "idle").otherwise(F.col("processor")), "processing-completed": F.when(~ok, "idle").when(F.col("processor") == "success", "success"),
        "workflow-completed": F.when(~ok, "idle").when(F.col("machine") == "success", "success"), "approval": F.when(~ok, "idle").when(F.col("machine") == "success", F.when(F.col("ingested"), "success").otherwise("running")),
    }
    steps = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("key"), F.lit(label).alias("label"), tone[k].alias("tone")) for i, (k, label) in enumerate(MILESTONES)])
    return r.select("run_id", F.explode(F.filter(steps, lambda s: s["tone"].isNotNull())).alias("s")).select("run_id", "s.position", "s.key", "s.label", "s.tone")


def approvals(actions: DataFrame) -> DataFrame:
    """(run_id, status, decided_by) after folding requests, approvals, rejections and ingests in order.

    A request opens a run that has none; an approval needs a pending or rejected
    run, a rejection a pending or approved one; an ingest ends an approved run.
    Anything else changes nothing. actions(run_id, at, action, actor).
    """
    listed = actions.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("at", "action", "actor"))).alias("a"))
    step = """case when x.action = 'request' and s.status is null then named_struct('status', 'pending', 'by', cast(null as string))
      when x.action = 'approve' and s.status in ('pending', 'rejected') then named_struct('status', 'approved', 'by', x.actor)
      when x.action = 'reject' and s.status in ('pending', 'approved') then named_struct('status', 'rejected', 'by', x.actor)
      when x.action = 'ingest' and s.status = 'approved' then named_struct('status', 'ingested', 'by', s.by) else s end"""
    folded = F.expr(f"aggregate(a, named_struct('status', cast(null as string), 'by', cast(null as string)), (s, x) -> {step})")
    return listed.withColumn("f", folded).select("run_id", F.col("f.status").alias("status"), F.col("f.by").alias("decided_by"))


def dashboard(documents: DataFrame) -> DataFrame:
    """One row of counters over documents(status, updated_at), and the newest times."""
    n = lambda s: F.count_if(F.col("status") == s)
    d = documents.agg(F.count(F.lit(1)).alias("total"), n("discovered").alias("new"), n("downloaded").alias("downloaded"), n("failed").alias("failed"), F.max("updated_at").alias("last_run"), F.max(F.when(F.col("status") == "downloaded", F.col("updated_at"))).alias("last_success"))
    return d.withColumn("skipped", F.greatest(F.col("total") - F.col("new") - F.col("downloaded") - F.col("failed"), F.lit(0)))


def after_watermark(rows: DataFrame, stored: DataFrame, source: str, day: str, key: str) -> DataFrame:
    """Rows newer than the newest stored day of their source, those stored already, and those without a day."""
    mark = stored.groupBy(F.col(source).alias("_s")).agg(F.max(day).alias("_mark"))
    known = stored.select(F.col(key).alias("_k")).distinct()
    j = rows.join(mark, F.col(source) == F.col("_s"), "left").join(known, F.col(key) == F.col("_k"), "left")
    return j.filter(F.col("_k").isNotNull() | F.col("_mark").isNull() | F.col(day).isNull() | (F.col(day) > F.col("_mark"))).drop("_s", "_mark", "_k")


def changed(rows: DataFrame, previous: DataFrame, key: str, content: Column) -> DataFrame:
    """Rows whose content hash differs from the previous one, new keys included."""
    prev = previous.select(F.col(key).alias("_k"), F.col("hash").alias("_h"))
    return rows.withColumn("hash", F.sha2(content.cast("string"), 256)).join(prev, F.col(key) == F.col("_k"), "left").filter(~F.col("hash").eqNullSafe(F.col("_h"))).drop("_k", "_h")


def period_rows(rows: DataFrame, day: str, back: int = 0) -> DataFrame:
    """Rows of the newest month, or of the month ``back`` months before it."""
    newest = rows.agg(F.add_months(F.trunc(F.max(day), "MM"), -back).alias("_p"))
    return rows.join(F.broadcast(newest), F.trunc(F.col(day), "MM") == F.col("_p")).drop("_p")  # one row


def positions(df: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """df with the 1-based position of each row in ``order``, without sorting all rows in one task.

    ``bucket`` is not null and monotone in ``order``; each is numbered alone and
    shifted by the rows of those before, whose counts alone meet in one task.
    """
    keyed = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = keyed.withColumn("_own", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return own.join(shift, "_bucket").select(*df.columns, (F.col("_own") + F.col("_shift")).cast("long").alias(name))
