"""Results that leave the engine: verdict rows, manifests, guarded and atomic replacement, delivery to clients."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.snapshots import Snapshots
from .stage import read_csv

TABLE = "table"


def verdict_rows(parts: list[DataFrame]) -> DataFrame:
    """All parts with the union of their columns, sorted in any case; nested values as JSON, nulls as empty texts."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    nested = (T.StructType, T.ArrayType, T.MapType)

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.coalesce(F.to_json(c) if isinstance(f.dataType, nested) else c.cast("string"), F.lit("")).alias(f.name)

    return rows.select(*[cell(f) for f in sorted(rows.schema.fields, key=lambda f: f.name.lower())])


def run_manifest(documents: DataFrame, run: str, at: str, is_pdf: Column) -> DataFrame:
    """One row a run: its documents, whether it has PDFs, its day, and all that as a JSON body."""
    g = documents.groupBy(F.col(run).alias("run_id")).agg(F.count(F.lit(1)).alias("documents_count"), F.bool_or(is_pdf).alias("has_pdfs"), F.date_format(F.max(at), "yyyy-MM-dd").alias("triggered_on"))
    return g.withColumn("body", F.to_json(F.struct("run_id", "documents_count", "has_pdfs", "triggered_on")))


#: Names of the result objects of stages.
STAGE_RESULTS = {"extractor": "extracted", "classifier": "classified", "parser": "parsed", "normalizer": "normalized", "ingester": "ingested", "processor": "processor", "profiler": "profiled"}


def stage_results(results: DataFrame, prefix: str) -> DataFrame:
    """(run_id, stage, key, body, error) of results(run_id, stage, ...): one object a row, all other columns as its JSON body.

    The key is ``prefix``/runs/<run>/results/<name>.json. A run that is no path
    segment, or a stage without a result, gives an error and neither key nor body.
    """
    run, stage = F.coalesce(F.col("run_id").cast("string"), F.lit("")), F.coalesce(F.col("stage"), F.lit(""))
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGE_RESULTS.items() for x in kv]), stage)
    error = F.when(run.isin("", ".", "..") | run.rlike(r"[/\\]"), "run_id must be a non-empty path segment").when(name.isNull(), F.concat(F.lit("unsupported result stage: "), stage))
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in results.columns if c not in ("run_id", "stage")]), {"ignoreNullFields": "false"})
    key = F.concat(F.lit(f"{prefix}/runs/"), run, F.lit("/results/"), name, F.lit(".json"))
    return results.select(run.alias("run_id"), stage.alias("stage"), F.when(error.isNull(), key).alias("key"), F.when(error.isNull(), body).alias("body"), error.alias("error"))


def recorded(scans: DataFrame, outcomes: DataFrame, key: str, status: Column) -> DataFrame:
    """scans with their status: ``processing`` when inserted, then what the outcome says, ``failed`` where it says nothing."""
    o = outcomes.select(key, status.alias("_status"), F.lit(True).alias("_done"))
    known = F.when(F.col("_done").isNull(), "processing").otherwise(F.coalesce("_status", F.lit("failed")))
    return scans.join(o, key, "left").withColumn("status", known).drop("_status", "_done")


def schema_outputs(tables: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences with their schema's id, rejected tables with the reason) of tables(..., signature, reason)."""
    ok = tables.filter("reason is null").join(inventory.select("signature", "schema_id"), "signature")
    return ok.drop("reason"), tables.filter("reason is not null").drop("signature")


def rewrite(df: DataFrame, folder: str, stamp: str) -> int | None:
    """Replace the table that ``folder`` publishes, whole: readers see the old one or the new one.

    A writer that dies leaves the old table. Returns the number of the version
    before, which stays as a backup; none at the first time.
    """
    store = Snapshots(df.sparkSession, folder)
    before = store.current()
    store.replace({TABLE: df}, stamp)
    return before or None


def stored(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """The table that ``rewrite`` published last, or an earlier version of it."""
    return Snapshots(spark, folder).read(TABLE, version)


def replace_all(relations: dict[str, DataFrame], folder: str, findings: DataFrame, confirmed: bool, order: Iterable[str]) -> list[tuple[str, int, int]]:
    """Replace all stored relations at once if that is confirmed and no finding speaks against it.

    ``order`` names parents first: old rows are counted in its reverse, new
    relations are written in it, and one pointer is swapped after the last. A
    check that fails, a writer that dies or a swap that fails leaves every old
    relation as it was. Returns (relation, rows deleted, rows written).
    """
    if not confirmed:
        raise PermissionError("a full replacement has to be confirmed")
    if findings.limit(1).count():
        raise ValueError("the staged relations have findings; nothing was replaced")
    spark, names = findings.sparkSession, list(order)
    store = Snapshots(spark, folder)
    base, own, deleted, parts, written = store.current(), store.transaction(), {}, {}, {}
    for name in reversed(names):
        old = store.read(name, base)
        deleted[name] = old.count() if old is not None else 0
    for name in names:
        parts[name] = [store.write(own, name, relations[name])]
        written[name] = spark.read.parquet(f"{folder}/data/{parts[name][0]}").count()
    store.publish(parts, base)
    return [(name, deleted[name], written[name]) for name in names]


def deliver(messages: list[str], clients: dict[str, Callable[[str], None]]) -> list[str]:
    """Send messages to all clients; one that fails gets no more and its name is returned. For the small batches of a live feed."""
    dead = []
    for name, send in list(clients.items()):
        try:
            for m in messages:
                send(m)
        except (ConnectionError, RuntimeError):
            dead.append(name)
            del clients[name]
    return dead


def claimed(work: DataFrame, workers: int, now: Column, stale_seconds: int = 900) -> DataFrame:
    """work(item, claimed_by, claimed_at, done) with ``worker``: who takes an item now; null where it is done or held.

    Every item has one taker, named by its hash, so no lock is needed; a claim older than ``stale_seconds`` is free again.
    """
    held = F.col("claimed_by").isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp("claimed_at") <= stale_seconds)
    return work.withColumn("worker", F.when(~F.col("done") & ~F.coalesce(held, F.lit(False)), F.pmod(F.crc32(F.col("item").cast("string").cast("binary")), F.lit(workers)).cast("int")))


def overridden(rows: DataFrame, fixed: DataFrame, key: str) -> DataFrame:
    """rows with the filled values of a fixed table put over theirs, by key."""
    names = [c for c in fixed.columns if c != key]
    f = fixed.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    out = rows.join(F.broadcast(f), key, "left")  # a table written by hand
    return out.select(*[F.coalesce(F.nullif(F.trim(f"_{c}"), F.lit("")), F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns])


def role_rows(rows: DataFrame, keep: list[str], roles: dict[str, Column]) -> DataFrame:
    """(keep..., organization, role): one row for each role that a record fills."""
    each = F.array(*[F.struct(c.alias("organization"), F.lit(r).alias("role")) for r, c in roles.items()])
    return rows.select(*keep, F.explode(each).alias("r")).select(*keep, "r.organization", "r.role").filter("organization is not null")


def inspected(relations: dict[str, DataFrame], n: int = 3) -> DataFrame:
    """(relation, line, content): header and first rows of each relation, as CSV lines in the order of their columns."""
    parts = []
    for name, df in sorted(relations.items()):
        head = df.sparkSession.createDataFrame([(name, 0, ",".join(df.columns))], "relation string, line int, content string")
        top = df.orderBy(*df.columns).limit(n).select(F.to_csv(F.struct("*")).alias("content"), F.struct("*").alias("o"))  # n rows
        lines = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "content"))), lambda x: x["content"]).alias("c")).select(F.lit(name).alias("relation"), F.posexplode("c").alias("line", "content"))
        parts += [head, lines.select("relation", (F.col("line") + 1).alias("line"), "content")]
    return reduce(DataFrame.unionByName, parts)


def inspected_folder(spark: SparkSession, folder: str, n: int = 3) -> DataFrame:
    """``inspected`` of every subfolder with CSV files, named by its path below ``folder``; all cells are texts."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names, root = set(), fs.makeQualified(base).toString()
    files = fs.listFiles(base, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().lower().endswith(".csv"):
            names.add(path.getParent().toString().removeprefix(root).strip("/"))
    if not names:
        return spark.createDataFrame([], "relation string, line int, content string")
    return inspected({name: read_csv(spark, f"{folder}/{name}") for name in sorted(names)}, n)
