"""Shared plumbing of the training-data operators: tables, staged results, distributed ranks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Rows of narrow results in one file; fewer files spare the store, and each still fits one task.
ROWS_PER_FILE = 200_000
#: Rows and bytes of an Arrow batch; each task holds a few batches on both sides of its Python worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
_local_dir: str | None = None


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of texts in small pieces, unless the session names sizes of its own."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode, where the session may name none (tests)."""
    global _local_dir
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError(f"{CHECKPOINT_KEY} names no folder, and executors of a cluster share no temporary one")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="medlattice-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


def _remove_local(path: str) -> None:
    """At the session's end, where the folder is local; other stores clean up by their own rules."""
    if path.startswith(("/", "file:")):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


class Staged:
    """Intermediate tables of one operator call, written as Parquet to the shared folder.

    They cut lineage and survive the loss of an executor. ``drop`` removes a
    table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/medlattice/{operator}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        atexit.register(_remove_local, self.base)

    def write(self, df: DataFrame, rows: int | None = None, spread: bool = False) -> DataFrame:
        """df as a table. ``rows``, a bound of its rows, keeps a small result from many files.

        ``spread`` leaves the last stage its tasks and deals their rows out anew.
        """
        if rows is not None:
            files = max(1, -(-rows // ROWS_PER_FILE))
            df = df.repartition(files) if spread else df.coalesce(files)
        self.made += 1
        path = f"{self.base}/t{self.made}"
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._staged_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def narrow(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input can't clash with ours."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def prefix_sums(df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: Column, name: str, levels: int = 1) -> DataFrame:
    """df with the sum of ``value`` over the earlier rows of its group, without sorting a group in one task.

    ``bucket`` must be monotone in ``order``: rows of a smaller bucket come
    first. Each (group, bucket) is summed alone and shifted by the sums of the
    buckets before it, so a group with a third of all rows is spread over as
    many tasks as it has buckets. With two levels the buckets of a group are
    summed by their names without the last two digits first, and so not in one
    task either.
    """
    # the group as one text that is never null, so that one exchange by it serves the windows and the join of the rows.
    # An exchange by the group alone would satisfy the window and put a hot group in one task.
    keyed = df.withColumn("_group", F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(group)])))
    keyed = keyed.withColumn("_bucket", F.coalesce(bucket.cast("string"), F.lit(""))).withColumn("_value", value.cast("long"))
    sums = keyed.groupBy("_group", "_bucket").agg(F.sum("_value").alias("_sum"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda window, c: F.coalesce(F.sum(c).over(window), F.lit(0))
    if levels == 1:
        shift = sums.select("_group", "_bucket", so_far(before("_group").orderBy("_bucket"), "_sum").alias("_shift"))
    else:
        sums = sums.withColumn("_upper", F.substring("_bucket", F.lit(1), F.greatest(F.length("_bucket") - 2, F.lit(0))))
        upper = sums.groupBy("_group", "_upper").agg(F.sum("_sum").alias("_all"))
        upper = upper.select("_group", "_upper", so_far(before("_group").orderBy("_upper"), "_all").alias("_far"))
        near = sums.withColumn("_near", so_far(before("_group", "_upper").orderBy("_bucket"), "_sum"))
        shift = near.join(upper, ["_group", "_upper"]).select("_group", "_bucket", (F.col("_far") + F.col("_near")).alias("_shift"))
    dealt = keyed.repartition("_group", "_bucket")
    summed = dealt.withColumn("_before", so_far(before("_group", "_bucket").orderBy(*order), "_value"))
    met = summed.join(shift, ["_group", "_bucket"])
    return met.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_shift")).cast("long").alias(name))


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str, levels: int = 1) -> DataFrame:
    """df with its 0-based rank within its group; see ``prefix_sums``."""
    return prefix_sums(df, group, bucket, order, F.lit(1), name, levels)


def levels_of(digits: int) -> int:
    """One level for groups of up to 16 ** 4 buckets."""
    return 1 if digits <= 4 else 2


def hex_digits(rows: int, per_bucket: int = 500) -> int:
    """Leading hex digits of a hash that deal ``rows`` into buckets of about ``per_bucket`` rows."""
    digits = 0
    while rows > per_bucket * 16**digits:
        digits += 1
    return digits


def connected(edges: DataFrame, staged: Staged, rows: int, left: str = "node", right: str = "hub") -> DataFrame:
    """Smallest node reachable, for each node of the bipartite ``edges(node long, hub)``.

    Alternates hub minimum and node minimum, each a partial aggregate, with one
    pointer jump a round, until no label changes; every round is written out.
    ``rows`` bounds the edges. Returns (node, label).
    """
    edges = edges.select(F.col(left).alias("node"), F.col(right).alias("hub"))
    labels = staged.write(edges.groupBy("hub").agg(F.min("node").alias("label")).join(edges, "hub").groupBy("node").agg(F.min("label").alias("label")), rows)
    while True:
        at_hub = edges.join(labels, "node").groupBy("hub").agg(F.min("label").alias("label"))
        spread = edges.join(at_hub, "hub").groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = spread.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        old = labels.withColumnRenamed("label", "was")
        new = staged.write(moved.join(old, "node").select("node", "label", (F.col("label") != F.col("was")).alias("changed")), rows)
        still = new.agg(F.max("changed")).first()[0]
        staged.drop(labels)
        labels = new
        if not still:
            return labels.select("node", "label")


def annotate(docs: DataFrame, fn, fields: str, text: str = "text", inputs: tuple[str, ...] = ()) -> DataFrame:
    """docs with new columns that ``fn(batch, text) -> {name: pyarrow array}`` computes from Arrow batches.

    ``fields`` is their DDL. Only the text and ``inputs`` go to Python and only
    the new columns come back; Spark keeps the others meanwhile. A column of the
    input that has the name of a new one is replaced. Memory is bounded by an
    Arrow batch (spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch).
    """
    added = T._parse_datatype_string(fields)
    names = added.names

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            new = fn(pa.RecordBatch.from_struct_array(batch), text)
            yield pa.StructArray.from_arrays([new[n] for n in names], names=names)
            del batch, new
            pa.default_memory_pool().release_unused()

    # not to be repeated where a result is used twice, so it counts as nondeterministic
    made = F.arrow_udf(each, added).asNondeterministic()
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    name = "_new"
    while name in kept:
        name += "_"
    asked = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys((text, *inputs))])
    marked = docs.select(*[F.col(f"`{c}`") for c in kept], made(asked).alias(name))
    return marked.select(*[F.col(f"`{c}`") for c in kept], *[F.col(name)[n].alias(n) for n in names])
