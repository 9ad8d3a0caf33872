"""Event streams: parsing, exactly-once effect, poison messages, windowed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, nested

#: Kinds of events by the source that sends them, and how often a message may fail.
KINDS = {"aws.states": "sfn.state_change", "aws.ecs": "ecs.task_state_change", "aws.cloudwatch": "alarm.state_change"}
MOST_ATTEMPTS = 3


def parsed(messages: DataFrame) -> DataFrame:
    """Envelopes of messages(message_id, body, attempts); ``bad`` marks bodies that can't be read."""
    body = nested.repaired_json(F.col("body"))
    d = messages.withColumn("json", body)
    pick = lambda p: F.get_json_object("json", p)
    source = F.coalesce(pick("$.source"), F.lit("unknown"))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), source), F.lit("unknown"))
    return d.select(
        F.coalesce("message_id", pick("$.event_id"), pick("$.id"), F.lit("unknown")).alias("event_id"), kind.alias("event_type"), source.alias("source"),
        F.coalesce(nested.run_id(source, pick("$.detail")), pick("$.run_id")).alias("run_id"), dates.utc_time(F.coalesce(pick("$.time"), pick("$.detail.timestamp"), pick("$.detail.eventTime"))).alias("event_time"),
        F.coalesce(pick("$.detail.status"), pick("$.status")).alias("status"), F.col("json").alias("payload"), F.col("json").isNull().alias("bad"), "attempts",
    )


def split_poison(events: DataFrame, most: int = MOST_ATTEMPTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, retried, dropped): unreadable messages are retried until they have failed too often."""
    good, bad = events.filter("not bad"), events.filter("bad")
    return good, bad.filter(F.col("attempts") < most), bad.filter(F.col("attempts") >= most)


def once(events: DataFrame, delay: str = "1 day", key: str = "event_id") -> DataFrame:
    """Each event id once, if its repeats arrive within the delay.

    State holds the ids that arrived within the delay, not all that ever did.
    The watermark runs on the time of arrival, which is the same when a batch is
    run again, so no event is late and none is lost for its own old time.
    """
    return events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay).dropDuplicatesWithinWatermark([key]).drop("_arrived")


def to_batches(stream: DataFrame, target: str, checkpoint: str, publish: Callable[[DataFrame], None] | None = None, mode: str = "append"):
    """Write each micro-batch to a folder of its own below ``target``, then publish it if it has rows.

    A batch that is run again after a failure writes the same folder again, so
    its rows are there once, and no batch reads what others have stored.
    """

    def save(batch: DataFrame, number: int) -> None:
        path = f"{target}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(path)
        if publish is not None and not stored.isEmpty():
            publish(stored)

    return stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def consume(stream: DataFrame, target: str, checkpoint: str, publish: Callable[[DataFrame], None] | None = None, delay: str = "1 day"):
    """Store and publish each event of the stream once, whether it is repeated within a batch, in a later one or after a restart."""
    return to_batches(once(stream, delay), target, checkpoint, publish)


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def replay_then_live(history: DataFrame, live: DataFrame, n: int = 20) -> DataFrame:
    """The newest stored events in their order, then live ones that they don't hold."""
    old = history.orderBy(F.desc("event_time"), F.desc("event_id")).limit(n).withColumn("kind", F.lit("history"))
    return old.unionByName(live.join(old.select("event_id"), "event_id", "left_anti").withColumn("kind", F.lit("live")))


def latest_status(updates: DataFrame, key: str = "worker") -> DataFrame:
    """The newest update of each worker, with its last start and last error."""
    order = F.struct("at", "status")
    last = lambda cond, c: F.max_by(F.when(cond, F.col(c)), F.when(cond, order))
    return updates.groupBy(key).agg(F.max_by("status", order).alias("status"), last(F.col("status") == "running", "at").alias("last_started_at"), last(F.col("status").isin("idle", "failed"), "at").alias("last_finished_at"), last(F.col("status") == "failed", "error").alias("last_error"))


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts in tumbling windows; late events within the delay are counted. Works on tables and streams."""
    return events.withWatermark("event_time", delay).groupBy(F.window("event_time", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
