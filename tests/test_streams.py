"""Streams against folds of the whole: repeats, rounds, restarts and failed batches."""

import random

import pytest
from pyspark.sql import functions as F

from medlattice.operators import runs
from medlattice.streaming import approvals, events

ACTIONS = "run_id string, at int, action string, actor string"


def plain(actions):
    state = {}
    for run, _, action, actor in sorted(actions, key=lambda a: (a[0], a[1], a[2], a[3] or "")):
        status, by = state.get(run, (None, None))
        if action == "request" and status is None:
            status = "pending"
        elif action == "approve" and status in ("pending", "rejected"):
            status, by = "approved", actor
        elif action == "reject" and status in ("pending", "approved"):
            status, by = "rejected", actor
        elif action == "ingest" and status == "approved":
            status = "ingested"
        state[run] = status, by
    return state


def test_streamed_approvals_equal_the_fold(spark, tmp_path):
    rng = random.Random(4)
    actions = [(f"r{rng.randrange(6)}", t, rng.choice(["request", "approve", "reject", "ingest", "click"]), rng.choice(["a", "b", None])) for t in range(160)]
    actions += [("hot", t, rng.choice(["approve", "reject"]), f"x{t}") for t in range(160)] + [("hot", -1, "request", "z")]
    schema = spark.createDataFrame([], ACTIONS).schema
    for lo, hi in ((-1, 40), (40, 41), (41, 120), (120, 200)):  # a round each, from the checkpoint of the last
        spark.createDataFrame([a for a in actions if lo <= a[1] < hi], ACTIONS).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        approvals.run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    want = plain(actions)
    got = {r.run_id: (r.status, r.decided_by) for r in approvals.states(spark, f"{tmp_path}/out").collect()}
    folded = {r.run_id: (r.status, r.decided_by) for r in runs.approvals(spark.createDataFrame(actions, ACTIONS)).collect()}
    assert got == want == folded and "ingested" in {s for s, _ in got.values()}
    assert spark.conf.get(approvals.PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or "RocksDB" not in spark.conf.get(approvals.PROVIDER, "")


def messages(spark, ids):
    return spark.createDataFrame([(str(i), f"2024-01-0{i % 9 + 1}" if i % 4 else None, f"v{i}") for i in ids], "event_id string, day string, body string").withColumn("event_time", F.to_timestamp("day"))


def test_each_event_once_over_rounds_and_restarts(spark, tmp_path):
    """Old and undated events count like others; repeats within a batch, in later ones and after a restart don't."""
    rng, seen, published = random.Random(5), set(), []
    schema = messages(spark, [1]).schema
    for _ in range(4):
        ids = [rng.randrange(40) for _ in range(25)]
        seen |= set(ids)
        messages(spark, ids).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        events.consume(stream, f"{tmp_path}/out", f"{tmp_path}/state", lambda df: published.extend(r.event_id for r in df.collect())).awaitTermination(120)
    out = [r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(out) == sorted(map(str, seen)) == sorted(published)


def test_a_batch_that_fails_while_publishing_is_stored_once(spark, tmp_path):
    messages(spark, range(10)).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(messages(spark, [1]).schema).parquet(f"{tmp_path}/in")

    def lost(df):
        raise OSError("no client")

    with pytest.raises(Exception, match="no client"):
        events.consume(stream(), f"{tmp_path}/out", f"{tmp_path}/state", lost).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    got = []
    events.consume(stream(), f"{tmp_path}/out", f"{tmp_path}/state", lambda df: got.append(df.count())).awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10 and got == [10]


def test_consume_reads_nothing_that_is_stored(spark, tmp_path):
    """The target may hold what can't be read: batches write their own folders only."""
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "batch=99").mkdir()
    (tmp_path / "out" / "batch=99" / "part-0.parquet").write_bytes(b"broken")
    messages(spark, range(3)).write.parquet(f"{tmp_path}/in")
    events.consume(spark.readStream.schema(messages(spark, [1]).schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/batch=0").count() == 3


def test_messages_of_a_batch_are_parsed_by_all_tasks(spark, monkeypatch):
    """Each of three batches was one file, and parsing it was left to the task that read it."""
    from medlattice.plans import sinks
    from medlattice.sources.driver import Domain

    asked, real = [], events.file_stream
    monkeypatch.setattr(events, "file_stream", lambda s, folder, schema, files=1: asked.append(files) or real(s, folder, schema, files))
    batches = []
    n = sinks._consumed(Domain(spark, "/root/testdata/sf0.001"), lambda b: batches.append(b.count())).count()
    assert asked == [spark.sparkContext.defaultParallelism] and len(batches) == 3 and sum(batches) == n > 0
