"""The approval machine of runs as a stream with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .events import to_batches

#: The statuses in which an action counts, and the status it leads to; null is a run that is not known yet.
MOVES = {
    ("request", None): "pending", ("approve", "pending"): "approved", ("approve", "rejected"): "approved", ("reject", "pending"): "rejected", ("reject", "approved"): "rejected", ("ingest", "approved"): "ingested",
}
DECISIONS = ("approve", "reject")
RESULT = "run_id string, status string, decided_by string, moves long"


class Approvals(StatefulProcessor):
    """One value a run: its status, who decided, and how often it moved. An ingested run is final: nothing leads on from it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "status string, decided_by string, moves long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        held = self.run.get() if self.run.exists() else (None, None, 0)
        status, by, moves = held
        # within a batch actions count in their order; across batches as they come
        for r in sorted(rows, key=lambda r: (r.at, r.action, r.actor or "")):
            to = MOVES.get((r.action, status))
            if to is not None:
                status, moves = to, moves + 1
                by = r.actor if r.action in DECISIONS else by
        self.run.update((status, by, moves))
        yield Row(run_id=key[0], status=status, decided_by=by, moves=moves)

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run(actions: DataFrame, target: str, checkpoint: str):
    """Fold a stream actions(run_id string, at, action, actor) into the runs' states; each batch stores the runs it has seen."""
    spark = actions.sparkSession
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        states = actions.groupBy("run_id").transformWithState(Approvals(), RESULT, "Update", "None")
        return to_batches(states, target, checkpoint, mode="update")
    finally:
        spark.conf.unset(PROVIDER) if was is None else spark.conf.set(PROVIDER, was)


def states(spark: SparkSession, target: str) -> DataFrame:
    """(run_id, status, decided_by, moves) after the last batch that saw each run."""
    stored = spark.read.parquet(target)
    last = stored.groupBy("run_id").agg(F.max_by(F.struct("status", "decided_by", "moves"), F.col("batch").cast("long")).alias("s"))
    return last.select("run_id", "s.*")
