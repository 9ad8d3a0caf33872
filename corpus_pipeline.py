"""The corpus pipeline: documents in, sharded training mix out.

Each stage calls one operator of ``medlattice.llm`` on all rows its predecessor
kept. ``run`` writes every stage as Parquet to the shared folder and reads it
again, so a lost executor costs a task and not the run.

Defined results: null and empty texts are scored as one empty line, link with
nothing, hold no benchmark text, have size 0 in the mix and share a shard like
any other row; null sources are a source of their own. Rows without an id count
as the smallest id. Ties go to the smallest id, then the smallest text hash.
Empty tables give no rows; extra columns of documents pass through all stages
but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlattice.llm import decontaminate, line_crf, mixing, ngram_join, sharding
from medlattice.llm.common import Staged, narrow, ranked, table

#: Ids that are sent to all tasks; more are met by a shuffle join.
SEND_IDS = 500_000
#: Ids of one bucket when rows are numbered.
ROWS_A_BUCKET = 1000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose line CRF score reaches the threshold."""
    model = line_crf.quality_model(docs, table(spark, sf_dir, "labels"))
    return line_crf.score(docs, model).filter(F.col("score") >= line_crf.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of links, that of the smallest doc_id; a null id counts as the smallest.

    Rows that share an id are rows of their own: where there are any, all rows
    are numbered by id and text, so equal rows leave one and unlinked texts stay.
    """
    staged = Staged(spark, "near_duplicates")
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.max(F.col("doc_id").isNull())).first()
    rows = counts[1]
    if counts[0] <= 1 and not counts[2]:
        found = ngram_join.components(narrow(docs, "doc_id", "text"))
        odd = staged.write(found.filter("component_id <> doc_id").select("doc_id"), rows)
        return docs.join(F.broadcast(odd) if odd.count() <= SEND_IDS else odd, "doc_id", "left_anti").select(*docs.columns)
    id_bucket = F.lpad(F.coalesce((F.col("doc_id") / ROWS_A_BUCKET).cast("long"), F.lit(0)).cast("string"), 20, "0")
    same = F.xxhash64("text", F.length("text"))
    numbered = ranked(docs.withColumn("_one", F.lit(1)), ["_one"], id_bucket, [F.col("doc_id").asc_nulls_first(), same, F.col("text")], "_row", 2)
    numbered = staged.write(numbered.drop("_one"))
    found = ngram_join.components(numbered.select(F.col("_row").alias("doc_id"), "text"))
    odd = staged.write(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_row")), rows)
    return numbered.join(F.broadcast(odd) if odd.count() <= SEND_IDS else odd, "_row", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hit_spans") == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(mixing.mix(docs), docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(narrow(docs, "doc_id", "text"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixed", mixed), ("sharded", sharded)]

#: The classifier's training can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    staged = Staged(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = staged.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
