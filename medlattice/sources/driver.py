"""Domain relations over the star-schema tables, so that every operator has data to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table's files whose rows one task meets where rows are held by key: as many at any size of the table.
TASK_BYTES = 8 << 20
#: The same where a table is stored in few bytes a row and each row becomes several.
SMALL_TASK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Domain:
    """Products, organizations, batches, events and documents of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def tasks(self, name: str, size: int | None = None) -> int:
        """How many tasks the rows of a table are for: one for ``size`` bytes of its files, and one a core at least."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return max(self.spark.sparkContext.defaultParallelism, -(-fs.getContentSummary(path).getLength() // (size or TASK_BYTES)))

    def dealt(self, name: str, key: str, by: str | None = None, size: int | None = None) -> DataFrame:
        """A table dealt by a key to tasks whose number follows the bytes of the table's files, or of those of ``by``: one for ``size`` bytes."""
        return self.table(name).repartition(self.tasks(by or name, size), key)

    def products(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand_name"), F.lower("p_name").alias("normalized_search_name"), F.col("p_type").alias("dosage_form"), F.concat(F.col("p_size").cast("string"), F.lit(" mg")).alias("strength"))

    def organizations(self) -> DataFrame:
        nation = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
        return self.table("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lower("s_name").alias("normalized_name"), F.col("n_name").alias("state"), F.col("r_name").alias("country"))

    def product_organizations(self) -> DataFrame:
        return self.dealt("lineitem", "l_partkey").select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("organization_id")).distinct().withColumn("role", F.lit("MANUFACTURER"))

    def product_ingredients(self) -> DataFrame:
        p = self.products()
        return p.select(F.col("id").alias("product_id"), F.explode(F.split("product_name", " ")).alias("name"), F.col("strength").alias("strength_text")).withColumn("normalized_name", F.lower("name"))

    def batches(self) -> DataFrame:
        """One batch for each number: the smallest of the rows that share it."""
        number = F.concat(F.lit("B-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("batch_number")
        first = F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate")).alias("m")
        return self.dealt("lineitem", "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(first).select(number, F.col("m.l_partkey").alias("product_id"), F.col("m.l_suppkey").alias("organization_id"), F.to_date("m.l_shipdate").alias("manufacturing_date"))

    def events(self) -> DataFrame:
        li, o = self.dealt("lineitem", "l_orderkey"), self.dealt("orders", "o_orderkey", by="lineitem")
        kind = F.when(F.col("l_returnflag") == "A", "NSQ").when(F.col("l_returnflag") == "R", "RECALL").otherwise("APPROVAL")
        legal = F.when(F.col("o_orderstatus") != "P", F.lit(None)).when(F.col("o_orderpriority") == "5-LOW", "STAYED").when(F.col("o_orderpriority") == "1-URGENT", "PROHIBITED")
        return (
            li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("l_partkey").alias("product_id"), F.concat(F.lit("B-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("batch_number"), F.col("l_suppkey").alias("organization_id"),
                kind.alias("event_type"), F.when(F.col("l_linestatus") == "F", "BATCH").otherwise("PRODUCT").alias("scope"), legal.cast("string").alias("legal_status"), F.col("o_orderpriority").alias("reason"),
                F.to_date("o_orderdate").alias("event_date"), F.col("l_orderkey").alias("document_id"),
            )
            .distinct()
        )

    def pipeline_events(self) -> DataFrame:
        """Run events; a run is a user, and its task states follow from the kind of the event."""
        e = self.table("events")
        return e.select("event_id", F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id").alias("run_id"), "event_type", "value", "props")


#: The same relations for DuckDB, as common table expressions.
DOMAIN_SQL = """
products AS (SELECT p_partkey AS id, p_name AS product_name, p_brand AS brand_name, lower(p_name) AS normalized_search_name, p_type AS dosage_form, p_size::VARCHAR || ' mg' AS strength FROM part),
organizations AS (SELECT s_suppkey AS id, s_name AS name, lower(s_name) AS normalized_name, n_name AS state, r_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
product_organizations AS (SELECT DISTINCT l_partkey AS product_id, l_suppkey AS organization_id, 'MANUFACTURER' AS role FROM lineitem),
product_ingredients AS (SELECT id AS product_id, unnest(string_split(product_name, ' ')) AS name, strength AS strength_text FROM products),
batches AS (SELECT 'B-' || l_orderkey || '-' || l_linenumber AS batch_number, m.p AS product_id, m.s AS organization_id, m.d::DATE AS manufacturing_date
  FROM (SELECT l_orderkey, l_linenumber, min({'p': l_partkey, 's': l_suppkey, 'd': l_shipdate}) AS m FROM lineitem GROUP BY ALL)),
regulatory_events AS (SELECT DISTINCT l_partkey AS product_id, 'B-' || l_orderkey || '-' || l_linenumber AS batch_number, l_suppkey AS organization_id,
  CASE l_returnflag WHEN 'A' THEN 'NSQ' WHEN 'R' THEN 'RECALL' ELSE 'APPROVAL' END AS event_type, CASE l_linestatus WHEN 'F' THEN 'BATCH' ELSE 'PRODUCT' END AS scope,
  CASE WHEN o_orderstatus <> 'P' THEN NULL WHEN o_orderpriority = '5-LOW' THEN 'STAYED' WHEN o_orderpriority = '1-URGENT' THEN 'PROHIBITED' END AS legal_status,
  o_orderpriority AS reason, o_orderdate::DATE AS event_date, l_orderkey AS document_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
