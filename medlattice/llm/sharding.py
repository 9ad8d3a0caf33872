"""Sharding by balanced label propagation.

Documents start in the shard of their id's hash. Documents of a group (equal
texts) are linked with each other. In each round every group asks to move its
members to the shard that holds most of them among those with room; requests
are joined with the shards' quotas and granted in order, large blocks first,
until a shard is full. Members of a group in one shard are interchangeable, so a
round moves blocks (group, shard, rows), at most one row for each group and
shard. Unlinked documents then fill the shards exactly: counts differ by at
most one (law ``rows``). All ranks are distributed prefix sums; a group with a
third of all rows fills whole shards one after another.

Defined results: a null text has size 1 and the checksum of an empty text, and
is linked with nothing; empty texts are equal texts. Repeated rows each get a
slot. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staged, hex_digits, levels_of, narrow, prefix_sums, ranked, table

SHARDS, ROUNDS = 16, 16
#: Groups (about 100 bytes each) that are sent to all tasks; more are met by a join that splits hot keys.
SEND_GROUPS = 200_000


def _pick(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def _digits(col: Column, digits: int) -> Column:
    return F.substring(F.md5(col.cast("string")), 1, digits)


def propagate(blocks: DataFrame, room: int, shards: int, rounds: int, staged: Staged, bound: int) -> DataFrame:
    """blocks(hub, shard, n) after label propagation with at most about ``room`` linked rows a shard."""
    blocks = staged.write(blocks, bound)
    size = hex_digits(blocks.count())
    for _ in range(rounds):
        load = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [max(0, room - load.get(s, 0)) for s in range(shards)]
        held = F.element_at(_pick(free), F.col("shard") + 1)
        votes = blocks.groupBy("hub").agg(F.max(F.when(held > 0, F.struct(F.col("n"), F.xxhash64("hub", "shard").alias("tie"), F.col("shard").alias("to")))).alias("best"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members"))
        # a small group moves whole, to the roomiest shard if its own are full; a large one towards its larger blocks
        small = F.col("members") <= max(2, room // 16)
        roomy = max(range(shards), key=lambda s: (free[s], -s))
        stuck = F.col("best").isNull() & (F.col("parts") > 1) & small & F.lit(free[roomy] > 0)
        joins = (F.col("best.to") != F.col("shard")) & (small | (F.col("n") <= F.col("best.n")))
        asked = blocks.join(votes, "hub").select("hub", "shard", "n", F.when(stuck, F.lit(roomy)).when(joins, F.col("best.to")).alias("to"))
        order = F.concat(F.lpad((64 - F.length(F.bin("n"))).cast("string"), 2, "0"), _digits(F.col("hub"), size))
        wants = prefix_sums(asked.filter("to is not null"), ["to"], order, [order, F.col("hub"), F.col("shard")], F.col("n"), "before", levels_of(size))
        granted = wants.withColumn("a", F.least("n", F.greatest(F.lit(0), F.element_at(_pick(free), F.col("to") + 1) - F.col("before"))))
        parts = asked.filter("to is null").select("hub", "shard", "n", F.lit(0).alias("moved"))
        parts = parts.unionByName(granted.select("hub", "shard", (F.col("n") - F.col("a")).alias("n"), F.lit(0).alias("moved")))
        parts = parts.unionByName(granted.select("hub", F.col("to").alias("shard"), F.col("a").alias("n"), F.when(F.col("a") > 0, 1).otherwise(0).alias("moved")))
        after = staged.write(parts.filter("n > 0").groupBy("hub", "shard").agg(F.sum("n").cast("long").alias("n"), F.max("moved").alias("moved")), bound)
        still = after.agg(F.max("moved")).first()[0]
        staged.drop(blocks)
        blocks = after.select("hub", "shard", "n")
        blocks._staged_path = after._staged_path
        if not still:
            break
    return blocks


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    spark = docs.sparkSession
    staged = Staged(spark, "sharding")
    plain = F.coalesce(F.col(text), F.lit(""))
    base = staged.write(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(plain) + 1).cast("long").alias("size"), F.crc32(F.encode(plain, "UTF-8")).alias("text_crc32"), F.when(F.col(text).isNotNull(), F.xxhash64(text, F.length(text))).alias("hub")))
    rows = base.count()
    digits = hex_digits(rows)
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(shards)).cast("int")
    # counted by (group, shard) first, so a hot group is at most ``shards`` rows when its members are summed
    counts = base.filter("hub is not null").groupBy("hub", start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.withColumn("members", F.sum("n").over(Window.partitionBy("hub"))).filter("members > 1").drop("members")
    blocks = propagate(blocks, rows // shards, shards, rounds, staged, rows)

    # a shard over its quota gives up rows, small blocks first
    load = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    over = [max(0, load.get(s, 0) - quota[s]) for s in range(shards)]
    order = F.concat(F.lpad(F.length(F.bin("n")).cast("string"), 2, "0"), _digits(F.col("hub"), digits))
    kept = prefix_sums(blocks, ["shard"], order, [order, F.col("hub")], F.col("n"), "before", levels_of(digits))
    kept = kept.withColumn("n", F.col("n") - F.least("n", F.greatest(F.lit(0), F.element_at(_pick(over), F.col("shard") + 1) - F.col("before")))).filter("n > 0")
    stretches = staged.write(kept.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("kept")), rows)  # one entry a shard
    few = stretches.count() <= SEND_GROUPS
    met = F.broadcast(stretches) if few else stretches
    hubs = F.broadcast(stretches.select("hub")) if few else stretches.select("hub")

    # members of a group are dealt to its stretches in the order of a rank
    draw = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")))
    drawn = base.withColumn("draw", draw)
    members = ranked(drawn.join(hubs, "hub", "left_semi"), ["hub"], F.substring("draw", 1, digits), [F.col("draw"), F.col("doc_id")], "k", levels_of(digits))
    step = "case when s.shard is null and k < s.seen + x.n then named_struct('seen', s.seen + x.n, 'shard', x.shard) else named_struct('seen', s.seen + x.n, 'shard', s.shard) end"
    placed = members.join(met, "hub").withColumn("shard", F.expr(f"aggregate(kept, named_struct('seen', 0L, 'shard', cast(null as int)), (s, x) -> {step}, s -> s.shard)"))
    alone = drawn.join(hubs, "hub", "left_anti").withColumn("shard", F.lit(None).cast("int"))
    columns = ["doc_id", "size", "text_crc32", "draw", "shard"]
    all_rows = staged.write(placed.select(*columns).unionByName(alone.select(*columns)), rows)

    # loose rows fill what is missing of each shard's quota
    load = {r["shard"]: r["n"] for r in all_rows.filter("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends, total = [], 0
    for s in range(shards):
        total += quota[s] - load.get(s, 0)
        ends.append(total)
    loose = ranked(all_rows.filter("shard is null").withColumn("one", F.lit(1)), ["one"], F.substring("draw", 1, digits), [F.col("draw"), F.col("doc_id")], "k", levels_of(digits))
    fill = F.size(F.filter(_pick(ends), lambda e: e <= F.col("k"))).cast("int")
    whole = all_rows.filter("shard is not null").unionByName(loose.select("doc_id", "size", "text_crc32", "draw", fill.alias("shard")))
    slotted = ranked(whole, ["shard"], F.substring("draw", 1, digits), [F.col("draw"), F.col("doc_id")], "slot", levels_of(digits))
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))
