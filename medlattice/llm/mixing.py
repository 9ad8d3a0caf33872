"""Mixing sources to target weights by systematic sampling.

A source's documents are laid out along a line, each as long as its expected
copies (target over source size, at most ``max_repeat``). One offset per source
is drawn from a hash; a document is emitted once for every integer its stretch
crosses. The line is ordered by size class (eight a power of two) and hash, so each size class gets its
share and the words taken come near the target. The layout is a distributed
prefix sum: no source is sorted in one task.

Defined results: a null text has size 0; null sources form one source, last in
the order; a source of size 0 has target 0. Equal rows are interchangeable.
The draw depends on the seed and the rows alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staged, hex_digits, levels_of, narrow, ranked, table

WEIGHTS, TOTAL, MAX_REPEAT, SEED = (5, 2, 1), 1.5, 2, "mix"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) of sizes(source, source_size, n): one row per source.

    Targets share ``total`` of all words by the weights, dealt in code-point
    order of the sources; a target stops at ``max_repeat`` times its source's
    size, and what it leaves is shared again by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap, weight = F.col("source_size") * float(max_repeat), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = sizes.select("*", cap.alias("cap"), weight.alias("w")).withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.select("*", (F.sum("source_size").over(whole) * F.lit(float(total))).alias("all_words"), F.sum("w").over(whole).alias("all_w"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    t = t.withColumn("full", F.col("cap") * (F.col("all_w") - F.col("w_before")) <= F.col("w") * (F.col("all_words") - F.col("cap_before")))
    left = (F.col("all_words") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)) / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(whole)
    return t.withColumn("level", F.when(F.col("full"), F.lit(0.0)).otherwise(left)).select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, max_repeat: float = MAX_REPEAT, seed: str = SEED, text: str = "text", doc_id: str = "doc_id", source: str = "source", words: Column | None = None) -> DataFrame:
    """docs with ``size``, ``source_size``, ``target`` and ``copies``; columns of these names are replaced."""
    made = ("size", "source_size", "target", "copies")
    sized = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], (word_count(text) if words is None else words).alias("size"))
    totals = narrow(sized, source, "size").groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    totals = Staged(docs.sparkSession, "mixing").write(totals, 1)
    found = totals.agg(F.sum("n"), F.count(F.lit(1))).first()
    digits = hex_digits(found[0] or 0, 40_000)
    goal = targets(totals, weights, total, max_repeat).select(F.col("source").alias("_source"), "source_size", "target")
    draw = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    sized = sized.withColumn("_class", F.concat(F.lpad(F.length(F.bin("size")).cast("string"), 2, "0"), F.substring(F.bin("size"), 1, 4))).withColumn("_draw", draw)
    bucket = F.concat("_class", F.substring("_draw", 1, digits))
    placed = ranked(sized, [source], bucket, [F.col("_class"), F.col("_draw"), F.col(doc_id), F.col("size"), F.xxhash64(text)], "_rank", levels_of(digits))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_source"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = goal.select("_source", "source_size", "target", rate.alias("_rate"), offset.alias("_offset"))
    # one row per source; the hint is dropped where sources are too many to send
    out = placed.join(F.broadcast(rates) if found[1] <= 100_000 else rates, F.col(source).eqNullSafe(F.col("_source")))
    copies = (F.floor((F.col("_rank") + 1) * F.col("_rate") + F.col("_offset")) - F.floor(F.col("_rank") * F.col("_rate") + F.col("_offset"))).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], "size", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])


def op8_systematic_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    # only sizes travel: the hash that orders equal ids needs no text here
    light = docs.select("doc_id", "source", word_count().alias("words"), F.lit(None).cast("string").alias("text"))
    return mix(light, words=F.col("words")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 2.0::DOUBLE AS cap, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS all_words, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before FROM w
  WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (all_w - w_before) <= w * (all_words - cap_before) AS is_full FROM r),
g AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * ((all_words - sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER ()) / sum(CASE WHEN is_full THEN 0.0 ELSE w END) OVER ()) END::DOUBLE AS target FROM f),
p AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), substr(bin(size), 1, 4), md5(coalesce(doc_id::VARCHAR, '')), doc_id, size) - 1 AS k FROM d),
q AS (SELECT p.doc_id, p.size, g.source_size, g.target, p.k, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(g.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (floor((k + 1) * rate + u) - floor(k * rate + u))::BIGINT)::BIGINT AS taken FROM q
"""
