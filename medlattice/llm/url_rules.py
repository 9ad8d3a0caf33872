"""URL filters by association rules.

Spark's FP-growth mines the token combinations of labelled bad URLs. A
combination becomes a rule if its support among the bad URLs and its confidence
(bad over all labelled URLs that hold it) reach their limits and no rule with
fewer tokens is part of it. Tokens are taken from the whole URL and no limit is
set on their number in a rule: tokens that the same labelled URLs hold count as
one (a rule with either says the same), and tokens that are rules alone are not
combined further (what they would make is no smallest rule). A rule is posted under its rarest token; a URL meets
the rules of its tokens by a join and is blocked if it holds all tokens of one.

Defined results: a null url, or one without ``://``, has an empty host and path
and no tokens, and is allowed. Repeated URLs are judged alike. Without labelled
bad URLs, or rules that reach the limits, the method allows everything.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, narrow, table
from .line_dedup import host

MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.01, 20, 0.8
#: Labelled URLs that one task of FP-growth reads; more are dealt to more tasks.
MINE_ROWS = 20_000
#: The explicit rules of the query: verdict, host, path.
EXPLICIT = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0))


def tokens(url: Column) -> Column:
    """Host labels, words of host and path, and parameters (name, and name with value) of the whole URL; distinct."""
    h, p = F.coalesce(host(url), F.lit("")), F.coalesce(path(url), F.lit(""))
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    parts = F.filter(F.split(h, r"[.\-]"), lambda x: x != "")
    steps = F.filter(F.split(F.lower(p), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    pairs = F.filter(F.split(F.lower(F.regexp_extract(url, r"\?([^#]*)", 1)), "[&;]"), lambda x: x != "")
    mark = lambda kind, a: F.transform(a, lambda x: F.concat(F.lit(kind), x))
    named = F.transform(pairs, lambda x: F.substring_index(x, "=", 1))
    every = F.concat(mark("host:", labels), mark("word:", F.array_except(parts, labels)), mark("path:", steps), mark("name:", named), mark("pair:", pairs))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def explicit(host: Column, path: Column, rules=EXPLICIT) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are a short configured list."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, rule_id) for each url (id, tokens) that holds all tokens of a rule (rule_id, posted, rule_tokens)."""
    posted = urls.select("id", "tokens", F.explode("tokens").alias("posted"))
    return posted.join(rules, "posted").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0).select("id", "rule_id")


def mine(labelled: DataFrame, staged: Staged, bound: int, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, rule_tokens, posted, support, confidence) of labelled(id, tokens, bad boolean)."""
    spark = labelled.sparkSession
    labelled = staged.write(labelled.filter(F.size("tokens") > 0).withColumn("row", F.monotonically_increasing_id()), bound)
    n_bad = labelled.filter("bad").count()
    schema = "rule_id long, rule_tokens array<string>, posted string, support long, confidence double"
    if n_bad < min_count:
        return spark.createDataFrame([], schema)
    least = max(min_count, min_support * n_bad)
    held = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    stats = held.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.count_if("bad").alias("support"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"))
    # of tokens that the same rows hold, one speaks for all
    known = staged.write(stats.filter(F.col("support") >= least).groupBy("df", "support", "x", "y").agg(F.min("token").alias("token")), bound).select("token", "df", "support")
    alone = F.col("support") / F.col("df") >= min_confidence
    single = known.filter(alone).select(F.xxhash64(F.array("token")).alias("rule_id"), F.array("token").alias("rule_tokens"), F.col("token").alias("posted"), "support", (F.col("support") / F.col("df")).alias("confidence"))
    rest = known.filter(~alone).select("token")
    baskets = held.filter("bad").join(rest, "token").groupBy("row").agg(F.collect_list("token").alias("items"))  # at most a URL's tokens
    tasks = max(1, -(-n_bad // MINE_ROWS))
    baskets = staged.write(baskets, bound)
    share = min(1.0, least / max(1, baskets.count()) * 0.999999)  # the count decides below
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=1.0, numPartitions=max(tasks, spark.sparkContext.defaultParallelism)).fit(baskets.repartition(tasks))
    sets = model.freqItemsets.filter((F.size("items") > 1) & (F.col("freq") >= least)).select(F.array_sort("items").alias("rule_tokens"), F.col("freq").alias("support"))
    sets = sets.select("rule_tokens", "support", F.xxhash64("rule_tokens").alias("rule_id"))
    rarest = sets.select("rule_id", F.explode("rule_tokens").alias("token")).join(known.select("token", "df"), "token").groupBy("rule_id").agg(F.min(F.struct("df", "token")).alias("least"))
    sets = staged.write(sets.join(rarest, "rule_id").select("rule_id", "rule_tokens", F.col("least.token").alias("posted"), "support"))
    met = _matches(labelled.select(F.col("row").alias("id"), "tokens"), sets).groupBy("rule_id").agg(F.count(F.lit(1)).alias("all"))
    good = sets.join(met, "rule_id").withColumn("confidence", F.col("support") / F.col("all")).filter(F.col("confidence") >= min_confidence).drop("all")
    good = staged.write(good.select("rule_id", "rule_tokens", "posted", "support", "confidence").unionByName(single))
    wider = _matches(good.select(F.col("rule_id").alias("id"), F.col("rule_tokens").alias("tokens")), good).filter("id <> rule_id").select(F.col("id").alias("rule_id")).distinct()
    return good.join(wider, "rule_id", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, rules=EXPLICIT, **limits) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) of pages(page_id, url); labels(page_id, bad) train the rules."""
    staged = Staged(pages.sparkSession, "url_rules")
    h, p = F.coalesce(host(F.col("url")), F.lit("")), F.coalesce(path(F.col("url")), F.lit(""))
    split = pages.select("page_id", "url", h.alias("host"), p.alias("path"), tokens(F.col("url")).alias("tokens"))
    split = split.withColumn("id", F.xxhash64("url"))
    bound = pages.count()
    bad = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    mined = staged.write(mine(split.join(bad, "page_id").select("id", "tokens", "bad"), staged, bound, **limits), bound)
    distinct = split.select("id", "tokens").dropDuplicates(["id"])
    hit = _matches(distinct, mined).groupBy("id").agg(F.min("rule_id").alias("mined"))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    out = split.join(hit, "id", "left").withColumn("rule", rule).withColumn("said", verdict)
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined")


def op5_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = narrow(table(spark, sf_dir, "pages"), "page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("bad"))
    return judge(pages, labels)
