"""Line dedup by site-relative frequency, in DataFrame functions only.

A page's text is its HTML with scripts, styles and comments removed and block
tags turned into line ends. For each host, the pages that contain a line are
divided by the host's pages; a line whose ratio exceeds ``max_ratio`` is
boilerplate and is dropped from all pages of that host. A host's boilerplate
lines number at most its mean lines a page over ``max_ratio``, whatever its size,
so they travel as one array a host.

Defined results: a null or empty html has no lines and an empty text. Hosts of
fewer than ``min_pages`` pages, and pages whose url has no host, keep all lines.
A line that repeats within a page counts once for the ratio; if it is
boilerplate all its repeats go. Repeated rows of a page count as pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, narrow, table

MAX_RATIO, MIN_PAGES = 0.3, 5
#: Boilerplate lines (16 bytes each) of all hosts that are sent to every task.
SEND_LINES = 500_000
#: Patterns that both engines read alike.
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BREAK = r"(?i)<br[^>]*>|</?(p|div|li|ul|ol|nav|article|section|header|footer|main|aside|table|tr|title|head|body|h[1-6])(\s[^>]*)?>"
TAG = r"<[^>]*>"


def host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end; A-Z in lower case; null without ://."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.translate(F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def lines(html: Column) -> Column:
    """Non-empty lines of the visible text, without space around them."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r\f]+|[ \t\r\f]+$", "")), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def drop_boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, n_lines, n_removed, text) of every page."""
    split = pages.select(F.col(page_id).alias("page_id"), F.coalesce(host(F.col(url)), F.lit("")).alias("host"), lines(F.col(html)).alias("lines"))
    keys = F.array_distinct(F.transform("lines", _key))
    seen = split.filter("host <> ''").select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    # a host has min_pages pages at least; lines of fewer pages than that implies go before a hot host's lines meet
    seen = seen.filter(F.col("n") > F.lit(min_pages * float(max_ratio)))
    totals = split.select("host").filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= min_pages)
    bad = seen.join(totals, "host").filter(F.col("n") > F.col("total") * F.lit(float(max_ratio))).groupBy("host").agg(F.collect_set("key").alias("bad"))
    bad = Staged(pages.sparkSession, "line_dedup").write(bad, pages.count())
    # sent to all tasks where few; else both sides are sorted, and Spark splits hot hosts
    few = (bad.agg(F.sum(F.size("bad"))).first()[0] or 0) <= SEND_LINES
    out = split.join(F.broadcast(bad) if few else bad.hint("merge"), "host", "left").withColumn("kept", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("bad", _key(x)))))
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join("kept", "\n").alias("text"))


def op4_site_relative_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(narrow(table(spark, sf_dir, "pages"), "page_id", "url", "html"))


OP4_SQL = rf"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', ' ', 'g'), '{BREAK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)),
    lambda x: regexp_replace(x, '^[ \t\r\f]+|[ \t\r\f]+$', '', 'g')), lambda x: x <> '') AS lines FROM pages),
t AS (SELECT coalesce(host, '') AS host, page_id, lines FROM p),
h AS (SELECT host, count(*) AS total FROM t WHERE host <> '' GROUP BY host HAVING count(*) >= {MIN_PAGES}),
s AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM t) GROUP BY host, line),
b AS (SELECT host, list(line) AS bad FROM s JOIN h USING (host) WHERE n > total * {MAX_RATIO}::DOUBLE GROUP BY host),
k AS (SELECT page_id, t.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM t LEFT JOIN b USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_removed, array_to_string(kept, chr(10)) AS text FROM k
"""
