"""Links, tables and frames of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import decoded_number
from ..functions.text import collapse


def links(pages: DataFrame, drop: tuple[str, ...] = (), require: str | None = None, suffix: str | None = None) -> DataFrame:
    """(page_id, href, position) of anchors, each once a page; hints to drop, to require and a suffix are compared in lower case."""
    found = F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), F.lit(1))
    a = pages.select("page_id", F.posexplode(found).alias("n", "href"))
    low = F.lower("href")
    if drop:
        a = a.filter(~low.rlike("|".join(drop)))
    if require:
        a = a.filter(F.contains(low, F.lit(require)))
    if suffix:
        a = a.filter(F.contains(low, F.lit(suffix)))
    return a.groupBy("page_id", "href").agg((F.min("n") + 1).cast("long").alias("position"))


def year_links(pages: DataFrame, pattern: str = "(?i)Drug\\s+Alerts?\\s+(20\\d{2})") -> DataFrame:
    """(page_id, year, href): the newest year whose anchor text fits the pattern."""
    found = F.regexp_extract_all("html", F.lit(r'(?s)(<a\s+href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    a = pages.select("page_id", F.explode(found).alias("a"))
    body = F.regexp_replace("a", "<[^>]*>", " ")
    y = a.select("page_id", F.regexp_extract(body, pattern, 1).alias("year"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href")).filter("year <> ''")
    return y.groupBy("page_id").agg(F.max_by(F.struct("year", "href"), F.struct("year", "href")).alias("b")).select("page_id", "b.year", "b.href")


def cells(row: Column) -> Column:
    """Texts of a row's cells."""
    return F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: collapse(F.regexp_replace(c, "<[^>]*>", " ")))


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, position, cells, href, number) of table rows with cells; ``number`` is decoded from a ``num_id`` of the link."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("position", "row"))
    href = F.regexp_extract("row", 'href="([^"]*)"', 1)
    return rows.select("page_id", "position", cells(F.col("row")).alias("cells"), href.alias("href"), decoded_number(F.regexp_extract(href, "num_id=([A-Za-z0-9+/=]+)", 1)).alias("number")).filter(F.size("cells") > 0)


def frame_targets(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with ``target``: the page that an iframe shows, or the page itself."""
    src = F.regexp_extract("html", r'(?i)<iframe[^>]*src="([^"]*)"', 1)
    return pages.withColumn("target", F.when(src == "", F.col(url)).when(src.rlike("^https?://"), src).otherwise(F.concat(F.regexp_extract(F.col(url), "^(https?://[^/?#]*)", 1), F.when(src.startswith("/"), "").otherwise("/"), src)))
