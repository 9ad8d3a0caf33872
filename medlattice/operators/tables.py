"""Extracted tables: validity, header rows, carried headers, structural profiles of pages and JSON bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SPACE_CHAR, blank, is_junk_cell, without_trailing_blanks

#: Words of headers, and texts that mark a real or a repeated header row.
TABLE_WORDS = (
    "no", "name", "batch", "date", "mfg", "exp", "reason", "drawn", "from", "nsq", "result", "reported", "device", "intended", "use", "risk", "class", "file", "company", "product", "regulatory", "status", "subject", "content",
    "page", "lot", "strength", "notification", "manufacturer", "remarks", "reply", "category", "testing", "facility", "vaccine", "strain", "indication", "month", "day", "study", "duration",
)
PARAGRAPH_WORDS = ("batch", "category", "date", "device", "drug", "exp", "expiry", "failure", "from", "lot", "manufacturer", "mfg", "name", "no", "product", "reason", "reported", "result", "serial", "status")
REAL_HEADER = ("s. no", "s no", "s.no", "sl no", "sr. no", "s n o", "s n", "name of drug", "product", "batch", "manufactured by", "reason for failure")
REPEATED_HEADER = ("s no", "s n", "batch no", "product", "manufactured by", "name of drug")
RECORD_ARRAYS = ("records", "items", "results", "rows", "data", "nsq_records", "spurious_records", "prohibited_drugs", "adr_alerts", "fdc_list")
STRATEGIES = ("default", "text", "mixed_v_text", "mixed_h_text")


def _mean_length(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c)) / F.size(cells)


def _any_in(text: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def table_header_score(cells: Column, serial: bool = True) -> Column:
    """Score of a row as a table's header, null if it can't be one; ``serial`` punishes a serial number in front.

    Words of headers count ten, cells two, their mean length up to two.
    """
    kept = F.filter(cells, lambda c: (c != "") & ~is_junk_cell(c))
    text = F.array_join(kept, " ")
    ascii_share = (F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))) / F.length(text)
    hits = F.size(F.filter(kept, lambda c: _any_in(F.lower(c), TABLE_WORDS)))
    fits = (F.size(kept) >= 2) & (ascii_share >= 0.85) & (_mean_length(kept) >= 3)
    score = hits * 10 + F.size(kept) * 2 + F.least(_mean_length(kept), F.lit(20.0)) * 0.1
    penalty = F.when(F.get(kept, 0).rlike(r"^[0-9]+\s*[.)]?$"), 20).otherwise(0) if serial else F.lit(0)
    return F.when(fits & (score - penalty > -1), score - penalty)


def paragraph_header_score(cells: Column) -> Column:
    """The variant for tables within prose: whole lower-case words, cells with letters and distinct cells count."""
    kept = F.filter(cells, lambda c: c != "")
    found = F.flatten(F.transform(kept, lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))))
    hits = F.size(F.filter(found, lambda w: w.isin(*PARAGRAPH_WORDS)))
    letters = F.size(F.filter(kept, lambda c: c.rlike(r"\p{L}")))
    unique = F.size(F.array_distinct(F.transform(kept, F.lower))) / F.size(kept)
    fits = (F.size(kept) >= 2) & (F.size(found) > 0) & (letters >= 2) & (unique >= 0.5)
    return F.when(fits, hits * 5 + letters * 2 + unique + F.least(_mean_length(kept), F.lit(20.0)) / 20)


def best_header(rows: DataFrame, table: str, score: Column, first: int) -> DataFrame:
    """(table, idx, header, first_row) of rows(table, idx, cells): the best of a table's first rows, of equals the earliest."""
    scored = rows.filter(F.col("idx") <= first).withColumn("s", F.when(F.col("idx") < first, score))
    best = scored.groupBy(table).agg(F.max_by("idx", F.struct("s", -F.col("idx"))).alias("best"), F.max("s").alias("top"), F.map_from_entries(F.collect_list(F.struct("idx", "cells"))).alias("rows"))
    row = lambda i: without_trailing_blanks(F.try_element_at("rows", i))
    return best.filter("top is not null").select(table, F.col("best").alias("idx"), row(F.col("best")).alias("header"), row(F.col("best") + 1).alias("first_row"))


def best_candidate(candidates: DataFrame, table: str) -> DataFrame:
    """Of candidates(table, categories, skipped, offset) the one with most header categories, fewest skipped rows, smallest offset."""
    return candidates.groupBy(table).agg(F.max_by(F.struct("categories", "skipped", "offset"), F.struct("categories", -F.col("skipped"), -F.col("offset"))).alias("b")).select(table, "b.*")


def header_row(rows: Column) -> Column:
    """0-based place of the real header in a table's rows: of the first 15 one with three cells and a header's words, else of the first five one with two, else the first."""
    full = lambda r: F.filter(r, lambda c: F.trim(blank(c)) != "")
    worded = F.transform(F.slice(rows, 1, 15), lambda r: (F.size(full(r)) >= 3) & _any_in(F.lower(F.array_join(full(r), " ")), REAL_HEADER))
    wide = F.transform(F.slice(rows, 1, 5), lambda r: F.size(full(r)) >= 2)
    at = lambda flags: F.nullif(F.array_position(flags, True), F.lit(0))
    return (F.coalesce(at(worded), at(wide), F.lit(1)) - 1).cast("int")


def carried_headers(tables: DataFrame, doc: str) -> DataFrame:
    """(doc, position, header, data) of tables(doc, position, rows): the first table's header is that of all; a repeated header row goes."""
    first = Window.partitionBy(doc).orderBy("position")
    d = tables.filter(F.size("rows") > 0).withColumn("at", header_row(F.col("rows"))).withColumn("nth", F.row_number().over(first))
    own = F.filter(F.get("rows", F.col("at")), lambda c: F.trim(blank(c)) != "")
    top = F.lower(F.array_join(F.get("rows", 0), " "))
    skipped = F.when(F.col("nth") == 1, F.col("at") + 1).otherwise(F.when(_any_in(top, REPEATED_HEADER), 1).otherwise(0))
    header = F.first(F.when(F.col("nth") == 1, own), ignorenulls=True).over(first)
    return d.withColumn("header", header).select(doc, "position", "header", F.slice("rows", skipped + 1, F.greatest(F.size("rows") - skipped, F.lit(0))).alias("data"))


def _widths(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.size(F.filter(r, lambda c: F.trim(blank(c)) != "")))


def is_table(rows: Column) -> Column:
    """Two rows of two cells or more, and widths of filled rows that differ by six at most."""
    filled = F.filter(_widths(rows), lambda n: n > 0)
    return (F.size(rows) >= 2) & (F.size(F.filter(filled, lambda n: n >= 2)) >= 2) & (F.array_max(filled) - F.array_min(filled) <= 6)


def is_text_table(rows: Column) -> Column:
    """The stricter gate for tables found by text alone: three rows, even widths, short cells, no sentence as a header."""
    w = _widths(rows)
    short = F.forall(F.flatten(rows), lambda c: F.length(c) <= 200)
    sentence = F.exists(F.get(rows, 0), lambda c: F.rtrim(c).rlike("[.?!]$"))
    return (F.size(rows) >= 3) & (F.array_min(w) >= 2) & (F.array_max(w) - F.array_min(w) <= 2) & short & ~sentence


def cascade(candidates: DataFrame, page: str) -> DataFrame:
    """(page, strategy, tables) of candidates(page, strategy, tables): the first strategy with a valid table and its valid tables; none if no one has."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy"))
    valid = F.filter("tables", lambda t: F.coalesce(F.when(F.col("strategy") == "text", is_text_table(t)).otherwise(is_table(t)), F.lit(False)))
    d = candidates.withColumn("rank", rank).withColumn("valid", valid)
    ok = (F.size("valid") > 0) & (F.col("rank") > 0)
    best = d.groupBy(page).agg(F.min_by(F.struct("strategy", "valid"), F.when(ok, F.col("rank"))).alias("b"))
    none = F.array().cast(candidates.schema["tables"].dataType)
    return best.select(page, F.coalesce("b.strategy", F.lit("none")).alias("strategy"), F.coalesce("b.valid", none).alias("tables"))


def strategy_counters(pages: DataFrame, doc: str, strategy: str) -> DataFrame:
    """(doc, counters): how often each strategy won, as a map."""
    n = pages.groupBy(doc, strategy).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(strategy, "n")))).alias("counters"))


def structural_profile(pages: DataFrame, doc: str) -> DataFrame:
    """Counts of text, image and empty pages(doc, text, has_images, has_table), the document's kind, its words, whether it has tables."""
    t = F.regexp_replace(blank(F.col("text")), f"^{SPACE_CHAR}+|{SPACE_CHAR}+$", "")
    kind = F.when(t != "", "text").when(F.col("has_images"), "image").otherwise("empty")
    n_words = F.when(t == "", 0).otherwise(F.size(F.split(t, f"{SPACE_CHAR}+")))
    d = pages.select(doc, kind.alias("kind"), "has_table", n_words.alias("n_words"))
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_pages")
    g = d.groupBy(doc).agg(F.count(F.lit(1)).alias("total_pages"), count("text"), count("image"), count("empty"), F.bool_or("has_table").alias("has_tables"), F.sum("n_words").alias("entity_total"))
    text, image = F.col("text_pages") > 0, F.col("image_pages") > 0
    return g.withColumn("primary_type", F.when(text & image, "mixed").when(text, "text").when(image, "scanned").otherwise("empty"))


def json_profile(body: Column) -> Column:
    """struct(root, keys, array_keys, records, item_type, class) of a JSON text; null if it is none."""
    v = F.try_parse_json(body)
    shape = lambda x: F.schema_of_variant(x)
    kind = lambda x: F.when(F.startswith(shape(x), F.lit("OBJECT")), "object").when(F.startswith(shape(x), F.lit("ARRAY")), "array").otherwise("value")
    root = F.when(F.startswith(shape(v), F.lit("OBJECT")), "object").when(F.startswith(shape(v), F.lit("ARRAY")), "array").when(shape(v) == "VOID", "null").otherwise("scalar")
    entries = F.when(root == "object", F.map_entries(F.from_json(body, "map<string,variant>")))
    lists = F.transform(F.filter(entries, lambda e: kind(e["value"]) == "array"), lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "array<variant>").alias("items")))
    held = F.filter(lists, lambda e: F.lower(e["key"]).isin(*RECORD_ARRAYS) | F.exists(e["items"], lambda x: F.coalesce(kind(x) == "object", F.lit(False))))
    items = F.when(root == "array", F.from_json(body, "array<variant>")).otherwise(F.flatten(F.transform(held, lambda e: e["items"])))
    kinds = F.array_distinct(F.transform(items, lambda x: F.coalesce(kind(x), F.lit("value"))))
    item_type = F.when(F.size(items) == 0, "empty").when(F.size(kinds) > 1, "mixed").otherwise(F.get(kinds, 0))
    cls = (
        F.when((root == "array") & (item_type == "object"), "record-array").when((root == "array") & (F.size(items) == 0), "empty-array").when(root == "array", F.concat(item_type, F.lit("-array")))
        .when(root != "object", "json-scalar").when(F.size(held) == 0, "object-no-record-array").when(item_type == "object", "object-with-record-arrays").otherwise("object-with-arrays")
    )
    lists_of = (root == "array") | (F.size(held) > 0)
    return F.when(
        v.isNotNull(),
        F.struct(
            F.when(root == "scalar", "null").otherwise(root).alias("root"), F.coalesce(F.array_join(F.transform(entries, lambda e: e["key"]), "|"), F.lit("")).alias("keys"), F.coalesce(F.array_join(F.transform(held, lambda e: e["key"]), "|"), F.lit("")).alias("array_keys"),
            F.when(lists_of, F.size(items)).otherwise(0).cast("long").alias("records"), F.when(lists_of, item_type).otherwise("").alias("item_type"), cls.alias("class"),
        ),
    )
