"""Payloads of binary files and API answers, with pluggable readers for formats that need a library of their own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A reader gives (text, tables) for each page of a file; a table is a list of rows of cells.
Page = tuple[str, list[list[list[str]]]]
PAGES = "path string, page int, type string, method string, text string, tables array<array<array<string>>>, error string"


def text_pages(content: bytes) -> list[Page]:
    """The reader that needs no library: pages end at form feeds; lines with tabs are rows of one table."""
    pages = []
    for part in content.decode("utf-8", "replace").split("\f"):
        lines = part.split("\n")
        rows = [x.split("\t") for x in lines if "\t" in x]
        pages.append(("\n".join(x for x in lines if "\t" not in x).strip(), [rows] if rows else []))
    return pages


def no_ocr(content: bytes, page: int) -> str:
    """The stub for optical character recognition: it reads nothing."""
    return ""


def payloads(files: DataFrame, read: Callable[[bytes], list[Page]] = text_pages, ocr: Callable[[bytes, int], str] = no_ocr) -> DataFrame:
    """Pages of files(path, content): text, tables, or OCR only where a page has neither.

    ``read`` and ``ocr`` are plain functions, run in batches on the executors. A
    file that can't be read gives one row with the error and stops nothing else.
    """

    def run(frames):
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                content = bytes(content or b"")
                try:
                    pages = read(content)
                except Exception as e:  # noqa: BLE001 - a reader's own errors are data
                    out.append((path, None, "failed", "none", "", [], f"{type(e).__name__}: {e}"))
                    continue
                for n, (text, tables) in enumerate(pages, 1):
                    method, kind = "text", "text" if text else "table"
                    if not text and not tables:
                        text = ocr(content, n)
                        method, kind = ("ocr", "image") if text else ("none", "empty")
                    out.append((path, n, kind, method, text, tables, None))
            frame = pd.DataFrame(out, columns=["path", "page", "type", "method", "text", "tables", "error"])
            yield frame.astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGES)


def api_records(files: DataFrame, key: str = "aaData") -> DataFrame:
    """(path, record, error) of API answers(path, content): the objects of the list under ``key``; another shape is an error."""
    body = F.col("content")
    held = F.get_json_object(body, f"$.{key}")
    ok = F.startswith(F.trim(body), F.lit("{")) & F.try_parse_json(body).isNotNull() & F.startswith(F.trim(held), F.lit("["))
    ok = F.coalesce(ok, F.lit(False))
    items = F.filter(F.from_json(held, "array<string>"), lambda x: F.startswith(F.trim(x), F.lit("{")))
    good = files.filter(ok).select("path", F.explode(items).alias("item")).select("path", F.from_json("item", "map<string,string>").alias("record"), F.lit(None).cast("string").alias("error"))
    bad = files.filter(~ok).select("path", F.lit(None).cast("map<string,string>").alias("record"), F.lit(f"unexpected shape: no list of {key}").alias("error"))
    return good.unionByName(bad)


def api_row(record: Column, number: Column, spurious: Column) -> Column:
    """The output row of an API record as map: one layout for lists of spurious drugs, one for the others. A missing value in a composed text reads None."""
    get = lambda n: F.try_element_at(record, F.lit(n))
    said = lambda n: F.coalesce(get(n), F.lit("None"))
    shared = {"Reporting Source": get("str_reporting_source"), "Reporting by Lab/State": get("str_reported_by_lab_or_state"), "Reporting Month & Year": get("dt_reporting_month_year")}
    own = {
        "S.No": number.cast("string"), "Name of Product": get("product_name_from_dtl"), "Batch No": get("str_batch_no"), "Manufacturing Dates": F.concat(F.lit("Manufacturing Date: "), said("dt_manufacturing_date"), F.lit(" Expiry Date: "), said("dt_expiry_date")),
        "Manufacturer Details": F.concat(F.lit("Manufacturer Name: "), said("str_manufactured_by"), F.lit(" Manufactured By: "), said("str_manufactured_by")), **shared, "Remarks": F.trim(F.concat_ws(" ", F.coalesce(get("str_nsq_remarks"), F.lit("")), F.coalesce(get("str_firm_reply"), F.lit("")))),
    }
    other = {"S.No": number.cast("string"), "Name of Product": get("str_product_name"), "Batch No": get("str_batch_no"), "Manufacturing Date": get("dt_manufacturing_date"), "Expiry Date": get("dt_expiry_date"), "Manufactured By": get("str_manufactured_by"), "NSQ Result": get("str_nsq_result"), **shared}
    as_map = lambda m: F.create_map(*[x for k, c in m.items() for x in (F.lit(k), c)])
    return F.when(spurious, as_map(own)).otherwise(as_map(other))
