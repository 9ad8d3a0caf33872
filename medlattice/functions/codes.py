"""Codes on packs and in links: GTIN, element strings, base64 numbers, rectangles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank

#: Application identifiers with their length (0: up to a separator, at most the second number).
IDENTIFIERS = {"00": (18, 18), "01": (14, 14), "02": (14, 14), "10": (0, 20), "11": (6, 6), "12": (6, 6), "13": (6, 6), "15": (6, 6), "16": (6, 6), "17": (6, 6), "20": (2, 2), "21": (0, 20), "22": (0, 20), "30": (0, 8), "37": (0, 8), "240": (0, 30), "241": (0, 30), "250": (0, 30), "400": (0, 30), "710": (0, 20), "711": (0, 20), "714": (0, 20)}

ELEMENTS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("value", T.StringType())]))


def decoded_number(c: Column) -> Column:
    """A number hidden in base64; null if it is none."""
    return F.try_to_binary(blank(c), F.lit("base64")).cast("string").try_cast("long")


def gtin_is_valid(c: Column) -> Column:
    """Check digit of 8, 12, 13 or 14 digits: weights 3 and 1 from the right."""
    t = blank(c)
    digits = F.reverse(F.split(t, ""))
    total = F.aggregate(F.transform(digits, lambda d, i: d.try_cast("int") * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return t.rlike("^(\\d{8}|\\d{12,14})$") & F.coalesce(total % 10 == 0, F.lit(False))


def gtin14(c: Column) -> Column:
    return F.when(gtin_is_valid(c), F.lpad(blank(c), 14, "0"))


def bracketed_elements(c: Column) -> Column:
    """map(identifier, value) of an element string with brackets."""
    found = F.regexp_extract_all(blank(c), F.lit("\\((\\d{2,4})\\)([^(]*)"), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, "\\((\\d{2,4})\\)", 1).alias("k"), F.trim(F.regexp_extract(x, "\\)(.*)$", 1)).alias("v")))
    first = F.filter(pairs, lambda p: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) > 0)
    return F.map_from_entries(F.array_distinct(first))


@F.pandas_udf(ELEMENTS)
def element_string(codes: pd.Series) -> pd.Series:
    """Elements of a concatenated string: each identifier says where the next begins, so it is read in order."""

    def read(code):
        rest, out = (code or "").removeprefix("]d2").removeprefix("]C1").lstrip("\x1d"), []
        while rest:
            name = next((rest[:n] for n in (2, 3, 4) if rest[:n] in IDENTIFIERS), None)
            if name is None:
                break  # an unknown identifier has no length
            fixed, most = IDENTIFIERS[name]
            rest = rest[len(name) :]
            end = fixed or min(most, rest.find("\x1d") if "\x1d" in rest else len(rest))
            out.append({"id": name, "value": rest[:end]})
            rest = rest[end:].lstrip("\x1d")
        return out

    return codes.map(read)


def photo_rectangle(x: Column, y: Column, w: Column, h: Column, view_w: Column, view_h: Column, photo_w: Column, photo_h: Column) -> Column:
    """A rectangle of a preview that covers its view, in the photo's pixels, cut at its edges."""
    scale = F.greatest(view_w / photo_w, view_h / photo_h)
    left, top = (photo_w * scale - view_w) / 2, (photo_h * scale - view_h) / 2
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    a, b = inside((x + left) / scale, photo_w.cast("double")), inside((y + top) / scale, photo_h.cast("double"))
    return F.struct(a.alias("x"), b.alias("y"), inside(w / scale, photo_w - a).alias("w"), inside(h / scale, photo_h - b).alias("h"))
