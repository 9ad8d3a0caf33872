"""Deterministic keys: SHA-256 over lower-case trimmed parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, canonical


def sha_key(*parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else blank(p) for p in parts]
    return F.sha2(F.concat_ws("|", *[F.lower(F.trim(c)) for c in cols]), 256)


def organization_key(name: Column, state: Column | None = None) -> Column:
    if state is None:
        return sha_key("ORG", canonical(name))
    s = canonical(state)
    return F.when(s != "", sha_key("ORG", canonical(name), s)).otherwise(sha_key("ORG_UNKNOWN_STATE", canonical(name)))


def product_key(name: Column, strength: Column, form: Column, category: Column, signature: Column | None = None) -> Column:
    """The maker is no part of a product's identity."""
    parts = [canonical(name), canonical(strength), canonical(form), F.when(blank(category) == "", "drug").otherwise(canonical(category))]
    return sha_key("PROD", *parts, *([] if signature is None else [signature]))


def ingredient_key(name: Column) -> Column:
    return sha_key("ING", canonical(name))


def signature(keys: Column) -> Column:
    """Key of a set of ingredient keys; empty without any."""
    kept = F.array_sort(F.filter(keys, lambda k: blank(k) != ""))
    return F.when(F.size(kept) > 0, F.sha2(F.concat(F.lit("sig|"), F.array_join(kept, "|")), 256)).otherwise("")


def batch_key(product: Column, organization: Column, number: Column) -> Column:
    return sha_key("BATCH", product, organization, canonical(number))


def event_key(document: Column, record: Column, kind: Column, day: Column, subtype: Column | None = None) -> Column:
    return sha_key("EVT", document, record, canonical(kind), day, canonical(subtype) if subtype is not None else "")


def fingerprint(product: Column, batch: Column, maker: Column, reason: Column) -> Column:
    return sha_key(product, batch, maker, reason)


def source_record_id(document: Column, page: Column, tbl: Column, mark: Column, nth: Column) -> Column:
    at_least_one = lambda c: F.greatest(F.lit(1), F.coalesce(c.cast("int"), F.lit(1)))
    short = F.substring(F.when(blank(mark) == "", "00000000").otherwise(blank(mark)), 1, 8)
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))  # noqa: E731  # format_string takes longer than the rest of a key
    return F.concat(F.coalesce(document.cast("string"), F.lit("null")), F.lit(":P"), two(at_least_one(page)), F.lit(":T"), two(at_least_one(tbl)), F.lit(":"), short, F.lit(":"), two(at_least_one(nth)))


def document_number(value: Column) -> Column:
    """The first 15 hex digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(value.cast("string"), 256), 1, 15), 16, 10).cast("long")


def document_code(value: Column, prefix: str = "doc_", digits: int = 10) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value.cast("string"), 256), 1, digits))
