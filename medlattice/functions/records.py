"""Schema-on-read: fields of records whose key names vary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank

#: Keys under which a document holds its records, in order of priority.
RECORD_KEYS = ("records", "aaData", "prohibited_drugs", "adr_alerts", "rows", "data", "fdc_list", "items")
LEAN_RECORD_KEYS = ("records", "aaData", "rows", "data", "items", "adr_alerts", "prohibited_drugs", "fdc_list")


def _spaced(c: Column) -> Column:
    return F.translate(F.lower(c), "_-", "  ")


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def candidates(keys: Column, names: list[str], loose: bool = True) -> Column:
    """Those of a record's keys that fit one of ``names``, best first.

    Tiers: the exact key, the key in any case, a key that holds a name, and
    (``loose``) containment of the letters and digits either way. The first two
    follow the order of ``names``; the others that of the record's keys. Records
    have few distinct sets of keys, so this is worked out once a set.
    """
    texts = lambda ts: F.array(*[F.lit(t) for t in ts])
    low, spaced = [n.lower().strip() for n in names], [n.lower().replace("_", " ").replace("-", " ") for n in names]
    bare = [t for t in ("".join(c for c in n.lower() if c.isascii() and c.isalnum()) for n in names) if t]

    def by_name(form, forms: list[str]) -> Column:
        ranks = F.transform(keys, lambda k, i: F.struct(F.array_position(texts(forms), form(k)).alias("rank"), i.alias("place"), k.alias("key")))
        return F.transform(F.array_sort(F.filter(ranks, lambda r: r["rank"] > 0)), lambda r: r["key"])

    inside = F.filter(keys, lambda k: F.exists(texts(spaced), lambda n: F.contains(_spaced(k), n)))
    either = F.filter(keys, lambda k: (_bare(k) != "") & F.exists(texts(bare), lambda n: F.contains(_bare(k), n) | F.contains(n, _bare(k))))
    return F.array_distinct(F.concat(by_name(lambda k: k, names), by_name(lambda k: F.trim(F.lower(k)), low), inside, *([either] if loose else [])))


def first_filled(record: Column, keys: Column) -> Column:
    """Trimmed value of the first of ``keys`` that the record fills; empty if none."""
    best = F.trim(F.try_element_at(record, F.get(keys, 0)))
    values = F.transform(keys, lambda k: F.trim(F.try_element_at(record, k)))
    rest = F.when(F.size(keys) > 1, F.get(F.filter(values, lambda v: v != ""), 0))
    return F.coalesce(F.when(best != "", best), rest, F.lit(""))


def field(record: Column, names: list[str], loose: bool = True) -> Column:
    """Value of a record's best filled key for ``names``, see ``candidates``."""
    return first_filled(record, candidates(F.map_keys(record), names, loose))


def strict_field(record: Column, names: list[str]) -> Column:
    """The three-tier variant: in any case also with underscores as spaces, no loose tier."""
    pairs = F.filter(F.map_entries(record), lambda e: F.trim(blank(e["value"])) != "")
    wanted = F.array(*[F.lit(n) for n in names])
    norm = lambda c: F.trim(F.translate(F.lower(c), "_", " "))
    by_name = lambda same: F.get(F.filter(F.transform(wanted, lambda n: F.trim(F.get(F.filter(pairs, lambda e: same(e["key"], n)), 0)["value"])), lambda v: v.isNotNull()), 0)
    inside = F.trim(F.get(F.filter(pairs, lambda e: F.exists(wanted, lambda n: F.contains(norm(e["key"]), norm(n)))), 0)["value"])
    return F.coalesce(by_name(lambda k, n: k == n), by_name(lambda k, n: norm(k) == norm(n)), inside, F.lit(""))


def records_of(body: Column, keys: tuple[str, ...] = RECORD_KEYS) -> Column:
    """Records of a JSON text as array<map>: a root array, the first key that holds an array, or the object itself."""
    kind = "array<map<string,string>>"
    root_list = F.trim(blank(body)).startswith("[")
    held = [F.when(F.trim(F.get_json_object(body, f"$.{k}")).startswith("["), F.from_json(F.get_json_object(body, f"$.{k}"), kind)) for k in keys]
    whole = F.array(F.from_json(body, "map<string,string>"))
    return F.when(root_list, F.from_json(body, kind)).otherwise(F.coalesce(*held, whole))
