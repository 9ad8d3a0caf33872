"""Classes of scanned parts: archetypes by signatures with product-type overrides, decisions from several hints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound, folded_words

#: Phrases of paragraphs by archetype, in order of precedence.
PARAGRAPHS = {
    "P1": ("spurious", "falsified", "adulterated", "misbranded"), "P2": ("nsq", "not of standard quality", "failed test"), "P3": ("prohibited", "prohibition", "section 26a"), "P3b": ("restricted", "restriction"),
    "P3c": ("category c", "18-month", "conditional permission", "continued manufacturing"), "P4": ("banned", "prohibited for manufacture"), "P5": ("recall", "field safety notice"), "P6": ("who alert", "falsified", "international authority"),
    "P7": ("pvpi", "adverse drug reaction", "adr", "suspected drug"), "P8": ("warning", "advisory", "labelling", "labeling"), "P9": ("medical device alert", "device recall", "device safety"),
    "P10": ("approved products", "approved for marketing", "market authorization"), "P11": ("registration certificate", "certificate holder", "importer register"), "P12": ("noc", "clarification", "not regulated", "regulatory status"),
    "P13": ("reference product", "bioequivalence study", "bcs class"), "P14": ("nlem", "essential medicines", "essential medicine"), "P15": ("testing facility", "laboratory list", "laboratory listing"), "P16": ("veterinary", "animal use"),
    "P17": ("ivd", "pcr kit", "diagnostic kit approval"), "P18": ("sae", "psur", "pharmacovigilance analytics"), "P19": ("country-wide survey", "aggregate findings", "sample counts"), "P20": ("application", "submission", "checklist", "babe"),
    "P21": ("babe centre", "study centre approval", "centre address"), "P22": ("faq", "public awareness", "general guidance"), "P23": ("expert committee", "committee report", "recommendation"), "P24": ("meeting", "minutes", "agenda", "participants"),
    "P25": ("enforcement", "prosecution", "compounding"), "P26": ("gazette", "appointment", "roster", "debarment", "port", "fee"), "P27": ("corrigendum", "correction to", "erratum"), "P28": ("public notice", "circular", "press note"),
    "P29": ("amendment", "draft", "proposed", "notification", "s.o."), "P30": ("historical", "emergency", "expired", "repealed"),
}
#: Phrases that tell a product's type, also without spaces; others are medicines.
PRODUCT_TYPES = {
    "device": ("medical device", "device alert", "guidewire", "catheter", "infusion pump", "remote controller", "controller", "stent", "ivd", "diagnostic kit", "device recall"),
    "cosmetic": ("cosmetic",),
}
DEVICE_ALERT, DEVICE_WORDS = "P9", ("alert", "recall", "safety")


def _phrase(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def _hits(t: Column, phrases: tuple[str, ...]) -> Column:
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    return sum((F.when(F.contains(padded, F.lit(f" {_phrase(p)} ")), 1).otherwise(0) for p in phrases), F.lit(0))


def _most(t: Column, signatures: dict[str, tuple[str, ...]], least: int) -> Column:
    hits = [_hits(t, phrases) for phrases in signatures.values()]
    best = F.array_max(F.array(*[F.struct(h.alias("hits"), F.lit(-i).alias("rank"), F.lit(n).alias("name")) for i, (n, h) in enumerate(zip(signatures, hits, strict=True))]))
    return F.when(best["hits"] >= least, best["name"])


def archetype(text: Column, signatures: dict[str, tuple[str, ...]], least: int = 1) -> Column:
    """The archetype with most phrases in the folded text; of equals the one named first; null with fewer than ``least``. Headers of tables need two."""
    return bound(folded_words(text), lambda t: _most(t, signatures, least))


def _type(t: Column) -> Column:
    veterinary = t.rlike(r"\bvet\b") | F.contains(t, F.lit("veterinary")) | F.contains(t, F.lit("animal use"))
    out = F.when(veterinary, "veterinary")
    packed = F.replace(t, F.lit(" "), F.lit(""))
    for kind, hints in PRODUCT_TYPES.items():
        found = [F.contains(t, F.lit(_phrase(h))) | F.contains(packed, F.lit(_phrase(h).replace(" ", ""))) for h in hints]
        out = out.when(F.array_contains(F.array(*found), True), kind)
    return out.otherwise("medicine")


def product_type(text: Column) -> Column:
    """veterinary, device, cosmetic or medicine, by hints in the folded text, the first that fits."""
    return bound(folded_words(text), _type)


def paragraph(text: Column) -> Column:
    """struct(archetype, product_type) of a paragraph.

    The archetype with most phrases, but P16 for veterinary products, P9 for
    devices with an alert, recall or safety, and P6 in place of P1 where a WHO
    alert is named.
    """

    def both(t: Column) -> Column:
        return bound(F.struct(t.alias("t"), _type(t).alias("kind"), _most(t, PARAGRAPHS, 1).alias("own")), decided_by)

    def decided_by(x: Column) -> Column:
        t = x["t"]
        alert = F.array_contains(F.array(*[F.contains(t, F.lit(w)) for w in DEVICE_WORDS]), True)
        who = (x["own"] == "P1") & F.contains(t, F.lit("who alert")) & (_hits(t, PARAGRAPHS["P6"]) > 0)
        a = F.when(x["kind"] == "veterinary", "P16").when((x["kind"] == "device") & alert, DEVICE_ALERT).when(who, "P6").otherwise(x["own"])
        return F.struct(a.alias("archetype"), x["kind"].alias("product_type"))

    return bound(folded_words(text), both)


def decided(forced: Column, from_table: Column, from_context: Column) -> Column:
    """struct(archetype, status): a forced one, else the table's, else that of file name and title."""
    a = F.coalesce(forced, from_table, from_context)
    s = F.when(forced.isNotNull(), "FORCED").when(from_table.isNotNull(), "TABLE").when(from_context.isNotNull(), "CONTEXT").otherwise("UNMATCHED")
    return F.struct(a.alias("archetype"), s.alias("status"))
