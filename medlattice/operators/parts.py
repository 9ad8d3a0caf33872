"""Parts of scanned documents: language, boilerplate, signals of fields, classes with priorities, contexts of file names."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import SPACE_CHAR, blank, bound, folded_words, words

#: Patterns of signals, all on lower-case words.
FORMS = r"\b(?:tablet|capsule|injection|syrup|solution|ointment|vaccine)\b"
NAMED = r"\b(?:product|drug|medicine|brand)\s+name\b|" + FORMS
BATCH = r"\b(?:batch|lot)\s*(?:no|number)?\b\s*[:.]?\s*[A-Za-z0-9\-/]+"
RESTRICTED = r"(?:shall not be used|only for|restricted to|not to be used|for use only|restricted to use)"
ACTION = r"\b(?:recall(?:\s+of)?|withdrawn|withdrawal|stop(?:\s+sale|\s+distribution)|safety alert)\b"
PRODUCT = r"\b(?:product|drug|medicine|brand|formulation)\s+(?:name|details|batch)\b|\b(?:tablet|capsule|injection|syrup|ointment|vaccine)\b"
SUSPECTED = r"\b(?:suspected drug|drug suspected|suspected medicine)\b"
REACTION = r"\b(?:adverse drug reaction|adverse reaction|adverse effect|reaction reported)\b"
NOTIFIED = r"(?i)(?:S\.?\s*O\.?|G\.?\s*S\.?\s*R\.?)\s*(?:No\.?|No\s*[:.]?)?\s*\d+[A-Za-z0-9\-/]*"
MADE_BY = r"\b(?:m s|manufactured by|manufacturer|manufacturing firm)\b"
CHECKED = r"\b(?:nsq|not of standard quality|adverse drug reaction|prohibited|banned)\b"
BATCH_NUMBER, QUOTE = r"(?i)(?:B\.?\s*No\.?|Batch\s*No\.?|Lot\s*No\.?)\s*[:.]?\s*([A-Za-z0-9\-/]+)", 500
SIGNALS = {
    "product_name": r"\b(?:product|drug|medicine|brand)\b(?:\s+name)?|" + NAMED,
    "manufacturer": r"\b(?:mfg|manufactured by|manufacturer|manufacturing firm|manufacture by)\b|\bm s\b",
    "failure_reason": r"\b(?:reason for failure|failed|failure|nsq|not of standard quality|spurious|falsified|adulterated|misbranded)\b",
    "operative_prohibition": r"\b(?:prohibited|prohibition|banned|ban on)\b",
    "operative_restriction": RESTRICTED,
    "restriction_condition": RESTRICTED,
    "operative_condition": r"\b(?:conditional|conditions|category c|continued manufacturing|subject to)\b",
    "falsified_product_evidence": r"\b(?:falsified|counterfeit|spurious|adulterated|misbranded)\b",
    "suspected_drug": SUSPECTED,
    "adverse_reaction": REACTION,
    "specific_product": PRODUCT,
    "action_verb": ACTION,
}
#: Classes and priorities of archetypes, and the fields that each needs; others are not usable.
USABLE, LATER, UNUSABLE = "Usable", "Future-usable", "Non-usable"
TABLE_CLASS = {"A": (USABLE, "P0"), "B": (USABLE, "P0"), "C": (USABLE, "P0"), "K": (USABLE, "P0"), "AR": (USABLE, "P0"), "Z": (USABLE, "P1"), "AQ": (USABLE, "P1"), "AV": (USABLE, "P1")} | dict.fromkeys(("D", "E", "F", "J", "M", "R", "AC", "AE", "AM", "AS", "AT", "AU"), (LATER, "P2"))
TEXT_CLASS = {"P1": (USABLE, "P0"), "P2": (USABLE, "P0"), "P3": (USABLE, "P0"), "P3b": (USABLE, "P0"), "P3c": (USABLE, "P0"), "P4": (USABLE, "P0"), "P7": (USABLE, "P1"), "P5": (USABLE, "P1"), "P6": (USABLE, "P1")} | dict.fromkeys(("P8", "P9", "P10", "P11", "P12", "P13", "P14", "P15", "P16", "P17", "P18", "P19", "P29", "P30"), (LATER, "P2"))
QUALITY_FIELDS, NOTICE_FIELDS, ALERT_FIELDS = ("product_name", "batch_no", "manufacturer", "failure_reason"), ("product_name", "notification_no", "operative_prohibition"), ("suspected_drug", "adverse_reaction", "alert_format")
TABLE_FIELDS = {"A": QUALITY_FIELDS, "B": QUALITY_FIELDS, "C": QUALITY_FIELDS, "K": NOTICE_FIELDS, "AR": NOTICE_FIELDS, "AQ": ("product_name", "falsified_product_evidence"), "Z": ALERT_FIELDS}
TEXT_FIELDS = {"P3": NOTICE_FIELDS, "P3b": ("product_name", "restriction_condition"), "P3c": ("operative_condition",), "P4": NOTICE_FIELDS, "P7": ALERT_FIELDS}
OUT_OF_SCOPE, LOW_CONFIDENCE = ("veterinary", "device", "cosmetic"), 0.55


def latin_share(text: Column) -> Column:
    """ASCII letters among all letters; 0 without a letter."""
    letters = F.length(F.regexp_replace(blank(text), r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(blank(text), "[^A-Za-z]", ""))
    return F.when(letters > 0, latin / letters).otherwise(0.0)


def english_block(text: Column, least: float = 0.85) -> Column:
    """The block without Devanagari, its lines' spaces collapsed and empty lines left out; null if too few letters are Latin."""
    lines = F.split(F.regexp_replace(blank(text), r"\p{IsDevanagari}", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, f"{SPACE_CHAR}+", " ")))
    return F.when(latin_share(text) >= least, F.array_join(F.filter(clean, lambda x: x != ""), "\n"))


def is_boilerplate(text: Column) -> Column:
    """A page number, or a printer's or publisher's line."""
    t = folded_words(text)
    page = F.contains(t, F.lit("page")) & F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.lit(" of ")) & (F.length(t) < 25)
    return page | F.contains(t, F.lit("printed by the manager")) | F.contains(t, F.lit("published by the controller"))


def _span(t: Column, pattern: str) -> Column:
    """(begin, end) of the first match of a pattern that is there, by the text that stands before it."""
    before = F.length(F.get(F.split(t, pattern, 2), 0))
    return F.struct(before.alias("a"), (before + F.length(F.regexp_extract(t, f"({pattern})", 1))).alias("b"))


def same_window(t: Column, patterns: tuple[str, ...], chars: int = 200) -> Column:
    """Whether the first matches of all patterns lie within ``chars`` characters; places are sought only where all match."""
    spans = F.array(*[_span(t, p) for p in patterns])
    near = bound(spans, lambda s: F.array_max(F.transform(s, lambda x: x["b"])) - F.array_min(F.transform(s, lambda x: x["a"])) <= chars)
    return F.when(reduce(and_, [t.rlike(p) for p in patterns]), near).otherwise(False)


def field_signals(text: Column, batch: Column | None = None) -> Column:
    """struct of the 18 flags that tell which fields a part speaks of; ``batch`` is a number known beforehand.

    All patterns but that of notifications are tried on the folded words. Those
    have no punctuation, so a suspected drug and an adverse reaction anywhere in
    the part make up the format of an alert.
    """
    given = blank(batch) != "" if batch is not None else F.lit(False)

    def flags(t: Column) -> Column:
        says = t.rlike
        out = {n: says(p) for n, p in SIGNALS.items()}
        numbered = given | says(BATCH)
        action = (numbered | out["specific_product"]) & out["action_verb"] | same_window(t, (NAMED, BATCH, ACTION))
        out |= {"batch_no": numbered, "specific_batch": numbered, "notification_no": blank(text).rlike(NOTIFIED), "current_check_match": given & says(CHECKED), "alert_format": out["suspected_drug"] & out["adverse_reaction"], "specific_action": action}
        return F.struct(*[c.alias(n) for n, c in sorted(out.items())])

    return bound(folded_words(text), flags)


def batch_of(text: Column) -> Column:
    """The number behind the first batch label of a text; null without one."""
    return F.nullif(F.regexp_extract(blank(text), BATCH_NUMBER, 1), F.lit(""))


def quality_window(text: Column, fields: Column, chars: int = 200) -> Column:
    """Whether a text's quote (its first 500 characters) names product, batch, maker and failure within ``chars`` of its folded words, by first matches."""
    near = bound(folded_words(F.substring(blank(text), 1, QUOTE)), lambda t: same_window(t, (NAMED, BATCH, MADE_BY, SIGNALS["failure_reason"]), chars))
    return bound(fields, lambda f: f["product_name"] & f["batch_no"] & f["manufacturer"] & f["failure_reason"]) & near


def usability(archetype: Column, is_table: Column, fields: Column, product_type: Column, confidence: Column, quality_window: Column, batch: Column) -> Column:
    """struct(class, priority, flags) of a part: its archetype's class, put off where fields are missing, the product is no medicine or the OCR is weak.

    ``fields`` is a struct of flags as of ``field_signals``; ``quality_window``
    tells whether a text's product, batch, maker and failure stand together. A
    batch number counts as there only if ``batch`` holds it, and tables have none.
    """
    given = {"archetype": archetype, "is_table": is_table, "fields": fields, "product_type": product_type, "confidence": confidence, "window": quality_window, "batch": blank(batch)}
    return bound(F.struct(*[c.alias(n) for n, c in given.items()]), lambda x: _usable(*[x[n] for n in given]))


def _usable(archetype: Column, is_table: Column, fields: Column, product_type: Column, confidence: Column, quality_window: Column, batch: Column) -> Column:
    has = lambda n: batch != "" if n == "batch_no" else fields[n]

    def known(maps: dict[str, tuple[str, str]]) -> Column:
        return F.try_element_at(F.create_map(*[x for k, v in maps.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("class"), F.lit(v[1]).alias("priority")))]), archetype)

    def needed(maps: dict[str, tuple[str, ...]]) -> Column:
        lacking = {k: F.array_join(F.array_compact(F.array(*[F.when(~has(n), F.lit(n)) for n in names])), ",") for k, names in maps.items()}
        out = F.lit("")
        for k, c in lacking.items():
            out = F.when(archetype == k, c).otherwise(out)
        return out

    own = F.coalesce(F.when(is_table, known(TABLE_CLASS)).otherwise(known(TEXT_CLASS)), F.struct(F.lit(UNUSABLE).alias("class"), F.lit("P3").alias("priority")))
    window = ~is_table & archetype.isin("P1", "P2") & ~quality_window
    action = ~is_table & archetype.isin("P5", "P6") & ~((fields["specific_batch"] | fields["specific_product"]) & fields["action_verb"])
    later = F.struct(F.lit(LATER).alias("class"), F.lit("P2").alias("priority"))
    weak = F.coalesce(confidence < LOW_CONFIDENCE, F.lit(False))

    # every value that is used more than once is bound, as nothing within a lambda is shared
    def with_missing(x: Column) -> Column:
        missing = F.when(window, "missing:" + ",".join(QUALITY_FIELDS) + "_window").when(action, "missing:specific_action").when(x["lacks"] != "", F.concat(F.lit("missing:"), x["lacks"]))
        return bound(F.struct(x["own"].alias("own"), missing.alias("missing")), put_off)

    def put_off(x: Column) -> Column:
        usable = x["missing"].isNull() & (x["own"]["class"] == USABLE)
        outside = F.coalesce(product_type.isin(*OUT_OF_SCOPE), F.lit(False)) & usable
        return bound(F.struct(x["own"].alias("own"), x["missing"].alias("missing"), usable.alias("usable"), outside.alias("outside"), (weak & usable & ~outside).alias("unclear")), result)

    def result(x: Column) -> Column:
        final = F.when(x["missing"].isNotNull() | x["outside"] | x["unclear"], later).otherwise(x["own"])
        flags = F.array_compact(F.array(x["missing"], F.when(x["outside"], F.concat(F.lit("out_of_medicine_scope:"), product_type)), F.when(weak, "low_ocr_confidence"), F.when(x["unclear"], "deferred_pending_ocr_review"), F.when(x["usable"] & ~x["outside"] & ~x["unclear"], "evidence_review_required")))
        return F.struct(final["class"].alias("class"), final["priority"].alias("priority"), flags.alias("flags"))

    none = F.struct(F.lit(UNUSABLE).alias("class"), F.lit("P3").alias("priority"), F.array(F.lit("unmapped_taxonomy")).alias("flags"))
    lacks = F.when(is_table, needed(TABLE_FIELDS)).otherwise(needed(TEXT_FIELDS))
    return F.when(archetype.isNull(), none).otherwise(bound(F.struct(own.alias("own"), lacks.alias("lacks")), with_missing))


def context_archetype(source: Column, filename: Column) -> Column:
    """The table archetype that source and file name tell, null if they tell none; the first rule that fits."""
    names = F.struct(words(F.regexp_replace(blank(filename), r"\.[^./\\]*$", "")).alias("stem"), blank(source).alias("source"))
    both = lambda n: F.struct(n["stem"].alias("stem"), words(F.concat_ws(" ", n["source"], n["stem"])).alias("title"))
    return F.get(F.transform(F.transform(F.array(names), both), _context_rules), 0)


#: Fixed rules, the first that fits.
def _context_rules(name: Column) -> Column:
    stem, title = name["stem"], name["title"]
    has = lambda t: F.contains(title, F.lit(t))
    named = lambda t: F.contains(stem, F.lit(t))
    monthly = stem.rlike(r"\bdrugs? alert\b") & (named("list") | named("month")) & ~named("state") & ~named("nsq") & ~named("spurious")
    combined = has("prohibit") | has("rational") | has("banned") | has("restrict") | (has("permitted") & has("manufacturing"))
    return (
        F.when(has("banned drugs") | has("drugs banned") | has("banneddrugs"), "AR").when(has("countrywide survey") & has("spurious drugs"), "C").when(has("spurious") & has("drug") & has("list"), "C")
        .when(has("nsq") & has("vaccine") & ~has("state"), "A").when(stem.rlike(r"\balert\b") & named("medical device"), "AS").when(monthly, "A").when(has("approved for marketing"), "AT").when(has("rc holders") & has("rc issued"), "AU").when(has("recall"), "AV")
        .when(has("nlem") | has("national list of essential medicines"), "AC").when(has("ba be") & has("study centre"), "O").when(has("fdc") & combined, "K")
        .when(has("laborator") & has("list") & has("performance evaluation") & (has("ivd") | has("in vitro diagnostic")), "F")
    )
