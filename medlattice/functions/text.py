"""Text functions as Column expressions: everything but ``ascii_words`` stays in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word lists and patterns that results depend on.
CORPORATE_SUFFIXES = "pvt|private|ltd|limited|inc|corp|corporation|co|company"
DOSAGE_FORMS = "tablets?(?:\\s+or\\s+capsules?)?|capsules?(?:\\s+or\\s+tablets?)?|injections?|syrups?|suspensions?|solutions?|creams?|ointments?|powders?|drops?"
PLAIN_FORMS = "tablets?|capsules?|injections?|syrups?|suspensions?|solutions?|creams?|ointments?|powders?|drops?"
STRENGTH = "\\b\\d+(?:\\.\\d+)?(?:\\s*/\\s*\\d+(?:\\.\\d+)?)?\\s*(?:mg|mcg|g|ml|%|iu)\\b"
BATCH_LABEL = "(?i)(?:B\\.?\\s*No\\.?|Batch\\s*No\\.?|Lot\\s*No\\.?)\\s*:?\\s*([A-Za-z0-9\\-_/]+)"
DATE_VALUE = "([0-9]{2}/[0-9]{4}|[A-Za-z]{3}-?[0-9]{2,4}|[0-9]{4}-[0-9]{2})"
MADE_LABEL = "(?i)(?:Mfg\\.?\\s*(?:dt|date)?|Manufactur(?:e|ing)\\s*Date)\\s*:?\\s*" + DATE_VALUE
EXPIRY_LABEL = "(?i)(?:Exp\\.?\\s*(?:dt|date)?|Expiry\\s*Date)\\s*:?\\s*" + DATE_VALUE
MAKER_LABEL = "(?i)(?:Mfd\\.?\\s*by|Manufactured\\s*By|M/s\\.?)\\s*:?\\s*([^\\n]+)"
DETAIL_WORD = "(?i)no|mfg|mfd|manufactur|exp|m/s"
MESSRS = "(?i)^\\s*(?:m/s\\.?|m s\\.?|messrs\\.?)[\\s:.-]*"
SPILL = "(?i)\\b(?:b\\.?\\s*no\\.?|batch\\s*no\\.?|lot\\s*no\\.?|mfg\\.?\\s*(?:dt|date)?|exp(?:iry)?\\.?\\s*(?:dt|date)?|label claims?)\\b"
ADDRESS_WORD = "(?i)\\s*[,;|]\\s*(?:address|plot|road|village|district|state)\\b"
ADDRESS_START = "(?i),\\s*(?:plot\\b|p\\.?\\s*no\\.?\\b|[a-z]?\\s*-\\s*\\d{1,5}\\b|road\\b|street\\b|village\\b|district\\b|sector\\b|phase\\b)"
CAS_NUMBER = "\\b\\d{2,7}-\\d{2}-\\d\\b"
NOTIFICATION = "(?i)\\b(?:G\\.?S\\.?R\\.?\\s*(?:NO\\.?)?|S\\.O\\.?\\s*\\d+|S\\.O\\.?|SO)\\b"

#: Letters, digits and marks as Python's regular expressions know them; Java's own classes depend on its version.
WORD_CHAR, SPACE_CHAR = "[\\p{L}\\p{N}_]", "[\\s\\x1c-\\x1f\\x85\\p{Z}]"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def blank(c: Column) -> Column:
    """Null becomes an empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def filled(c: Column) -> Column:
    """An empty or blank text becomes null; what remains is trimmed."""
    t = trim_space(c.cast("string"))
    return F.when(t != "", t)


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r\u00a0"))


def collapse(c: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


#: Most texts need no change; one match tells so and spares the replacements. Groups repeat with *+, which is a loop: Java takes
#: a frame of its stack for each turn of a plain *, and a long text overflows it.
CANONICAL = f"^(?:(?!(?:{CORPORATE_SUFFIXES})(?![a-z0-9]))[a-z0-9]+(?: (?!\\z)|\\z))*+\\z"
SUFFIX_START = "pvt|private|ltd|limited|inc|co"
PLAIN_NAME = f"^(?!(?i:m/s|m s|messrs))[A-Za-z0-9#&'()/._]+(?: [A-Za-z0-9#&'()/._]+)*+\\z"
PLAIN_PRODUCT = "^[A-Za-z][A-Za-z0-9]*(?: [A-Za-z0-9]+)*+\\z"
PRODUCT_WORD = f"(?i)\\b(?:{DOSAGE_FORMS}|{PLAIN_FORMS}|with|and|ip|bp|usp|coated|hard|fixed|fdc)\\b|{STRENGTH}"


def canonical(c: Column) -> Column:
    """Lower case without corporate suffixes and punctuation; null gives an empty text."""
    t = F.lower(blank(c))
    flat = lambda x: F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    bare = F.regexp_replace(t, f"(?<!{WORD_CHAR})({CORPORATE_SUFFIXES})(?!{WORD_CHAR})\\.?", "")
    return F.when(t.rlike(CANONICAL), t).when(~t.rlike(SUFFIX_START), flat(t)).otherwise(flat(bare))


def words(c: Column) -> Column:
    """Lower-case ASCII letters and digits, one space between runs."""
    return F.trim(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", " "))


#: Case folds that give ASCII letters where lower case doesn't.
CASE_FOLDS = {c: c.casefold() for c in "ßẞſŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ"}


def casefold_words(c: Column) -> Column:
    """``words`` after a case fold instead of lower case: ß counts as ss, a ligature as its letters."""
    t = blank(c)
    for x, y in CASE_FOLDS.items():
        t = F.replace(t, F.lit(x), F.lit(y))
    return words(t)


def compact(c: Column) -> Column:
    return F.replace(F.lower(blank(c)), F.lit(" "), F.lit(""))


def fold_words(c: Column) -> Column:
    """Camel case split, accents folded to ASCII, then ``words``."""
    split = F.regexp_replace(blank(c), "(?<=[a-z])(?=[A-Z])", " ")
    return words(F.translate(split, "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñÝýÿ", "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyy"))


def fold_ascii(t: str | None) -> str:
    """Camel case split, compatibility decomposition, whatever isn't ASCII then left out, then ``words``, of one text."""
    t = re.sub("(?<=[a-z])(?=[A-Z])", " ", t or "")
    return re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii").lower()).strip()


@partial(F.pandas_udf, returnType=T.StringType())
def ascii_words(texts: pd.Series) -> pd.Series:
    """``fold_ascii`` of a column."""
    return texts.map(fold_ascii, na_action=None)


def folded_words(c: Column) -> Column:
    """``fold_ascii``; only texts with other than ASCII characters leave the JVM."""
    odd = blank(c).rlike(r"[^\x00-\x7F]")
    plain = words(F.regexp_replace(blank(c), "(?<=[a-z])(?=[A-Z])", " "))
    return F.when(odd, ascii_words(F.when(odd, c))).otherwise(plain)


def content_tokens(c: Column) -> Column:
    """Distinct lower-case runs of three or more letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(blank(c)), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def strip_edges(c: Column, chars: str = " ,;:\\-") -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def organization_name(c: Column) -> Column:
    """A name cell without its honorific and without batch, date or address spill."""
    t = F.regexp_replace(blank(c), MESSRS, "")
    t = F.element_at(F.split(t, SPILL, 2), 1)
    t = F.element_at(F.split(t, ADDRESS_WORD, 2), 1)
    return strip_edges(F.regexp_replace(t, "\\s+", " "))


def organization_and_address(c: Column) -> Column:
    """struct(name, address): cut at the first comma before a word that starts an address."""

    def cut(t: Column) -> Column:
        return bound(F.struct(t.alias("t"), F.element_at(F.split(t, ADDRESS_START, 2), 1).alias("head")), both)

    def both(x: Column) -> Column:
        t, head = x["t"], x["head"]
        found = F.length(head) < F.length(t)
        tail = F.regexp_replace(F.substr(t, F.length(head) + 1), "^,\\s*", "")
        name = strip_edges(head)
        return F.struct(F.when(found & (name != ""), name).otherwise(t).alias("name"), F.when(found, strip_edges(tail)).otherwise("").alias("address"))

    t = blank(c)
    plain = (t == "") | (t.rlike(PLAIN_NAME) & ~t.rlike(SPILL))
    return F.when(plain, F.struct(t.alias("name"), F.lit("").alias("address"))).otherwise(bound(organization_name(c), cut))


def batch_details(c: Column) -> Column:
    """struct(batch_number, made, expires, maker) from one cell that holds them all."""
    t = blank(c)
    pick = lambda p: trim_space(F.regexp_extract(t, p, 1))
    found = {"batch_number": BATCH_LABEL, "made": MADE_LABEL, "expires": EXPIRY_LABEL, "maker": MAKER_LABEL}
    return F.when((t == "") | ~t.rlike(DETAIL_WORD), F.struct(*[F.lit("").alias(n) for n in found])).otherwise(F.struct(*[pick(p).alias(n) for n, p in found.items()]))


def cas_number(c: Column) -> Column:
    return F.regexp_extract(blank(c), CAS_NUMBER, 0)


def strengths(c: Column) -> Column:
    return F.regexp_extract_all(blank(c), F.lit("(?i)" + STRENGTH), F.lit(0))


def formulation(c: Column) -> Column:
    """struct(ingredients array<struct(name, strength)>, dosage_form, strength) of a product name.

    Parts count as ingredients if joined by +, with or and, or if there is just one.
    """

    def body_of(t: Column) -> Column:
        body = F.regexp_replace(t, "(?i)^\\s*(?:fixed\\s*dose\\s*combination(?:s)?\\s*of|fdc\\s*of)\\s+", "")
        body = strip_edges(F.regexp_replace(body, f"(?is)\\b(?:{PLAIN_FORMS})\\b.*$", ""))
        body = F.regexp_replace(F.regexp_replace(body, "(?i)\\b(?:hard\\s+gelatin|film\\s+coated|coated)\\b", ""), "(?i)" + STRENGTH, "")
        form = F.upper(F.regexp_extract(t, f"(?i)\\b({DOSAGE_FORMS})\\b", 1))
        return bound(F.struct(body.alias("body"), strengths(t).alias("found"), form.alias("form")), parts_of)

    def parts_of(x: Column) -> Column:
        parts = F.transform(F.split(x["body"], "(?i)\\s*(?:\\+|\\bwith\\b|\\band\\b|,)\\s*"), lambda p: strip_edges(F.regexp_replace(p, "(?i)\\s*\\b(?:ip|bp|usp)\\b\\.?", ""), " ."))
        parts = F.filter(parts, lambda p: (p != "") & ~p.rlike("(?i)^\\d+(?:\\.\\d+)?\\s*(?:mg|mcg|g|ml|%)?$"))
        return bound(parts, lambda ps: result(x, ps))

    def result(x: Column, parts: Column) -> Column:
        joined = x["body"].rlike("(?i)\\+|\\bwith\\b|\\band\\b")
        kept = F.when(joined | (F.size(parts) == 1), parts).otherwise(F.array().cast("array<string>"))
        items = F.transform(kept, lambda p, i: F.struct(p.alias("name"), F.coalesce(F.get(x["found"], i), F.lit("")).alias("strength")))
        return F.struct(items.alias("ingredients"), x["form"].alias("dosage_form"), F.array_join(F.transform(x["found"], lambda s: F.trim(s)), " + ").alias("strength"))

    t = trim_space(blank(c))
    one = F.struct(F.array(F.struct(t.alias("name"), F.lit("").alias("strength"))).alias("ingredients"), F.lit("").alias("dosage_form"), F.lit("").alias("strength"))
    return F.when(t.rlike(PLAIN_PRODUCT) & ~t.rlike(PRODUCT_WORD), one).otherwise(bound(t, body_of))


def product_with_notification(product: Column, notification: Column) -> Column:
    """Product name completed by the text that stands before a notification's number."""
    name, note = blank(product), blank(notification)
    at = F.regexp_instr(note, F.lit(NOTIFICATION))
    lead = F.trim(F.regexp_replace(F.trim(F.substr(note, F.lit(1), F.greatest(at - 1, F.lit(0)))), "^\\d+[\\.\\)]\\s*", ""))
    first = F.trim(F.element_at(F.split(note, "(?i)\\b(?:S\\.O\\.|G\\.S\\.R\\.|GSR|S\\.O|SO|Dated)\\b"), 1))
    plain = (F.length(first) > 2) & ~first.rlike("^\\d+$")
    return (
        F.when(note == "", name)
        .when((at > 1) & (lead != ""), F.when(name == "", lead).when(~F.contains(name, lead), F.trim(F.concat_ws(" ", name, lead))).otherwise(name))
        .when((at <= 1) & (name == "") & plain, first)
        .otherwise(name)
    )


def clean_cell(c: Column) -> Column:
    return collapse(blank(c))


def header_key(c: Column) -> Column:
    """A column header as a record key; what has nothing left is ``Column``."""
    t = F.regexp_replace(clean_cell(c), "[\\.\\s]+\\b", " ")
    t = F.trim(F.regexp_replace(t, "[^a-zA-Z0-9\\s/_\\-&]", ""))
    return F.when(t == "", "Column").otherwise(t)


def without_trailing_blanks(cells: Column) -> Column:
    last = F.array_max(F.transform(cells, lambda x, i: F.when(F.trim(blank(x)) != "", i + 1).otherwise(0)))
    return F.when(F.coalesce(last, F.lit(0)) > 0, F.slice(cells, F.lit(1), F.coalesce(last, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def safe_file_name(c: Column, limit: int = 120) -> Column:
    t = strip_edges(F.regexp_replace(blank(c), "[^A-Za-z0-9._-]+", "_"), "._")
    return F.when(t == "", "document").otherwise(F.substring(t, 1, limit))


def batch_number(c: Column) -> Column:
    """Label removed up to twice, upper case, letters, digits, dash and slash, 64 characters."""
    label = "(?i)^\\s*(?:batch|lot|b)\\.?\\s*(?:no|number|num)?\\.?\\s*[:#.-]*\\s*(?=[A-Za-z0-9])"
    labelled = lambda t: F.when(t.rlike("(?i)^\\s*(?:(?:batch|lot)\\b|b\\.?\\s*no)"), F.regexp_replace(t, label, "")).otherwise(t)
    t = F.regexp_replace(F.upper(labelled(labelled(blank(c)))), "[^A-Z0-9/-]", "")
    return F.substring(t, 1, 64)


def pack_fields(c: Column) -> Column:
    """struct(name, batch, made, expires, dose) guessed from the text on a pack."""
    t = blank(c)
    rows = F.filter(F.transform(F.split(t, "\\n"), collapse), lambda x: x != "")
    labelled = "(?i)\\b(?:batch|b\\.?\\s*no|lot|mfg|mfd|exp|expiry|price|mrp|rs\\.?|license|lic|keep|store|schedule|warning)\\b"
    named = F.filter(rows, lambda x: x.rlike("[A-Za-z]{3,}") & ~x.rlike(labelled) & (F.length(x) <= 80))
    day = "([0-9]{1,2}[/-][0-9]{2,4}|[A-Za-z]{3}\\.?[ -]?[0-9]{2,4})"
    return F.struct(
        F.coalesce(F.get(named, 0), F.lit("")).alias("name"),
        F.regexp_extract(t, "(?i)\\b(?:batch|lot|b\\.?)\\s*(?:no|number)?\\.?\\s*[:#]?\\s*([A-Za-z0-9/-]*[0-9][A-Za-z0-9/-]*)", 1).alias("batch"),
        F.regexp_extract(t, "(?i)\\b(?:mfg|mfd|manufactur\\w*)\\.?\\s*(?:date|dt)?\\.?\\s*[:.]?\\s*" + day, 1).alias("made"),
        F.regexp_extract(t, "(?i)\\b(?:exp|expiry|use before)\\.?\\s*(?:date|dt)?\\.?\\s*[:.]?\\s*" + day, 1).alias("expires"),
        F.regexp_extract(t, "(?i)" + STRENGTH, 0).alias("dose"),
    )


def grounded(value: Column, source: Column) -> Column:
    """Whether the value's words stand in the source's words."""
    v = words(value)
    return (v != "") & F.contains(words(source), v)


def joined_lines(c: Column) -> Column:
    """Hyphenated line ends are closed, single line ends become spaces."""
    t = F.regexp_replace(blank(c), "(?<=\\w)-\\n(?=[a-z])", "")
    return collapse(F.regexp_replace(t, "(?<!\\n)\\n(?!\\n)", " "))


def ends_sentence(c: Column) -> Column:
    return F.rtrim(blank(c)).rlike("[.!?:;][\"')\\]]*$")


def sample_text(c: Column, whole: int = 4000, chunk: int = 800, points: int = 5, gap: str = "\n...\n") -> Column:
    """The text, or evenly spread pieces of it if it has more than ``whole`` characters."""
    t = blank(c)
    last = F.length(t) - chunk
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.bround(i * last / (points - 1)).cast("int")))
    return F.when(F.length(t) <= whole, t).otherwise(F.array_join(F.transform(at, lambda a: F.substr(t, a + 1, F.lit(chunk))), gap))


def clip(c: Column, limit: int, mark: str = " [...]") -> Column:
    t = blank(c)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(mark))).otherwise(t)


def share_of(c: Column, pattern: str) -> Column:
    """Share of characters that match a one-character pattern; 0 for an empty text."""
    t = blank(c)
    return F.when(F.length(t) == 0, 0.0).otherwise((F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / F.length(t))


def occurrences(text: Column, term: str) -> Column:
    """Occurrences of a term that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def whole_word(text: Column, term: str) -> Column:
    import re

    return text.rlike("\\b" + re.sub(r"([^A-Za-z0-9 ])", r"\\\1", term) + "\\b")


#: Units that belong to the number before them.
NUMBER_UNITS = ("billion", "cfu", "g", "gm", "iu", "kg", "l", "mcg", "meq", "mg", "million", "ml", "mmol", "mol", "ng", "unit", "units", "ug", "wv")


def lexicon_name(c: Column) -> Column:
    """Words of a name with numbers joined to their units, spelled letters joined, and bare numbers dropped."""
    t = F.concat(F.lit(" "), words(c), F.lit(" "))
    t = F.regexp_replace(t, f"(?<= )(\\d+) (?=(?:{'|'.join(NUMBER_UNITS)}) )", "$1")
    t = F.regexp_replace(t, "(?<= )(\\d+) (?=\\d+[a-z])", "$1")
    t = F.regexp_replace(t, "(?<= [a-z]) (?=[a-z] )", "\u0001")
    t = F.regexp_replace(F.regexp_replace(t, "(?<=\u0001[a-z]) (?=[a-z] )", "\u0001"), "\u0001", "")
    t = F.regexp_replace(t, "(?<= )([a-z]) (?=[a-z]+\\d+ )", "$1")
    return collapse(F.regexp_replace(t, "(?<= )\\d+(?= )", ""))


def is_junk_cell(c: Column) -> Column:
    """Nothing, a lone mark or number, or hardly any ASCII."""
    t = clean_cell(c)
    return (t == "") | t.rlike("^[\\W\\d_]+$") | (share_of(t, "[\\x00-\\x7F]") < 0.5)


def header_signature(cells: Column, names: dict[str, str] | None = None) -> Column:
    """Canonical header of a table: words of each cell, replaced by a dictionary, joined by |."""
    pairs = [F.lit(x) for kv in (names or {"": ""}).items() for x in kv]
    return F.array_join(F.transform(cells, lambda c: F.coalesce(F.try_element_at(F.create_map(*pairs), words(c)), words(c))), "|")


def near(text: Column, patterns: list[str], within: int = 200) -> Column:
    """Whether the first matches of all patterns lie within a span of ``within`` characters."""
    t = blank(text)
    starts = [F.regexp_instr(t, F.lit(p)) for p in patterns]
    ends = [s + F.length(F.regexp_extract(t, p, 0)) for s, p in zip(starts, patterns, strict=True)]
    found = starts[0] > 0
    for s in starts[1:]:
        found = found & (s > 0)
    return found & (F.greatest(*ends) - F.least(*starts) <= within) if len(patterns) > 1 else found
