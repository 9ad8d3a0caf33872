"""Rule classifiers of documents: keyword scores, entities, ordered verdicts."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql import types as T

from ..functions.fuzzy import indel_ratio_of, token_sort_ratio_of
from ..functions.text import SPACE_CHAR, WORD_CHAR, blank, bound, collapse, occurrences, words

#: Keywords with weights, caps and bands.
KEYWORDS = {
    "spurious": 5, "nsq": 5, "not of standard quality": 5, "drug alert": 4, "recall": 4, "prohibited": 4, "fdc": 3, "fixed dose combination": 3, "adulterated": 5, "misbranded": 5, "substandard": 5, "drug alerts": 4, "drugs alert": 4, "drugs alerts": 4, "safety alert": 4, "safety alerts": 4, "adverse drug reaction": 4,
    "adverse drug reactions": 4, "pharmacovigilance": 4, "pvpi": 4, "banned": 4, "banned drug": 4, "banned drugs": 4, "section 26a": 4, "section 10a": 4, "fdcs": 3, "fixed dose combinations": 3, "batch no": 1, "batch nos": 1, "batch number": 1, "batch numbers": 1, "b. no": 1, "b.no": 1, "lot no": 1, "manufacturer": 1, "manufacturers": 1, "manufactured by": 1, "mfd by": 1,
}
MOST_COUNTS, FULL_SCORE, LOW, HIGH, BORDER = 5, 40.0, 0.30, 0.60, (0.28, 0.32)
BATCH_CODE, BATCH_CONTEXT = f"(?<!{WORD_CHAR})[A-Z]{{1,4}}[0-9]{{3,8}}[A-Z]?(?!{WORD_CHAR})", r"(?i)batch|b\.?\s*no|lot"
MAKER_SUFFIXES = ("ltd", "pvt ltd", "pharmaceuticals", "pharma", "labs", "laboratories")
DRUG_NAMES = ("paracetamol", "ibuprofen", "nimesulide", "diclofenac", "amoxicillin", "azithromycin", "cefixime", "metformin", "atorvastatin", "omeprazole", "pantoprazole", "cetirizine", "ambroxol", "dextromethorphan", "oxytocin", "etodolac", "sibutramine", "gatifloxacin", "tegaserod")
EVENT_WORDS = ("nsq", "spurious", "recall", "banned", "prohibited", "theft", "stolen", "falsified", "cancellation", "cancelled", "substandard", "sub-standard", "adulterated", "misbranded")
CONTEXT_WORDS = ("drug", "medicine", "pharmaceutical", "drugs rules", "medical devices rules", "schedule m", "schedule h", "section 26a", "section 10a", "cdsco", "drug controller", "gazette notification")
TYPE_HINTS = {"guideline": ("guidance", "guideline", "guidelines"), "sop": ("sop", "standard operating procedure"), "circular": ("circular",), "notice": ("notice",), "meeting": ("meeting", "agenda", "minutes"), "appointment": ("appointment",), "order": ("order",), "advisory": ("advisory",)}
HEADERS = {
    "drug_name_column": ("drug", "product", "medicine", "brand", "formulation", "fdc", "fixed dose combination", "name of drug", "name of product", "name of drugs", "drugs name", "drug name", "product name", "medicine name", "suspected drugs", "suspected drug", "suspected medicine", "suspected medicines"),
    "batch_column": ("batch", "b no", "batch no", "batch number", "lot"), "manufacturer_column": ("manufacturer", "mfg", "mfd", "made by", "manufactured by", "company"), "notification_column": ("notification", "notif no", "s o", "s o no", "gazette"), "notification_date_column": ("date", "notification date", "issue date", "publication date"),
    "reason_column": ("reason", "reason for failure", "failure reason", "defect"), "status_column": ("status", "action taken", "decision", "outcome"), "indication_column": ("indication", "used for", "therapeutic use"), "alert_column": ("alert", "alert reason", "adverse", "adr", "adverse drug reaction"),
}


def keyword_score(text: Column, keywords: dict[str, int] | None = None) -> Column:
    """struct(score, matched): weighted counts, each capped, over the full score and at most 1."""
    kw = KEYWORDS if keywords is None else keywords

    def score(low: Column) -> Column:
        found = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(w).alias("weight"), occurrences(low, k).alias("n")) for k, w in kw.items()])
        return F.filter(found, lambda x: x["n"] > 0)

    def total(hit: Column) -> Column:
        raw = F.aggregate(hit, F.lit(0).cast("long"), lambda a, x: a + x["weight"] * F.least(x["n"], F.lit(MOST_COUNTS)))
        return F.struct(F.least(F.lit(1.0), raw / FULL_SCORE).alias("score"), F.transform(hit, lambda x: F.struct(x["keyword"], x["n"])).alias("matched"))

    return bound(bound(F.lower(collapse(blank(text))), score), total)


def band(score: Column) -> Column:
    return F.when(score.between(*BORDER), "borderline").when(score >= HIGH, "high").when(score >= LOW, "medium").otherwise("low")


def entities(text: Column, suffixes: tuple[str, ...] = MAKER_SUFFIXES, code: str = BATCH_CODE, context: str = BATCH_CONTEXT, drugs: tuple[str, ...] = DRUG_NAMES, reach: int = 50) -> Column:
    """struct(batches, makers, drugs): distinct codes with a batch label within ``reach`` characters, names before a company suffix, known drugs.

    Each code is judged by the text around its own place, other codes included.
    """

    def codes(t: Column) -> Column:
        found, between = F.regexp_extract_all(t, F.lit(code), F.lit(0)), F.split(t, code)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,code:string>>").alias("spans"))
        step = lambda s, x: F.struct((s["at"] + F.length(x["gap"]) + F.length(x["code"])).alias("at"), F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(x["gap"])).alias("a"), x["code"].alias("code")))).alias("spans"))
        pairs = F.filter(F.arrays_zip(between.alias("gap"), found.alias("code")), lambda x: x["code"].isNotNull())
        spans = F.aggregate(pairs, start, step)["spans"]
        begin = lambda x: F.greatest(x["a"] - reach, F.lit(0))
        near = F.filter(spans, lambda x: F.substr(t, begin(x) + 1, x["a"] + F.length(x["code"]) + reach - begin(x)).rlike(context))
        return F.array_distinct(F.transform(near, lambda x: x["code"]))

    def every(t: Column) -> Column:
        names = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(f"(?iu)(?<!{WORD_CHAR}){WORD_CHAR}++ {s}(?!{WORD_CHAR})"), F.lit(0)) for s in suffixes])))
        known = bound(F.lower(t), lambda low: F.filter(F.array(*[F.lit(x) for x in drugs]), lambda x: F.contains(low, x)))
        return F.struct(codes(t).alias("batches"), names.alias("makers"), known.alias("drugs"))

    return bound(F.trim(F.regexp_replace(blank(text), f"{SPACE_CHAR}+", " ")), every)


def whole_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """Terms that stand in the text as whole words."""
    t = F.concat(F.lit(" "), words(text), F.lit(" "))
    return F.array_compact(F.array(*[F.when(F.contains(t, F.lit(f" {re.sub('[^a-z0-9]+', ' ', k.lower()).strip()} ")), F.lit(k)) for k in terms]))


#: First words of a lexicon that are compared within the scan; with more of them all runs of words are joined.
FIRST_WORDS = 20_000


def lexicon_matches(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, name): names of the lexicon that stand in a text as whole words; within a text only the longest of nested names.

    Runs of as many words as names have are joined with the names, so both
    sides may be large. Where the names' first words are few, only runs that
    start with one of them are made.
    """
    names = lexicon.select(words(F.col("name")).alias("name")).filter("name <> ''").distinct()
    w = F.split("name", " ")
    shape = names.agg(F.collect_set(F.size(w)).alias("sizes"), F.approx_count_distinct(w[0]).alias("firsts")).first()
    starts = F.sequence(F.lit(0), F.size("w") - 1)
    if (shape["firsts"] or 0) <= FIRST_WORDS:
        firsts = [r[0] for r in names.select(w[0]).distinct().collect()]
        starts = F.filter(starts, lambda i: F.get("w", i).isin(firsts))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.array(*[F.lit(n) for n in sorted(shape["sizes"]) or [1]]), lambda n: F.when(i + n <= F.size("w"), F.array_join(F.slice("w", i + 1, n), " ")))))
    grams = docs.select("doc_id", F.split(words(F.col("text")), " ").alias("w")).select("doc_id", F.explode(F.array_distinct(runs)).alias("name")).filter("name is not null")
    hit = grams.join(names, "name").groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    inside = lambda a, b: (a != b) & F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))
    return hit.select("doc_id", F.explode(F.filter("names", lambda a: ~F.exists("names", lambda b: inside(a, b)))).alias("name"))


def fuzzy_lexicon(values: DataFrame, lexicon: DataFrame, limit: float = 85.0) -> DataFrame:
    """(value, name, score): the best name by token sort ratio, for values that no name equals.

    No pair that reaches the limit is lost. A ratio of the limit needs a common
    subsequence of c = limit * (a + b) / 200 letters. Of the a + 1 letter pairs of a
    padded text one that is left out spoils two and makes one, one that is put in
    spoils one, so at least 3c - a - b + 1 pairs are shared, and each side's rarest
    pairs beyond its least such number hold one of them. Where that bound says
    nothing (limits up to 200 / 3) single letters take the place of pairs.
    """
    v = values.select(words(F.col("value")).alias("value")).filter("value <> ''").distinct()
    n = lexicon.select(words(F.col("name")).alias("name")).filter("name <> ''").distinct()
    rest = v.join(n, F.col("value") == F.col("name"), "left_anti")
    pairs = _near(rest, n, limit) if limit > 0 else rest.crossJoin(n)

    def score(frames):
        for f in frames:
            yield f.assign(score=[token_sort_ratio_of(x, y) for x, y in zip(f["value"], f["name"], strict=True)])

    scored = pairs.mapInPandas(score, "value string, name string, score double").filter(F.col("score") >= limit)
    return scored.groupBy("value").agg(F.max_by(F.struct("name", "score"), F.struct("score", "name")).alias("b")).select("value", "b.name", "b.score")


def _near(values: DataFrame, names: DataFrame, limit: float) -> DataFrame:
    """Pairs (value, name) whose lengths and shared letter pairs allow the limit; see ``fuzzy_lexicon``."""
    q = 2 if limit > 200 / 3 else 1

    def shared(a: int, b: int) -> int:
        common = math.ceil(limit * (a + b) / 200 - 1e-9)
        return 3 * common - a - b + 1 if q == 2 else common

    def least(a: int) -> int:
        """The bound over all lengths that fit to a: that of the smallest, less what rounding up may move it by."""
        return max(1, shared(a, math.ceil(a * limit / (200 - limit) - 1e-9)) - 2 * (q - 1))

    def grams(text: str) -> list[str]:
        """Letters with their occurrence, over the sorted words."""
        t = " ".join(sorted(text.split()))
        t = f"^{t}$" if q == 2 else t
        seen, out = {}, []
        for i in range(len(t) - q + 1):
            g = t[i : i + q]
            seen[g] = seen.get(g, 0) + 1
            out.append(f"{g}{seen[g]}")
        return out

    def counted(frames):
        for f in frames:
            yield pd.DataFrame({"gram": [g for t in f["name"] for g in grams(t)]})

    # of letters, digits and a few marks there are at most some thousand
    spread = {r["gram"]: r["count"] for r in names.mapInPandas(counted, "gram string").groupBy("gram").count().collect()}

    def posted(df: DataFrame, c: str) -> DataFrame:
        def each(frames):
            for f in frames:
                rows = []
                for t in f[c]:
                    own = sorted(grams(t), key=lambda g: (spread.get(g, 0), g))
                    rows += [(t, own, g) for g in own[: max(0, len(own) - least(len(t)) + 1)]]
                yield pd.DataFrame(rows, columns=[c, f"{c}_grams", "gram"])

        return df.select(c).mapInPandas(each, f"{c} string, {c}_grams array<string>, gram string")

    a, b = F.length("value"), F.length("name")
    common = F.ceil(limit * (a + b) / 200 - 1e-9)
    enough = F.size(F.array_intersect("value_grams", "name_grams")) >= (3 * common - a - b + 1 if q == 2 else common)
    fits = (200 * F.least(a, b) >= limit * (a + b) - 1e-6) & enough
    return posted(values, "value").join(posted(names, "name"), "gram").filter(fits).select("value", "name").distinct()


def header_category_of(value: str) -> str | None:
    """Category of a table header: equal to a pattern, holding one as words, or close to one."""
    text = " ".join(re.findall("[a-z0-9]+", (value or "").lower()))
    best, top, letters = None, 84.0, Counter(text)
    for category, patterns in HEADERS.items() if text else ():
        for p in patterns:
            if text == p:
                score = 200.0 + len(p)
            elif f" {p} " in f" {text} ":
                score = 100.0 + len(p)
            elif 8 <= len(text) <= 64 and len(p) >= 8 and 200.0 * (letters & Counter(p)).total() / (len(text) + len(p)) > top:
                score = indel_ratio_of(text, p)  # no common subsequence is longer than the letters that both have
            else:
                continue
            if score > top:
                best, top = category, score
    return best


def _categories(values: pd.Series) -> pd.Series:
    known = {v: header_category_of(v) for v in values.unique()}
    return values.map(lambda v: known[v])


header_category = F.pandas_udf(_categories, T.StringType())


def document_hint(filename: Column) -> Column:
    t = F.concat(F.lit(" "), words(filename), F.lit(" "))
    hint = F.lit(None).cast("string")
    for name, patterns in reversed(TYPE_HINTS.items()):
        cond = F.lit(False)
        for p in patterns:
            cond = cond | F.contains(t, F.lit(f" {p} "))
        hint = F.when(cond, name).otherwise(hint)
    return hint


def verdict(ocr_pending: Column, table_drugs: Column, table_fdcs: Column, scanned_details: Column, drugs: Column, batches: Column, makers: Column, events: Column, context: Column, has_columns: Column, hint: Column) -> Column:
    """struct(rule, bucket, reason) by the ordered rules over precomputed counts and flags."""
    supported = (batches > 0) | (makers > 0)
    weak = ~has_columns & (hint.isNotNull() | (context >= 2) | ((context == 1) & (drugs >= 2)))
    rule = F.when(ocr_pending, "D7").when(table_drugs > 0, "D2").when(table_fdcs > 0, "D3").when(scanned_details & supported, "D8").when((drugs > 0) & (supported | (events > 0)), "D4").when(weak, "D5").otherwise("D6")
    return F.struct(rule.alias("rule"), F.when(rule == "D5", "context-only").when(rule == "D6", "unimportant").otherwise("event-bearing").alias("bucket"), F.when(rule == "D5", "regulatory_context_detected").when(rule == "D6", "no_regulatory_signal").otherwise("deterministic_event_signal").alias("reason"))


def completed(rule: Column, bucket: Column, reason: Column, makers: Column, batches: Column, has_context: Column, strong: Column) -> Column:
    """struct(bucket, reason, needs_review) after weak hits are demoted and strong evidence promoted."""
    d4 = rule == "D4"
    demoted = d4 & (makers > 0) & (batches == 0) & ~has_context
    promoted = ~demoted & strong & (bucket != "event-bearing")
    weak = ~demoted & ~strong & d4 & (bucket == "event-bearing")
    noted = ~demoted & ~promoted & ~weak & has_context & (bucket == "context-only")
    return F.struct(
        F.when(demoted | weak, "context-only").when(promoted, "event-bearing").otherwise(bucket).alias("bucket"),
        F.when(demoted, "drug_and_manufacturer_without_event_context").when(promoted, "explicit_drug_safety_event").when(weak, "weak_event_signal").otherwise(reason).alias("reason"),
        (weak | noted).alias("needs_review"),
    )


def ensemble(bucket: Column, model: Column, confidence: Column) -> Column:
    """struct(bucket, reason): a model's relevant verdict overrides at 0.70 and asks for review at 0.50."""
    side = F.when(bucket == "context-only", "context").otherwise("unimportant")
    confirmed = F.when(bucket == "context-only", "context_confirmed").otherwise("unimportant")
    relevant = F.coalesce(model == "relevant", F.lit(False))
    c = F.coalesce(confidence, F.lit(0.0))
    out = lambda b, r: F.struct(b.alias("bucket"), r.alias("reason"))
    return F.when(bucket == "event-bearing", out(bucket, F.lit("deterministic_event_signal"))).when(relevant & (c >= 0.70), out(F.lit("event-bearing"), F.concat(side, F.lit("_override_model_strong")))).when(relevant & (c >= 0.50), out(F.lit("needs_review"), F.concat(side, F.lit("_model_uncertain")))).otherwise(out(bucket, confirmed))


def averaged(samples: DataFrame, relevant: tuple[str, ...], uniform: float = 0.34) -> DataFrame:
    """(doc_id, top_label, top_score, verdict) from samples(doc_id, label, score): the mean score of each label.

    Means are rounded where the order of a sum shows, so that equal ones are equal in whatever order rows come.
    """
    mean = samples.groupBy("doc_id", "label").agg(F.round(F.avg("score"), 9).alias("score"))
    top = mean.groupBy("doc_id").agg(F.max_by(F.struct("label", "score"), F.struct("score", "label")).alias("t"))
    v = F.when(F.col("t.score") <= uniform, "needs_review").when(F.col("t.label").isin(*relevant), "relevant").otherwise("not_relevant")
    return top.select("doc_id", F.col("t.label").alias("top_label"), F.round("t.score", 4).alias("top_score"), v.alias("verdict"))


#: Two terms that count together where a text names the programme and a reaction.
PROGRAMME, REACTION, PAIR = ("pvpi", "pharmacovigilance programme of india"), (r"\badr\b", "adverse drug reaction"), ("pvpi", "adr")


def distinct_event_terms(docs: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(doc_id, n): distinct terms in a text, counting only the longest of those that overlap, the first of equals.

    Spans are found by position, grouped where they overlap (gaps and islands)
    and the longest term of each group counts. A text that names the
    pharmacovigilance programme and an adverse reaction has both terms of PAIR.
    """
    low = F.lower(blank(F.col("text")))
    spans = None
    for term in terms:
        cut = F.split(low, "\\b" + re.escape(term).replace("\\ ", " ") + "\\b")
        at = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cut) - 1, F.lit(1))), lambda i: F.aggregate(F.slice(F.col("cut"), F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * len(term))
        part = docs.withColumn("cut", cut).filter(F.size("cut") > 1).select("doc_id", F.lit(term).alias("term"), F.explode(at).alias("a"))
        spans = part if spans is None else spans.unionByName(part)
    spans = spans.withColumn("b", F.col("a") + F.length("term"))
    w = Window.partitionBy("doc_id").orderBy("a", "b", "term")
    begins = F.coalesce(F.col("a") >= F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    grouped = spans.withColumn("new", begins).withColumn("g", F.sum("new").over(w)).groupBy("doc_id", "g").agg(F.min_by("term", F.struct(-F.length("term"), "a", "b", "term")).alias("term"))
    programme = F.contains(low, F.lit(PROGRAMME[0])) | F.contains(low, F.lit(PROGRAMME[1]))
    pairs = docs.filter(programme & (low.rlike(REACTION[0]) | F.contains(low, F.lit(REACTION[1])))).select("doc_id", F.explode(F.array(*[F.lit(p) for p in PAIR])).alias("term"))
    return grouped.select("doc_id", "term").unionByName(pairs).groupBy("doc_id").agg(F.countDistinct("term").alias("n"))


def document_family(headers: Column, sample: Column) -> Column:
    """One of sixteen families of alert documents by words of headers and text, the first rule that fits."""
    h, s = F.lower(blank(headers)), F.lower(blank(sample))
    inh, ins = (lambda t: F.contains(h, F.lit(t))), (lambda t: F.contains(s, F.lit(t)))
    return (
        F.when(inh("spurious") | ins("spurious") | inh("manufacturer details"), "Doc 4").when(inh("suspected drugs") | inh("adverse drug reaction") | ins("pvpi"), "Doc 2").when((inh("drugs name") | ins("prohibited") | ins("banned")) & (ins("notification") | ins("26a")), "Doc 1")
        .when(inh("nsq result") & (inh("reporting by lab") | inh("state lab") | inh("reporting source")), "Doc 3").when(inh("cdsco laboratory") | inh("reported by cdsco"), "Doc 5").when(inh("drawn by") | inh("reason for failure"), "Doc 6").when(ins("device") | ins("catheter") | ins("implant"), "Doc 7")
        .when(ins("approved") & ins("indication"), "Doc 8").when(ins("fdc") & (ins("irrational") | ins("prohibition")), "Doc 9").when(ins("sec") | ins("tentative schedule"), "Doc 10").when(ins("noc") | ins("import"), "Doc 11").when(ins("vaccine") & ins("inspection"), "Doc 12").when(ins("pcr") | ins("testing kit"), "Doc 13")
        .when(ins("laboratory") & ins("ivd"), "Doc 14").when(ins("fee") | ins("faq"), "Doc 15").when(ins("g.s.r") | ins("s.o."), "Doc 16").otherwise("General")
    )


def priority(title: Column, important: tuple[str, ...], unimportant: tuple[str, ...], has_text: Column) -> Column:
    t = F.lower(blank(title))
    any_of = lambda ks: F.array_contains(F.array(*[F.contains(t, F.lit(k)) for k in ks]), True)
    return F.when(~has_text, "Review").when(any_of(important), "Important").when(any_of(unimportant), "Unimportant").otherwise("Review")
