"""Date functions: several source formats, none of which may fail a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, trim_space

#: Month names, longest first where one starts another.
MONTHS = {"january": 1, "february": 2, "march": 3, "april": 4, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12, "june": 6, "july": 7, "sept": 9, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}


def _number(c: Column) -> Column:
    return F.try_to_number(c, F.lit("999999")).cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    y, m, d = (F.expr(f"try_cast(null as int)") if x is None else x.try_cast("int") for x in (year, month, day))
    ok = m.between(1, 12) & d.between(1, 31) & y.between(1900, 2100)
    return F.when(ok, F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))


def load_date(c: Column) -> Column:
    """Date of a stored text; month precision gives the first day, impossible days null."""
    t = trim_space(blank(c))
    part = lambda p, i: F.regexp_extract(t, p, i)
    my, ym, dmy, inside = "^(\\d{1,2})[-/](\\d{4})$", "^(\\d{4})[-/](\\d{1,2})$", "^(\\d{1,2})[-/](\\d{1,2})[-/](\\d{4})$", "\\b(\\d{1,2})[-/](\\d{4})\\b"
    one = F.lit("1")
    return (
        F.when(t.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
        .when(t.rlike(my) & _day(part(my, 2), part(my, 1), one).isNotNull(), _day(part(my, 2), part(my, 1), one))
        .when(t.rlike(ym) & _day(part(ym, 1), part(ym, 2), one).isNotNull(), _day(part(ym, 1), part(ym, 2), one))
        .when(t.rlike(dmy), _day(part(dmy, 3), part(dmy, 2), part(dmy, 1)))
        .otherwise(_day(part(inside, 2), part(inside, 1), one))
    )


def strict_date(c: Column) -> Column:
    """Only yyyy-MM-dd, dd/MM/yyyy and dd-MM-yyyy with leading zeros."""
    t = trim_space(blank(c))
    return F.when(t.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")).when(t.rlike("^\\d{2}/\\d{2}/\\d{4}$"), F.try_to_date(t, "dd/MM/yyyy")).when(t.rlike("^\\d{2}-\\d{2}-\\d{4}$"), F.try_to_date(t, "dd-MM-yyyy"))


def _month(name: Column) -> Column:
    pairs = [F.lit(x) for k, v in MONTHS.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def month_or_text(c: Column) -> Column:
    """A month and year as its first day in ISO form, anything else unchanged."""
    t = trim_space(blank(c))
    p = "^([A-Za-z]+)[ -](\\d{4})$"
    d = _day(F.regexp_extract(t, p, 2), _month(F.regexp_extract(t, p, 1)).cast("string"), F.lit("1"))
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), t)


def release_date(c: Column) -> Column:
    """Date of a scraped release: day, month or year precision, month names in any case."""
    t = F.initcap(trim_space(blank(c)))
    tries = [("^\\d{4}-[A-Za-z]{3}-\\d{1,2}$", "yyyy-MMM-d"), ("^\\d{4}-[A-Za-z]{4,}-\\d{1,2}$", "yyyy-MMMM-d"), ("^\\d{4}-\\d{1,2}-\\d{1,2}$", "yyyy-M-d"), ("^[A-Za-z]{4,}-\\d{4}$", "MMMM-yyyy"), ("^[A-Za-z]{3}-\\d{4}$", "MMM-yyyy"), ("^[A-Za-z]{4,} \\d{4}$", "MMMM yyyy"), ("^[A-Za-z]{3} \\d{4}$", "MMM yyyy"), ("^\\d{1,2}/\\d{4}$", "M/yyyy"), ("^\\d{4}$", "yyyy")]
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_timestamp(F.regexp_replace(t, "(?<=-)([a-z])", "$1"), F.lit(f)).cast("date")) for p, f in tries])


def period_of_file(name: Column) -> Column:
    """struct(day, label): month and year in a file name as ISO first day and ``May 2022``; empty if there is none."""
    p = "(?<![a-z])(" + "|".join(sorted(MONTHS, key=lambda m: (-len(m), m))) + ")[^a-z0-9]+(20\\d{2})\\b"
    t = F.lower(blank(name))
    month, year = F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)
    day = F.date_format(_day(year, _month(month).cast("string"), F.lit("1")), "yyyy-MM-dd")
    return F.struct(F.coalesce(day, F.lit("")).alias("day"), F.when(month != "", F.concat_ws(" ", F.initcap(month), year)).otherwise("").alias("label"))


def barcode_date(c: Column) -> Column:
    """YYMMDD of a barcode as ISO date; years 00 to 49 are 20xx; day 00 gives the month only."""
    t = blank(c)
    yy, mm, dd = (F.substring(t, i, 2) for i in (1, 3, 5))
    year = F.concat(F.when(yy < "50", "20").otherwise("19"), yy)
    good = t.rlike("^\\d{6}$") & mm.between("01", "12") & (dd <= "31")
    return F.when(good, F.when(dd == "00", F.concat_ws("-", year, mm)).otherwise(F.concat_ws("-", year, mm, dd)))


def utc_time(c: Column) -> Column:
    """ISO time as a timestamp; a time without a zone is UTC."""
    t = trim_space(blank(c))
    zoned = t.rlike("(?i)(z|[+-]\\d{2}:?\\d{2})$") & t.rlike("\\d{2}:\\d{2}")
    return F.when(t.rlike("^\\d{4}-\\d{2}-\\d{2}"), F.try_to_timestamp(F.when(zoned, t).otherwise(F.concat(t, F.when(t.rlike("\\d{2}:\\d{2}"), "Z").otherwise("T00:00:00Z")))))
