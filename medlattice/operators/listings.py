"""Numbered lists in plain text: entries accepted by their numbers, the lines between dealt to an entry's fields."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE_CHAR, blank
from .folds import in_order

#: Words that tell an indication, and words that tell a notification.
INDICATED = ("for the", "for treatment", "treatment", "prevention", "indicated", "promoted", "acute", "hand protectant", "same as", "by intracavity", "additional indication")
NOTIFIED = ("gsr", "s.o.", "dated", "no.", "notification")
#: Lines that belong to no entry, by what they begin with, hold or match.
RULER = "====="
APPROVED_TITLE = "LIST OF APPROVED"
APPROVED_HEADER = re.compile(r"(?i)(S\.No|Name Of Drug|Indication|Date of issue)")
BANNED_TITLES = ("LIST OF DRUGS PROHIBITED", "GAZETTE NOTIFICATIONS", "SECTION 26A", "MINISTRY OF HEALTH", "ACT 1940")
BANNED_HEADER = re.compile(r"(?i)(Sr\.?\s*No\.?|Drugs?\s*Name|Notification)")
NOTICE_PARTS = ("NOTICE", "Examination of safety", "FDC DIVISION", "S.NO.", "NAME OF COMPANY", "DOCUMENT")
#: Numbers of entries, a day alone on its line, a count of letters.
NUMBERED = re.compile(r"(\d{1,18})\.\s*(.*)")
NUMBER_ALONE = re.compile(r"(\d{1,18})\.\s*")
DAY_ALONE = re.compile(r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})\.?")
LETTERS = re.compile(r"(?i)\d+\s*Letters?")


@dataclass
class Entry:
    """An entry that is still open: its number, its name, what is said of it, and its day or document."""

    number: int
    name: str = ""
    detail: str = ""
    note: str = ""

    def add(self, to: str, text: str) -> None:
        setattr(self, to, f"{getattr(self, to)} {text}".strip())


@dataclass
class Listing:
    """How a kind of list is read.

    ``skips`` tells lines that belong to no entry and ``takes`` deals a line to
    the open entry. ``opens`` matches the line of a number, its second group the
    name; with ``follows``, only one more than the number before opens an entry,
    whatever the first is. ``early`` may take a line before it is tried as a number.
    """

    skips: Callable[[str], bool]
    takes: Callable[[Entry, str], None]
    opens: re.Pattern = NUMBERED
    follows: bool = True
    early: Callable[[Entry, str], bool] = field(default=lambda entry, line: False)
    closed: Callable[[Entry], None] = field(default=lambda entry: None)

    def read(self, lines: Iterator[str]) -> Iterator[Entry]:
        entry: Entry | None = None
        for line in lines:
            if self.skips(line) or (entry and self.early(entry, line)):
                continue
            m = self.opens.fullmatch(line)
            if m and not (self.follows and entry and int(m[1]) != entry.number + 1):
                if entry:
                    self.closed(entry)
                    yield entry
                entry = Entry(int(m[1]), m[2].strip() if m.re.groups > 1 else "")
            elif entry:
                self.takes(entry, line)
        if entry:
            self.closed(entry)
            yield entry


def _holds(line: str, words: tuple[str, ...]) -> bool:
    return any(w in line for w in words)


def _approval_day(entry: Entry, line: str) -> bool:
    m = DAY_ALONE.fullmatch(line)
    if m:
        entry.note = m[1].rstrip(".")
    return m is not None


def _approval_line(entry: Entry, line: str) -> None:
    said = entry.note or entry.detail or _holds(line.lower(), INDICATED)
    entry.add("detail" if said else "name", line)


def _ban_line(entry: Entry, line: str) -> None:
    said = entry.detail or _holds(line.lower(), NOTIFIED) or re.search(r"\d", line)
    entry.add("detail" if said else "name", line)


def _company_line(entry: Entry, line: str) -> None:
    m = LETTERS.search(line)
    if m:
        entry.note = m[0]
        entry.add("name", line.replace(m[0], "").strip())
    elif not entry.note:
        entry.add("name", line)


def clean_notification(text: str) -> str:
    """One space between words, one after ``Dated``, and none within a day, whose year may be torn in two."""
    text = " ".join(text.split())
    text = re.sub(r"(?i)Dated\s*", "Dated ", text)
    text = re.sub(r"(\d{2})\s*\.\s*(\d{2})\s*\.\s*(\d{4})", r"\1.\2.\3", text)
    return re.sub(r"(\d{2})\s*\.\s*(\d{2})\s*\.\s*(\d{1,2})\s+(\d{2,4})", r"\1.\2.\3\4", text).strip()


def _clean(entry: Entry) -> None:
    entry.detail = clean_notification(entry.detail)


#: The three lists: approvals (name, indication, day of issue), bans (name, notification), notices to companies (name, document).
LISTINGS = {
    "approvals": Listing(lambda x: x.startswith((RULER, APPROVED_TITLE)) or bool(APPROVED_HEADER.match(x)), _approval_line, early=_approval_day),
    "bans": Listing(lambda x: x.startswith(RULER) or _holds(x.upper(), BANNED_TITLES) or bool(BANNED_HEADER.match(x)), _ban_line, closed=_clean),
    "notices": Listing(lambda x: x.startswith(RULER) or _holds(x, NOTICE_PARTS), _company_line, NUMBER_ALONE, follows=False),
}


def listed(lines: DataFrame, doc: str, order: str, kind: str) -> DataFrame:
    """(doc, position, number, name, detail, note) of the entries of lines(doc, order, text); ``kind`` is one of LISTINGS.

    A text may hold several lines; empty ones don't count. Lines before the first
    number go; one of over 18 digits is none. A document is read in its
    order as a stream, so what is held is its open entry.
    """
    listing = LISTINGS[kind]

    def fold(group: Iterator[tuple]) -> Iterator[tuple]:
        each = (line.strip() for text, in group for line in text.split("\n"))
        for i, e in enumerate(listing.read(line for line in each if line)):
            yield i, e.number, e.name, e.detail, e.note

    d = lines.withColumn("text", F.regexp_replace(blank(F.col("text")), "\r\n?", "\n")).filter(~F.col("text").rlike(f"^{SPACE_CHAR}*$"))
    return in_order(d, [doc], [F.col(order)], ["text"], fold, "position int, number long, name string, detail string, note string")
