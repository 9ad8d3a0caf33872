"""Numbered lists and drug safety alerts against plain loops, and on fixtures of each list."""

import random
import re

import pytest

from medlattice.operators import assemble, listings

LINES = "doc string, n int, text string"


def read(spark, text, kind):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(text.split("\n"))], LINES)
    return [(r.number, r.name, r.detail, r.note) for r in listings.listed(df, "doc", "n", kind).orderBy("position").collect()]


def test_bans(spark):
    text = """
    LIST OF DRUGS PROHIBITED FOR MANUFACTURE
    Sr. No. Drugs Name Notification
    stray line
    7. Amidopyrine
    and its salts
    GSR 578(E) Dated23 . 07 . 1983
    as amended
    9. not the next
    =====
    under section 26A of the act
    8.Fixed combination of 2 drugs
    S.O. 5 dated 01.02.20 04
    8. seen again"""
    assert read(spark, text, "bans") == [
        (7, "Amidopyrine and its salts", "GSR 578(E) Dated 23.07.1983 as amended 9. not the next", ""),
        (8, "Fixed combination of 2 drugs", "S.O. 5 Dated 01.02.2004 8. seen again", ""),
    ]


def test_approvals(spark):
    text = "LIST OF APPROVED DRUGS\nS.No Name Of Drug\n3. Aspirin\ntablets\nFor the relief\nof pain\n12.05.2020.\nand more\n1. old\n4.\nSecond drug\n7/8/99\n01-01-2001\n5 no dot\n99999999999999999999. x"
    assert read(spark, text, "approvals") == [(3, "Aspirin tablets", "For the relief of pain and more 1. old", "12.05.2020"), (4, "Second drug", "5 no dot 99999999999999999999. x", "01-01-2001")]


def test_notices(spark):
    text = "NOTICE\nS.NO.\n3.\nX Pharma\nLimited 2 Letters here\nnot read\n1.\nDOCUMENT\nY Labs\n12LETTERS\n3. with text\n2.\n"
    assert read(spark, text, "notices") == [(3, "X Pharma Limited  here", "", "2 Letters"), (1, "Y Labs", "", "12LETTERS"), (2, "", "", "")]


def plain(lines, kind):
    """Entries by the rules of each list, with all of them kept as dictionaries."""
    out = []
    for x in lines:
        x = x.strip()
        up, low = x.upper(), x.lower()
        if not x or x[:5] == "=====":
            continue
        if kind == "approvals" and (x.startswith("LIST OF APPROVED") or re.match("s.no|name of drug|indication|date of issue".replace(".no", r"\.no"), low)):
            continue
        if kind == "bans" and (any(t in up for t in ["LIST OF DRUGS PROHIBITED", "GAZETTE NOTIFICATIONS", "SECTION 26A", "MINISTRY OF HEALTH", "ACT 1940"]) or re.match(r"sr\.?\s*no|drugs?\s*name|notification", low)):
            continue
        if kind == "notices" and re.search("NOTICE|Examination of safety|FDC DIVISION|S[.]NO[.]|NAME OF COMPANY|DOCUMENT", x):
            continue
        now = out[-1] if out else None
        if kind == "approvals" and now and re.fullmatch(r"\d\d?[./-]\d\d?[./-]\d{2,4}\.?", x):
            now["note"] = x.rstrip(".")
            continue
        m = re.match(r"(\d+)\.\s*(.*)$", x)
        if m and (not m[2] if kind == "notices" else now is None or int(m[1]) == now["number"] + 1):
            out.append({"number": int(m[1]), "name": [m[2]], "detail": [], "note": ""})
        elif now is None:
            continue
        elif kind == "notices":
            letters = re.search(r"\d+\s*letters?", x, re.I)
            if letters:
                now["note"] = letters[0]
                now["name"].append(x.replace(letters[0], "").strip())
            elif not now["note"]:
                now["name"].append(x)
        else:
            words = ["gsr", "s.o.", "dated", "no.", "notification"] if kind == "bans" else ["for the", "treatment", "prevention", "indicated", "promoted", "acute", "hand protectant", "same as", "by intracavity", "additional indication"]
            hit = any(w in low for w in words) or (kind == "bans" and re.search("[0-9]", x)) or now["note"] or now["detail"]
            now["detail" if hit else "name"].append(x)
    squeeze = lambda t: listings.clean_notification(t) if kind == "bans" else t
    return [(e["number"], " ".join(t for t in e["name"] if t), squeeze(" ".join(e["detail"])), e["note"]) for e in out]


@pytest.mark.parametrize("kind", ["bans", "approvals", "notices"])
def test_random_lists(spark, kind):
    rng = random.Random(5)
    parts = ["", "  ", "=====", "Sr No", "Indication", "plain words", "more", "GSR No. 5", "dated 3", "Acute pain", "for the use", "1.2.2020", "11-12-99.", "2 Letters", "Z Ltd 1 letter x", "NOTICE", "12", "section 26a", "NAME OF COMPANY"]
    lists = {}
    for doc in "abcdef":
        n, lists[doc] = rng.randrange(5), []
        for _ in range(120):
            if rng.random() < 0.35:
                n = n + 1 if rng.random() < 0.7 else rng.randrange(9)
                lists[doc].append(f"{n}." + rng.choice(["", " Drug", "name", " "]))
            else:
                lists[doc].append(rng.choice(parts))
    rows = [(doc, i, "\r\n".join(lines[3 * i : 3 * i + 3])) for doc, lines in lists.items() for i in range(40)]
    found = listings.listed(spark.createDataFrame(rows, LINES), "doc", "n", kind).orderBy("doc", "position").collect()
    assert [(r.doc, r.number, r.name, r.detail, r.note) for r in found] == [(doc, *e) for doc, lines in lists.items() for e in plain(lines, kind)]
    assert listings.listed(spark.createDataFrame([], LINES), "doc", "n", kind).count() == 0


HEAD = ["S No", "Suspected Drugs", "Indication(s)", "Adverse Drug Reactions"]


def test_safety_alerts_of_tables_texts_and_both(spark):
    texts = [
        ("table", "PvPI alert\nFile No. 12/3 Dated: 4 May 2020\nend"), ("none", "other document"), ("both", "Drug Safety Alerts\nSuspected Drugs Indication Adverse Drug Reactions\n1 Textdrug used for pain. Rash"),
        ("text", "pvpi\nDated 5 June\nS. No. Suspected Drugs Indication(s)\nAdverse Drug Reactions\n1 Aspirin: for the treatment of\npain. Severe rash. Fever\n 2 Nothing said\n3 Other - Used for fever and cold\nHealthcare Professionals, 4 X used for y. Z"),
        ("empty", None), ("lone", "pvpi, no entries"),
    ]
    rows = [
        ("table", ["0", "too early", "", ""]), ("table", HEAD), ("table", ["", "before any", "", ""]), ("table", ["1.", "Drug  a", "", "rash"]), ("table", ["", "b", "pain", ""]), ("table", ["Healthcare professionals are advised"]), ("table", ["5", "shut", "", ""]),
        ("table", HEAD), ("table", ["", "c", None, "fever"]), ("table", ["2", "Second", "x", "y", "beyond"]), ("table", ["Disclaimer: none"]), ("table", ["3", "shut", "", ""]), ("none", HEAD), ("none", ["1", "a", "b", "c"]), ("both", HEAD), ("both", ["7", "Tabledrug", "i", "r"]),
        ("text", ["no header", "1", "2", "3"]),
    ]
    docs = spark.createDataFrame(texts, "doc string, text string")
    table = spark.createDataFrame([(d, i, c) for i, (d, c) in enumerate(rows)], "doc string, n int, cells array<string>")
    found = assemble.safety_alerts(docs, table, "doc", ["n"]).orderBy("doc", "position").collect()
    got = [(r.doc, r.number, r.suspected_drug, r.indications, r.reaction, r.issue_date, r.file_number, r.origin) for r in found]
    # the table "none" has the words of an alert in its header, so it counts although its text has none
    assert got == [
        ("both", 7, "Tabledrug", "i", "r", "", "", "table"), ("none", 1, "a", "b", "c", "", "", "table"), ("table", 1, "Drug a b c", "pain", "rash fever", "4 May 2020", "12/3", "table"), ("table", 2, "Second", "x", "y", "4 May 2020", "12/3", "table"),
        ("text", 1, "Aspirin", "for the treatment of pain.", "Severe rash. Fever", "5 June", "", "text"), ("text", 3, "Other", "Used for fever and cold", "", "5 June", "", "text"),
    ]
