"""Lines, rows, paragraphs, chunks and archetypes against plain loops over lists."""

import random
import re
import statistics
from difflib import SequenceMatcher
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from medlattice.operators import layout

BLOCKS = "doc string, page int, id long, x0 double, y0 double, x1 double, y1 double, text string, confidence double"


def random_blocks(rng, pages, n):
    """Blocks on a coarse grid, so that centres, overlaps and edges tie."""
    texts = ["", " ", "BATCH NO", "Remarks:", "Page 1 of 2", "Printed by the Manager", "some words", "more", "LONG " * 30, "ÉTAT", "Publishéd by the Controller of x"]
    rows = []
    for page in range(pages):
        for i in range(n):
            x, y, h = rng.randrange(0, 40) * 10, rng.randrange(0, 60) * 4, rng.choice([0, 4, 8, 10, 12, 20])
            rows.append((rng.choice("ab"), page, page * 1000 + i, float(x), float(y), float(x + 9), float(y + h), rng.choice(texts), rng.choice([None, 0.25, 0.5, 1.0])))
    return rows + [("a", 0, 9999, None, 1.0, 2.0, 3.0, "no box", 1.0), ("a", 0, 9998, 1.0, 1.0, 2.0, 3.0, None, 1.0)]


def plain_rows(blocks):
    """All rows are kept; of the last four the best takes a block."""
    rows = []
    for b in sorted(blocks, key=lambda b: ((b["y0"] + b["y1"]) / 2, b["x0"], b["id"])):
        centre, height = (b["y0"] + b["y1"]) / 2, max(1.0, b["y1"] - b["y0"])
        best, chosen = None, None
        for row in rows[-4:]:
            top, low = statistics.median([x["y0"] for x in row]), statistics.median([x["y1"] for x in row])
            ratio = max(0.0, min(low, b["y1"]) - max(top, b["y0"])) / min(max(1.0, low - top), height)
            delta = abs(centre - statistics.median([(x["y0"] + x["y1"]) / 2 for x in row]))
            if (ratio >= 0.35 or delta <= 8) and (best is None or (ratio, -delta) > best):
                best, chosen = (ratio, -delta), row
        if chosen is None:
            rows.append([b])
        else:
            chosen.append(b)
    return [sorted(r, key=lambda b: b["x0"]) for r in rows]


def pages_of(rows):
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    usable = [dict(zip(names, r, strict=True)) for r in rows]
    usable = [b | {"text": b["text"].strip(), "confidence": b["confidence"] or 0.0} for b in usable if b["text"] and b["text"].strip() and b["x0"] is not None]
    key = lambda b: (b["doc"], b["page"])
    return [(k, list(g)) for k, g in groupby(sorted(usable, key=key), key=key)]


@pytest.mark.parametrize("seed", [1, 2])
def test_visual_rows(spark, seed):
    rows = random_blocks(random.Random(seed), 4, 60)
    want = {(*k, b["id"]): (i, j) for k, page in pages_of(rows) for i, row in enumerate(plain_rows(page)) for j, b in enumerate(row)}
    found = layout.ocr_rows(spark.createDataFrame(rows, BLOCKS).withColumn("row", F.lit("clash")), "doc").collect()
    assert {(r.doc, r.page, r.id): (r.row, r.place) for r in found} == want and len(found) == len(want)
    assert any(j for _, j in want.values())


def test_photographed_rows(spark):
    rows = random_blocks(random.Random(3), 3, 50)
    want = []
    for k, page in pages_of(rows):
        lines = []
        for b in sorted(page, key=lambda b: ((b["y0"] + b["y1"]) / 2, b["id"])):
            height, centre = b["y1"] - b["y0"], (b["y0"] + b["y1"]) / 2
            if height <= 0:
                continue
            if lines and abs(centre - lines[-1][1]) <= 0.6 * max(height, lines[-1][2]):
                items, c, h = lines[-1]
                n = len(items) + 1
                lines[-1] = (items + [b], (c * (n - 1) + centre) / n, (h * (n - 1) + height) / n)
            else:
                lines.append(([b], centre, height))
        want += [(*k, i, "  ".join(b["text"] for b in sorted(items, key=lambda b: b["x0"]))) for i, (items, _, _) in enumerate(lines)]
    assert sorted(map(tuple, layout.reading_rows(spark.createDataFrame(rows, BLOCKS), "doc").collect())) == sorted(want)


def plain_boilerplate(text):
    t = " ".join(re.findall("[a-z0-9]+", text.lower().replace("é", "e")))
    return ("page" in t and " of " in f" {t} " and len(t) < 25) or "printed by the manager" in t or "published by the controller" in t


@pytest.mark.parametrize("seed", [4, 5])
def test_block_paragraphs(spark, seed):
    rng = random.Random(seed)
    rows = random_blocks(rng, 4, 60)
    taken = [r[:3] for r in rows if rng.random() < 0.2]
    want = []
    for k, page in pages_of([r for r in rows if r[:3] not in taken]):
        out, held, before = [], [], None

        def close(held=held, out=out):
            text = " ".join(b["text"] for b in held).strip()
            if held and not plain_boilerplate(text):
                out.append((text, sum(b["confidence"] for b in held) / len(held)))
            held.clear()

        for row in plain_rows(page):
            text = " ".join(b["text"] for b in row)
            if plain_boilerplate(text):
                continue
            if before and min(b["y0"] for b in row) - before[0] > max(24, before[1] * 1.3):
                close()
            if len(text) <= 80 and (text.isupper() or text.endswith(":")):
                close()
                out.append((text, sum(b["confidence"] for b in row) / len(row)))
            else:
                held += row
            before = max(b["y1"] for b in row), statistics.median(max(1.0, b["y1"] - b["y0"]) for b in row)
        close()
        want += [(*k, i, *p) for i, p in enumerate(out)]
    found = layout.ocr_paragraphs(spark.createDataFrame(rows, BLOCKS), "doc", spark.createDataFrame(taken, "doc string, page int, id long")).collect()
    rounded = lambda rows: sorted((*r[:4], round(r[4], 9)) for r in rows)
    assert rounded(found) == rounded(want) and len(want) > 20


LINES = "doc string, page int, n int, x0 double, y0 double, x1 double, y1 double, size double, text string"


def random_lines(rng, n):
    texts = ["ends here.", "goes on", "hy-", "a long line " * 6, "Title", "semi;", "दण्ड।", "word", "soft-\nwrap  and\tspace", "", " \n "]
    rows = []
    for i in range(n):
        x, y = rng.choice([50, 55, 60, 200]), rng.randrange(0, 80) * 10
        rows.append((rng.choice("xy"), rng.randrange(3), i, float(x), float(y), float(x + rng.choice([40, 300, 460])), float(y + rng.choice([0, 9, 10, 11])), rng.choice([0.0, 10.0, 10.0, 12.0, 12.1, 15.0]), rng.choice(texts)))
    return rows


def plain_labels(rows):
    """(row, label) of lines with a text."""
    clean = [(*r[:8], " ".join(re.sub(r"(\w+)-\n(\w+)", r"\1\2", r[8]).split())) for r in rows]
    clean = [r for r in clean if r[8]]
    out = []
    for r in clean:
        doc, page, _, x0, y0, x1, y1, size, text = r
        sizes = [q[7] for q in clean if q[0] == doc and q[7] > 0]
        deep, wide = (max(q[i] for q in clean if q[:2] == r[:2]) for i in (6, 5))
        if y0 < 0.08 * deep:
            label = "HEADER"
        elif y1 > 0.92 * deep:
            label = "FOOTER"
        elif size > 1.2 * (statistics.median(sizes) if sizes else 10.0):
            label = "TITLE"
        else:
            label = "TITLE" if abs((x0 + x1) / 2 - wide / 2) < 0.15 * wide and len(text) < 60 and text[-1] != "." else "PARAGRAPH"
        out.append((r, label))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_and_paragraphs(spark, seed):
    rows = random_lines(random.Random(seed), 120)
    labelled = plain_labels(rows)
    made = layout.line_labels(layout.lines_of_text(spark.createDataFrame(rows, LINES)), "doc")
    assert {(r.doc, r.n): (r.text, r.label) for r in made.collect()} == {(r[0], r[2]): (r[8], label) for r, label in labelled}
    want = []
    for doc in "xy":
        own = sorted((x for x in labelled if x[0][0] == doc), key=lambda x: (x[0][1], x[0][4], x[0][3], x[0][2]))
        heights = [r[6] - r[4] for r, _ in own if r[6] > r[4]]
        height, out, open_ = statistics.median(heights), [], None
        for r, label in own:
            _, page, _, x0, y0, _, y1, _, text = r
            if label != "PARAGRAPH":
                out.append([label, [page], text])
                open_ = None
                continue
            if open_ is not None:
                part, (p, px, py) = open_
                near = y0 - py <= 1.5 * height and abs(x0 - px) <= 0.8 * height
                over = py >= 640 and part[2].rstrip()[-1] not in ".!?।:;"
                if near if p == page else over:
                    part[2] = part[2][:-1] + text if part[2][-1] == "-" else part[2] + " " + text
                    part[1] += [page] if page not in part[1] else []
                    open_ = part, (page, x0, y1)
                    continue
            out.append(["PARAGRAPH", [page], text])
            open_ = out[-1], (page, x0, y1)
        want += [(doc, i, *p) for i, p in enumerate(out)]
    found = [(r.doc, r.paragraph, r.label, r.pages, r.text) for r in layout.paragraphs(made, "doc").collect()]
    assert sorted(found) == sorted(want)


def test_paragraphs_close_hyphens_and_cross_pages(spark):
    at = lambda n, page, y, text, x=50.0: ("d", page, n, x, float(y), x + 500, y + 10.0, text, "PARAGRAPH")
    rows = [at(0, 1, 100, "hy-"), at(1, 1, 112, "phen-"), at(2, 1, 124, "ated."), at(3, 1, 650, "at the foot"), at(4, 2, 90, "of a page"), at(5, 2, 102, "ends."), at(6, 3, 90, "starts")]
    df = spark.createDataFrame(rows, "doc string, page int, n int, x0 double, y0 double, x1 double, y1 double, text string, label string")
    assert [(r.pages, r.text) for r in layout.paragraphs(df, "doc").orderBy("paragraph").collect()] == [([1], "hyphenated."), ([1, 2], "at the foot of a page ends."), ([3], "starts")]
    assert layout.paragraphs(df.limit(0), "doc").count() == 0


def test_chunks(spark):
    def chunk(text, soft=40):
        return [(r.path, r.blocks, r.chars, r.text) for r in layout.chunk_markdown(spark.createDataFrame([(1, text)], "k int, text string"), "k", soft).orderBy("chunk").collect()]

    assert chunk("# A ##\n\none\n \t\ntwo\n\n### B\n\nthree\n\n## C #\nnot a heading\n\n## D\n\nfour") == [
        ("A", 5, 30, "# A ##\n\none\n\ntwo\n\n### B\n\nthree"), ("A > B", 1, 20, "## C #\nnot a heading"), ("A > D", 2, 10, "## D\n\nfour"),
    ]
    # packed with separators: 18 + 2 + 20 fills 40 and closes; 41 alone is one chunk
    assert [c[1:3] for c in chunk("a" * 18 + "\n\n" + "b" * 20 + "\n\n" + "c")] == [(2, 40), (1, 1)]
    assert [c[1:3] for c in chunk("a" * 19 + "\n\n" + "b" * 20 + "\n\n" + "c" * 41 + "\n\nd")] == [(1, 19), (1, 20), (1, 41), (1, 1)]
    assert [c[0] for c in chunk("# A\n\n## B\n\nx\n\n# C\n\n   ### D  ###  \n\ny")] == ["A", "A > B", "C"]
    assert chunk("#no heading\n\n## H\nsecond line") == [("", 2, 29, "#no heading\n\n## H\nsecond line")]
    assert chunk(None) == chunk(" \n\n ") == []
    with pytest.raises(ValueError):
        layout.chunk_markdown(spark.createDataFrame([(1, "")], "k int, text string"), "k", 0)


def test_chunks_equal_plain_packing(spark):
    rng = random.Random(6)
    for soft in (1, 12, 30):
        blocks = [rng.choice(["# A", "## B b", "### C #", "x" * rng.randrange(1, 35), "l1\nl2", "####### no"]) for _ in range(60)]
        out, path, held = [], {}, []
        size = lambda held: sum(map(len, held)) + 2 * (len(held) - 1) if held else 0
        for b in blocks:
            m = re.fullmatch(r"(#{1,6}) (.+?) ?#*", b) if "\n" not in b else None
            if held and ((m and len(m[1]) < 3) or size([*held, b]) > soft):
                out.append((where, held))
                held = []
            if m:
                path = {k: v for k, v in path.items() if k < len(m[1])}
                path[len(m[1])] = m[2]
            where = where if held else " > ".join(v for _, v in sorted(path.items()))
            held = [*held, b]
            if size(held) >= soft:
                out.append((where, held))
                held = []
        out += [(where, held)] if held else []
        found = layout.chunk_markdown(spark.createDataFrame([(1, "\n\n".join(blocks))], "k int, text string"), "k", soft).orderBy("chunk").collect()
        assert [(r.path, r.blocks, r.chars, r.text) for r in found] == [(w, len(h), size(h), "\n\n".join(h)) for w, h in out]


def plain_archetype(cells, archetypes):
    """Every archetype is scored; the first with the largest (ratio, score, matched) wins."""

    def fits(cell, name):
        a, b = (" ".join(re.findall("[a-z0-9]+", t.lower())) for t in (cell, name))
        if not a or not b:
            return False
        return a == b or (min(len(a), len(b)) > 4 and (a in b or b in a or SequenceMatcher(None, a, b).ratio() >= 0.78))

    text = " ".join(cells)
    if len(cells) < 2 or (text and len([c for c in text if ord(c) < 128]) / len(text) < 0.85):
        return None
    best, chosen = (0, 0, 0), None
    for name, required, optional in archetypes:
        used, matched = set(), [0, 0]
        for k, groups in enumerate((required, optional)):
            for group in groups:
                for cell in cells:
                    if cell not in used and any(fits(cell, n) for n in group):
                        used.add(cell)
                        matched[k] += 1
                        break
        ratio = matched[0] / len(required)
        if ratio < 0.75 or matched[0] < 2:
            continue
        score = round(0.85 * ratio + 0.15 * (matched[1] / len(optional) if optional else 0), 3)
        if (round(ratio, 3), score, matched[0]) > best:
            best, chosen = (round(ratio, 3), score, matched[0]), name
    return chosen and (chosen, best[1], best[0])


def test_archetypes(spark):
    rng = random.Random(7)
    names = ["s no", "batch no", "product name", "name of drug", "lot no", "reason for failure", "recall date", "remarks", "device name", "id"]
    archetypes = [layout.Archetype(f"k{i}", tuple(tuple(rng.sample(names, rng.randrange(1, 3))) for _ in range(rng.randrange(1, 5))), tuple((rng.choice(names),) for _ in range(rng.randrange(3)))) for i in range(9)]
    spoiled = lambda t: rng.choice([t, t.upper(), t + ".", t.replace("o", "0", 1), f"{t} etc", "Ünïcödé täxt", ""])
    headers = [(i, [spoiled(rng.choice(names)) for _ in range(rng.randrange(0, 7))]) for i in range(300)]
    found = {r.table_id: r for r in layout.header_archetypes(spark.createDataFrame(headers, "table_id long, cells array<string>"), archetypes).collect()}
    for i, cells in headers:
        want = plain_archetype(cells, archetypes)
        assert (want is None and found[i].archetype is None) or want == (found[i].archetype, found[i].score, found[i].required)
    assert len({r.archetype for r in found.values()}) > 4


def test_a_header_cell_fills_one_group(spark):
    a = layout.Archetype("a", (("batch no",), ("batch no", "lot no"), ("product name",)))
    headers = [(1, ["Batch No", "Product name"]), (2, ["Batch No", "Lot No", "Product name"]), (3, ["Batch No", "Batch No", "Product name"]), (4, None), (5, [None, None])]
    found = {r.table_id: r.archetype for r in layout.header_archetypes(spark.createDataFrame(headers, "table_id long, cells array<string>"), [a]).collect()}
    assert found == {1: None, 2: "a", 3: None, 4: None, 5: None}
    rows = spark.createDataFrame([("b", 1, "required", 0, ["x"]), ("a", 0, "optional", 0, ["z"]), ("a", 0, "required", 1, ["q"]), ("a", 0, "required", 0, ["p", "r"])], "archetype string, position int, part string, nth int, names array<string>")
    assert layout.archetypes_of(rows) == [layout.Archetype("a", (("p", "r"), ("q",)), (("z",),)), layout.Archetype("b", (("x",),))]
