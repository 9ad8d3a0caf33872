"""Layout of pages: lines, paragraphs, rows, tables and chunks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from statistics import median
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.text import SPACE_CHAR, WORD_CHAR, blank, fold_ascii
from .folds import in_order


def lines_of_text(lines: DataFrame) -> DataFrame:
    """lines with soft wraps closed and white space collapsed; empty ones go."""
    closed = F.regexp_replace(blank(F.col("text")), f"({WORD_CHAR}+)-\n({WORD_CHAR}+)", "$1$2")
    return lines.withColumn("text", F.trim(F.regexp_replace(closed, f"{SPACE_CHAR}+", " "))).filter("text <> ''")


def line_labels(lines: DataFrame, doc: str) -> DataFrame:
    """lines(doc, page, x0, y0, x1, y1, size, text) with ``label``.

    HEADER begins in the top 8 % of its page and FOOTER ends in the bottom 8 %
    (a page reaches to its lowest and rightmost line). TITLE is larger than 1.2
    times the document's median of positive sizes (10 where there are none), or
    stands in the middle, is short and has no full stop. The rest is PARAGRAPH.
    """
    per_doc = lines.groupBy(doc).agg(F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(10.0)).alias("_m"))
    per_page = lines.groupBy(doc, "page").agg(F.greatest(F.max("y1"), F.lit(0.0)).alias("_deep"), F.greatest(F.max("x1"), F.lit(0.0)).alias("_wide"))
    d = lines.join(per_doc, doc).join(per_page, [doc, "page"])
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("_wide") / 2) < F.col("_wide") * 0.15
    title = (F.col("size") > F.col("_m") * 1.2) | (centred & (F.length("text") < 60) & ~F.endswith(F.col("text"), F.lit(".")))
    label = F.when(F.col("y0") < F.col("_deep") * 0.08, "HEADER").when(F.col("y1") > F.col("_deep") * 0.92, "FOOTER").when(title, "TITLE").otherwise("PARAGRAPH")
    return d.withColumn("label", label).drop("_m", "_deep", "_wide")


#: What a sentence ends with.
SENTENCE_ENDS = (".", "!", "?", "\u0964", ":", ";")


def paragraphs(lines: DataFrame, doc: str, page_height: float = 800.0) -> DataFrame:
    """(doc, paragraph, label, pages, text) of lines(doc, page, x0, y0, y1, text, label), of equal places by n if there is one.

    Headers, footers and titles stand alone and close the open paragraph. A line
    goes on with it on the same page if the gap to its last line is at most 1.5
    median line heights and the indent differs by at most 0.8; on a later page
    if its last line reaches the lowest fifth of a page and its text so far
    doesn't end a sentence. A hyphen at the end of the open paragraph is closed.
    """
    height = F.col("y1") - F.col("y0")
    per_doc = lines.groupBy(doc).agg(F.coalesce(F.median(F.when(height > 0, height)), F.lit(12.0)).alias("_h"))

    def fold(group: Iterator[tuple]) -> Iterator[tuple]:
        number, text, pages, last = 0, None, [], None
        for page, x0, y0, y1, line, label, h in group:
            if text is not None and label == "PARAGRAPH":
                last_page, last_x0, last_y1 = last
                if page == last_page:
                    joins = y0 - last_y1 <= 1.5 * h and abs(x0 - last_x0) <= 0.8 * h
                else:
                    joins = last_y1 >= 0.8 * page_height and not text.rstrip().endswith(SENTENCE_ENDS)
                if joins:
                    text = text[:-1] + line if text.endswith("-") else f"{text} {line}"
                    pages += [page] if page not in pages else []
                    last = page, x0, y1
                    continue
            if text is not None:
                yield number, "PARAGRAPH", pages, text
                number, text = number + 1, None
            if label == "PARAGRAPH":
                text, pages, last = line, [page], (page, x0, y1)
            else:
                yield number, label, [page], line
                number += 1
        if text is not None:
            yield number, "PARAGRAPH", pages, text

    d = lines.join(per_doc, doc).withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "y1")}).withColumn("page", F.col("page").cast("int"))
    order = [F.col(c) for c in ("page", "y0", "x0", "n") if c in d.columns]
    return in_order(d, [doc], order, ["page", "x0", "y0", "y1", "text", "label", "_h"], fold, "paragraph int, label string, pages array<int>, text string")


class Block(NamedTuple):
    """A recognized piece of text with its box."""

    id: int
    x0: float
    y0: float
    x1: float
    y1: float
    text: str
    confidence: float

    @property
    def centre(self) -> float:
        return (self.y0 + self.y1) / 2

    @property
    def height(self) -> float:
        return max(1.0, self.y1 - self.y0)


BACK, OVERLAP, CENTRE = 4, 0.35, 8.0


def _closeness(row: list[Block], block: Block) -> tuple[float, float] | None:
    """How well a block fits a row: shared height over the smaller one, then nearness of centres; none if neither is enough."""
    top, low = median(b.y0 for b in row), median(b.y1 for b in row)
    shared = max(0.0, min(low, block.y1) - max(top, block.y0)) / min(max(1.0, low - top), block.height)
    apart = abs(block.centre - median(b.centre for b in row))
    return (shared, -apart) if shared >= OVERLAP or apart <= CENTRE else None


def rows_of_blocks(blocks: Iterable[Block]) -> Iterator[list[Block]]:
    """Rows of blocks that come in order of centre and left edge: each joins the best of the last rows, or begins one."""
    recent: deque[list[Block]] = deque()
    for block in blocks:
        fits = [(closeness, -i, row) for i, row in enumerate(recent) if (closeness := _closeness(row, block))]
        if fits:
            max(fits, key=lambda f: f[:2])[2].append(block)
            continue
        if len(recent) == BACK:
            yield sorted(recent.popleft(), key=lambda b: b.x0)
        recent.append([block])
    for row in recent:
        yield sorted(row, key=lambda b: b.x0)


_BLOCK = ["id", "x0", "y0", "x1", "y1", "text", "confidence"]


def _blocks(df: DataFrame) -> DataFrame:
    """Blocks with a text and a box, as doubles."""
    box = ["x0", "y0", "x1", "y1"]
    d = df.withColumn("text", F.trim(F.regexp_replace(blank(F.col("text")), f"^{SPACE_CHAR}+|{SPACE_CHAR}+$", ""))).filter("text <> ''").dropna(subset=box)
    return d.withColumns({c: F.col(c).cast("double") for c in box} | {"confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), "id": F.col("id").cast("long")})


def _by_page(blocks: DataFrame, doc: str, fold, made: str) -> DataFrame:
    centre = (F.col("y0") + F.col("y1")) / 2
    return in_order(_blocks(blocks), [doc, "page"], [centre, F.col("x0"), F.col("id")], _BLOCK, lambda group: fold(Block(*b) for b in group), made)


def ocr_rows(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, page, row, place, id, ...): blocks(doc, page, id, x0, y0, x1, y1, text, confidence) in visual rows, left to right.

    Blocks come in order of their centre; each joins the best of the last four
    rows by overlap with the row's median extent, then by distance to its median
    centre, if it overlaps by 0.35 or lies within 8. Ties go to the earlier row.
    """

    def fold(page: Iterator[Block]) -> Iterator[tuple]:
        for i, row in enumerate(rows_of_blocks(page)):
            for place, b in enumerate(row):
                yield (i, place, *b)

    return _by_page(blocks, doc, fold, "row int, place int, id long, x0 double, y0 double, x1 double, y1 double, text string, confidence double")


def reading_rows(blocks: DataFrame, doc: str, tolerance: float = 0.6, gap: str = "  ") -> DataFrame:
    """(doc, page, row, text): rows of a photographed pack.

    A block joins the row before if their centres differ by at most the
    tolerance times the larger height; a row's centre and height are the running
    means of its blocks, so the band doesn't drift.
    """

    def fold(page: Iterator[Block]) -> Iterator[tuple]:
        number, row, centre, height = 0, [], 0.0, 0.0
        text = lambda: gap.join(b.text for b in sorted(row, key=lambda b: b.x0))
        for b in page:
            own = b.y1 - b.y0
            if own <= 0:
                continue
            if row and abs(b.centre - centre) <= tolerance * max(own, height):
                row.append(b)
                n = len(row)
                centre, height = (centre * (n - 1) + b.centre) / n, (height * (n - 1) + own) / n
                continue
            if row:
                yield number, text()
                number += 1
            row, centre, height = [b], b.centre, own
        if row:
            yield number, text()

    centre = (F.col("y0") + F.col("y1")) / 2
    return in_order(_blocks(blocks), [doc, "page"], [centre, F.col("id")], _BLOCK, lambda group: fold(Block(*b) for b in group), "row int, text string")


def boilerplate(text: str) -> bool:
    """A page number, or a printer's or publisher's line."""
    t = fold_ascii(text)
    return ("page" in t and " of " in f" {t} " and len(t) < 25) or "printed by the manager" in t or "published by the controller" in t


SHORT, ROW_GAP = 80, 24.0


def ocr_paragraphs(blocks: DataFrame, doc: str, consumed: DataFrame | None = None) -> DataFrame:
    """(doc, page, paragraph, text, confidence) of the blocks that no table of ``consumed`` (doc, page, id) has taken.

    Rows are formed as in ``ocr_rows``. Empty and boilerplate rows don't count.
    A gap of more than 24 and of 1.3 times the height of the row before ends a
    paragraph; a short row in capitals or with a colon at its end is one by
    itself. Confidence is the mean of the blocks.
    """
    left = blocks if consumed is None else blocks.join(consumed.select(doc, "page", "id").distinct(), [doc, "page", "id"], "left_anti")

    def parts(page: Iterator[Block]) -> Iterator[list[Block]]:
        held, bottom, height = [], None, 0.0
        for row in rows_of_blocks(page):
            text = " ".join(b.text for b in row).strip()
            if not text or boilerplate(text):
                continue
            alone = len(text) <= SHORT and (text.isupper() or text.endswith(":"))
            if held and (alone or min(b.y0 for b in row) - bottom > max(ROW_GAP, 1.3 * height)):
                yield held
                held = []
            if alone:
                yield row
            else:
                held += row
            bottom, height = max(b.y1 for b in row), median(b.height for b in row)
        if held:
            yield held

    def fold(page: Iterator[Block]) -> Iterator[tuple]:
        number = 0
        for part in parts(page):
            text = " ".join(b.text for b in part).strip()
            if not boilerplate(text):
                yield number, text, sum(b.confidence for b in part) / len(part)
                number += 1

    return _by_page(left, doc, fold, "paragraph int, text string, confidence double")


HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$")


def chunks_of(markdown: str, soft: int) -> Iterator[tuple[list[str], int, str]]:
    """(heading path, number of blocks, text) of each chunk."""
    path: dict[int, str] = {}
    held: list[str] = []
    where: list[str] = []
    size = 0
    for block in filter(None, (b.strip() for b in re.split(r"\n[ \t]*\n+", markdown))):
        head = HEADING.match(block) if len(block.splitlines()) == 1 else None
        # a separator of two characters comes before every block but the first
        if held and (head and len(head[1]) <= 2 or size + 2 + len(block) > soft):
            yield where, len(held), "\n\n".join(held)
            held, size = [], 0
        if head:
            path = {k: v for k, v in path.items() if k < len(head[1])} | {len(head[1]): head[2].strip()}
        if not held:
            where = [path[k] for k in sorted(path)]
        size += len(block) + (2 if held else 0)
        held.append(block)
        if size >= soft:
            yield where, len(held), "\n\n".join(held)
            held, size = [], 0
    if held:
        yield where, len(held), "\n\n".join(held)


def chunk_markdown(docs: DataFrame, doc: str, soft: int = 4000) -> DataFrame:
    """(doc, chunk, path, blocks, chars, text): blocks packed up to a soft size under their headings.

    Headings of the first two levels begin a chunk. A chunk that reaches the soft
    size is closed, so a large block stands alone. Only blocks of one line are
    headings; hashes at their end don't count.
    """
    if soft < 1:
        raise ValueError("the size of a chunk must be positive")
    kinds = T.StructType([docs.schema[doc], *T._parse_datatype_string("chunk int, path string, blocks int, chars int, text string").fields])
    arrow = to_arrow_schema(kinds)

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(key, i, " > ".join(p), n, len(t), t) for i, (p, n, t) in enumerate(chunks_of(text or "", soft))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return docs.select(doc, "text").mapInArrow(run, kinds)


def coverage(rects: DataFrame, key: list[str]) -> DataFrame:
    """(key..., area): area of the union of rectangles, by slabs between neighbouring x edges.

    Each slab's covered height is a merge of intervals (gaps and islands), so a
    page's rectangles are compared by joins and windows, not one by one.
    """
    edges = rects.select(*key, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    w = Window.partitionBy(*key).orderBy("x")
    slabs = edges.withColumn("to", F.lead("x").over(w)).filter("to > x")
    inside = slabs.join(rects, key).filter((F.col("x0") <= F.col("x")) & (F.col("x1") >= F.col("to")))
    v = Window.partitionBy(*key, "x").orderBy("y0", "y1")
    reach = F.max("y1").over(v.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.col("y1") - F.greatest(F.coalesce(reach, F.col("y0")), F.col("y0")), F.lit(0.0))
    return inside.withColumn("gain", gain * (F.col("to") - F.col("x"))).groupBy(*key).agg(F.sum("gain").alias("area"))


def blocks_in_tables(blocks: DataFrame, tables: DataFrame, key: list[str], share: float = 0.35) -> DataFrame:
    """blocks with ``in_table``: whether a table of the page covers enough of them."""
    t = tables.select(*key, *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = F.least("x1", "t_x1") - F.greatest("x0", "t_x0")
    high = F.least("y1", "t_y1") - F.greatest("y0", "t_y0")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    hit = F.when((wide > 0) & (high > 0), wide * high >= share * area).otherwise(False)
    return blocks.join(t, key, "left").groupBy(*blocks.columns).agg(F.max(F.coalesce(hit, F.lit(False))).alias("in_table"))


def continued_tables(tables: DataFrame, doc: str, tolerance: float = 25.0) -> DataFrame:
    """tables(doc, page, starts array<double>) with ``continues``: the next page's first row starts where this header does."""
    w = Window.partitionBy(doc).orderBy("page")
    nxt, page = F.lead("starts").over(w), F.lead("page").over(w)
    close = F.forall(F.zip_with("starts", nxt, lambda a, b: F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))), lambda x: x)
    return tables.withColumn("continues", F.coalesce((page == F.col("page") + 1) & close, F.lit(False)))


def aligned_columns(lines: DataFrame, key: list[str], tolerance: float = 14.0, rows: int = 3) -> DataFrame:
    """(key..., x, n): starts of text that several lines of a page share: a table without a grid."""
    reach = round(tolerance * 1000)
    near = Window.partitionBy(*key).orderBy((F.col("x0") * 1000).cast("long")).rangeBetween(-reach, reach)
    d = lines.withColumn("n", F.count(F.lit(1)).over(near)).filter(F.col("n") >= rows)
    step = Window.partitionBy(*key).orderBy("x0")
    new = F.coalesce(F.col("x0") - F.lag("x0").over(step) > tolerance, F.lit(True)).cast("int")
    d = d.withColumn("new", new).withColumn("g", F.sum("new").over(step))
    return d.groupBy(*key, "g").agg(F.min("x0").alias("x"), F.count(F.lit(1)).alias("n")).drop("g")


def selected_pages(n: Column) -> Column:
    return F.array_distinct(F.filter(F.array(F.lit(0), F.lit(1), n - 1), lambda i: (i >= 0) & (i < n)))


class Archetype(NamedTuple):
    """A kind of table: groups of alternative names of its columns, those it needs and those it may have."""

    name: str
    required: tuple[tuple[str, ...], ...]
    optional: tuple[tuple[str, ...], ...] = ()


#: Resemblance of names, share of required groups, their least number, ASCII share, and weights of the score.
ALIKE, NEEDED, LEAST, ASCII_SHARE, WEIGHTS = 0.78, 0.75, 2, 0.85, (0.85, 0.15)


def archetypes_of(rows: DataFrame) -> list[Archetype]:
    """Archetypes of a table(archetype, position, part, nth, names array<string>) written by hand; ``part`` is required or optional."""
    out: dict[tuple, dict[str, list]] = {}
    for r in rows.orderBy("position", "archetype", "part", "nth").collect():  # some tens of rows an archetype
        out.setdefault((r.position, r.archetype), {"required": [], "optional": []})[r.part].append(tuple(r.names))
    return [Archetype(name, tuple(g["required"]), tuple(g["optional"])) for (_, name), g in out.items()]


def _cell_words(cell: str | None) -> str:
    return " ".join(re.findall("[a-z0-9]+", (cell or "").casefold()))


@lru_cache(maxsize=1 << 16)
def _cell_fits(cell: str, names: tuple[str, ...]) -> bool:
    """Whether a cell equals a name, holds or is held by one, or resembles one; the last two only beyond four letters."""
    a = _cell_words(cell)
    for b in map(_cell_words, names):
        if a and a == b:
            return True
        if len(a) > 4 and len(b) > 4 and (b in a or a in b or SequenceMatcher(None, a, b).ratio() >= ALIKE):
            return True
    return False


def _assigned(cells: list[str], groups: tuple[tuple[str, ...], ...], used: set[str]) -> list[str]:
    """The first unused cell that fits each group, in the order of the groups; each is then used."""
    taken = []
    for names in groups:
        cell = next((c for c in cells if c not in used and _cell_fits(c, names)), None)
        if cell is not None:
            used.add(cell)
            taken.append(cell)
    return taken


def best_archetype(cells: list[str], archetypes: list[Archetype]) -> tuple | None:
    """(name, score, required ratio, optional ratio, matched cells) of the archetype a header fits best, if it fits any."""
    whole = " ".join(cells)
    if len(cells) < 2 or whole and sum(c < "\x80" for c in whole) / len(whole) < ASCII_SHARE:
        return None
    found = []
    for i, a in enumerate(archetypes):
        used: set[str] = set()
        matched = _assigned(cells, a.required, used)
        ratio = len(matched) / len(a.required) if a.required else 0.0
        if ratio < NEEDED or len(matched) < LEAST:
            continue
        more = len(_assigned(cells, a.optional, used)) / len(a.optional) if a.optional else 0.0
        score = round(WEIGHTS[0] * ratio + WEIGHTS[1] * more, 3)
        found.append(((round(ratio, 3), score, len(matched), -i), (a.name, score, round(ratio, 3), round(more, 3), matched)))
    return max(found)[1] if found else None


def header_archetypes(headers: DataFrame, archetypes: list[Archetype], key: str = "table_id") -> DataFrame:
    """headers(key, cells array<string>) with archetype, score, required, optional and matched cells; nulls where none fits.

    A header cell fills one group: required groups are served first, then
    optional ones, each by the first cell left. An archetype counts if three
    quarters of its required groups and at least two are filled. The best has the
    highest required ratio, then score, then number of matched groups; of equals
    the one named first. Null cells are empty.
    """
    kinds = T.StructType([headers.schema[key], *T._parse_datatype_string("archetype string, score double, required double, optional double, matched array<string>").fields])
    arrow = to_arrow_schema(kinds)

    def run(batches):
        known: dict[tuple, tuple] = {}  # headers repeat
        for batch in batches:
            rows = []
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                header = tuple(c or "" for c in cells or [])
                if header not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[header] = best_archetype(list(header), archetypes) or (None,) * 5
                rows.append((k, *known[header]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return headers.select(key, "cells").mapInArrow(run, kinds)


def has_grid(drawings: DataFrame, key: list[str]) -> DataFrame:
    """(key..., grid) of drawings(key..., kind, x0, y0, x1, y1): whether a page has two horizontal and two vertical rules.

    A line counts if it is straight within 1.5 and at least 25 wide or 12 high; a rectangle has two of each.
    """
    wide, high = F.abs(F.col("x0") - F.col("x1")), F.abs(F.col("y0") - F.col("y1"))
    line, box = F.col("kind") == "l", F.col("kind") == "re"
    rules = F.when(line & (high <= 1.5) & (wide >= 25), F.array(F.bround((F.col("y0") + F.col("y1")) / 2))).when(box, F.array(F.bround("y0"), F.bround("y1")))
    bars = F.when(line & ~((high <= 1.5) & (wide >= 25)) & (wide <= 1.5) & (high >= 12), F.array(F.bround((F.col("x0") + F.col("x1")) / 2))).when(box, F.array(F.bround("x0"), F.bround("x1")))
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    return drawings.groupBy(*key).agg(((distinct(rules) >= 2) & (distinct(bars) >= 2)).alias("grid"))


def text_table(words: DataFrame, key: list[str], gap: float = 18.0, tolerance: float = 14.0, rows: int = 3, height: float = 24.0) -> DataFrame:
    """(key..., y0, y1, n): where words(key..., line, x0, y0, x1, y1) stand in columns without rules.

    A line has columns if a gap parts its words; it is a row if the first two
    columns of another line of the page start within the tolerance.
    """
    order = Window.partitionBy(*key, "line").orderBy("x0", "x1")
    right = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = words.withColumn("start", F.when(right.isNull() | (F.col("x0") - right >= gap), F.col("x0")))
    ends = [F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    lines = starts.groupBy(*key, "line").agg(F.slice(F.array_sort(F.collect_list("start")), 1, 2).alias("s"), *ends).filter(F.size("s") >= 2)
    page = lines.groupBy(*key).agg(F.collect_list(F.struct("line", "s", "y0", "y1")).alias("lines"))  # lines of one page
    near = lambda a, b: (a["line"] != b["line"]) & (F.abs(a["s"][0] - b["s"][0]) <= tolerance) & (F.abs(a["s"][1] - b["s"][1]) <= tolerance)
    kept = page.withColumn("lines", F.filter("lines", lambda a: F.exists("lines", lambda b: near(a, b))))
    out = kept.select(*key, F.array_min(F.transform("lines", lambda x: x["y0"])).alias("y0"), F.array_max(F.transform("lines", lambda x: x["y1"])).alias("y1"), F.size("lines").cast("long").alias("n"))
    return out.filter((F.col("n") >= rows) & (F.col("y1") - F.col("y0") >= height))
