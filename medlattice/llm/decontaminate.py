"""Benchmark decontamination by winnowing.

Both sides keep the smallest hash of ``GRAM`` words in every ``SPAN - GRAM + 1``
consecutive grams, so any shared run of SPAN words shares a kept hash. Documents
meet the items' kept hashes within their own task, and each hit is extended word
by word in both directions; runs of SPAN words or more count. An item of fewer
words is one window and is looked up by the hash of all its words.

Items of up to SEND_BLOCKS blocks of ``BLOCK_MB`` of text are sent with the tasks, a
pass within the same stage for each. A larger benchmark stays on the executors:
documents emit the windows around fingerprints that a filter lets pass, and
windows of both sides are joined; work grows with the places that are found.

Defined results: null or empty texts and items have no words, so no window and
no hit. Items with equal texts all count; a null item id is an item of its own,
which lists name as null. Repeated rows are judged alike.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, annotate, narrow, table
from .words import ALNUM, Block, blocks, gram_hashes, mix, sliding_min

SPAN, GRAM, BLOCK_MB, SEND_BLOCKS = 10, 5, 32, 2


def _kept(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are the smallest of some ``width`` consecutive ones."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = sliding_min(grams, width)
    # the largest of the windows' minima around a gram equals it exactly if it's kept
    pad = np.concatenate([np.zeros(width - 1, low.dtype), low, np.zeros(width - 1, low.dtype)])
    return np.flatnonzero(~sliding_min(~pad, width) == grams)


class ItemIndex:
    """Words and kept hashes of a block of items."""

    def __init__(self, ids: list[str | None], texts: list[str | None], span: int = SPAN, gram: int = GRAM):
        data = [(t or "").encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        block = Block(np.frombuffer(b"".join(data), np.uint8), offsets, ALNUM, True)
        self.span, self.gram, self.ids = span, gram, ids
        self.words, self.first = block.hashes, block.first
        lengths = np.diff(block.first)
        prints, places, short = [], [], {}
        for i, n in enumerate(lengths):
            own = self.words[block.first[i] : block.first[i + 1]]
            if n >= span:
                g = gram_hashes(own, gram)
                at = _kept(g, span - gram + 1)
                prints.append(g[at])
                places.append(at + block.first[i])
            elif n:
                short.setdefault(int(n), []).append((gram_hashes(own, int(n))[0], i))
        self.prints = np.concatenate([np.zeros(0, np.uint64), *prints])
        self.places = np.concatenate([np.zeros(0, np.int64), *places])
        order = np.argsort(self.prints, kind="stable")
        self.prints, self.places = self.prints[order], self.places[order]
        self.owner = np.repeat(np.arange(len(ids)), lengths)
        self.short = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)])) for n, x in short.items()}
        self.maybe = {n: self._filter(h) for n, h in [(0, self.prints), *((n, h) for n, (h, _) in self.short.items())]}

    @staticmethod
    def _filter(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 16, bool)
        out[(hashes >> np.uint64(48)).astype(np.int64)] = True
        return out

    def _lookup(self, at: np.ndarray, grams: np.ndarray, hashes: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index into hashes) for every pair that agrees."""
        at = at[maybe[(grams[at] >> np.uint64(48)).astype(np.int64)]]
        lo, hi = (np.searchsorted(hashes, grams[at], side) for side in ("left", "right"))
        count = hi - lo
        start = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(lo) else lo, count)
        return np.repeat(at, count), start + np.arange(count.sum())

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs (first word, end word, item) of the block's documents; words are numbered over the block."""
        h, n = block.hashes, len(block.starts)
        owner = np.repeat(np.arange(len(block.offsets) - 1), np.diff(block.first))
        out = []
        if len(self.prints) and n >= self.span:
            grams = gram_hashes(h, self.gram)
            p, k = self._lookup(_kept(grams, self.span - self.gram + 1), grams, self.prints, self.maybe[0])
            j = self.places[k]
            good = p + self.gram <= block.first[owner[p] + 1]
            for x in range(self.gram):
                good[good] = h[p[good] + x] == self.words[j[good] + x]
            p, j = p[good], j[good]
            item = self.owner[j]
            a, b = p.copy(), p + self.gram
            left, right = block.first[owner[p]], block.first[owner[p] + 1]
            ileft, iright = self.first[item], self.first[item + 1]
            live = np.arange(len(p))
            while len(live):
                x, y = a[live] - 1, j[live] - (p[live] - a[live]) - 1
                ok = (x >= left[live]) & (y >= ileft[live])
                ok[ok] = h[x[ok]] == self.words[y[ok]]
                live = live[ok]
                a[live] -= 1
            live = np.arange(len(p))
            while len(live):
                x, y = b[live], j[live] + (b[live] - p[live])
                ok = (x < right[live]) & (y < iright[live])
                ok[ok] = h[x[ok]] == self.words[y[ok]]
                live = live[ok]
                b[live] += 1
            long = b - a >= self.span
            out.append((a[long], b[long], item[long]))
        for size, (hashes, items) in self.short.items():
            if n >= size:
                grams = gram_hashes(h, size)
                p, k = self._lookup(np.arange(len(grams)), grams, hashes, self.maybe[size])
                good = p + size <= block.first[owner[p] + 1] if len(p) else np.zeros(0, bool)
                out.append((p[good], p[good] + size, items[k[good]]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


RESULT = "n_words bigint, hit_spans array<struct<a:bigint,b:bigint>>, hit_items array<string>"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _pass(docs: DataFrame, ids: list[str | None], texts: list[str], text: str, before: bool) -> DataFrame:
    """docs with the hits of a block of items, added to those of earlier blocks."""
    token = uuid.uuid4().hex  # workers outlive a pass, and other items may have the same ids

    def run(batch, text):
        if _pass.cache.get("token") != token:
            _pass.cache |= {"index": ItemIndex(ids, texts), "token": token}
        index = _pass.cache["index"]
        n_words, spans, items = [], [], []
        old = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit_spans", "hit_items")] if before else None
        for lo, hi, block in blocks(batch, ALNUM, True, text):
            a, b, item = index.hits(block)
            doc = np.searchsorted(block.first, a, "right") - 1
            doc = np.minimum(doc, hi - lo - 1)
            order = np.lexsort((b, a, doc))
            cut = np.searchsorted(doc[order], np.arange(hi - lo + 1))
            for i in range(hi - lo):
                own = order[cut[i] : cut[i + 1]]
                s = [{"a": x - int(block.first[i]), "b": y - int(block.first[i])} for x, y in sorted(set(zip(a[own].tolist(), b[own].tolist(), strict=True)))] if len(own) else []
                t = {index.ids[k] for k in item[own]}
                if before:
                    s, t = old[0][lo + i] + s, t.union(old[1][lo + i])
                spans.append(s)
                items.append(sorted(t, key=lambda x: (x is not None, x or "")))
            n_words.append(np.diff(block.first).astype(np.int64))
        return {"n_words": pa.array(np.concatenate([np.zeros(0, np.int64), *n_words])), "hit_spans": pa.array(spans, _SPANS), "hit_items": pa.array(items, pa.list_(pa.string()))}

    return annotate(docs, run, RESULT, text, ("hit_spans", "hit_items") if before else ())


_pass.cache = {}


#: Bits of the filter of item fingerprints that tasks get of a large benchmark, whatever its size (8 MB).
FILTER_BITS = 26
#: Texts with hits, and their spans, that are sent to all tasks; more are met by a shuffle join.
SEND_TEXTS, SEND_SPANS = 200_000, 2_000_000
_SECOND = np.uint64(0xA0761D6478BD642F)
_WINDOW = "n int, wa long, wb long"
_DIGEST = lambda c: F.sha2(F.to_json(c), 256)


def _second(hashes: np.ndarray) -> np.ndarray:
    """Words' hashes for the other half of a window's 128 bits."""
    return mix(hashes ^ _SECOND)


def _item_windows(batches, span: int = SPAN):
    """(item, n, wa, wb): the distinct windows of items(item, t); an item of fewer words is one window."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for lo, hi, block in blocks(batch, ALNUM, True, "t"):
            for i in range(lo, hi):
                own = block.hashes[block.first[i - lo] : block.first[i - lo + 1]]
                n = min(span, len(own))
                if n:
                    pairs = np.unique(np.stack([gram_hashes(own, n), gram_hashes(_second(own), n)], 1), axis=0).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i]] * len(pairs)), pa.array(np.full(len(pairs), n, np.int32)), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["item", "n", "wa", "wb"])


def _item_prints(batches, span: int = SPAN, gram: int = GRAM):
    """(print): kept fingerprints of items, and the hashes of all words of those that are shorter than a window."""
    for batch in batches:
        for lo, hi, block in blocks(batch, ALNUM, True, "t"):
            out = [np.zeros(0, np.uint64)]
            for i in range(hi - lo):
                own = block.hashes[block.first[i] : block.first[i + 1]]
                if len(own) >= span:
                    g = gram_hashes(own, gram)
                    out.append(g[_kept(g, span - gram + 1)])
                elif len(own):
                    out.append(gram_hashes(own, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)).view(np.int64))], names=["print"])


def _filter_of(prints: DataFrame) -> np.ndarray:
    """The leading bits of the prints that occur, ored word by word on the executors; 2 ** FILTER_BITS bits in all."""
    at = F.shiftrightunsigned("print", 64 - FILTER_BITS)
    ored = prints.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in ored.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r.word] = r.bits
    return out.view(np.uint64)


def _passes(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _candidates(known, lengths: list[int], span: int = SPAN, gram: int = GRAM):
    """(a, b, at, n, wa, wb) of rows (a, b, text): the windows around kept fingerprints that the items may have, and short runs likewise."""

    def run(batches):
        maybe = known.value
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, _, block in blocks(batch, ALNUM, True):
                h = block.hashes
                other = _second(h)
                owner = np.repeat(np.arange(len(block.offsets) - 1), np.diff(block.first))
                for n in [span, *lengths]:
                    if len(h) < n:
                        continue
                    wa = gram_hashes(h, n)
                    if n == span:
                        grams = gram_hashes(h, gram)
                        p = _kept(grams, span - gram + 1)
                        p = p[_passes(maybe, grams[p])]
                        s = np.unique((p[:, None] - np.arange(span - gram + 1)).ravel())
                        s = s[(s >= 0) & (s < len(wa))]
                    else:
                        s = np.flatnonzero(_passes(maybe, wa))
                    s = s[s + n <= block.first[owner[s] + 1]]
                    if len(s):
                        doc, wb = owner[s], gram_hashes(other, n)
                        columns = [a[lo + doc], b[lo + doc], s - block.first[doc], np.full(len(s), n, np.int32), wa[s].view(np.int64), wb[s].view(np.int64)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "at", "n", "wa", "wb"])

    return run


def _by_join(docs: DataFrame, items: DataFrame, text: str, staged: Staged) -> DataFrame:
    """docs with hits, for a benchmark that is too large to be sent.

    Windows of both sides are joined by 128 bits of hash, so a phrase of fewer
    words that many texts share joins nothing. Documents emit only windows around
    kept fingerprints that pass a filter of fixed size. Each distinct window is one
    row on the items' side, so a passage that a third of all documents and items
    share makes one row for each place in a document. The items of a window come
    last: windows with the same items form a class, texts with the same classes
    one set, and items are gathered once a set.
    """
    spark = docs.sparkSession
    # items of equal texts are one; ids are kept in structs, so that a null id is one of them
    rows = items.filter("length(t) > 0").groupBy("t").agg(F.sort_array(F.collect_set(F.struct("id"))).alias("ids"))
    rows = staged.write(rows.select("t", "ids", F.monotonically_increasing_id().alias("item")))
    windows = rows.select("item", "t").mapInArrow(_item_windows, f"item long, {_WINDOW}")
    # a window's items as one sorted list, and a class for each distinct list
    listed = windows.groupBy("n", "wa", "wb").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = staged.write(listed.withColumn("class", _DIGEST(F.struct("items"))))
    classes = staged.write(listed.groupBy("class").agg(F.first("items").alias("items")))
    lengths = sorted(r[0] for r in listed.select("n").distinct().collect() if r[0] < SPAN)  # at most SPAN - 1
    known = spark.sparkContext.broadcast(_filter_of(rows.select("t").mapInArrow(_item_prints, "print long")))

    keyed = docs.withColumn("_a", F.when(F.length(text) > 0, F.xxhash64(text))).withColumn("_b", F.xxhash64(F.lit(1), text))
    texts = keyed.filter("_a is not null").select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col(f"`{text}`").alias("text"))
    found = texts.mapInArrow(_candidates(known, lengths), f"a long, b long, at long, {_WINDOW}").distinct()
    hits = staged.write(found.join(listed.select("n", "wa", "wb", "class"), ["n", "wa", "wb"]).select("a", "b", "at", "n", "class"))
    spans = F.sort_array(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b"))))
    per_text = hits.groupBy("a", "b").agg(spans.alias("hit_spans"), F.sort_array(F.collect_set("class")).alias("classes"))
    per_text = staged.write(per_text.withColumn("set", _DIGEST(F.struct("classes"))))
    sets = per_text.groupBy("set").agg(F.first("classes").alias("classes"))
    gathered = sets.select("set", F.explode("classes").alias("class")).join(classes, "class").select("set", F.explode("items").alias("item")).distinct()
    named = gathered.join(rows.select("item", "ids"), "item").select("set", F.explode("ids").alias("id")).distinct()
    named = named.groupBy("set").agg(F.transform(F.sort_array(F.collect_list("id")), lambda x: x["id"]).alias("hit_items"))
    merged = staged.write(per_text.join(named, "set").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "hit_spans", "hit_items"))
    size = merged.agg(F.count(F.lit(1)), F.sum(F.size("hit_spans") + F.size("hit_items"))).first()
    small = size[0] <= SEND_TEXTS and (size[1] or 0) <= SEND_SPANS

    made = {"n_words", "hit_spans", "hit_items"}
    kept = [c for c in docs.columns if c.lower() not in made]
    plain = keyed.select(*[F.col(f"`{c}`") for c in kept], F.size(_words(text)).cast("long").alias("n_words"), "_a", "_b")
    none = "cast(array() as array<struct<a:bigint,b:bigint>>)"
    out = plain.join(F.broadcast(merged) if small else merged, ["_a", "_b"], "left")
    return out.select(*[F.col(f"`{c}`") for c in kept], "n_words", F.coalesce("hit_spans", F.expr(none)).alias("hit_spans"), F.coalesce("hit_items", F.expr("cast(array() as array<string>)")).alias("hit_items"))


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_mb: float = BLOCK_MB, send_blocks: int = SEND_BLOCKS) -> DataFrame:
    """docs with ``n_words``, ``hit_spans`` (runs of words, ends excluded) and ``hit_items`` (sorted ids)."""
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-size // int(block_mb * 1e6)))
    if count > send_blocks:
        return _by_join(docs, items, text, Staged(docs.sparkSession, "decontaminate"))
    out = docs
    for k in range(count):
        rows = sorted(((r["id"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(count)) == k).collect() if r["t"]), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        out = _pass(out, [r[0] for r in rows], [r[1] for r in rows], text, k > 0)
    return out


def hit_count(spans: str = "hit_spans"):
    """Words inside at least one span; spans are sorted within a pass only, so they are sorted here."""
    step = "named_struct('end', greatest(s.end, x.b), 'n', s.n + greatest(x.b - greatest(x.a, s.end), 0L))"
    return F.expr(f"aggregate(array_sort({spans}), named_struct('end', 0L, 'n', 0L), (s, x) -> {step}, s -> s.n)")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", hit_count().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k+9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(ws[k:k+n-1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
