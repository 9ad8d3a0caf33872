"""Substring dedup by compressed FM-indexes, one per shard.

A window is WINDOW consecutive words of one document; a word goes if a window
over it also starts in a document with a smaller id.

1. Every window has an anchor, the smallest hash of its GRAM-word runs; equal
   windows have equal anchors. Windows whose anchor only one document has can't
   repeat and are left out.
2. A run of windows with one anchor is a segment, and its anchor names its shard.
   Of the windows of all segments only first occurrences are worth indexing: a
   segment goes into its shard's FM-index if its document is the smallest of at
   least one repeated window. A shard with many segments is read in parts, each
   of which offers its own first ones; what the parts offer is read again in
   fewer parts, so a passage of a third of all documents is indexed once.
3. All segments are streamed backwards through their shard's index. Matching
   statistics of WINDOW words or more, with an owner smaller than the segment's
   document, are intervals to remove. Shards with many segments are searched by
   several tasks, each with the shard's index.
4. A document's intervals are united and cut from its text.

Defined results: null and wordless texts have no words and an empty digest.
Repeats within a document stay. Documents of equal ids don't remove each
other's words; a null id removes nothing and loses nothing.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, annotate, narrow, table
from .fm_index import FMIndex
from .words import Block, U, blocks, gram_hashes, signed, sliding_min

WINDOW, GRAM = 50, 8
#: Words of one FM-index, segments of a shard on average and of one task at most, and documents or anchors that are sent to all tasks.
INDEX_WORDS, SHARD_SEGMENTS, TASK_SEGMENTS, SEND_DOCS, SEND_ANCHORS = 150_000, 8_000, 20_000, 200_000, 3_000_000
#: Patterns searched in lock-step, and windows of one; longer segments are searched in overlapping pieces.
LANES, PIECE = 8000, 96


def _anchors(block: Block, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, anchor) of every window of the block."""
    grams = block.grams(gram)
    low = sliding_min(grams, window - gram + 1)
    owner = np.repeat(np.arange(len(block.offsets) - 1), np.diff(block.first))
    at = np.flatnonzero(owner[: len(low)] == owner[window - 1 :]) if len(low) else np.zeros(0, np.int64)
    return owner[at], at, low[at]


def _document_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, block in blocks(batch):
                doc, _, anchor = _anchors(block, window, gram)
                if len(doc):
                    new = np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))
                    pair = np.unique(np.rec.fromarrays([doc[new], anchor[new]]))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(pair.f1))), pa.array(ids[lo:hi][pair.f0])], names=["anchor", "doc_id"])

    return docs.mapInArrow(run, "anchor long, doc_id long")


def _segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, doc_id, start, windows, words) of docs(doc_id, text, anchors); words joined by one space."""

    def run(batches):
        for batch in batches:
            ids, shared = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            for lo, hi, block in blocks(batch):
                doc, at, anchor = _anchors(block, window, gram)
                if not len(doc):
                    continue
                cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])))
                size = np.diff(np.append(cut, len(doc)))
                own, start, name = doc[cut], at[cut], signed(anchor[cut])
                bounds = np.searchsorted(own, np.arange(hi - lo + 1))
                keep = np.zeros(len(cut), bool)
                for i in range(hi - lo):
                    a, b = bounds[i], bounds[i + 1]
                    keep[a:b] = np.isin(name[a:b], np.array(shared[lo + i], np.int64))
                rows = np.flatnonzero(keep)
                text = [b" ".join(block.bytes_of(s, e) for s, e in zip(block.starts[k : k + n + window - 1].tolist(), block.ends[k : k + n + window - 1].tolist(), strict=True)) for k, n in zip(start[rows].tolist(), size[rows].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(name[rows]), pa.array(ids[lo:hi][own[rows]]), pa.array((start[rows] - block.first[own[rows]]).astype(np.int32)), pa.array(size[rows].astype(np.int32)), pa.array(text, pa.binary())], names=["anchor", "doc_id", "start", "windows", "words"])

    return docs.mapInArrow(run, "anchor long, doc_id long, start int, windows int, words binary")


def _block(words: list[bytes]) -> Block:
    data = b"\n".join(words)
    offsets = np.cumsum([0, *(len(w) + 1 for w in words)])
    offsets[-1] = len(data)
    return Block(np.frombuffer(data, np.uint8), offsets.astype(np.int64))


def _hashes(words: list[bytes]) -> list[np.ndarray]:
    block = _block(words)
    return [block.hashes[a:b] for a, b in zip(block.first[:-1], block.first[1:], strict=True)]


def _groups(batches, columns: int):
    """(key, rows) of runs of rows that agree in their first two columns, across batches."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
            if row[:2] != now:
                if held:
                    yield now, held
                now, held = row[:2], []
            held.append(row)
    if held:
        yield now, held


def _first_segments(rows: DataFrame, window: int) -> DataFrame:
    """(shard, doc_id, start, words, again): segments whose document is the smallest of a window, in each (shard, part) of rows.

    Equal windows have one anchor and so one shard. Where a shard is one part,
    windows of a single document are left out; ``again`` marks segments that
    hold a window which some part has seen repeat.
    """

    def run(batches):
        for (shard, _), held in _groups(batches, 7):
            block = _block([h[5] for h in held])
            sizes = np.diff(block.first)
            owner = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
            keys = gram_hashes(block.hashes, window)
            at = np.flatnonzero(owner[: len(keys)] == owner[window - 1 :])
            keys, owner = keys[at], owner[at]
            doc = np.array([h[3] for h in held], np.int64)[owner]
            order = np.lexsort((doc, keys))
            keys, owner, doc = keys[order], owner[order], doc[order]
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(begin, len(keys)))
            least = doc == np.repeat(doc[begin], size)
            repeats = least & np.repeat(doc[begin] < doc[begin + size - 1], size)
            again = np.array([h[6] for h in held], bool)
            good = repeats | least & (again[owner] | (held[0][2] > 1))
            again[owner[repeats]] = True
            chosen = np.unique(owner[good])
            for k in range(0, len(chosen), 2000):
                own = [held[i] for i in chosen[k : k + 2000]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(own), pa.int64()), pa.array([h[3] for h in own], pa.int64()), pa.array([h[4] for h in own], pa.int32()), pa.array([h[5] for h in own], pa.binary()), pa.array(again[chosen[k : k + 2000]])],
                    names=["shard", "doc_id", "start", "words", "again"],
                )

    ordered = rows.select("shard", "part", "parts", "doc_id", "start", "words", "again").repartition("shard", "part").sortWithinPartitions("shard", "part")
    return ordered.mapInArrow(run, "shard long, doc_id long, start int, words binary, again boolean")


def _in_parts(rows: DataFrame, staged: Staged, shards: int, task_segments: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows with part and parts, the table of parts, the most parts of a shard) of rows(shard, doc_id, start, ...)."""
    parts = staged.write(rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / task_segments).cast("int").alias("parts")), shards)
    dealt = rows.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.col("parts")).cast("int"))
    return dealt, parts, parts.agg(F.max("parts")).first()[0] or 0


def _indexed(stream: DataFrame, most: int, staged: Staged, shards: int, window: int, task_segments: int) -> DataFrame:
    """The segments to index: what the parts of a shard offer is read again until a shard is one part or shrinks no more."""
    offered = staged.write(_first_segments(stream.withColumn("again", F.lit(False)), window))
    while most > 1:
        dealt, _, now = _in_parts(offered, staged, shards, task_segments)
        if now >= most:
            break
        fewer = staged.write(_first_segments(dealt, window))
        staged.drop(offered)
        offered, most = fewer, now
    return offered.select("shard", "doc_id", "start", "words")


def _search(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, a, b): words to remove, by searching the stream rows of each (shard, part) in its index rows."""

    def search(indexes, held):
        if not indexes or not held:
            return None
        # equal segments of several documents are searched once
        number: dict[bytes, int] = {}
        which = [number.setdefault(h[2], len(number)) for h in held]
        words = _hashes(list(number))
        pieces, place = [], []
        for k, w in enumerate(words):
            for a in range(0, len(w) - window + 1, PIECE):
                pieces.append(w[a : a + PIECE + window - 1])
                place.append((k, a))
        best = [np.full(len(w), np.iinfo(np.int64).max) for w in words]
        for fm in indexes:
            for (k, a), own in zip(place, fm.smallest_owners(pieces), strict=True):
                n = min(PIECE, len(own))
                np.minimum(best[k][a : a + n], own[:n], out=best[k][a : a + n])
        docs, begins, ends = [], [], []
        for (doc, start, _), own in zip(held, (best[k] for k in which), strict=True):
            hit = np.flatnonzero(own < doc)
            if len(hit):
                gap = np.flatnonzero(np.diff(hit) > window)
                a, b = hit[np.append(0, gap + 1)], hit[np.append(gap, len(hit) - 1)] + window
                docs += [doc] * len(a)
                begins += (a + start).tolist()
                ends += (b + start).tolist()
        if docs:
            return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "a", "b"])
        return None

    def run(batches):
        now, passages, owners, size, indexes, held = None, [], [], 0, [], []

        def build():
            nonlocal passages, owners, size
            if passages:
                indexes.append(FMIndex(_hashes(passages), owners, window))
                passages, owners, size = [], [], 0

        for batch in batches:
            for shard, part, kind, doc, start, words in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (shard, part) != now:
                    build()
                    if (out := search(indexes, held)) is not None:
                        yield out
                    now, indexes, held = (shard, part), [], []
                if kind == 0:
                    passages.append(words)
                    owners.append(doc)
                    size += words.count(b" ") + 1
                    if size >= 2 * INDEX_WORDS:
                        build()
                else:
                    build()
                    held.append((doc, start, words))
                    if len(held) >= LANES:
                        if (out := search(indexes, held)) is not None:
                            yield out
                        held = []
        build()
        if (out := search(indexes, held)) is not None:
            yield out

    ordered = rows.select("shard", "part", "kind", "doc_id", "start", "words").repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    return ordered.mapInArrow(run, "doc_id long, a int, b int")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, task_segments: int = TASK_SEGMENTS) -> DataFrame:
    """(doc_id, spans) of documents(doc_id, text) that lose words; spans are pairs of word numbers, ends excluded."""
    staged = Staged(docs.sparkSession, "substring_dedup")
    docs = docs.filter("doc_id is not null and text is not null")
    anchors = staged.write(_document_anchors(docs, window, gram))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    wanted = staged.write(anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), docs.count())
    size = wanted.agg(F.count(F.lit(1)), F.sum(F.size("anchors"))).first()
    few = size[0] <= SEND_DOCS and (size[1] or 0) <= SEND_ANCHORS
    met = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "text", "anchors")
    segments = staged.write(_segments(met, window, gram))
    staged.drop(anchors, wanted)

    shards = max(1, -(-segments.count() // SHARD_SEGMENTS))
    named = segments.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    stream, parts, most = _in_parts(named, staged, shards, task_segments)
    stream = stream.withColumn("kind", F.lit(1))
    indexed = _indexed(stream, most, staged, shards, window, task_segments)
    index = indexed.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(0))
    columns = ["shard", "part", "kind", "doc_id", "start", "words"]
    found = _search(index.select(*columns).unionByName(stream.select(*columns)), window)
    return staged.write(found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans")), size[0])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, kept_text: bool = True, task_segments: int = TASK_SEGMENTS) -> DataFrame:
    """docs(doc_id, text) with ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked for, ``kept_text``."""
    spans = repeated_spans(narrow(docs, "doc_id", "text"), window, gram, task_segments)
    few = spans.count() <= SEND_DOCS
    spans = spans.select(F.col("doc_id").alias("_doc"), F.flatten(F.transform("spans", lambda s: F.array(s["a"], s["b"]))).alias("_spans"))
    met = docs.join(F.broadcast(spans) if few else spans, docs["doc_id"] == spans["_doc"], "left").drop("_doc")

    def run(batch, text):
        cut = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
        n_words, removed, digest, kept = [], [], [], []
        for lo, hi, block in blocks(batch, text=text):
            for i in range(hi - lo):
                a, b = block.first[i], block.first[i + 1]
                words = block.bytes_of(block.offsets[i], block.offsets[i + 1]).split()
                if cut[lo + i]:
                    keep = np.ones(b - a, bool)
                    for x, y in zip(cut[lo + i][::2], cut[lo + i][1::2], strict=True):
                        keep[x:y] = False
                    words = list(compress(words, keep.tolist()))
                n_words.append(int(b - a))
                removed.append(int(b - a) - len(words))
                joined = b" ".join(words)
                digest.append(hashlib.sha256(joined).hexdigest())
                if kept_text:
                    kept.append(joined.decode())
        out = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return out | ({"kept_text": pa.array(kept, pa.string())} if kept_text else {})

    fields = "n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if kept_text else "")
    return annotate(met, run, fields, inputs=("_spans",)).drop("_spans")


def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text")
    return remove_repeats(docs, kept_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS k FROM g),
f AS (SELECT k, min(doc_id) AS first_doc FROM h GROUP BY k),
r AS (SELECT doc_id, list(i) AS starts FROM h JOIN f USING (k) WHERE first_doc < doc_id GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(list_transform(starts, lambda s: range(s, s + 50)), recursive := true) AS p FROM r),
c AS (SELECT doc_id, list(p) AS cut FROM x GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
  CASE WHEN cut IS NULL THEN ws ELSE list_filter(ws, lambda v, p: NOT list_contains(cut, p)) END AS kept FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
