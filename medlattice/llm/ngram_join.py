"""N-gram Jaccard join by signature trees.

Documents are sets of distinct 5-word shingles (64-bit hashes); two link when
their sets' Jaccard similarity is 0.75 or more. The result names every
document's component of links.

1. Equal sets form a class; its smallest document stands for it.
2. Candidates: a class keeps its SKETCH smallest hashes. Two linked classes share
   at least ``sketch_shared(n)`` of them: sets whose union fits a sketch by
   counting, larger ones but for a chance below 1e-10 (the tail of SKETCH draws
   from their union, three quarters of which are shared). With ``sketch=None`` a
   class keeps all that a linked one may lack, a quarter of its hashes, and some
   more, so they share ``least_shared(n)`` of them for certain. By the prefix
   principle they then share one of the rarest of these keys, so only keys that
   several classes have, rarest first, connect clusters. A passage that many
   documents share is never among the rarest unless it makes up about half of a
   document (a third, or some hundred words, with ``sketch=None``).
3. Within a cluster a signature tree is built over whole sets: leaves of like
   sizes, nodes with OR- and AND-combined bitmaps and size ranges. A dual
   traversal drops node pairs whose sizes or largest possible overlap rule a link
   out, and those already in one component; leaves are compared exactly.
4. A cluster of more than CHUNK classes is dealt into chunks that share pivots.
   Afterwards everything outside its largest component meets every chunk, so no
   link between different components is missed, however large the cluster is.

Defined results: null, empty and wordless texts have no shingles and stand
alone; 1 to 4 words make one shingle of all of them. Repeated rows are one
class. A null id belongs to no component.
"""

from __future__ import annotations

from math import exp, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, connected, narrow, table
from .words import Block, U, blocks, gram_hashes, mix, signed

WORDS, PERCENT, SKETCH, SPARE, CHUNK, PIVOTS, LEAF, BITS = 5, 75, 96, 32, 512, 32, 32, 2048
#: Shingles of a chunk on average; long documents make smaller chunks.
CHUNK_SHINGLES = 400_000
#: Members of clusters that are sent to the scan; more are met by a shuffle join.
SEND_ROWS = 200_000
#: Classes (32 bytes each) that are sent to the scan of kept hashes; more are met by a shuffle join.
SEND_CLASSES = 500_000


def shingle_sets(block: Block, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    grams = block.grams(words)
    out = []
    for a, b in zip(block.first[:-1], block.first[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(gram_hashes(block.hashes[a:b], int(b - a)) if b > a else np.zeros(0, U))
    return out


def _sketches(docs: DataFrame, words: int, percent: int, sketch: int | None) -> DataFrame:
    kept = (lambda n: kept_keys(n, percent)) if sketch is None else lambda n: sketch

    def run(batches):
        for batch in batches:
            for lo, hi, block in blocks(batch, lower=True):
                sets = shingle_sets(block, words)
                n = pa.array([len(s) for s in sets], pa.int64())
                h1 = pa.array(np.array([s.sum(dtype=U) if len(s) else 0 for s in sets], U).view(np.int64))
                h2 = pa.array(np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], U).view(np.int64))
                hashes = pa.array([signed(s[: kept(len(s))]) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), n, h1, h2, hashes], names=["doc_id", "n", "h1", "h2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch array<long>")


def _spare(n: int) -> int:
    return max(1, min(n // 5, SPARE))


def kept_keys(n: int, percent: int = PERCENT) -> int:
    """How many of its n hashes, smallest first, a set keeps: all that a linked set may lack, and up to SPARE more."""
    return n + (-n * percent // 100) + _spare(n)


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Fewest kept keys that a set of n shingles and a linked one share; the smallest linked set has ``percent`` of n."""
    return _spare(-(-n * percent // 100))


def sketch_shared(n: int, percent: int = PERCENT, sketch: int = SKETCH, risk: float = 1e-10) -> int:
    """Fewest keys that the sketches of a set of n shingles and a linked one share, but for the risk."""
    union, share = -(-n * 100 // percent), percent / 100
    # a union that fits the sketch has n shingles at least, and all that are shared are seen
    counted = -(-n * percent // 100) if n <= sketch else sketch
    if union <= sketch:
        return counted
    good = int(union * share)
    choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    tail = 0.0
    for x in range(max(0, sketch - (union - good)), sketch + 1):
        tail += exp(choose(good, x) + choose(union - good, sketch - x) - choose(union, sketch))
        if tail > risk:
            return max(1, min(x, counted))
    return 1


def _share(n: Column, percent: int, sketch: int) -> Column:
    """``sketch_shared`` by steps, each with the smallest value within it."""
    exact = 64
    out = F.lit(sketch_shared(1 << 30, percent, sketch))
    for end in (1 << k for k in range(16, 6, -1)):
        out = F.when(n <= end, F.lit(sketch_shared(end, percent, sketch))).otherwise(out)
    for end in range(160, exact, -8):
        out = F.when(n <= end, F.lit(min(sketch_shared(k, percent, sketch) for k in range(end - 7, end + 1)))).otherwise(out)
    return F.when(n <= exact, F.ceil(n * percent / 100)).otherwise(out)


class Tree:
    """Signature tree over sets and the components that its self-join finds."""

    def __init__(self, sets: list[np.ndarray], component: np.ndarray, percent: int = PERCENT):
        self.percent, self.component = percent, component
        size = np.array([len(s) for s in sets])
        band = np.floor(np.log(np.maximum(size, 1)) / np.log(100 / percent)).astype(int)
        low = np.array([s[0] if len(s) else 0 for s in sets], U)
        self.order = np.lexsort((size, low, band))
        self.size = size
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        bits = np.zeros((len(sets), BITS // 8), np.uint8)
        at = (mix(flat) % U(BITS)).astype(np.int64)
        np.bitwise_or.at(bits, (owner, at >> 3), (1 << (at & 7)).astype(np.uint8))
        self.bits = bits.view(np.uint64)
        _, ids, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[ids] > 1
        number = np.cumsum(count > 1) - 1
        self.ids, self.owner, self.wide = number[ids[keep]], owner[keep], int((count > 1).sum())
        self.begin = np.searchsorted(self.owner, np.arange(len(sets) + 1))
        self.dense = None
        if len(sets) * self.wide <= 1 << 24:
            self.dense = np.zeros((len(sets), self.wide), np.float32)
            self.dense[self.owner, self.ids] = 1
        # nodes: (items, or, and, smallest, largest, children)
        level = [self._node([self.order[i : i + LEAF]], None) for i in range(0, len(sets), LEAF)]
        while len(level) > 1:
            level = [self._node([x[0] for x in level[i : i + 4]], level[i : i + 4]) for i in range(0, len(level), 4)]
        self.root = level[0]

    def _node(self, parts, children):
        items = np.concatenate(parts)
        b = self.bits[items]
        return items, np.bitwise_or.reduce(b), np.bitwise_and.reduce(b), int(self.size[items].min()), int(self.size[items].max()), children

    def _inter(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[a] @ self.dense[b].T
        mine = [self.ids[self.begin[i] : self.begin[i + 1]] for i in a]
        local = np.unique(np.concatenate(mine))
        rows = []
        for group in (a, b):
            x = np.zeros((len(group), len(local) + 1), np.float32)
            for r, i in enumerate(group):
                ids = self.ids[self.begin[i] : self.begin[i + 1]]
                at = np.searchsorted(local, ids)
                at[at == len(local)] = 0
                x[r, at[local[at] == ids] if len(local) else at[:0]] = 1
            rows.append(x)
        return rows[0] @ rows[1].T

    def _possible(self, a, b) -> bool:
        p = self.percent
        if a[4] * 100 < p * b[3] or b[4] * 100 < p * a[3]:
            return False
        need = p * (a[3] + b[3]) / (100 + p)
        for x, y in ((a, b), (b, a)):
            if x[4] - int(np.bitwise_count(x[2] & ~y[1]).sum()) < need:
                return False
        own = self.component[a[0]]
        return not ((own == own[0]).all() and (self.component[b[0]] == own[0]).all())

    def join(self) -> np.ndarray:
        """Component of each set: the smallest of the given components that links reach."""
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            if not self._possible(a, b):
                continue
            if a[5] is None and b[5] is None:
                inter = self._inter(a[0], b[0])
                union = self.size[a[0]][:, None] + self.size[b[0]][None, :] - inter
                i, j = np.nonzero((100 * inter >= self.percent * union) & (self.component[a[0]][:, None] != self.component[b[0]][None, :]))
                for x, y in zip(a[0][i], b[0][j], strict=True):
                    p, q = self.component[x], self.component[y]
                    if p != q:
                        self.component[self.component == max(p, q)] = min(p, q)
            elif a is b:
                for k, x in enumerate(a[5]):
                    stack += [(x, y) for y in a[5][k:]]
            elif b[5] is None or a[5] is not None and len(a[0]) >= len(b[0]):
                stack += [(x, b) for x in a[5]]
            else:
                stack += [(a, x) for x in b[5]]
        return self.component


def _tree_join(rows: DataFrame, percent: int) -> DataFrame:
    """(doc_id, root) of each group (cluster, part) of rows(cluster, part, doc_id, component, shingles)."""

    def solve(doc_ids, components, shingles):
        ids = np.array(doc_ids, np.int64)
        comp = Tree([np.frombuffer(s, U) for s in shingles], np.array(components, np.int64), percent).join() if len(ids) > 1 else np.array(components)
        return ids, comp

    def run(batches):
        now, held = None, ([], [], [])

        def out():
            ids, comp = solve(*held)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), now[0])), pa.array(ids), pa.array(np.asarray(comp, np.int64))], names=["cluster", "doc_id", "root"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for cluster, part, doc_id, component, shingles in zip(*cols, strict=True):
                if (cluster, part) != now:
                    if held[0]:
                        yield out()
                    now, held = (cluster, part), ([], [], [])
                held[0].append(doc_id)
                held[1].append(component)
                held[2].append(shingles)
        if held[0]:
            yield out()

    ordered = rows.select("cluster", "part", "doc_id", "component", "shingles").repartition("cluster", "part").sortWithinPartitions("cluster", "part")
    return ordered.mapInArrow(run, "cluster long, doc_id long, root long")


def components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text", sketch: int | None = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    ``sketch`` hashes of a set find its candidates, but for a risk below that of
    hash collisions; None takes as many as rule that risk out.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "ngram_join")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = staged.write(_sketches(plain, words, percent, sketch))
    sets_of = every.filter("n > 0 and doc_id is not null")
    classes = staged.write(sets_of.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")))
    rows, n_keys = every.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("sketch")), F.lit(0))).first()

    # the kept hashes of each class are those of its smallest document; where that row repeats, its keys do, which widens the prefixes only
    named_by = classes.select("n", "h1", "h2", F.col("rep").alias("doc_id"))
    named_by = F.broadcast(named_by) if classes.count() <= SEND_CLASSES else named_by
    keys = sets_of.join(named_by, ["n", "h1", "h2", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), F.explode("sketch").alias("key"))
    df = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = keys.join(df, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys"))  # at most half a set
    exact = lambda n: F.greatest(F.lit(1), F.least(F.lit(SPARE), F.floor(F.ceil(n * percent / 100) / 5)))
    shared_of = exact if sketch is None else lambda n: _share(n, percent, sketch)
    size = classes.groupBy("rep").agg(F.min("n").alias("n"))
    rare = shared.join(size, "rep").withColumn("take", F.size("keys") - shared_of(F.col("n")).cast("int") + 1).filter("take > 0")
    prefix = staged.write(rare.select("rep", F.explode(F.slice("keys", F.lit(1), F.col("take"))).alias("k")).select("rep", F.col("k.key").alias("key")), n_keys)
    pivot = prefix.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = staged.write(prefix.join(pivot, "key").select(F.col("rep").alias("node"), F.col("pivot").alias("hub")).distinct(), n_keys)
    cluster = connected(edges, staged, edges.count()).withColumnRenamed("label", "cluster")
    cluster = cluster.join(size.withColumnRenamed("rep", "node"), "node")
    sizes = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    chunks = F.greatest(F.ceil(F.col("members") / chunk), F.ceil(F.col("total") / CHUNK_SHINGLES)).cast("int")
    members = staged.write(cluster.join(sizes, "cluster").filter("members > 1").select(F.col("node").alias("doc_id"), "cluster", chunks.alias("chunks"), "members", "total"), rows)
    staged.drop(prefix, edges)

    def with_sets(batches):
        for batch in batches:
            for lo, hi, block in blocks(batch, lower=True):
                sets = pa.array([s.tobytes() for s in shingle_sets(block, words)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in (0, 2, 3, 4)] + [sets], names=["doc_id", "cluster", "chunks", "members", "shingles"])

    n_members = members.count()
    few = n_members <= SEND_ROWS
    met = plain.join(F.broadcast(members) if few else members, "doc_id").select("doc_id", "text", "cluster", "chunks", "members")
    sets = staged.write(met.mapInArrow(with_sets, "doc_id long, cluster long, chunks int, members long, shingles binary"))

    # one pass over all clusters; large ones in chunks, each with the cluster's pivots
    own = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
    is_pivot = (F.col("chunks") > 1) & (F.pmod(F.xxhash64(F.lit("pivot"), "doc_id"), F.col("members")) < PIVOTS)
    parts = F.when(is_pivot, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
    first = staged.write(_tree_join(sets.withColumn("part", F.explode(parts)).withColumn("component", F.col("doc_id")), percent), 2 * n_members, spread=True)
    large = members.filter("chunks > 1")
    roots = first.join(large.select("cluster").distinct(), "cluster", "left_anti").groupBy("doc_id").agg(F.min("root").alias("root"))
    if large.limit(1).count():
        joined = connected(first.join(large.select("cluster").distinct(), "cluster", "left_semi").select(F.col("doc_id").alias("node"), F.col("root").alias("hub")), staged, 2 * n_members)
        state = large.join(joined.withColumnRenamed("node", "doc_id"), "doc_id")
        most = state.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("of"), F.max("n").alias("n"))
        # as many parts of what is outside as its share of the cluster's chunks
        rest = F.ceil((F.col("of") - F.col("n")) / F.col("of") * F.col("chunks")).cast("int")
        most = most.join(large.select("cluster", "chunks").distinct(), "cluster").withColumn("rest", rest)
        state = staged.write(state.join(most.select("cluster", "main", "rest"), "cluster").filter("rest > 0"), n_members)
        # what is outside the largest component meets every chunk
        outside = F.col("label") != F.col("main")
        pairs = lambda a, b: F.transform(a, lambda i: F.transform(b, lambda r: i * F.col("rest") + r))
        all_rest, all_chunks = F.sequence(F.lit(0), F.col("rest") - 1), F.sequence(F.lit(0), F.col("chunks") - 1)
        mine, mine_rest = F.array(F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")), F.array(F.pmod(F.xxhash64(F.lit("rest"), "doc_id"), F.col("rest")).cast("int"))
        where = F.array_distinct(F.flatten(F.concat(pairs(mine, all_rest), F.when(outside, pairs(all_chunks, mine_rest)).otherwise(F.array().cast("array<array<int>>")))))
        again = sets.select("doc_id", "shingles").join(state.select("doc_id", "cluster", F.col("label").alias("component"), F.explode(where).alias("part")), "doc_id")
        second = staged.write(_tree_join(again, percent).select("doc_id", "root").distinct(), 2 * n_members, spread=True)
        # ties of the second pass join components, not documents
        ends = second.join(state.select("doc_id", "label"), "doc_id").select(F.col("label").alias("node"), F.col("root").alias("hub")).distinct()
        merged = connected(ends, staged, n_members).select(F.col("node").alias("label"), F.col("label").alias("top"))
        final = joined.withColumnRenamed("node", "doc_id").join(merged, "label", "left").select("doc_id", F.least(F.col("label"), F.coalesce("top", "label")).alias("root"))
        roots = roots.unionByName(final)
    named = classes.select("n", "h1", "h2", "rep").join(roots, classes["rep"] == roots["doc_id"], "left").select(F.col("n").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.coalesce("root", "rep").alias("component_id"))
    out = every.join(named, (F.col("n") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op9_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS root FROM n UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.x WHERE r.root < b.y)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, min(r.root))::BIGINT AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""
