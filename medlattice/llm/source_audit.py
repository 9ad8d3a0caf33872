"""Source divergence audit by deduplicated count columns.

Within a language every kept term has a sparse vector of its counts by source.
Terms with the same vector add the same amount to the distance of any two
sources, so terms are grouped by their vector, each pair of sources is evaluated
once per distinct vector, and the amount is multiplied by the number of terms.

A pair's sum over all kept terms is split by which of the two sources has the
term, so that absent counts are never written out. With d(x, y) the difference
at counts x and y:

    d(x, y) = d(0, 0) + [d(x, 0) - d(0, 0)] + [d(0, y) - d(0, 0)] + both(x, y)

The first part is one number a pair. The second and third depend on one source's
count only and are evaluated once per distinct count of a source. ``both`` is 0
unless the vector holds both sources, and is evaluated once per distinct vector.

All numbers are integers: p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)),
divided as decimals; no sum depends on the order of rows.

Defined results: null text, lang and source are empty strings. A group without
kept terms has N = 0 and counts of 0. A language without kept terms has V = 0:
its pairs have value 0 and it has no term rows. Repeated rows are documents of
their own. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staged, narrow, table
from .words import LOWER, blocks

MIN_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Rows of a small side that are sent to all tasks; beyond it the join is salted and shuffled.
SEND_ROWS, SALTS = 200_000, 64
#: Distinct (group, term) pairs a task holds before it passes them on, bytes of one piece of text, and pairs evaluated at once.
HELD, PIECE, PAIRS = 400_000, 1 << 22, 1 << 20

#: Bytes of terms, ASCII letters and all bytes of non-ASCII characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The terms at the given spans, lower-cased, as one dictionary array."""
    mask = np.zeros(len(data) + 1, np.int8)
    mask[starts] += 1
    mask[ends] -= 1
    letters = LOWER[data[np.cumsum(mask[:-1], dtype=np.int8).astype(bool)]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    plain = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return plain.dictionary_encode()


def _block_counts(block, group: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of a block of documents, whose groups are numbered."""
    doc_of = np.repeat(np.arange(len(group)), np.diff(block.first))
    parts, at = [], 0
    while at < len(block.starts):
        # a piece has adjoining spans; a long document's pieces meet again below
        end = max(at + 1, int(np.searchsorted(block.ends, block.starts[at] + PIECE, "right")))
        lo, hi = block.starts[at], block.ends[end - 1]
        words = _terms(block.data[lo:hi], block.starts[at:end] - lo, block.ends[at:end] - lo)
        key, n = np.unique(doc_of[at:end] * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
        doc, code = np.divmod(key, len(words.dictionary))
        parts.append(pa.table({"doc": doc, "term": words.dictionary.take(pa.array(code)), "n": n}))
        at = end
    if not parts:
        return pa.table({"group": pa.array([], pa.int64()), "term": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "docs": pa.array([], pa.int64())})
    found = parts[0] if len(parts) == 1 else pa.concat_tables(parts).group_by(["doc", "term"]).aggregate([("n", "sum")]).rename_columns(["doc", "term", "n"])
    found = found.append_column("group", pa.array(group[found["doc"].to_numpy()]))
    return found.group_by(["group", "term"]).aggregate([("n", "sum"), ("n", "count")]).rename_columns(["group", "term", "n", "docs"])


def _term_counts(batches):
    """(lang, source, term, n, docs) of a task's documents, summed before they leave it."""
    names: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def out() -> pa.RecordBatch | None:
        if not held:
            return None
        summed = pa.concat_tables(held).group_by(["group", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        langs, sources = (pa.array([k[i] for k in names], pa.string()) for i in (0, 1))
        held.clear()
        group = summed["group"].combine_chunks()
        columns = [langs.take(group), sources.take(group), summed["term"].combine_chunks(), summed["n_sum"].combine_chunks(), summed["docs_sum"].combine_chunks()]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        names.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi, block in blocks(batch, LETTER):
            group = np.array([names.setdefault((langs[i], sources[i]), len(names)) for i in range(lo, hi)], np.int64)
            held.append(_block_counts(block, group))
        if sum(len(t) for t in held) > HELD:
            yield out()
    if (last := out()) is not None:
        yield last


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; docs(lang, source, text) has no nulls."""
    parts = docs.select("lang", "source", "text").mapInArrow(_term_counts, _COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """p = 1 + floor(SCALE * (count + PRIOR) / total), exact; ``total`` is N + PRIOR * V."""
    big = lambda c: c.cast("decimal(20,0)")
    scaled = (big(count + F.lit(PRIOR)) * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", scaled, big(total).cast("decimal(38,0)")) + F.lit(1).cast("long")


def _with_groups(rows: DataFrame, groups: DataFrame, n_groups: int, salt: Column, send_rows: int) -> DataFrame:
    """rows joined with all groups of their lang: sent while they are few, else dealt by (lang, salt) with a copy of the groups for each salt."""
    if n_groups <= send_rows:
        return rows.join(F.broadcast(groups), "lang")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salted, ["lang", "_salt"]).drop("_salt")


def _pairs_of_vectors(batches):
    """(lang, a, b, value): what distinct vectors add for pairs of sources that both have the term, summed before it leaves the task.

    Vectors are laid out flat; the pairs of at most PAIRS entries are made at a time.
    """
    held: dict[tuple[str, str, str], int] = {}

    def out() -> pa.RecordBatch:
        keys = list(held)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array([held[k] for k in keys], pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    for batch in batches:
        langs, vectors, times = batch.column(0), batch.column(1), batch.column(2).to_numpy().astype(np.int64)
        sizes = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
        flat = vectors.flatten()
        source, p, p0 = flat.field(0).dictionary_encode(), flat.field(1).to_numpy(zero_copy_only=False), flat.field(2).to_numpy(zero_copy_only=False)
        code, name = source.indices.to_numpy().astype(np.int64), source.dictionary.to_pylist()
        lang = langs.dictionary_encode()
        lang_names, lang_of = lang.dictionary.to_pylist(), lang.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # each entry meets the later entries of its vector
        later = ends[owner] - np.arange(len(owner)) - 1
        at = 0
        while at < len(owner):
            reach = np.cumsum(later[at : at + PAIRS])
            end = at + max(1, int(np.searchsorted(reach, PAIRS, "right")))
            left = np.repeat(np.arange(at, end), later[at:end])
            first = np.cumsum(later[at:end]) - later[at:end]
            right = left + 1 + np.arange(len(left)) - np.repeat(first, later[at:end])
            x, y, x0, y0 = p[left], p[right], p0[left], p0[right]
            both = (np.abs(x - y) - np.abs(x - y0) - np.abs(x0 - y) + np.abs(x0 - y0)) * times[owner[left]]
            key, where = np.unique((lang_of[owner[left]] * len(name) + code[left]) * len(name) + code[right], return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, where, both)
            for k, v in zip(key.tolist(), sums.tolist(), strict=True):
                rest, b = divmod(k, len(name))
                g, a = divmod(rest, len(name))
                pair = (lang_names[g], name[a], name[b])
                held[pair] = held.get(pair, 0) + v
            at = end
            if len(held) > HELD:
                yield out()
    if held:
        yield out()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source", send_rows: int = SEND_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources of a language lie apart, and by which terms each stands out."""
    spark = docs.sparkSession
    staged = Staged(spark, "source_audit")
    filled = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = term_counts(filled)
    # one row per kept term with its counts by source, in the order of the sources so that equal vectors are equal arrays
    kept = staged.write(
        counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
        .filter(F.col("docs") >= min_docs).select("lang", "term", "vector")
    )
    total = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    # distinct vectors: everything below that speaks of all terms is read off these
    vectors = staged.write(kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("m")).withColumn("total", total))
    langs = vectors.groupBy("lang").agg(F.sum("m").alias("v"), F.sum(F.col("m") * F.col("total")).alias("lang_n"))
    entries = vectors.select("lang", "m", F.explode("vector").alias("e")).select("lang", F.col("e.source").alias("source"), F.col("e.n").alias("n"), "m")
    histogram = entries.groupBy("lang", "source", "n").agg(F.sum("m").alias("m"))
    sums = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    groups = filled.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    groups = groups.select("lang", "source", v.alias("v"), (F.coalesce("n", F.lit(0)) + PRIOR * v).alias("d"), (F.coalesce("lang_n", F.lit(0)) + PRIOR * v).alias("lang_d"))
    groups = staged.write(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("d")))))
    n_groups = groups.count()

    # pairs: the part of absent counts
    left, right = groups.withColumnRenamed("source", "a"), groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    all_pairs = _with_groups(left, right, n_groups, F.xxhash64("a"), send_rows).filter("a <> b")
    base = all_pairs.select("lang", "a", "b", F.when(F.col("v") > 0, F.col("v") * F.abs(F.col("p0") - F.col("b0"))).otherwise(F.lit(0)).alias("value"))
    # counts of one source against the absent ones of all others, once per distinct count
    known = histogram.join(F.broadcast(groups) if n_groups <= send_rows else groups, ["lang", "source"])
    known = known.select("lang", F.col("source").alias("a"), share(F.col("n"), F.col("d")).alias("p"), "p0", "m")
    alone = _with_groups(known, right, n_groups, F.xxhash64("a", "p"), send_rows).filter("a <> b")
    alone = alone.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * (F.abs(F.col("p") - F.col("b0")) - F.abs(F.col("p0") - F.col("b0")))).alias("value"))
    # and pairs that both have the term, once per distinct vector
    shares = F.broadcast(groups) if n_groups <= send_rows else groups
    placed = vectors.withColumn("id", F.monotonically_increasing_id())
    weighed = staged.write(
        placed.select("lang", "id", "m", F.explode("vector").alias("e")).select("lang", "id", "m", F.col("e.source").alias("source"), F.col("e.n").alias("n")).join(shares, ["lang", "source"])
        .groupBy("lang", "id", "m").agg(F.collect_list(F.struct("source", share(F.col("n"), F.col("d")).alias("p"), "p0")).alias("vector")).select("lang", F.sort_array("vector").alias("vector"), "m")
    )
    both = weighed.filter(F.size("vector") > 1).mapInArrow(_pairs_of_vectors, "lang string, a string, b string, value long")
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # the last two hold for both directions of a pair
    turned = lambda df: df.unionByName(df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = base.unionByName(turned(alone)).unionByName(turned(both)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    # terms: each source's counts against those of its language; the best of each task are cut before they are shuffled
    terms = kept.withColumn("total", total).select("lang", "term", "total", F.explode("vector").alias("e"))
    terms = terms.select("lang", "term", "total", F.col("e.source").alias("source"), F.col("e.n").alias("n")).join(shares, ["lang", "source"])
    value = share(F.col("n"), F.col("d")) - share(F.col("total"), F.col("lang_d"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")).filter("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(narrow(table(spark, sf_dir, "documents"), "text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT + 5 * coalesce(any_value(v), 0) AS t FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN v ON v.lang = g.lang GROUP BY g.lang, g.source),
ln AS (SELECT lang, sum(n)::HUGEINT + 5 * any_value(v) AS t FROM c JOIN v USING (lang) GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // gn.t AS p
  FROM g JOIN k USING (lang) JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // any_value(ln.t) AS q FROM c JOIN ln USING (lang) GROUP BY lang, term),
w AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(w.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT lang, source, part, item, value, rank FROM u WHERE part = 'pair' OR rank <= 50
"""
