"""The source divergence audit against a plain evaluation of every term."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from medlattice.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        frequency = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in frequency if frequency[t] >= min_docs]
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if t in set(kept))
        total = sum(counts.values(), Counter())
        p = lambda c, t: 1 + (10**9 * (c[t] + 5)) // (sum(c.values()) + 5 * len(kept))
        for s in counts:
            pairs = [(sum(abs(p(counts[s], t) - p(counts[o], t)) for t in kept), o) for o in counts if o != s]
            terms = [(p(counts[s], t) - p(total, t), t) for t in kept if counts[s][t] and p(counts[s], t) > p(total, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def corpus(rng, n):
    words = ["alpha", "Beta", "GAMMA", "délta", "ΩMEGA", "x", "a1b", "tab\tbed", "long" * 9, *[f"w{c}" for c in "abcdefghijkl"]]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", "", None, "s1"])
        k = rng.randrange(1, len(words))
        rows.append((i, rng.choice([None, "", "12 34 ..", *[" ".join(rng.choice(words[:k]) for _ in range(rng.randrange(1, 25))) for _ in range(8)]]), lang, source))
    return rows + rows[:5]  # repeated rows


@pytest.mark.parametrize("send_rows", [1000, 0])
def test_equals_plain_evaluation(spark, monkeypatch, send_rows):
    rng = random.Random(3 + send_rows)
    rows = corpus(rng, 150) + [(900, "only one", "xx", "s9"), (901, None, "yy", "s1"), (902, "", "yy", "s2")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1)).withColumn("vector", F.lit("x"))
    found = source_audit.audit(docs, min_docs=6, top=3, send_rows=send_rows)
    assert sorted(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows, 6, 3)


def test_text_in_pieces_and_flushed_counts(monkeypatch):
    """A document that is counted in pieces, and a task that passes its counts on early, give the same sums."""
    import pyarrow as pa

    rng = random.Random(8)
    rows = [r for r in corpus(rng, 60) if r[1] is not None]
    batches = [pa.record_batch({"lang": [r[2] or "" for r in part], "source": [r[3] or "" for r in part], "text": [r[1] for r in part]}) for part in (rows[:31], rows[31:])]
    want = Counter()
    for _, t, lang, source in rows:
        for term, n in Counter(TERM.findall(lower(t))).items():
            want[lang or "", source or "", term, "n"] += n
            want[lang or "", source or "", term, "docs"] += 1
    for piece, held in ((1, 1), (7, 10**6), (50, 100)):
        monkeypatch.setattr(source_audit, "PIECE", piece)
        monkeypatch.setattr(source_audit, "HELD", held)
        got = Counter()
        for out in source_audit._term_counts(iter(batches)):
            for x in out.to_pylist():
                for c in ("n", "docs"):
                    got[x["lang"], x["source"], x["term"], c] += x[c]
        assert got == want


def test_pairs_of_vectors_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("p0", pa.int64())]))
    vectors = [[{"source": s, "p": rng.randrange(100), "p0": rng.randrange(50)} for s in sorted(rng.sample("abcdef", rng.randrange(1, 6)))] for _ in range(40)]
    langs, times = [rng.choice(["l1", "l2"]) for _ in vectors], [rng.randrange(1, 9) for _ in vectors]
    want = Counter()
    for lang, vector, m in zip(langs, vectors, times, strict=True):
        for i, x in enumerate(vector):
            for y in vector[i + 1 :]:
                want[lang, x["source"], y["source"]] += m * (abs(x["p"] - y["p"]) - abs(x["p"] - y["p0"]) - abs(x["p0"] - y["p"]) + abs(x["p0"] - y["p0"]))
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(vectors, kind), pa.array(times)], names=["lang", "vector", "m"])
    for pairs, held in ((1, 0), (5, 3), (10**6, 10**6)):
        monkeypatch.setattr(source_audit, "PAIRS", pairs)
        monkeypatch.setattr(source_audit, "HELD", held)
        got = Counter()
        for out in source_audit._pairs_of_vectors(iter([batch])):
            for x in out.to_pylist():
                got[x["lang"], x["a"], x["b"]] += x["value"]
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_exact_where_products_leave_a_long(spark):
    big = 10**13
    df = spark.createDataFrame([(big, 3 * big + 7)], "n long, d long").select(source_audit.share(F.col("n"), F.col("d")).alias("p"))
    assert df.first().p == 1 + (10**9 * (big + 5)) // (3 * big + 7) and df.dtypes == [("p", "bigint")]


def test_empty_and_query(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert source_audit.audit(empty).count() == 0
    rng = random.Random(4)
    rows = corpus(rng, 300)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    found = source_audit.op11_source_divergence_audit(spark, str(tmp_path))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(rows, 30, 50)
