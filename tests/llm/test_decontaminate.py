"""Decontamination by large benchmarks: shared phrases, shared passages, null ids, and agreement of both paths."""

import random
import re

import pytest
from pyspark.sql import functions as F

from medlattice.llm import decontaminate

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words_of(t), set(), set()
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]), ())
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found, key=lambda x: (x is not None, x or ""))))
    return sorted(out, key=str)


def found(spark, docs, items, **sizes):
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contamination(df.withColumn("_a", F.lit("clash")), bench, **sizes)
    rows = got.select("doc_id", "n_words", decontaminate.hit_count().alias("n_hit"), "hit_items").collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in rows), key=str)


JOIN = {"block_mb": 1e-6, "send_blocks": 0}


def prose(rng, n, kind="w"):
    return " ".join(f"{kind}{rng.randrange(300)}" for _ in range(n))


@pytest.mark.parametrize("sizes", [{}, {"block_mb": 0.002, "send_blocks": 99}, JOIN])
def test_null_and_empty_ids_are_items_of_their_own(spark, sizes):
    rng = random.Random(1)
    one, two, three = (prose(rng, 12) for _ in range(3))
    items = [(None, one), ("", one), ("", two), (None, two), ("5", three), (None, None), ("x", " ")]
    docs = [(1, f"{one} and {three}"), (2, two.upper()), (3, None), (4, ""), (1, f"{one} and {three}")]
    assert found(spark, docs, items, **sizes) == brute(docs, items)
    assert any(None in r[3] and "" in r[3] for r in found(spark, docs, items, **sizes))


def test_windows_that_many_share(spark, monkeypatch):
    """A passage and a short item in a third of all documents and items, near windows, and texts that occur again."""
    rng = random.Random(2)
    hot = prose(rng, 25)
    items = [(str(i), " ".join([prose(rng, 8, "i"), hot if i % 3 == 0 else "", prose(rng, 9, "j")])) for i in range(60)] + [("s1", "short item"), ("s2", "one"), ("s3", "Short item!")]
    docs = [(i, " ".join([prose(rng, 6), (hot if i % 3 == 0 else " ".join(hot.split()[3 : 3 + i % 14])), prose(rng, 6), rng.choice(["short item", "", "one"])])) for i in range(150)]
    docs += [(1000 + i, docs[0][1]) for i in range(50)]
    want = brute(docs, items)
    assert found(spark, docs, items, **JOIN) == want == found(spark, docs, items)
    monkeypatch.setattr(decontaminate, "SEND_TEXTS", 0)
    assert found(spark, docs, items, **JOIN) == want


def test_a_phrase_of_few_words_joins_nothing(spark, monkeypatch):
    """Seven words in a third of documents and items make no pair; with a full filter the result is the same."""
    rng = random.Random(3)
    phrase = "seven words that are in so many"
    items = [(str(i), f"{prose(rng, 9, 'i')} {phrase} {prose(rng, 9, 'j')}") for i in range(300)]
    docs = [(i, f"{prose(rng, 9, 'd')} {phrase} {prose(rng, 9, 'e')}") for i in range(300)]
    joined = []
    write = decontaminate.Staged.write

    def counted(self, df, *a, **b):
        out = write(self, df, *a, **b)
        joined.append((tuple(out.columns), out.count()))
        return out

    with monkeypatch.context() as m:
        m.setattr(decontaminate.Staged, "write", counted)
        assert all(r[2] == 0 for r in found(spark, docs, items, **JOIN))
    assert dict(joined)["a", "b", "at", "n", "class"] == 0
    # rows that leave the documents' tasks are bounded by their windows, whatever the filter lets pass
    docs[7] = (7, items[5][1])
    monkeypatch.setattr(decontaminate, "_filter_of", lambda prints: decontaminate.np.full(1 << (decontaminate.FILTER_BITS - 6), -1, decontaminate.np.int64).view(decontaminate.np.uint64))
    assert found(spark, docs, items, **JOIN) == brute(docs, items)


def test_empty_tables(spark):
    rng = random.Random(4)
    items, docs = [("1", prose(rng, 20))], [(1, prose(rng, 20))]
    assert found(spark, [], items, **JOIN) == [] and found(spark, docs, [], **JOIN) == [(1, 20, 0, [])]
    assert found(spark, docs, [("1", None), (None, " ! ")], **JOIN) == [(1, 20, 0, [])]


def test_query(spark, tmp_path):
    import hashlib

    rng = random.Random(5)
    items = [(str(i), prose(rng, rng.choice([4, 12, 40]))) for i in range(20)] + [("", items_text := prose(rng, 15)), (None, items_text)]
    docs = [(i, " ".join([prose(rng, 5), rng.choice(items)[1], prose(rng, 5)]) if i % 2 else prose(rng, 20, "z")) for i in range(60)] + [(None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in decontaminate.op10_winnowing(spark, str(tmp_path)).collect()}
    for d, n, hit, own in brute(docs, items):
        digest = hashlib.sha256(",".join(i for i in own if i is not None).encode()).hexdigest()
        assert tuple(got[d]) == (d, n, hit, len(own), digest, hit > 0)
