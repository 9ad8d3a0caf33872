"""The registered queries over a small written folder: folds, flags, columns, odd rows and empty tables."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from medlattice.llm import language_id, line_crf, queries, sharding, url_rules

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>, label int",
}


def written(spark, folder, **tables):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(tables.get(name, []), schema).withColumn("extra", F.lit("x")).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rest(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def corpus(rng):
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "eng", "ung"]}
    rows = []
    for i in range(160):
        lang = rng.choice(list(parts))
        good = i % 2
        line = lambda: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(9)) if good else "#### 12 %% " * 4  # noqa: B023, E731
        rows.append((i, "\n".join(line() for _ in range(6)) + " " + "".join(rng.choice(parts[lang]) for _ in range(20)), lang, rng.choice(["s1", "s2", None]), 1))
    return rows + [(900, None, "aa", None, None), (901, "", None, "s1", 0), (None, "no id at all", None, None, 1), (3, "a second row of id three", "aa", "s1", 1)]


def test_language_query_learns_from_its_folds_alone(spark, tmp_path):
    rng = random.Random(1)
    docs = corpus(rng)
    other = [(i, t, "zz" if rest(i, 4) == 2 else lang, s, n) for i, t, lang, s, n in docs]
    key = lambda r: str(tuple(r))
    first, second = (sorted(language_id.op2_byte_cnn(spark, written(spark, tmp_path / str(k), documents=d)).collect(), key=key) for k, d in enumerate((docs, other)))
    assert first == second and first[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"]
    assert all(r.held_out == (rest(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in first) and len(first) == len(docs)
    by = {i: lang for i, _, lang, _, _ in docs}
    held = [r.lang_pred == by[r.doc_id] for r in first if r.held_out and r.doc_id is not None and r.doc_id < 160 and r.doc_id != 3]
    assert sum(held) / len(held) > 0.9 and {r.lang_pred for r in first if r.doc_id in (900, 901)} == {"und"}


def test_quality_query_learns_from_its_folds_alone(spark, tmp_path):
    rng = random.Random(2)
    docs = corpus(rng)
    labels = [(i, i % 2, 0) for i in range(160)] + [(None, 1, 0), (12345, 0, 0)]
    turned = [(i, 1 - q if rest(i, 5) == 0 else q, t) for i, q, t in labels]
    key = lambda r: str(tuple(r))
    first, second = (sorted(line_crf.op7_line_crf(spark, written(spark, tmp_path / str(k), documents=docs, labels=x)).collect(), key=key) for k, x in enumerate((labels, turned)))
    assert first == second and len(first) == len(docs)
    assert all(r.held_out == (rest(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) for r in first)
    right = [r.predicted == r.doc_id % 2 for r in first if r.held_out and r.doc_id is not None and r.doc_id < 160 and r.doc_id != 3]
    assert sum(right) / len(right) > 0.9


def test_line_features_weigh_by_length(spark):
    """A text's score is the mean of its lines' marginals by their characters, which a long bad line pulls down."""
    good, bad = "ka lo mi ka lo mi ka lo mi", "#### 12 %% " * 3
    rows = [(i, "\n".join([good if i % 2 else bad] * 5), i % 2) for i in range(80)]
    model = line_crf.train(spark.createDataFrame(rows, "doc_id long, text string, label int").select("doc_id", "text"), spark.createDataFrame(rows, "doc_id long, text string, label int").select("doc_id", "label"))
    short, long = "\n".join([good] * 9 + [bad]), "\n".join([good] * 9 + [bad * 40])
    out = {r.doc_id: r.score for r in line_crf.score(spark.createDataFrame([(1, short), (2, long)], "doc_id long, text string"), model).collect()}
    assert out[1] > out[2]


def test_shard_query(spark, tmp_path):
    rng = random.Random(3)
    docs = corpus(rng) + [(2000 + i, "the same text", None, None, 1) for i in range(90)]
    out = sharding.op3_balanced_label_propagation(spark, written(spark, tmp_path, documents=docs)).collect()
    count = Counter(r.shard for r in out)
    assert len(out) == len(docs) and set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    for r in out:
        assert r.law == "rows" and r.grown_shard is None
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    for s, n in count.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    # 90 equal texts need nine shards of 16 at least; votes keep them together as far as quotas allow
    assert len({r.shard for r in out if r.doc_id is not None and r.doc_id >= 2000}) <= 8
    groups = [{r.shard for r in out if r.text_crc32 == zlib.crc32(t.encode())} for t in {t for _, t, *_ in docs if t}]
    assert sum(len(g) > 1 for g in groups) <= 1


def test_url_query_maps_labels_to_pages(spark, tmp_path):
    rng = random.Random(4)
    pages = [(i, f"http://{'bad' if i % 3 == 0 else 'fine'}.net/{rng.choice('xy')}/{i}", None) for i in range(240)] + [(900, "https://sub.example.org/es/a", None), (901, None, None), (None, "http://a.com/fr/x", None)]
    labels = [(i, 0 if i % 3 == 0 else 1, 0) for i in range(160)] + [(170, None, 1)]
    out = {r.page_id: r for r in url_rules.op5_association_rules(spark, written(spark, tmp_path, pages=pages, labels=labels)).collect()}
    assert len(out) == len(pages) and all(out[i].verdict == ("block" if i % 3 == 0 else "allow") for i in range(240))
    assert (out[900].rule, out[900].verdict, out[None].rule, out[901].verdict) == ("example.org/es/", "block", "com/fr/", "allow")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_of_empty_tables(spark, tmp_path, name):
    folder = written(spark, tmp_path)
    assert queries.QUERIES[name](spark, folder).count() == 0


def test_pipeline_of_odd_rows_and_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none")).count() == 0
    rng = random.Random(5)
    docs = [r for r in corpus(rng) if r[0] is None or r[0] % 2] + [(None, None, None, None, None), (None, "", "aa", None, 1), (None, "no id at all", None, None, 1)]
    folder = written(spark, tmp_path / "odd", documents=docs, labels=[(i, 1, 0) for i in range(160)], benchmark=[(1, "nothing of this is there"), (None, None)])
    given = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, given, folder)
    assert kept.columns == given.columns and kept.count() == len(docs)
    once = corpus_pipeline.near_duplicates(spark, kept, folder)
    # rows of one id are told apart, equal texts leave one, and texts without words link with nothing
    assert once.columns == given.columns and once.filter("doc_id = 3").count() == 2 and once.filter("text = 'no id at all'").count() == 1 and once.filter("text is null or text = ''").count() == 3
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)
