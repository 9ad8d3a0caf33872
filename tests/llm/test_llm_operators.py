"""Training-data operators against brute force and on odd inputs."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from medlattice.llm import decontaminate, language_id, line_crf, line_dedup, mixing, ngram_join, quality_rules, sharding, substring_dedup, url_rules, words
from medlattice.llm.common import Staged, connected, ranked
from medlattice.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, repeated rows, nulls, empty and long texts."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    base = prose(rng, 120)
    near = base.split()
    near[5] = near[90] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One two"), (9, prose(rng, 40) + " " + passage), (10, passage + "\n" + prose(rng, 60)), (11, passage), (12, prose(rng, 4000)), (13, "a " * 300), (14, "a " * 300), (15, prose(rng, 200))]
    rows += [(20 + i, prose(rng, 30) + " " + passage + " " + prose(rng, 30)) for i in range(12)]
    full = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), None) for i, t in rows]
    return spark.createDataFrame(full, DOCS), {i: t for i, t in rows}


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("kind,pattern", [(words.WORD, WORD), (words.ALNUM, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))])
def test_words_and_hashes(kind, pattern, monkeypatch):
    rng = random.Random(1)
    seen = {}
    for _ in range(60):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab éB1 \n\t -!\x1f") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 9))]
        monkeypatch.setattr(words, "BLOCK_BYTES", rng.choice([1, 10, 1000]))
        monkeypatch.setattr(words, "PIECE_BYTES", rng.choice([1, 3, 7, 1000]))
        for a, b, block in words.blocks(pa.record_batch({"text": pa.array(texts, pa.string())}), kind, True):
            for i in range(a, b):
                want = pattern.findall(lower(texts[i] or ""))
                f, t = block.first[i - a], block.first[i - a + 1]
                assert [lower(block.bytes_of(block.starts[j], block.ends[j]).decode()) for j in range(f, t)] == want
                for w, h in zip(want, block.hashes[f:t]):
                    assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_grams_agree_with_the_polynomial():
    h = np.random.default_rng(4).integers(0, 1 << 63, 40).astype(np.uint64)
    for k in (1, 2, 3, 5, 8, 40, 41):
        want = [sum(int(x) * pow(int(words._GRAM), j, 1 << 64) for j, x in enumerate(h[i : i + k])) % (1 << 64) for i in range(len(h) - k + 1)]
        assert list(words.gram_hashes(h, k)) == list(words.mix(np.array(want, np.uint64) + np.uint64(k)))


def test_ranked_and_connected(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", None) for i in range(300)], "g string, i int")
    r = ranked(df, ["g"], F.lpad(F.col("i").cast("string"), 3, "0").substr(1, 2), [F.col("i")], "k").collect()
    assert all(x.k == x.i for x in r) and len(r) == 600
    r = ranked(df, ["g"], F.lpad(F.col("i").cast("string"), 3, "0"), [F.col("i")], "k", 2).collect()
    assert all(x.k == x.i for x in r) and len(r) == 600
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 20)] + [(i, i) for i in range(20)] + [(50, 50)], "node long, hub long")
    assert {x.node: x.label for x in connected(edges, Staged(spark, "t"), 50).collect()} == {i: 0 for i in range(20)} | {50: 50}


def test_base_counts_and_verdict(spark, corpus):
    docs, texts = corpus
    out = {r.doc_id: r for r in quality_rules.divergence_filter(docs.withColumn("kept", F.lit("clash")), quality_rules.references(docs)).collect()}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.divergence_filter(empty(spark), {}).count() == 0


def test_js_distance():
    p, q = np.array([[1, 1, 0], [1, 0, 0], [0, 0, 0]]), np.array([[1, 1, 0]])
    d = quality_rules.js_distance(p, q)
    m = 0.75
    kl = (np.log2(1 / m) + 0.5 * np.log2(0.5 / m) + 0.5 * np.log2(0.5 / 0.25)) / 2
    assert d[0] == pytest.approx(0) and d[1] == pytest.approx(kl**0.5) and d[2] == 1


def test_junk_is_dropped_and_prose_kept(spark):
    rng = random.Random(3)
    common = quality_rules.COMMON_WORDS["en"]
    clean = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeiounrstl") for _ in range(6)) for _ in range(150)) + "."
    rows = [(i, clean(), "en") for i in range(60)] + [(100, " ".join("x%d***" % rng.randrange(9999) for _ in range(200)), "en"), (101, " ".join(f"{rng.randrange(10**6)}" for _ in range(200)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.kept for r in quality_rules.divergence_filter(docs, quality_rules.references(docs)).collect()}
    assert all(out[i] for i in range(60)) and not out[100] and not out[101]


def languages(rng, n):
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "eng", "ung", "er"], "cc": ["éa", "oñ", "ío", "ue"]}
    return [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(40)), k) for i in range(n) for k in [rng.choice(list(parts))]]


def test_language_network(spark):
    rows = languages(random.Random(2), 240)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(docs.filter("doc_id < 160"))
    out = language_id.predict(docs.filter("doc_id >= 160").withColumn("score", F.lit("clash")), net).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "ka" * 9000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, net).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "aa"
    nothing = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert language_id.predict(odd, nothing).first().lang_pred == "und"


def test_network_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (30, language_id.WINDOW)).astype(np.uint8)
    net = language_id.fit(windows, rng.integers(0, 2, 30), ["x", "y"], epochs=1)
    e, z = net.embed[windows], []
    places = language_id.WINDOW - language_id.WIDTHS[-1] + 1
    for w, f, b in zip(language_id.WIDTHS, net.filters, net.bias, strict=True):
        r = np.concatenate([e[:, j : j + places] for j in range(w)], 2) @ f
        z.append(r.max(1) + b)
    want = language_id._softmax(np.maximum(np.hstack(z), 0) @ net.dense + net.out)
    assert np.allclose(net.probabilities(windows, net.tables()), want, atol=1e-4)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    unary, trans = rng.normal(size=5), rng.normal(size=(2, 2))
    index, n = np.array([[0, 1, 2, 3, 4], [1, 2, 2, 2, 2]]), np.array([5, 2])
    p, pair, log_z = line_crf.forward_backward(unary, trans, index, n)
    for d in range(2):
        own = unary[index[d][: n[d]]]
        total, good, pairs = 0.0, np.zeros(n[d]), np.zeros((2, 2))
        for code in range(2 ** n[d]):
            y = [(code >> k) & 1 for k in range(n[d])]
            s = np.exp(sum(u for u, v in zip(own, y) if v) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += s
            good += s * np.array(y)
            for a, b in zip(y, y[1:]):
                pairs[a, b] += s
        assert np.allclose(p[d][: n[d]], good / total) and np.allclose(pair[d], pairs / total) and log_z[d] == pytest.approx(np.log(total))


def test_crf_separates_labels_and_scores_empty_texts(spark):
    rng = random.Random(4)
    good = lambda: "\n".join(prose(rng, 12) for _ in range(5))
    bad = lambda: "\n".join(" ".join("ab%d###" % rng.randrange(99) for _ in range(8)) for _ in range(5))
    rows = [(i, good() if i % 2 else bad()) for i in range(120)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (5, None)], "doc_id long, label int")
    model = line_crf.train(docs, labels)
    out = {r.doc_id: r.score for r in line_crf.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert all((out[i] > 0.5) == bool(i % 2) for i in range(80, 120)) and 0 <= out[200] == out[201] <= 1
    assert line_crf.train(docs, labels.filter("label = 1")).constant == 1.0
    assert line_crf.score(docs.limit(0), model).count() == 0


def check_shards(rows, n):
    count = Counter(r.shard for r in rows)
    assert max(count.values()) - min([count[s] for s in range(n)]) <= 1
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))


def test_sharding(spark, corpus):
    docs, texts = corpus
    rows = sharding.shard(docs.unionByName(docs.limit(3)), 4).collect()
    assert len(rows) == len(texts) + 3
    check_shards(rows, 4)
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.grown_shard is None for r in rows)
    again = sharding.shard(docs.unionByName(docs.limit(3)), 4).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert sharding.shard(empty(spark)).count() == 0


def test_sharding_keeps_groups_and_packs_a_hot_one(spark):
    rows = [(i, "same") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(400)] + [(2000 + i, f"alone {i}") for i in range(400)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check_shards(out, 8)
    by = {}
    for r in out:
        by.setdefault("hot" if r.doc_id < 1000 else (r.doc_id - 1000) // 2 if r.doc_id < 2000 else None, []).append(r.shard)
    split = sum(len(set(v)) > 1 for k, v in by.items() if isinstance(k, int))
    assert split <= 10 and len(set(by["hot"])) <= 5


def page(i, url, *lines):
    return i, url, "<html><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


def test_line_dedup(spark):
    rows = [page(i, f"https://A.example/{i}", "menu", f"own {i}", "half" if i % 4 == 0 else f"x {i}") for i in range(10)] + [page(20, "https://b.example/", "menu", "menu"), page(21, None, "menu"), (22, "https://a.example/z", None)]
    out = {r.page_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert all(out[i].host == "a.example" and "menu" not in out[i].text and f"own {i}" in out[i].text and out[i].n_removed == 1 for i in range(10))
    assert (out[20].n_removed, out[21].host, out[21].text, out[22].n_lines, out[22].text) == (0, "", "menu", 0, "")


def test_url_rules(spark):
    rng = random.Random(6)
    rows = [(i, f"http://{'spam-' if i % 3 == 0 else 'nice-'}{rng.choice('xyz')}.net/{rng.choice(['a', 'b'])}/{i}") for i in range(300)]
    rows += [(1000, "https://Blog.Example.org/es/1"), (1001, "http://example.org/en/12"), (1002, "http://x.com/fr/"), (1003, "http://x.com/de/9?q"), (1004, None), (1005, "nothing"), (1006, "http://q.org"), (1007, "http://example.org/ok")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(200)], "page_id long, bad boolean")
    out = {r.page_id: r for r in url_rules.judge(pages, labels).collect()}
    assert len(out) == len(rows) and all(out[i].verdict == ("block" if i % 3 == 0 else "allow") for i in range(300))
    want = {1000: ("example.org/es/", "block"), 1001: ("example.org/en/1", "block"), 1002: ("com/fr/", "allow"), 1003: ("com/de/", "block"), 1004: (None, "allow"), 1005: (None, "allow"), 1006: (None, "allow"), 1007: ("org/", "allow")}
    assert {k: (out[k].rule, out[k].verdict) for k in want} == want
    assert (out[1000].host, out[1000].path, out[1004].host, out[1005].path) == ("blog.example.org", "/es/1", "", "")
    assert {r.verdict for r in url_rules.judge(pages.filter("page_id < 10"), labels.limit(0)).collect()} == {"allow"}


def test_url_rules_against_all_combinations(spark):
    rng = random.Random(11)
    rows = [(i, f"http://{rng.choice('abc')}.{rng.choice(['net', 'biz'])}/{rng.choice(['ü', 'x1'])}/{rng.choice('pq')}{i}?k={rng.choice('12')}") for i in range(240)]
    bad = {i: ("biz" in u and "/ü/" in u or "k=1" in u and "/x1/" in u and "//a" in u) or rng.random() < 0.05 for i, u in rows}
    pages = spark.createDataFrame(rows, "page_id long, url string")
    split = pages.select("page_id", F.xxhash64("url").alias("id"), url_rules.tokens(F.col("url")).alias("tokens"))
    held = {r.page_id: frozenset(r.tokens) for r in split.collect()}
    found = url_rules.mine(split.join(spark.createDataFrame(list(bad.items()), "page_id long, bad boolean"), "page_id"), Staged(spark, "t"), 240, min_count=8).collect()
    names = sorted({t for s in held.values() for t in s if sum(t in x for x in held.values()) > 7})
    holders = {}
    for n in range(1, 5):
        for combo in itertools.combinations(names, n):
            own = frozenset(i for i, s in held.items() if s.issuperset(combo))
            if sum(bad[i] for i in own) >= max(8, 0.01 * sum(bad.values())) and sum(bad[i] for i in own) / len(own) >= 0.8:
                holders[frozenset(combo)] = own
    least = [c for c in holders if not any(o < c for o in holders)]
    # of combinations that the same URLs hold, one is mined
    assert {frozenset(i for i, s in held.items() if s.issuperset(r.rule_tokens)) for r in found} == {holders[c] for c in least}
    assert all(frozenset(r.rule_tokens) in holders for r in found) and any(len(r.rule_tokens) > 1 for r in found)


def removed_words(texts):
    first = {}
    w = {i: WORD.findall(t or "") for i, t in texts.items()}
    for i in sorted(w):
        for k in range(len(w[i]) - 49):
            first.setdefault(tuple(w[i][k : k + 50]), i)
    out = {}
    for i, ws in w.items():
        gone = {k + j for k in range(len(ws) - 49) if first[tuple(ws[k : k + 50])] < i for j in range(50)}
        out[i] = (len(ws), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(ws) if k not in gone).encode()).hexdigest())
    return out


def test_substring_dedup(spark, corpus):
    docs, texts = corpus
    out = substring_dedup.remove_repeats(docs.select("doc_id", "text").withColumn("n_words", F.lit("clash"))).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == removed_words(texts)
    assert substring_dedup.remove_repeats(empty(spark).select("doc_id", "text")).count() == 0


def test_substring_dedup_random(spark):
    rng = random.Random(9)
    parts = [prose(rng, 60, 5) for _ in range(6)]
    texts = {i: " ".join(rng.choice(parts) if rng.random() < 0.5 else prose(rng, 40, 3) for _ in range(rng.randrange(1, 5))) for i in range(60)}
    for parts in (20_000, 5):  # one part a shard, and many whose first windows meet again
        out = substring_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), task_segments=parts).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == removed_words(texts)


def test_fm_index_against_scan():
    rng = np.random.default_rng(3)
    for _ in range(150):
        length, v = int(rng.integers(1, 6)), int(rng.integers(1, 5))
        passages = [rng.integers(0, v, rng.integers(1, 15)).astype(np.uint64) * 7 for _ in range(rng.integers(1, 7))]
        owners = [int(x) for x in rng.integers(0, 50, len(passages))]
        best = {}
        for p, o in zip(passages, owners):
            for i in range(len(p) - length + 1):
                best[tuple(p[i : i + length])] = min(best.get(tuple(p[i : i + length]), o), o)
        patterns = [rng.integers(0, v + 1, rng.integers(1, 20)).astype(np.uint64) * 7 for _ in range(5)]
        none = np.iinfo(np.int64).max
        for p, got in zip(patterns, FMIndex(passages, owners, length).smallest_owners(patterns)):
            assert [best.get(tuple(p[i : i + length]), none) if i + length <= len(p) else none for i in range(len(p))] == list(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(5, 60)), rng.choice(["a", "b", "c", "d", None])) for i in range(600)] + [(900, None, "a"), (901, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows) and all(r.copies <= 2 for r in out)
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r.size == len(WORD.findall(dict((a, b) for a, b, _ in rows)[r.doc_id] or ""))
        size[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while True:  # water filling
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] <= level * weight[s]}
        if not full:
            break
        for s in full:
            want[s] = 2.0 * size[s]
            left -= want[s]
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= max(120, 0.05 * target[s])
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.emit(mixing.mix(docs), ["doc_id"]).count() == sum(r.copies for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def components_of(texts):
    def shingles(t):
        w = WORD.findall(lower(t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in s}
    for _ in s:
        for a in s:
            for b in s:
                if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[i]] == root[i] for i in s):
            break
    return {i: (len(s[i]), root[i]) for i in s}


@pytest.mark.parametrize("chunk,sketch", [(512, 96), (4, 96), (4, None)])
def test_ngram_join(spark, corpus, chunk, sketch):
    docs, texts = corpus
    rng = random.Random(8)
    base = prose(rng, 100).split()
    more = dict(texts)
    for i in range(40):  # a dense group of near copies, some beyond the limit
        t = list(base)
        for _ in range(rng.randrange(0, 8)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(50)}"
        more[100 + i] = " ".join(t)
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string").withColumn("n", F.lit("clash"))
    out = ngram_join.components(df.unionByName(df.filter("doc_id = 2")), chunk=chunk, sketch=sketch).collect()
    assert len(out) == len(more) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == components_of(more)
    assert ngram_join.components(empty(spark)).count() == 0


def test_least_shared_holds():
    rng = np.random.default_rng(2)
    keep = lambda x: np.sort(x)[: ngram_join.kept_keys(len(x))]
    for n in (1, 2, 3, 4, 5, 7, 20, 70, 91, 120, 300, 1000):
        for _ in range(200):
            union = int(rng.integers(n, -(-n * 4 // 3) + 1))
            both = -(-union * 3 // 4)
            if both > n:
                continue
            keys = rng.permutation(union)
            common, rest = keys[:both], keys[both:]
            a, b = np.concatenate([common, rest[: n - both]]), np.concatenate([common, rest[n - both :]])
            shared = len(np.intersect1d(keep(a), keep(b)))
            assert shared >= ngram_join.least_shared(len(a)) and shared >= ngram_join.least_shared(len(b))
            drawn = len(np.intersect1d(np.sort(a)[: ngram_join.SKETCH], np.sort(b)[: ngram_join.SKETCH]))
            assert drawn >= ngram_join.sketch_shared(len(a)) and drawn >= ngram_join.sketch_shared(len(b))


def test_winnowing(spark):
    rng = random.Random(7)
    items = [(1, prose(rng, 30)), (2, "Short, item"), (3, None), (4, ""), (5, prose(rng, 10)), (6, prose(rng, 200, 3)), (7, "one")]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            t = rng.choice(items)[1] or ""
            w = t.split()
            a = rng.randrange(len(w) + 1)
            parts += [prose(rng, rng.randrange(0, 12)), " ".join(w[a : a + rng.randrange(1, 30)]).upper() + "!"]
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, items[0][1] + " one")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = pattern.findall(lower(t or ""))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = {}
    for i, t in rows:
        w = pattern.findall(lower(t or ""))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= own
        want[i] = (len(w), len(hit), sorted(found))
    for clash, mb, send in ((True, 32, 2), (False, 0.001, 99), (True, 0.001, 1)):  # one block, several blocks, a join of fingerprints
        own = docs.withColumn("hit_items", F.lit("clash")).withColumn("n_words", F.lit("clash")) if clash else docs
        got = decontaminate.contamination(own, bench, block_mb=mb, send_blocks=send)
        out = got.select("doc_id", "n_words", decontaminate.hit_count().alias("n_hit"), "hit_items").collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.hit_items) for r in out} == want
    assert decontaminate.contamination(docs, bench.limit(0)).filter("size(hit_items) > 0").count() == 0


def test_winnowing_reads_the_texts_of_each_benchmark(spark):
    old, new = (" ".join(f"{w}{i}" for i in range(12)) for w in ("old", "new"))
    # more parts than workers, so each worker that is used again has met the benchmark before
    docs = spark.createDataFrame([("a", old), ("b", new)] * 32, "doc_id string, text string").repartition(32)
    for text, want in ((old, "a"), (new, "b"), (old, "a")):
        bench = spark.createDataFrame([(0, text)], "item_id long, text string")
        assert [r.doc_id for r in decontaminate.contamination(docs, bench).filter("size(hit_items) > 0").collect()] == [want] * 32
    # two blocks of one benchmark whose ids are all null
    bench = spark.createDataFrame([(None, old), (None, new)], "item_id long, text string")
    for mb in (32, 1e-6 * (len(old) // 4), 1e-6 * len(old)):
        assert decontaminate.contamination(docs, bench, block_mb=mb).filter("size(hit_items) > 0").count() == 64
