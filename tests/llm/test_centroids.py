"""Centroid clustering against a comparison of every vector with all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medlattice.llm import centroids

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, dim, rounds, seed="3"):
    """(vec_id, cluster, distance) sorted, and the centroids, by the definition."""
    good = lambda e: e is not None and len(e) == dim and all(x is not None and math.isfinite(x) and abs(x) <= 65536 for x in e)
    found = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if good(e)]
    first = sorted(found, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [x for _, x in first[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        own = [[] for _ in cs]
        for _, x in found:
            own[nearest(x)[1]].append(x)
        cs = [[sum(col) // len(xs) for col in zip(*xs, strict=True)] if xs else c for xs, c in zip(own, cs, strict=True)]
    return sorted(((i, *nearest(x)[::-1]) for i, x in found), key=lambda r: (r[0] is None, r[0] or 0, r[1:])), cs


def rows_of(rng, n, dim):
    """Clumps, equal vectors, a hot vector, vectors that take no part, null and repeated ids."""
    middles = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * dim) for i in range(n // 2)] + [(2000 + i, [float(rng.choice([-1, 0, 1])) for _ in range(dim)]) for i in range(n // 2)]
    odd = [None, [], [1.0] * (dim - 1), [1.0] * (dim + 1), [None] + [1.0] * (dim - 1), [math.nan] * dim, [math.inf] + [0.0] * (dim - 1), [1e30] * dim]
    rows += [(3000 + i, e) for i, e in enumerate(odd)] + [rows[0], rows[0], (rows[0][0], [0.25] * dim), (None, [0.75] * dim)]
    rng.shuffle(rows)
    return rows


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.integers(1, 4), st.integers(0, 10**9), st.booleans(), st.sampled_from([2, 5, 1000, 1 << 26]))
def test_annulus_equals_comparison_with_all(k, dim, seed, hinted, size):
    rng = np.random.default_rng(seed)
    cs, x = rng.integers(-size, size + 1, (k, dim)), rng.integers(-size, size + 1, (40, dim))
    if k > 1:
        cs[-1] = cs[0]  # equal centroids, and vectors halfway between two
        x[0] = cs[0]
        x[1] = -cs[0]
    number, distance, _ = centroids.Annulus(cs).nearest(x, rng.integers(0, k, 40) if hinted else None)
    every = ((x[:, None, :] - cs[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_annulus_leaves_centroids_out():
    rng = np.random.default_rng(1)
    cs = (np.arange(1, 201)[:, None] * 1000 * np.ones((1, 3))).astype(np.int64)
    x = cs[rng.integers(0, 200, 500)] + rng.integers(-20, 21, (500, 3))
    assert centroids.Annulus(cs).nearest(x)[2] < 500 * 3


@pytest.mark.parametrize("k,rounds", [(5, 4), (1, 2), (8, 0), (500, 1)])
def test_cluster_equals_plain_rounds(spark, k, rounds):
    rng = random.Random(k)
    rows = rows_of(rng, 60, 6)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("cluster", F.lit(1)).repartition(5)
    found, cs = centroids.cluster(df, k, 6, rounds)
    want, want_cs = plain(rows, k, 6, rounds)
    got = sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert got == want and cs.tolist() == want_cs


def test_query_and_empty_tables(spark, tmp_path):
    rng = random.Random(2)
    rows = rows_of(rng, 90, 64)
    spark.createDataFrame(rows, SCHEMA).withColumn("distance", F.lit("clash")).write.parquet(str(tmp_path / "embeddings.parquet"))
    want, cs = plain(rows, 8, 64, 10)
    got = centroids.op13_centroid_clustering(spark, str(tmp_path)).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == want
    total = {c: sum(d for _, x, d in want if x == c) for c in {c for _, c, _ in want}}
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (total[r.cluster], sum(total.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert centroids.op13_centroid_clustering(spark, str(tmp_path / "none")).count() == 0
    only_bad = spark.createDataFrame([(1, [1.0])], SCHEMA)
    assert centroids.cluster(only_bad)[0].count() == 0
    with pytest.raises(ValueError):
        centroids.cluster(only_bad, k=0)
