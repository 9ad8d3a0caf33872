"""Centroid clustering (Lloyd rounds) with annulus search for the nearest centroid.

Centroids are sorted by norm. For each vector x, the distance u to one centroid
bounds the nearest one from above, and the triangle inequality puts every
centroid at distance u or less into the annulus of norms |x| - u to |x| + u.
Binary searches give that range, and only its centroids are compared. Norms and
bounds are floats, so the annulus is widened by SLACK times their size; the
comparison itself is in integers, and centroids at its border are among those
compared, so ties go to the smaller number as in a comparison with all.

The bound starts from the centroid that the vector had in the first round (it
is written with the vectors) and from the one next to it by norm, the nearer.

Every round is one pass over a written table. A task sums its vectors by
cluster, and an aggregate adds the tasks' sums; only the k sums reach the
driver, and only the k centroids are sent, both bounded by ``k`` and not by the
rows. Vectors are never exchanged, so a cluster of a third of all rows is no
hot key.

Defined results: a vector takes part if it has exactly ``dim`` components, none
null or not finite, and none so large that distances leave 64 bits (integers
over LARGEST in size). Repeated rows are vectors of their own. A null id comes
after all others in the order of the first centroids; equal ids are told apart
by their components. With fewer than k vectors there are fewer centroids. Empty
tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, narrow, table

K, DIM, ROUNDS, SCALE, SEED = 8, 64, 10, 1024, "3"
#: Largest component; dim * (2 * LARGEST) ** 2 fits into 63 bits for up to 256 components.
LARGEST = 1 << 26
SLACK = 1e-9
#: Rows compared at a time.
BLOCK = 8192


class Annulus:
    """Centroids (k by dim integers) in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        centroids = np.asarray(centroids, np.int64)
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.place = np.argsort(self.order)  # a centroid's place by norm
        self.norms, self.sorted = norms[self.order], centroids[self.order]

    def _distance(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        diff = x - self.sorted[place]
        return np.einsum("ij,ij->i", diff, diff)

    def nearest(self, x: np.ndarray, hint: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, centroids compared in all) of each row of x."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        right = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        start = np.where(norm - self.norms[left] < self.norms[right] - norm, left, right)
        best, found = self._distance(x, start), start
        if hint is not None:
            other = self.place[hint]
            distance = self._distance(x, other)
            found = np.where(distance < best, other, found)
            best = np.minimum(best, distance)
        reach = np.sqrt(best.astype(np.float64))
        slack = SLACK * (1.0 + norm + reach)
        lo = np.searchsorted(self.norms, norm - reach - slack, "left")
        hi = np.searchsorted(self.norms, norm + reach + slack, "right")
        number = self.order[found]
        compared = int((hi - lo).sum())
        step = 0
        live = np.flatnonzero(lo < hi)
        while len(live):
            place = lo[live] + step
            distance, own = self._distance(x[live], place), self.order[place]
            better = (distance < best[live]) | ((distance == best[live]) & (own < number[live]))
            at = live[better]
            best[at], number[at] = distance[better], own[better]
            step += 1
            live = live[lo[live] + step < hi[live]]
        return number, best, compared


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def vectors(df: DataFrame, vec_id: str, embedding: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, x): the integer components of the vectors that take part."""
    parts = F.transform(F.col(f"`{embedding}`"), lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    fits = lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) <= float(LARGEST) / scale)
    good = (F.size(F.col(f"`{embedding}`")) == dim) & F.forall(F.col(f"`{embedding}`"), fits)
    return df.filter(good).select(F.col(f"`{vec_id}`").alias("vec_id"), parts.cast("array<long>").alias("x"))


def first_centroids(found: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids have the smallest SHA-256; only k rows leave each task."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = found.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def _assigned(found: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    """found with the number of its nearest centroid and the squared distance; a column ``hint`` is used if there is one."""
    hinted = "hint" in found.columns

    def run(batches):
        search = Annulus(centroids)
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            hint = batch.column(2).to_numpy() if hinted else None
            parts = [search.nearest(x[a : a + BLOCK], None if hint is None else hint[a : a + BLOCK])[:2] for a in range(0, len(x), BLOCK)]
            number, distance = (np.concatenate([np.zeros(0, np.int64), *[p[i] for p in parts]]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "x", "cluster", "distance"])

    kind = found.schema["vec_id"].dataType.simpleString()
    return found.mapInArrow(run, f"vec_id {kind}, x array<long>, cluster int, distance long")


def _sums(found: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    """(cluster, part, value): componentwise sums, and at part = dim the number of vectors."""

    def run(batches):
        search, k = Annulus(centroids), len(centroids)
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x, hint = _matrix(batch.column(0), dim), batch.column(1).to_numpy()
            for a in range(0, len(x), BLOCK):
                block = x[a : a + BLOCK]
                number, _, _ = search.nearest(block, hint[a : a + BLOCK])
                order = np.argsort(number, kind="stable")
                own, first = np.unique(number[order], return_index=True)
                total[own, :dim] += np.add.reduceat(block[order], first, axis=0)
                total[:, dim] += np.bincount(number, minlength=k)
        used = np.flatnonzero(total[:, dim])
        cluster, part = np.repeat(used, dim + 1), np.tile(np.arange(dim + 1), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(total[used].ravel())], names=["cluster", "part", "value"])

    return found.select("x", "hint").mapInArrow(run, "cluster int, part int, value long")


def _moved(centroids: np.ndarray, sums: DataFrame, dim: int) -> np.ndarray:
    """Centroids at the floor of their vectors' means; empty ones stay. Sums are added as decimals."""
    total = sums.groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    out, by = centroids.copy(), {(r.cluster, r.part): int(r.value) for r in total.collect()}  # k * (dim + 1) rows
    for c in {c for c, _ in by}:
        out[c] = [by[c, i] // by[c, dim] for i in range(dim)]
    return out


def cluster(df: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, cluster, distance) of the vectors that take part, and the centroids they were held against last."""
    if k < 1 or not 0 < dim <= 256:
        raise ValueError("k must be positive and dim at most 256")
    staged = Staged(df.sparkSession, "centroids")
    found = vectors(df, vec_id, embedding, dim, scale)
    centroids = first_centroids(found, k, seed)
    if not len(centroids):
        return found.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    if not rounds:
        return _assigned(found, centroids, dim), centroids
    # the first round's numbers go with the vectors, as later rounds' hints
    hinted = staged.write(_assigned(found, centroids, dim).select("vec_id", "x", F.col("cluster").alias("hint")))
    for _ in range(rounds):
        centroids = _moved(centroids, _sums(hinted, centroids, dim), dim)
    return _assigned(hinted, centroids, dim), centroids


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(narrow(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    found = Staged(spark, "op13").write(found.select("vec_id", "cluster", "distance"))
    inertia = {r.cluster: int(r.n) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("n")).collect()}  # at most k rows
    rows = [(c, n, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row a centroid
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> str:
    """The rounds one after the other, each vector against all centroids."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings"
        f" WHERE len(embedding) = {dim} AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))))",
        "e AS MATERIALIZED (SELECT r, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT k, unnest(range(1, {dim + 1})) AS i, unnest(x) AS x FROM"
        f" (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS k, x FROM v) WHERE k < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS MATERIALIZED (SELECT r, k, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM e JOIN c{n} c USING (i) GROUP BY r, k)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n} JOIN e USING (r) GROUP BY k, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT k, i, CASE WHEN n IS NULL THEN x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM c{n} LEFT JOIN m{n} USING (k, i))")
    last = f"h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)"
    result = (
        "SELECT v.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256"
        f" FROM a{rounds} a JOIN v USING (r) JOIN h USING (k)"
    )
    return f"WITH {', '.join([*parts, last])} {result}"


OP13_SQL = _sql()
