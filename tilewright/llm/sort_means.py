"""Centroid clustering by sort-means (operator 11).

Each round orders, for every centroid, the other centroids by their distance
from it.  A vector starts at the centroid it had and looks at the others in that
order; once one lies strictly further from its own centroid than twice the
vector's distance, neither it nor any later one can be as near, and the scan ends.
At exactly twice the distance a tie is possible, so the scan goes on.

All arithmetic is in integers: components are ``floor(scale * x)``, distances
are squared, and a new centroid is the floor of sum over count.  A round is one
pass: tasks read the vectors with the clusters they had, write them with the new
ones, and end with a row of sums for each cluster, which Spark adds up.  Only
centroids (a fixed number) pass through the driver.  Rounds write by turns to two
tables in the shared folder, so a round's input is intact until it has ended.

Vectors that are null, hold a null or a value that is not finite, or have another
number of components are left out.  Ties go to the smaller cluster number.
Repeated rows are vectors of their own (two of them may both start as centroids).
A null id is kept, and starts as a centroid only where ids are too few.  With fewer vectors than centroids
there are as many centroids as vectors; an empty table gives no rows.  Other columns are not looked at.
A scaled component beyond 2**25 is an error, as distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frees, scratch, table
from .vectors import packed, scaled, unpacked

K, DIM, ROUNDS, SCALE = 8, 64, 10, 1024
_FIELDS = "vec_id long, vector binary, cluster int, distance long, n long, total array<long>"


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = x - centroid
    return np.einsum("ij,ij->i", apart, apart)


class Centroids:
    """Centroids with the order in which each one's vectors look at the others."""

    def __init__(self, places: np.ndarray):
        self.places = places
        self.between = np.array([squared(places, c) for c in places]).reshape(len(places), len(places))
        self.order = [[int(j) for j in np.argsort(row, kind="stable") if j != a] for a, row in enumerate(self.between)]
        self.looked_at = 0

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector and its squared distance, from the centroids ``before``."""
        cluster, distance = before.copy(), np.zeros(len(x), dtype=np.int64)
        for a in np.unique(before):
            mine = np.flatnonzero(before == a)
            vectors = x[mine]
            own = squared(vectors, self.places[a])
            best, number = own.copy(), np.full(len(mine), a)
            self.looked_at += len(mine)
            open_ = np.arange(len(mine))
            for j in self.order[a]:
                open_ = open_[self.between[a, j] <= 4 * own[open_]]
                if not len(open_):
                    break
                self.looked_at += len(open_)
                d = squared(vectors[open_], self.places[j])
                nearer = (d < best[open_]) | (d == best[open_]) & (j < number[open_])
                best[open_[nearer]], number[open_[nearer]] = d[nearer], j
            cluster[mine], distance[mine] = number, best
        return cluster, distance


def kept(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """The whole vectors of ``dim`` components as integers, all of cluster 0."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in scaled(batch.column(1), scale, 2.0**25):
                if matrix.shape[1] == dim:
                    yield _rows(batch.column(0).take(pa.array(at)), matrix.astype(np.int64), np.zeros(len(at), dtype=np.int32), np.zeros(len(at), dtype=np.int64))

    return vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, _FIELDS)


def _rows(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int64())
    return pa.RecordBatch.from_arrays([ids, packed(x.astype(np.int32)), pa.array(cluster.astype(np.int32)), pa.array(distance), none, pa.nulls(len(ids), pa.list_(pa.int64()))], names=["vec_id", "vector", "cluster", "distance", "n", "total"])


def assigned(points: DataFrame, places: np.ndarray) -> DataFrame:
    """The vectors with their nearest centroid, and at a task's end a row of sums for each of its clusters.

    Such a row has ``n`` (the others have null there), the sum of distances, and the sums of components.
    """
    held = Centroids(places)

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = places.shape
        n, far, total = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpacked(batch.column(1), np.int32).astype(np.int64)
            cluster, distance = held.nearest(x, batch.column(2).to_numpy().astype(np.int64))
            for a in np.unique(cluster):
                mine = cluster == a
                n[a] += mine.sum()
                far[a] += distance[mine].sum()
                total[a] += x[mine].sum(axis=0)
            yield _rows(batch.column(0), x, cluster, distance)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some.astype(np.int32)), pa.array(far[some]), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
            names=["vec_id", "vector", "cluster", "distance", "n", "total"],
        )

    return points.where("n IS NULL").select("vec_id", "vector", "cluster").mapInArrow(run, _FIELDS)


def first_centroids(points: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``3:<id>``, null ids last, in that order."""
    hashed = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    rows = points.select(hashed.alias("hashed"), "vector").orderBy(F.col("hashed").asc_nulls_last(), "vector").limit(k).collect()
    return np.array([np.frombuffer(r.vector, dtype=np.int32) for r in rows], dtype=np.int64)


def moved(written: DataFrame, places: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of sum over count, empty ones as they were."""
    sums = written.where("n IS NOT NULL").select("cluster", "n", F.posexplode("total").alias("place", "part"))
    out = places.copy()
    for r in sums.groupBy("cluster", "place").agg(F.sum("part").alias("part"), F.sum("n").alias("n")).collect():  # clusters x components
        out[r.cluster, r.place] = r.part // r.n
    return out


def cluster(vectors: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Per vector: vec_id, vector (int32 components), cluster, squared distance; and the final centroids.

    The table also has each task's rows of sums, those with ``n``.
    """
    spark = vectors.sparkSession
    turns = [scratch(spark, "means"), scratch(spark, "means")]
    kept(vectors, dim, scale, id_col, vector_col).write.parquet(turns[0])
    points = spark.read.schema(_FIELDS).parquet(turns[0])
    places = first_centroids(points, k)
    if not len(places):
        return points, np.zeros((0, dim), dtype=np.int64)
    for r in range(rounds + 1):
        assigned(points, places).write.mode("overwrite").parquet(turns[1 - r % 2])
        points = spark.read.schema(_FIELDS).parquet(turns[1 - r % 2])
        if r < rounds:
            places = moved(points, places)
    return points, places


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster after ten rounds, with the inertias and the centroid's digest."""
    points, places = cluster(table(spark, sf_dir, "embeddings"))
    names = [(a, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for a, c in enumerate(places)]
    each = points.where("n IS NOT NULL").groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    inertia = {r["cluster"]: r.cluster_inertia for r in each}
    final = spark.createDataFrame([(a, inertia.get(a, 0), sum(inertia.values()), name) for a, name in names], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return points.where("n IS NULL").select("vec_id", "cluster", "distance").join(F.broadcast(final), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Every round spelled out: assign, then floor the means."""
    steps = [
        f"""pts AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM pts ORDER BY h LIMIT {K}))",
    ]
    apart = "CAST(list_sum(list_transform(list_zip(p.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    for r in range(ROUNDS + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT p.vec_id, p.v, q.c, {apart} AS d FROM pts p CROSS JOIN c{r} q)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT c, i, (s - ((s % n) + n) % n) // n AS x FROM
  (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {DIM + 1})) AS i FROM d{r}) GROUP BY c, i))""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT q.c, coalesce(m.v, q.v) AS v FROM c{r} q LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM m{r} GROUP BY c) m ON q.c = m.c)")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, CAST(d.c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY d.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(q.v, ',')) AS centroid_sha256
FROM d{ROUNDS} d JOIN c{ROUNDS} q ON d.c = q.c"""


ORACLE_SQL = _sql()
