"""Clustering around integer centroids; a vector's nearest one is searched in an annulus of norms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Components of a vector, what they are multiplied by before they are cut to integers, centroids and rounds.
DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Prefix of the hashed vector numbers that draw the first centroids.
SEED = 1
#: Rows that distances are computed for at a time.
SLICE = 4096


def integers(lists: pa.Array, dims: int = DIMS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): the positions of the vectors with exactly ``dims`` components, none null or not finite, and their
    floor(scale * x) as int64. Vectors with a component of 2^30 / sqrt(dims) or more after that are left out as well, for
    a squared distance has to fit in 63 bits."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    rows = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
    found = lists.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(found * scale)
        good = (np.abs(scaled) < 2.0**30 / dims**0.5).all(axis=1)
    return rows[good], scaled[good].astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the centroid nearest to each row of ``x``, both int64; of equally near ones the
    smallest number.

    Centroids are sorted by norm. The distance to the one of the nearest norm is an upper bound u, and no centroid whose
    norm differs from the vector's by more than u can be as near; those within, ends included, are a range that two binary
    searches find and are compared exactly, in integers. Norms are rounded, so the ring is widened by more than that.
    """
    norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    norms, sorted_ = norms[order], centroids[order]
    number, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), SLICE):
        own = x[at : at + SLICE]
        size = np.sqrt((own.astype(np.float64) ** 2).sum(axis=1))
        above = np.minimum(np.searchsorted(norms, size), len(norms) - 1)
        below = np.maximum(above - 1, 0)
        seed = np.where(size - norms[below] < norms[above] - size, below, above)
        best = _squares(own, sorted_[seed])
        which = order[seed]
        bound = np.sqrt(best.astype(np.float64)) + 1e-6 + 1e-9 * (size + norms[-1])
        low, high = np.searchsorted(norms, size - bound, "left"), np.searchsorted(norms, size + bound, "right")
        for step in range(int((high - low).max(initial=0))):
            row = np.flatnonzero(low + step < high)
            candidate = low[row] + step
            d, c = _squares(own[row], sorted_[candidate]), order[candidate]
            closer = (d < best[row]) | ((d == best[row]) & (c < which[row]))
            best[row[closer]], which[row[closer]] = d[closer], c[closer]
        number[at : at + SLICE], distance[at : at + SLICE] = which, best
    return number, distance


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def first_centroids(vectors: DataFrame, key: str, embedding: str, dims: int, scale: int, count: int) -> np.ndarray:
    """The kept vectors of the ``count`` smallest lowercase-hex sha256 of ``1:<key>``, in that order; a null key counts as
    an empty one, and vectors of equal keys follow their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(1), dims, scale)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dims, x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], names=["id", "x"])

    drawn = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    kept = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("x")).mapInArrow(
        run, "id long, x array<bigint>"
    )
    found = kept.orderBy(drawn, "x").limit(count).collect()
    return np.array([r["x"] for r in found], dtype=np.int64).reshape(-1, dims)


def moved(vectors: DataFrame, embedding: str, centroids: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The centroids after one round: the componentwise floor(sum / count) of the vectors nearest to each; those without
    vectors stay. A task returns one row of sums for each centroid, which Spark adds up by component."""
    count, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count, dims + 1), np.int64)
        for batch in batches:
            _, x = integers(batch.column(0), dims, scale)
            number, _ = nearest(x, centroids)
            by = np.argsort(number, kind="stable")
            seen, starts = np.unique(number[by], return_index=True)
            if len(seen):
                sums[seen, :dims] += np.add.reduceat(x[by], starts, axis=0)
                sums[:, dims] += np.bincount(number, minlength=count)
        seen = np.flatnonzero(sums[:, dims])
        lists = pa.ListArray.from_arrays(np.arange(len(seen) + 1, dtype=np.int32) * (dims + 1), sums[seen].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(seen), lists], names=["cluster", "sums"])

    parts = vectors.select(F.col(embedding)).mapInArrow(run, "cluster long, sums array<bigint>")
    totals = parts.select("cluster", F.posexplode("sums").alias("i", "part")).groupBy("cluster", "i")
    out = np.zeros((count, dims + 1), object)
    for r in totals.agg(F.sum("part").alias("total")).collect():  # count * (dims + 1) rows at most
        out[r["cluster"], r["i"]] = r["total"]
    return np.array([[s // n for s in sums] if n else old for *sums, n, old in zip(*out.T, centroids.tolist(), strict=True)])


def cluster_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    dims: int = DIMS,
    scale: int = SCALE,
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, after ``rounds`` rounds of
    assigning vectors to the nearest of ``count`` centroids and moving these to the floor of their vectors' mean.

    Vectors are kept as ``integers`` says; null vectors, other lengths and components that are null or not finite leave.
    Null keys count as empty and repeated rows count each; with fewer than ``count`` kept vectors each starts a cluster;
    an empty table gives an empty result. Columns besides the two are ignored. Only centroids pass the driver.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(key).cast("long").alias(key), F.col(embedding).alias(embedding))
    centroids = first_centroids(vectors, key, embedding, dims, scale, count)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(vectors, embedding, centroids, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.column(1), dims, scale)
            number, distance = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(number.astype(np.int32)), pa.array(distance)],
                names=[key, "cluster", "distance"],
            )

    schema = f"`{key}` long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = cut(vectors.mapInArrow(run, schema), "clusters")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame(
        [(c, s, digests[c]) for c, s in sorted(sums.items())],
        "cluster int, cluster_inertia long, centroid_sha256 string",
    )
    # A row for each cluster, so at most ``count``.
    return assigned.join(F.broadcast(about), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256"
    )


def op13_annulus_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster; nulls, ties, repeated rows and empty tables as ``cluster_vectors`` says."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _assigned(of: str) -> str:
    return f"""(SELECT r, vec_id, e, c, d FROM (SELECT r, vec_id, v.e, c.c, CAST(list_sum([p[1] * p[1] FOR p IN [[v.e[i] - c.e[i]] FOR i IN range(1, {DIMS + 1})]]) AS BIGINT) AS d FROM v, {of} c)
 QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""


def _next(step: int) -> str:
    return f"""a{step} AS MATERIALIZED {_assigned(f"c{step}")},
s{step} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range({DIMS})) AS i FROM a{step}) GROUP BY c, i),
c{step + 1} AS MATERIALIZED (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS e FROM s{step} GROUP BY c
 UNION ALL SELECT c, e FROM c{step} WHERE c NOT IN (SELECT c FROM s{step}))"""


OP13_SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
 FROM embeddings WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT e, sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v) ORDER BY h, e LIMIT {CENTROIDS}),
{", ".join(_next(i) for i in range(ROUNDS))},
a AS MATERIALIZED {_assigned(f"c{ROUNDS}")}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(k.e, ',')) AS centroid_sha256
FROM a JOIN c{ROUNDS} k ON k.c = a.c"""
