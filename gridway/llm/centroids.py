"""Centroid clustering by plain Lloyd rounds in integers.

Vectors of exactly `dimensions` components, none null or non-finite, become integers floor(scale * x); all others are left out.
The first centroids are the k vectors whose ids have the smallest SHA-256. Each round broadcasts the centroids (k times
`dimensions` numbers, whatever the data), assigns every vector to the nearest one, ties to the lower number, and replaces each
centroid that has vectors by the floor of their mean. Tasks add up their own vectors; what they pass on, a row for each centroid
and component, is merged by groupBy. Sums and quotients are exact, so results do not depend on partitions.

Rows that share an id are vectors of their own; among equal hashes the smaller vector is taken first, and null ids come last. With
fewer than k vectors there are fewer centroids; without any the result is empty. A centroid without vectors stays where it is. Rounds
stop early only where no centroid moved, as all later rounds would repeat that one. A component above `LARGEST` is an error, since
squared distances of such vectors do not fit a long. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The largest absolute value of floor(scale * x): 64 squared differences of twice this stay below 2 ** 63.
LARGEST = (1 << 27) - 1
#: Vectors compared at a time.
ROWS = 4096


def usable(vector: Column, dimensions: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def quantised(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, point): the components' integers."""

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * float(scale)
        return F.when(F.abs(scaled) < LARGEST, F.floor(scaled).cast("int")).otherwise(F.raise_error(f"a component is above {LARGEST / scale:.0f}: squared distances would not fit a long").cast("int"))

    return vectors.filter(usable(F.col("embedding"), dimensions)).select("vec_id", F.transform("embedding", whole).alias("point"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid, the lowest of several, and the squared distance to it."""
    distances = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    own = distances.argmin(axis=1)
    return own, distances[np.arange(len(x)), own]


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            part = batch.iloc[start : start + ROWS]
            yield part, np.stack(part.point.to_numpy()).astype(np.int64)


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k points with the smallest hashes: each task passes on k rows at most."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(F.asc_nulls_last(key), "point").limit(k).select("point").collect()
    return np.array([r.point for r in rows], np.int64)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        old = shared.value
        total, n = np.zeros_like(old), np.zeros(len(old), np.int64)
        for _, x in slices(batches):
            own, _ = nearest(x, old)
            for c in np.unique(own):
                total[c] += x[own == c].sum(axis=0)
            n += np.bincount(own, minlength=len(old))
        cluster, component = (a.ravel() for a in np.indices(old.shape))
        some = n[cluster] > 0
        yield pd.DataFrame({"cluster": cluster[some], "component": component[some], "total": total.ravel()[some], "n": n[cluster][some]})

    parts = points.select("point").mapInPandas(sums, "cluster int, component int, total bigint, n bigint")
    # Sums over all tasks may pass a long.
    merged = parts.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    new = centroids.copy()
    for r in merged:
        new[r.cluster, r.component] = int(r.total) // r.n
    shared.unpersist()
    return new


def lloyd(points: DataFrame, k: int, rounds: int, seed: int) -> np.ndarray:
    centroids = first_centroids(points, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        before, centroids = centroids, moved(points, centroids)
        if (before == centroids).all():
            break
    return centroids


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every point."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in slices(batches):
            own, distance = nearest(x, shared.value)
            yield pd.DataFrame({"vec_id": part.vec_id, "cluster": own, "distance": distance})

    # Ids go to Python as text: pandas would make floats of longs among nulls.
    kind = points.schema["vec_id"].dataType.simpleString()
    named = points.select(F.col("vec_id").cast("string"), "point").mapInPandas(label, "vec_id string, cluster int, distance bigint")
    return named.select(F.col("vec_id").cast(kind), "cluster", "distance")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64, scale: int = 1024) -> DataFrame:
    """Per usable row of vectors (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    points = common.checkpoint(quantised(vectors, dimensions, scale))
    centroids = lloyd(points, k, rounds, seed)
    found = common.checkpoint(assigned(points, centroids))
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    whole = sum(inertia.values())
    # One row for each of the k centroids.
    facts = spark.createDataFrame([(c, n, whole, digest[c]) for c, n in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle(k: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64) -> str:
    steps = [
        f"""points AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row_no, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS point
            FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, point AS centroid
            FROM points ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})""",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT row_no, unnest(point) AS x, generate_subscripts(point, 1) AS component, cluster, distance FROM (
            SELECT row_no, any_value(point) AS point, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
                SELECT row_no, point, cluster, list_sum(list_transform(list_zip(point, centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM points, c{n}) GROUP BY row_no))""")
        if n < rounds:
            steps.append(f"""m{n} AS MATERIALIZED (SELECT cluster, list(mean ORDER BY component) AS centroid FROM (
                SELECT cluster, component, CASE WHEN sum(x) % count(*) < 0 THEN sum(x) // count(*) - 1 ELSE sum(x) // count(*) END::BIGINT AS mean FROM a{n} GROUP BY ALL) GROUP BY cluster)""")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.centroid, c.centroid) AS centroid FROM c{n} c LEFT JOIN m{n} m USING (cluster))")
    return f"""WITH {", ".join(steps)}
        SELECT p.vec_id, a.cluster::INT AS cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c.centroid, ',')) AS centroid_sha256
        FROM (SELECT DISTINCT row_no, cluster, distance FROM a{rounds}) a JOIN points p USING (row_no) JOIN c{rounds} c ON c.cluster = a.cluster"""


ORACLE = {"op11_centroid_clustering": _oracle()}
