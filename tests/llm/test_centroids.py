"""Centroid clustering against plain Python integers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from gridway.llm import centroids
from gridway.llm.queries import ORACLES, QUERIES
from oracle import SMALL, expected, rows

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(data, k, rounds, seed=3, dimensions=4):
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in data if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    hashed = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "")
    centres = [p for _, p in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:k]]
    square = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))
    own = lambda p: min(range(len(centres)), key=lambda c: (square(p, centres[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(own(p), []).append(p)
        for c, g in groups.items():
            centres[c] = tuple(sum(x) // len(g) for x in zip(*g, strict=True))
    found = [(i, own(p), square(p, centres[own(p)])) for i, p in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sum(e for _, b, e in found if b == c), sum(e for *_, e in found), digest[c]) for i, c, d in found), key=str)


def found(df, **options):
    return sorted((tuple(r) for r in centroids.cluster(df, dimensions=4, **options).collect()), key=str)


@pytest.mark.parametrize("k,rounds", [(3, 0), (3, 4), (8, 10), (40, 2)])
def test_matches_plain_integers(spark, k, rounds):
    rng = random.Random(k)
    data = [(n, [rng.uniform(-1, 1) for _ in range(4)]) for n in range(60)]
    data += [(5, data[5][1]), (5, data[6][1]), (None, data[7][1]), (70, [2.0, -0.0, 0.0, 1e-9])]
    data += [(80, None), (81, []), (82, [1.0] * 5), (83, [1.0, None, 1.0, 1.0]), (84, [math.nan, 1.0, 1.0, 1.0]), (85, [math.inf, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, SCHEMA)
    for n in (1, 5):
        assert found(df.repartition(n), k=k, rounds=rounds) == brute(data, k, rounds)


def test_ties_empty_centroids_and_equal_points(spark):
    data = [(n, [0.0, 0.0, 0.0, 0.0]) for n in range(6)] + [(9, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(data, SCHEMA)
    assert found(df, k=4, rounds=3) == brute(data, 4, 3)


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(df).count() == 0
    one = spark.createDataFrame([(1, [0.5] * 4)], SCHEMA).select("*", *(F.lit("x").alias(c) for c in "point cluster component total n distance inertia".split()))
    assert [tuple(r)[:5] for r in centroids.cluster(one, dimensions=4).collect()] == [(1, 0, 0, 0, 0)]


def test_text_ids_and_large_longs(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, [0.25] * 4), (None, [0.5] * 4)], SCHEMA)
    assert {r.vec_id for r in centroids.cluster(df, dimensions=4).collect()} == {big, None}


def test_components_beyond_longs_are_refused(spark):
    df = spark.createDataFrame([(1, [1e6] * 4)], SCHEMA)
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.cluster(df, dimensions=4).collect()


def test_query_matches_sql(spark):
    name = "op11_centroid_clustering"
    assert rows(QUERIES[name](spark, SMALL).toPandas()) == rows(expected(ORACLES[name]))
