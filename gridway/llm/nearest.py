"""Approximate nearest neighbours by cross-polytope hashing.

A hash function turns unit vectors by a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and
assigns them to the nearest signed axis. Each table joins several functions, more of them the more vectors there are, so
that its buckets stay small; vectors are posted in one bucket of every table, and queries probe the `probes` best of the
product of their nearest axes, best sums first. Vectors and queries meet by the first function's axis, are compared within
equal buckets only, and scored exactly in double precision; what all tables found is ranked once more.

A sample of vectors, one in 32 and at most `sample`, compared with all queries, gives each query a bound that its best `k`
reach for certain; candidates below it need not leave their task. The sample gives no neighbours itself. Few tables go first
and raise the bounds for the others, so that what leaves tasks does not grow with the buckets.

For inner products of vectors of unequal length, vectors are cut into bands of at most STEP powers of two of length. In
each band one coordinate is added that gives all its vectors the length of its longest; it is 0 for queries, so their
nearest direction is their largest product. Each query probes its buckets in every band. Of a band with few vectors a query
may need a large share: a band with fewer than SHALLOW vectors for each signed axis is hashed by the first function alone, and
the fewer vectors it has, the more axes are probed, up to all; then fewer tables are enough.

A query for which the tables found fewer than k neighbours is compared with all vectors, block by block. With `exhaustive`
that is done for every query instead of hashing.

Vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do those whose length differs from
the commonest. Rows that share an id count as one candidate with its best score. Ties go to the smaller id. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Vectors and queries that meet in one group.
BLOCK, QUERIES = 4096, 2048
#: Axes of one function that best-first probing considers, and the parts of all tables at which a round ends.
POOL, ROUNDS = 24, (1 / 32, 1 / 8, 1)
#: Logarithms to base 2: how far the lengths of a band may differ, and the bins the bands are made of.
STEP, BIN = 0.5, 1 / 16
#: Vectors for each signed axis below which a band is hashed by one function.
SHALLOW = 8
#: Tables are enough for a shallow band when a vector far from the query is missed no more often than this.
MISSED = 1e-4


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform."""
    n, d = x.shape
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], x.dtype), (3, d))
    for row in signs:
        x, h = x * row, 1
        while h < d:
            x = x.reshape(n, -1, 2, h)
            x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
            h *= 2
    return x


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the logarithms to base 2 of the lengths; neither overflows."""
    most = np.abs(x).max(axis=1)
    x = x / most[:, None]
    norm = np.linalg.norm(x, axis=1)
    return x / norm[:, None], np.log2(most) + np.log2(norm)


class Functions:
    """The hash functions of all tables, as one matrix: `count` for each table."""

    def __init__(self, size: int, added: int, tables: int, count: int):
        width = 1 << (size + added - 1).bit_length()
        self.width, self.tables, self.count = width, tables, count
        self.axes = min(width, 1 << (size - 1).bit_length())  # coordinates that are looked at; each has two signs
        turned = [rotated(np.eye(width), f)[: size + added, : self.axes] for f in range(tables * count)]
        self.matrix = np.concatenate(turned, axis=1)

    def some(self, first: int, end: int) -> Functions:
        """Those of the tables from first on, up to end."""
        out = copy.copy(self)
        out.tables, out.matrix = end - first, self.matrix[:, first * self.count * self.axes : end * self.count * self.axes]
        return out

    def turned(self, x: np.ndarray) -> np.ndarray:
        """(row, table, function, signed axis) -> how near x lies to it."""
        y = (x @ self.matrix[: x.shape[1]]).reshape(len(x), self.tables, self.count, self.axes)
        return np.concatenate([y, -y], axis=3)

    def buckets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, table) -> the first function's axis, and the number that the other functions' axes make."""
        axis = self.turned(x).argmax(axis=3)
        rest = np.zeros(axis.shape[:2], np.int64)
        for f in range(1, self.count):
            rest = rest * 2 * self.axes + axis[:, :, f]
        return axis[:, :, 0], rest

    def probed(self, y: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, table, probe) -> the same for the best buckets of the product, by the sum over the functions; y is turned."""
        pool = min(POOL, 2 * self.axes)
        best = np.argpartition(-y, pool - 1, axis=3)[..., :pool]
        near = np.take_along_axis(y, best, axis=3)
        first, rest, total = best[:, :, 0], np.zeros_like(best[:, :, 0]), near[:, :, 0]
        for f in range(1, self.count):
            shape = (*total.shape, pool)
            flat = (*shape[:2], shape[2] * pool)
            total = (total[..., None] + near[:, :, f, None, :]).reshape(flat)
            first = np.broadcast_to(first[..., None], shape).reshape(flat)
            rest = (rest[..., None] * 2 * self.axes + best[:, :, f, None, :]).reshape(flat)
            keep = probes if f == self.count - 1 else 4 * probes
            if total.shape[2] > keep:
                at = np.argpartition(-total, keep - 1, axis=2)[..., :keep]
                total, first, rest = (np.take_along_axis(z, at, axis=2) for z in (total, first, rest))
        return first, rest


def bands_of(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The bands of rows (v): their greatest lengths (logarithms), ascending, how many vectors each has, and whether lengths
    differ within bands."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, length = directions(batch.column(0).flatten().to_numpy().reshape(-1, size))
            yield pa.RecordBatch.from_pydict({"bin": np.floor(length / BIN).astype(np.int64), "length": length})

    # One row per bin; doubles have lengths for some 34,000 bins at most.
    bins = rows.select("v").mapInArrow(binned, "bin bigint, length double").groupBy("bin").agg(F.max("length").alias("top"), F.min("length").alias("low"), F.count("*").alias("n")).collect()
    tops: list[float] = []
    counts: list[int] = []
    uneven = False
    for one in sorted(bins, key=lambda r: -r.bin):
        if not tops or one.bin * BIN < tops[-1] - STEP:
            tops.append(one.top)
            counts.append(0)
        counts[-1] += one.n
        uneven |= one.low < tops[-1] - 1e-3
    return np.array(tops[::-1]), np.array(counts[::-1]), uneven


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)))
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def best_of(ids: np.ndarray, x: np.ndarray, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of x for q, exactly: ids and scores, best first, ties to the smaller id."""
    own = ids != query
    ids, exact = ids[own], (x[own] * q).sum(axis=1)
    best = np.lexsort((ids, -exact))[:k]
    return ids[best], exact[best]


def search(vectors: DataFrame, every: int = 20, k: int = 20, tables: int = 32, probes: int = 120, sample: int = 512, exhaustive: bool = False) -> DataFrame:
    """The k nearest of each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score."""
    rows = usable(vectors)
    kinds = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if kinds is None:
        return vectors.sparkSession.createDataFrame([], result)
    size = kinds.n
    # Single-precision vectors travel as such, which loses nothing.
    narrow = np.dtype("<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8")
    rows = rows.filter(F.size("v") == size).withColumn("vec_id", F.col("vec_id").cast("long"))
    tops, counts, uneven = bands_of(rows, size)
    signed = 2 << (size - 1).bit_length()
    shallow = counts < SHALLOW * signed
    axes = np.minimum(signed, np.ceil(signed * k / counts)).astype(int)  # probed in a shallow band
    with np.errstate(divide="ignore"):
        needed = np.maximum(1, np.ceil(np.log(MISSED) / np.log1p(-axes / signed)))
    functions = Functions(size, int(uneven), tables, max(2, int(math.log(counts.max()) / math.log(signed))))
    parts = -(-int(counts.max()) // (signed * BLOCK))
    spark = vectors.sparkSession
    seen = {r.vec_id: r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(sample, int(counts.sum()) // 32)).collect()}  # one of each id
    sampled = spark.sparkContext.broadcast((np.array(list(seen)), np.array(list(seen.values())).reshape(-1, size)))

    def from_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = np.full(batch.num_rows, -np.inf)
            for n, (query, q) in enumerate(zip(batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, size), strict=True)):
                score = best_of(*sampled.value, query, q, k)[1]
                if len(score) == k:
                    reach[n] = score[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach)], ["vec_id", "v", "least"])

    columns = ["t", "axis", "part", "asks", "vec_id", "least", "rest", "v"]
    schema = "t int, axis int, part int, asks boolean, vec_id bigint, least double, rest array<bigint>, v binary"

    def made(x: np.ndarray, ids: np.ndarray, least: np.ndarray | None, row: np.ndarray, t: np.ndarray, axis: np.ndarray, rest: np.ndarray) -> pa.RecordBatch:
        """One row for each vector, table, axis and part, with all that it has to do with of the rest; queries have a least score."""
        part = rest % parts
        order = np.lexsort((part, axis, t, row))
        row, t, axis, part, rest = (z[order] for z in (row, t, axis, part, rest))
        at = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(t) != 0) | (np.diff(axis) != 0) | (np.diff(part) != 0)])) if len(row) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), pa.array(rest.astype(np.int64)))
        v = pa.array([z.astype(narrow).tobytes() for z in x], pa.binary()).take(pa.array(row[at]))
        numbers = [pa.array(z[at].astype(np.int32)) for z in (t, axis, part)]
        reach = np.zeros(len(at)) if least is None else least[row[at]]
        return pa.RecordBatch.from_arrays([*numbers, pa.array(np.full(len(at), least is not None)), pa.array(ids[row[at]]), pa.array(reach), lists, v], columns)

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                yield piece.column(0).to_numpy(), piece.column(1).flatten().to_numpy().reshape(-1, size), piece

    def meeting(first: int, end: int, asking: DataFrame) -> DataFrame:
        """Rows of vectors and of queries (vec_id, v, least) in the buckets of the tables from first to end."""
        shared = spark.sparkContext.broadcast(functions.some(first, end))

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_functions = shared.value
            for ids, x, _ in vectors_of(batches):
                unit, length = directions(x)
                band = np.minimum(np.searchsorted(tops, length - 1e-9), len(tops) - 1)
                flat = np.zeros((len(x), size + int(uneven)))
                flat[:, :size] = unit * np.exp2(np.minimum(length - tops[band], 0))[:, None]
                if uneven:
                    flat[:, size] = np.sqrt(np.maximum(0, 1 - (flat**2).sum(axis=1)))
                axis, rest = own_functions.buckets(flat)
                rest[shallow[band]] = 0
                axis = axis + band[:, None] * 2 * functions.axes
                own, at = np.nonzero(np.arange(first, end)[None, :] < np.where(shallow, needed, tables)[band][:, None])
                yield made(x, ids, None, own, at + first, axis[own, at], rest[own, at])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x, piece in vectors_of(batches):
                # Products of equal vectors differ in their last bits.
                least = piece.column(2).to_numpy(zero_copy_only=False)
                least = least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0))
                turned = shared.value.turned(directions(x)[0])
                if not shallow.all():
                    bucket, rest = shared.value.probed(turned, probes)
                    row, table, _ = np.indices(bucket.shape).reshape(3, -1)
                    for b in np.flatnonzero(~shallow).tolist():
                        yield made(x, ids, least, row, table + first, bucket.ravel() + b * 2 * functions.axes, rest.ravel())
                if shallow.any():
                    nearest = np.argsort(-turned[:, :, 0], axis=2)
                    for b in np.flatnonzero(shallow & (needed > first)).tolist():
                        bucket = nearest[:, : int(min(end, needed[b])) - first, : axes[b]]
                        row, table, _ = np.indices(bucket.shape).reshape(3, -1)
                        yield made(x, ids, least, row, table + first, bucket.ravel() + b * 2 * functions.axes, np.zeros(bucket.size, np.int64))

        return rows.mapInArrow(post, schema).unionByName(asking.select("vec_id", "v", "least").mapInArrow(ask, schema))

    key = ["t", "axis", "part"]
    place = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def dealt(posted: DataFrame) -> DataFrame:
        """Where many vectors or queries share an axis and part, both are cut, and each piece meets each."""
        sums = posted.groupBy(*key).agg(F.ceil(F.count_if(~F.col("asks")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if("asks") / QUERIES).cast("int").alias("pieces"))
        cut = posted.join(sums.filter("blocks > 1 OR pieces > 1"), key, "left").fillna(1, ["blocks", "pieces"])
        base = cut.filter("NOT asks").withColumn("block", place("blocks")).withColumn("piece", every_one("pieces"))
        asked = cut.filter("asks").withColumn("piece", place("pieces")).withColumn("block", every_one("blocks"))
        return base.unionByName(asked).select(*columns, "block", "piece")

    def meet(table: pa.Table) -> pa.Table:
        is_query = table["asks"].to_numpy()
        ids, least = table["vec_id"].to_numpy(), table["least"].to_numpy()
        lists = table["rest"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        bucket, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lengths)
        order = np.argsort(bucket, kind="stable")
        bucket, owner = bucket[order], owner[order]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0])) if len(bucket) else []
        v = np.frombuffer(b"".join(table["v"].to_pylist()), narrow).reshape(-1, size).astype(float)
        queries, found = [], []
        for a, b in zip(heads, [*heads[1:], len(bucket)], strict=True):
            own = owner[a:b]
            q, x = own[is_query[own]], own[~is_query[own]]
            if len(q) and len(x):
                near = v[q] @ v[x].T
                i, j = np.nonzero((near >= least[q][:, None]) & (ids[q][:, None] != ids[x][None, :]))
                queries.append(q[i])
                found.append(x[j])
        queries, found = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (queries, found))
        exact = (v[found] * v[queries]).sum(axis=1)
        order = np.lexsort((ids[found], -exact, queries))
        queries, found, exact = queries[order], found[order], exact[order]
        head = np.flatnonzero(np.concatenate([[True], np.diff(queries) != 0])) if len(queries) else np.zeros(0, np.int64)
        rank = np.arange(len(queries)) - np.repeat(head, np.diff(np.append(head, len(queries))))
        return pa.table({"query_id": ids[queries[rank < k]], "vec_id": ids[found[rank < k]], "score": exact[rank < k]})

    scored = "query_id bigint, vec_id bigint, score double"

    def ranked(found: DataFrame) -> DataFrame:
        one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return one.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)

    def whole(side: DataFrame, asks: bool) -> DataFrame:
        """All vectors, or all queries, in one bucket, which is dealt in blocks."""

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x, _ in vectors_of(batches):
                zero = np.zeros(len(x), np.int64)
                yield made(x, ids, np.full(len(x), -np.inf) if asks else None, np.arange(len(x)), zero, zero, zero)

        return side.select("vec_id", "v").mapInArrow(one, schema)

    def met(posted: DataFrame) -> DataFrame:
        return dealt(posted).groupBy(*key, "block", "piece").applyInArrow(meet, scored)

    queries = rows.filter(F.col("vec_id") % every == 0)
    if exhaustive:
        return ranked(met(whole(rows, False).unionByName(whole(queries, True)))).select("query_id", "rank", "vec_id", "score")
    bounded = common.checkpoint(queries.mapInArrow(from_sample, "vec_id bigint, v array<double>, least double"))
    best, first = spark.createDataFrame([], f"{scored}, rank int"), 0
    reached = lambda: best.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("found"))
    for part in ROUNDS:
        end = max(first + 1, round(tables * part))
        if first >= tables:
            break
        least = F.greatest("least", F.when(F.col("n") == k, F.col("found")))
        asking = bounded.join(reached(), "vec_id", "left").withColumn("least", least)
        found = met(meeting(first, min(end, tables), asking))
        best, first = common.checkpoint(ranked(best.select("query_id", "vec_id", "score").unionByName(found))), end
    full = reached().filter(F.col("n") == k)
    short = common.checkpoint(queries.join(full, "vec_id", "left_anti"))
    if not short.isEmpty():
        rest = met(whole(rows, False).unionByName(whole(short, True)))
        best = ranked(best.select("query_id", "vec_id", "score").unionByName(rest))
    return best.select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
