"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed byte pairs and triples. Learning takes at most `per_language` labelled
texts of each language (those with the smallest hash of their id), inverse document frequencies and `clusters` spherical
k-means centroids for each. A text gets the language of the centroid with the largest cosine; it is `rejected` when it
lies further from that centroid than nearly all of the centroid's own texts.

Null texts and texts without letters are `und`, score 0. Ties go to the language that sorts first. Without any labelled
text everything is `und`. Rows that share an id are predicted each by itself. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 2048
LETTER = re.compile(r"[^\W\d_]")
STRETCH = 1 << 20


def counts(text: str) -> np.ndarray:
    """How often each hashed byte pair and triple occurs in the lower-cased words of the text.

    What is between words (ASCII but letters) counts as one space, so that decoration does not drown the language.
    """
    data = np.frombuffer(text.lower().encode(), np.uint8)
    data = np.where((data >= 128) | ((data >= 97) & (data <= 122)), data, np.uint8(32))
    data = data[~((data == 32) & np.concatenate([[False], data[:-1] == 32]))] if len(data) else data
    out = np.zeros(DIMENSIONS, np.float32)
    for at in range(0, max(1, len(data)), STRETCH):
        a = data[at : at + STRETCH + 2].astype(np.uint32)
        pair = a[:-1] * 257 + a[1:]
        triple = pair[:-1] * 263 + a[2:] + 70_001
        for x in (pair[:STRETCH], triple[:STRETCH]):
            out += np.bincount((x * np.uint32(2654435761)) >> np.uint32(21), minlength=DIMENSIONS)
    return out


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(rows) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def cluster(rows: np.ndarray, clusters: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from rows spread evenly over the sample."""
    centres = rows[np.linspace(0, len(rows) - 1, min(clusters, len(rows))).astype(int)]
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


class Centroids:
    """What learning leaves: a few centroids for each language."""

    def __init__(self, languages: list[str], centres: np.ndarray, nearest: np.ndarray, idf: np.ndarray):
        self.languages, self.centres, self.nearest, self.idf = languages, centres, nearest, idf


def fit(labelled: DataFrame, per_language: int = 2000, clusters: int = 4, quantile: float = 0.001) -> Centroids:
    """Learn from rows (doc_id, text, lang). The sample is bounded by per_language; so is all that is collected."""
    spark = labelled.sparkSession
    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    # A language that most texts have is ranked in parts first, each of which passes on per_language rows at most.
    ids, order = usable.select("doc_id", "lang"), [F.xxhash64("doc_id"), "doc_id"]
    ids = ids.withColumn("part", common.salt(common.partitions(spark), "doc_id"))
    for group in (("lang", "part"), ("lang",)):
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("n") <= per_language)
    ids = ids.select("doc_id", "lang").distinct()
    sample = usable.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([counts(t.as_py()).tobytes() for t in part.column(1)], pa.binary())], ["lang", "vector"])

    rows = common.checkpoint(sample.mapInArrow(vectors, "lang string, vector binary"))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMENSIONS)
        for batch in batches:
            for v in batch.column(0):
                n, df = n + 1, df + (np.frombuffer(v.as_py(), np.float32) > 0)
        yield pa.RecordBatch.from_pydict({"n": [n], "df": [df.tobytes()]})

    found = rows.select("vector").mapInArrow(present, "n bigint, df binary").collect()
    n, df = sum(r.n for r in found), sum((np.frombuffer(r.df) for r in found), np.zeros(DIMENSIONS))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        own = weighted(np.stack([np.frombuffer(v, np.float32) for v in group.vector]), idf)
        own = own[np.lexsort(own.T[:8])]
        centres = cluster(own, clusters)
        near = own @ centres.T
        least = [float(np.quantile(near[near.argmax(axis=1) == k, k], quantile)) if (near.argmax(axis=1) == k).any() else 0.0 for k in range(len(centres))]
        return pd.DataFrame({"lang": group.lang.iloc[0], "centre": [c.astype(np.float32).tobytes() for c in centres], "nearest": least})

    learnt = sorted(rows.groupBy("lang").applyInPandas(learn, "lang string, centre binary, nearest double").collect())
    centres = np.stack([np.frombuffer(r.centre, np.float32) for r in learnt]) if learnt else np.zeros((0, DIMENSIONS), np.float32)
    return Centroids([r.lang for r in learnt], centres, np.array([r.nearest for r in learnt]), idf)


def predict(docs: DataFrame, model: Centroids, slack: float = 0.5) -> DataFrame:
    """Per row of docs (doc_id, text): lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(1).to_pylist()
                usable = [bool(t and LETTER.search(t)) and len(model.languages) > 0 for t in texts]
                lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), [True] * len(texts)
                if any(usable):
                    near = weighted(np.stack([counts(t) for t, u in zip(texts, usable, strict=True) if u]), model.idf) @ model.centres.T
                    for i, row in zip(np.flatnonzero(usable), near, strict=True):
                        k = int(row.argmax())
                        lang[i], score[i], rejected[i] = model.languages[k], min(1.0, max(0.0, float(row[k]))), bool(row[k] < slack * model.nearest[k])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(label, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = predict(docs, fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
