"""Language identification: held-out accuracy, and predictions against a plain nearest centroid."""

import numpy as np
from pyspark.sql import functions as F

from gridway.llm import language_id

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = language_id.op3_language_id(spark, SMALL).select("doc_id", "held_out", "lang_pred", "score")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(docs, "doc_id").filter("held_out AND lang IS NOT NULL AND text IS NOT NULL").collect()
    assert len(rows) > 150 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95


def test_predictions_are_the_nearest_centroids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id % 5 = 0").select("doc_id", "text", "lang")
    model = language_id.fit(docs, per_language=40)
    found = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for r in docs.filter(F.col("text").rlike("[a-z]")).collect():
        v = np.log1p(language_id.counts(r.text).astype(float)) * model.idf
        near = model.centres @ (v / np.linalg.norm(v))
        best = max(near)
        assert abs(found[r.doc_id].score - min(1, max(0, best))) < 1e-4
        assert found[r.doc_id].lang_pred in {lang for lang, x in zip(model.languages, near, strict=True) if x > best - 1e-5}


def test_sample_is_the_same_however_it_is_dealt(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    one, other = (language_id.fit(docs.repartition(n), per_language=30) for n in (1, 9))
    assert one.languages == other.languages and np.allclose(one.idf, other.idf) and np.allclose(one.centres, other.centres, atol=1e-4)
