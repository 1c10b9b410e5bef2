"""Every operator on awkward input: null, repeated and text ids, null, empty, blank and very long texts, and extra columns."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridway.llm import exact_dedup, language_id, minhash, mixing, nearest, packing, personal_data, quality, suffix_dedup, token_counts

#: Names that operators use inside, or could.
EXTRA = "n copies batch rank bits token row hash key size part word length piece keep_id digest component node family a b i j text_sha256 run hit bucket class nth of place kept score t axis".split()
WORDS = "the of and river stone winter garden letter music table".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    long = sentence(rng, 180_000)  # over a mebibyte
    texts = [(1, a), (2, b), (2, c), (2, c), (None, a), (None, "short"), (None, None), (3, None), (3, ""), (4, " \n"), (5, long), (6, long + " end"), (7, a), (8, a + " more")]
    return [(i, t, "en" if k % 3 else None, "s" if k % 2 else None, k) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, at int").repartition(3).cache()
    return df.select("*", *(F.lit("x").alias(c) for c in EXTRA))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id bigint, quality int, toxic int")


def ids(found):
    return Counter(r.doc_id for r in found)


def test_every_row_is_reported(docs, rows, labels):
    wanted = Counter(i for i, *_ in rows)
    assert ids(suffix_dedup.remove_repeats(docs).collect()) == wanted
    assert ids(language_id.predict(docs, language_id.fit(docs)).collect()) == wanted
    assert ids(minhash.components(docs).collect()) == wanted
    assert ids(personal_data.find(docs, personal_data.fit(docs)).collect()) == wanted
    assert ids(mixing.copies(docs).collect()) == wanted
    assert ids(quality.judge(docs, labels).collect()) == wanted
    assert ids(packing.pack(docs).filter("piece = 0").collect()) == wanted


def test_exact_dedup(docs, rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    found = exact_dedup.dedup(docs).collect()
    largest = lambda g: max((i for i in g if i is not None), default=None)
    wanted = Counter((i, largest(g), len(g), i == largest(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == wanted
    kept = exact_dedup.keep_rows(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter((largest(g), t) for t, g in groups.items())


def test_token_counts(docs, rows):
    found = token_counts.count_tokens(docs, head=3).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in found) == Counter((i, len((t or "").encode())) for i, t, *_ in rows)
    assert len({r.n_tokens for r in found if r.n_bytes == len(rows[2][1])}) == 1


def test_mix_gives_the_copies_it_counts(docs, rows):
    counted = Counter()
    for r in mixing.copies(docs).collect():
        counted[r.doc_id, r.source, r.size] += r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    found = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixed.collect())
    assert found == +counted


def test_rows_that_stay_keep_their_columns(docs, labels):
    for kept in (quality.keep_rows(docs, labels), minhash.keep_rows(docs)):
        assert kept.columns == docs.columns and kept.count() > 0


@pytest.mark.parametrize("n", [1, 2, 5])
def test_few_unrelated_documents(spark, n):
    rng = random.Random(n)
    texts = [sentence(rng, 30) for _ in range(n)]
    df = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()} == {(f"d{k}", len(t), 0) for k, t in enumerate(texts)}


def test_text_ids_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 40)
    rng = random.Random(5)
    a, b = sentence(rng, 20), sentence(rng, 20)
    df = spark.createDataFrame([("b", a), ("a", "x " + a), ("c", b), (None, "y " + b), ("d", "z")], "doc_id string, text string").repartition(7)
    found = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()}
    assert found == {"a": 0, "b": len(a), "c": 0, None: len(b), "d": 0}


def test_nearest_with_repeated_ids_and_extra_columns(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", *(F.lit("x").alias(c) for c in EXTRA))
    found = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 4)) for r in nearest.search(df, k=3).collect())
    assert found == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 6, 0.0)]
