"""Near-dedup against all pairs, on groups whose members are near but mostly not linked."""

import random

import numpy as np
import pytest

from gridway.llm import minhash


def labels(sets):
    label = list(range(len(sets)))
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while True:
        before = list(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def shingled(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("rows", [40, 2048])  # in blocks against blocks, and in one
def test_group_of_near_but_unlinked_texts(spark, monkeypatch, rows):
    monkeypatch.setattr(minhash, "ROWS", rows)
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**5)}" for _ in range(100)]
    texts = []
    for _ in range(220):
        gone = set(rng.sample(range(100), rng.choice((1, 2, 4, 5, 6, 8))))  # words left out: others leave out the same
        texts.append(" ".join(w for i, w in enumerate(base) if i not in gone))
    sets = list(map(shingled, texts))
    wanted = labels(sets)
    assert len(set(wanted)) > 20 and max(np.bincount(wanted)) > 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in minhash.components(df).collect()} == dict(enumerate(wanted))


def test_overlaps_equal_intersections():
    rng = np.random.default_rng(2)
    few, many = np.arange(30, dtype=np.uint64), np.arange(30, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(few, 20), rng.choice(many, rng.integers(1, 60))])) for _ in range(90)]
    found = minhash.overlaps(sets[:33], sets[33:])
    assert (found == [[len(set(a) & set(b)) for b in sets[33:]] for a in sets[:33]]).all()


def test_text_ids_and_ids_of_several_texts(spark):
    rng = random.Random(3)
    one, two, three = (" ".join(f"w{rng.randrange(10**5)}" for _ in range(60)) for _ in range(3))
    rows = [("b", one), ("a", one + " more"), ("c", two), ("d", three), ("d", two + " more"), ("e", three + " too"), ("f", ""), ("f", None), (None, one), ("d", "")]
    found = minhash.components(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in found if r.n_shingles} == {("a", "a", True), ("b", "a", False), ("c", "c", True), ("d", "c", False), ("e", "c", False), (None, None, True)}
    assert {(r.doc_id, r.component_id) for r in found if not r.n_shingles} == {("f", "f"), ("d", "d")}
