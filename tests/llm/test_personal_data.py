"""What the field adds to the patterns: entities that a document gives once more without their pattern, and nothing else."""

import itertools
import random
import time

import numpy as np
import pytest

from gridway.llm import personal_data as pii

WORDS = "the of and river stone winter garden letter music table window street".split()


def card(rng):
    digits = "".join(str(rng.randrange(10)) for _ in range(15))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def phone(rng):
    return f"+{rng.randrange(11, 99)} {rng.randrange(100, 999)} {rng.randrange(10**6, 10**7)}"


def mail(rng):
    return f"{rng.choice('abcdef')}{rng.randrange(999)}.doe@mail.example.org"


def ip(rng):
    return ".".join(str(rng.randrange(1, 255)) for _ in range(4))


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(3)
    texts = []
    for k in range(300):
        text = " ".join(rng.choice(WORDS) for _ in range(8))
        if k % 2:
            text += f" {rng.choice((card, phone, mail, ip))(rng)} and more"
        for _ in range(rng.randrange(3)):
            text += f" {rng.choice((rng.randrange(1900, 2030), rng.randrange(10**15, 10**16), rng.randrange(10**6, 10**7), 'v1.2.3'))} {rng.choice(WORDS)}"
        texts.append(text)
    return pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3))


def test_second_mentions_without_a_pattern(spark, field):
    rng = random.Random(9)
    c, p, m, a = card(rng), phone(rng), mail(rng), ip(rng)
    wrong = c[:-1] + str((int(c[-1]) + 1) % 10)
    second = [("card", c, f"{c[:4]}/{c[4:]}"), ("phone", p, p[1:]), ("email", m, m.split("@")[0] + "@mail"), ("ip", a, a.replace(".", ":"))]
    texts = [f"first {one} then {other} again" for _, one, other in second]
    texts += [f"only {other} here" for *_, other in second[1:]]  # a card's check digit would tell even here
    texts += [f"card {wrong} and 1234567 in 2020", "9" * 70 + "x" + " " + "1" * 300]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), field).collect()}
    for i, (kind, one, other) in enumerate(second):
        at = texts[i].index(" then ") + 6
        assert f"{kind}:{at}:{at + len(other)}" in found[i].spans.split(","), (kind, found[i].spans)
    assert not {(texts[i], found[i].spans) for i in range(len(second), len(texts)) if found[i].n_added}


def test_long_tokens_count_whole(spark, field):
    rng = random.Random(4)
    c = card(rng)
    tail = "x" * 500
    assert pii.shape("1" * 70 + "a" + "2" * 80) == "<20>a<20>" and pii.key("y" * 300 + c) == f"d{c[-7:]}"
    graph = pii.Graph([f"{tail}{c}"], [pii.tokens(f"{tail}{c}")])
    assert graph.spans == [(0, 516)]


def test_message_passing_on_a_loop_is_close_to_enumeration():
    rng = np.random.default_rng(1)
    text = "7654321 x 7654321 y 7654321"
    graph = pii.Graph([text], [pii.tokens(text)])
    assert sorted(map(tuple, graph.edges[1].tolist())) == [(0, 1), (0, 2), (1, 2)]
    same = np.eye(pii.LABELS) * 0.8
    field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)) * 0.3, [np.zeros((pii.LABELS, pii.LABELS)), same])
    observed = np.array([3, 0, 0])
    unary = field.weights[graph.features].sum(axis=1)
    unary[0, 3] += pii.OBSERVED
    joint = np.zeros((pii.LABELS, pii.LABELS, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=3):
        joint[labels] = np.exp(sum(unary[i, x] for i, x in enumerate(labels)) + sum(same[labels[i], labels[j]] for i, j in graph.edges[1]))
    joint /= joint.sum()
    wanted = [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]
    assert np.allclose(field.marginals(graph, observed, rounds=100), wanted, atol=0.06)


def test_overlaps_by_one_sweep():
    rng = random.Random(6)
    for _ in range(300):
        cuts = sorted(rng.sample(range(200), 2 * rng.randrange(1, 40)))
        spans = list(zip(cuts[::2], cuts[1::2], strict=True))
        base = []
        for kind in range(4):
            ends = sorted(rng.sample(range(200), 2 * rng.randrange(12)))
            base += [(kind, a, b) for a, b in zip(ends[::2], ends[1::2], strict=True)]
        wanted = [max((k for k, (_, x, y) in enumerate(base) if x < b and a < y), default=None) for a, b in spans]
        assert pii.touching(spans, base) == wanted


def test_sweeps_stay_linear_in_long_texts():
    n = 400_000
    spans = [(10 * k, 10 * k + 8) for k in range(n)]
    base = [(k % 4, 10 * k + 2, 10 * k + 6) for k in range(0, n, 2)]
    start = time.process_time()
    found = pii.touching(spans, base)
    assert time.process_time() - start < 20 and sum(k is None for k in found) == n // 2
