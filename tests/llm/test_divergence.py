"""The audit of sources against plain Python integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridway.llm import divergence
from gridway.llm.queries import ORACLES, QUERIES
from oracle import SMALL, expected, rows

SCHEMA = "doc_id bigint, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {a: a + 32 for a in range(65, 91)}


def brute(data, least, top=50):
    docs, n, group_n, groups = Counter(), Counter(), Counter(), set()
    for _, text, lang, source in data:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        docs.update({(lang, t) for t in terms})
        n.update((lang, t) for t in terms)
        group_n.update((lang, source, t) for t in terms)
    kept = defaultdict(set)
    for (lang, t), k in docs.items():
        if k >= least:
            kept[lang].add(t)
    p = lambda count, total, v: 1 + (10**9 * (count + 5)) // (total + 5 * v)
    sources = defaultdict(list)
    for lang, s in groups:
        sources[lang].append(s)
    out = []
    for lang, those in sources.items():
        terms, v = kept[lang], len(kept[lang])
        whole = sum(n[lang, t] for t in terms)
        own = {s: {t: p(group_n[lang, s, t], sum(group_n[lang, s, u] for u in terms), v) for t in terms} for s in those}
        for s in those:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in terms)) for o in those if o != s]
            best = [(t, own[s][t] - q) for t in terms if group_n[lang, s, t] and own[s][t] > (q := p(n[lang, t], whole, v))]
            for part, items, limit in (("pair", pairs, None), ("term", best, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def made(n=240, seed=1):
    rng = random.Random(seed)
    words = "Alpha beta GAMMA über straße élan naïve delta-epsilon x1y 東京 zeta".split()
    data = [(k, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(9))), rng.choice(["en", "en", "fr", None]), rng.choice(["a", "B", "é", "hot", "hot", "hot", None])) for k in range(n)]
    data += [(5, None, "en", "silent"), (5, "", "en", "silent"), (None, "Alpha", "it", "lone"), (7, "123 456", "xx", "one"), (8, None, "xx", "two"), data[3], data[3]]
    return data


@pytest.mark.parametrize("block,entries,shares", [(128, 1 << 18, 1_000_000), (2, 6, 5), (1, 1, 1)])
def test_matches_plain_integers(spark, monkeypatch, block, entries, shares):
    for name, value in (("BLOCK", block), ("ENTRIES", entries)):
        monkeypatch.setattr(divergence, name, value)
    data = made()
    wanted = brute(data, 12)
    assert {r[2] for r in wanted} == {"pair", "term"}
    for n in (1, 6):
        found = divergence.audit(spark.createDataFrame(data, SCHEMA).repartition(n), least=12, share_rows=shares)
        assert sorted(map(tuple, found.collect())) == wanted


def test_shares_follow_the_counts(spark, monkeypatch):
    held = []
    monkeypatch.setattr(divergence, "partials", lambda kept, groups, shares, *rest, f=divergence.partials: held.append(shares) or f(kept, groups, 7, *rest))
    data = made()
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(data, SCHEMA), least=12, share_rows=20).collect())) == brute(data, 12)
    assert 1 <= held[0] <= 20


def test_only_the_best_terms_are_ranked(spark):
    rng, words = random.Random(9), [f"t{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghijklmn" for c in "abcdefghijkl"]
    data = [(k, " ".join(rng.choices(words, k=200)), "en", "a" if k % 2 else "b") for k in range(60)]
    found = divergence.audit(spark.createDataFrame(data, SCHEMA), least=1, top=7)
    assert sorted(map(tuple, found.collect())) == brute(data, 1, 7)


def test_languages_without_kept_terms(spark):
    data = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, None, "en", None)]
    found = sorted(map(tuple, divergence.audit(spark.createDataFrame(data, SCHEMA)).collect()))
    assert found == brute(data, 30) and len(found) == 6 and all(r[4] == 0 for r in found)


def test_empty_table_and_clashing_names(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    data = made(60, 2)
    df = spark.createDataFrame(data, SCHEMA).select("*", *(F.lit("x").alias(c) for c in "term document docs n row block share total v i j rank item value part".split()))
    assert sorted(map(tuple, divergence.audit(df, least=5).collect())) == brute(data, 5)


def test_very_long_text(spark):
    rng = random.Random(4)
    data = [(1, " ".join(rng.choice("abcdefgh") * 3 for _ in range(400_000)), "en", "x"), (2, "aaa bbb", "en", "y")]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(data, SCHEMA), least=2).collect())) == brute(data, 2)


def test_probabilities_are_exact():
    import numpy as np

    n, total = np.array([7 * 10**14, 5, 123456789012345], np.int64), np.array([9 * 10**14, 10**15, 999999999999999], np.int64)
    assert divergence.probability(n, total, 9).tolist() == [1 + 10**9 * a // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]


def test_query_matches_sql(spark):
    name = "op12_source_divergence"
    assert rows(QUERIES[name](spark, SMALL).toPandas()) == rows(expected(ORACLES[name]))
