"""Small cases of each operator against brute force, with nulls, empty and repeated rows, and an empty table."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute import kneser_ney
from gridway.llm import exact_dedup, language_id, minhash, mixing, nearest, packing, personal_data, quality, suffix_dedup, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and river stone winter garden letter music table window street paper summer market bridge doctor silver orange yellow".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(1, 120)) for _ in range(60)]
    passage = sentence(rng, 30)
    texts += [texts[3], texts[3], texts[7], None, "", " \n\t", "déjà vu — ünï 😀 <|endoftext|> 's don't"]
    texts += [t + " " + passage + " " + sentence(rng, 4) for t in texts[10:16]]
    texts += [texts[20] + " extra", " ".join(texts[21].split()[2:]), texts[22].upper()]
    return [(i, t, "en" if i % 7 else None, ["b", "a", None, "b", "é"][i % 5], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup(docs, corpus):
    low = {}
    data = [(d, (t or "").encode()) for d, t, *_ in corpus]
    for d, b in data:
        for i in range(len(b) - 49):
            low.setdefault(b[i : i + 50], d)
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if low[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        r = found[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_of_null_and_shared_ids(spark):
    rng = random.Random(8)
    a, b, c, d, e = (sentence(rng, 20) for _ in range(5))
    # Texts a and c come again under ids that other texts have too; b and d are unique, and 9 repeats b.
    rows = [(3, a), (5, a), (5, b), (4, c), (None, c), (None, d), (None, e), (None, e), (9, b + " " + e)]
    wanted = Counter((i, len(t), n) for (i, t), n in zip(rows, (0, len(a), 0, 0, len(c), 0, len(e), len(e), len(b)), strict=True))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()) == wanted


def test_suffix_dedup_without_repeats(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, sentence(rng, 20)) for i in range(5)], "doc_id bigint, text string")
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()} == {(i, 0) for i in range(5)}


def test_merge_of_transforms_equals_sorting():
    rng = np.random.default_rng(3)
    stretches = [bytes(rng.integers(97, 99, rng.integers(12, 40)).astype(np.uint8)) for _ in range(30)]
    documents = rng.permutation(30).astype(np.int64)
    suffix_dedup.SHARD, before = 100, suffix_dedup.SHARD  # many shards
    try:
        found = suffix_dedup.earliest(stretches, documents, 10)
    finally:
        suffix_dedup.SHARD = before
    low = {}
    for s, d in zip(stretches, documents, strict=True):
        for i in range(len(s) - 9):
            low[s[i : i + 10]] = min(d, low.get(s[i : i + 10], 99))
    assert [list(x) for x in found] == [[low[s[i : i + 10]] for i in range(len(s) - 9)] for s in stretches]


def test_exact_dedup(docs, corpus):
    groups = {}
    for d, t, *_ in corpus:
        groups.setdefault(t or "", []).append(d)
    found = {r.doc_id: r for r in exact_dedup.dedup(docs).collect()}
    for t, ids in groups.items():
        for d in ids:
            r = found[d]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(ids), len(ids), d == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id for r in exact_dedup.keep_rows(docs).collect()} == {max(ids) for ids in groups.values()}


def test_near_dedup(docs, corpus):
    sets = {}
    for d, t, *_ in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components(docs).collect()}
    assert found == {d: (len(s), label[d], d == label[d]) for d, s in sets.items()}


def test_hot_group_of_near_copies(spark):
    rng = random.Random(9)
    base = sentence(rng, 120).split()
    texts = []
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(120), k % 9):
            w[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i : i + 5]) for i in range(116)} for w in (t.split() for t in texts)]
    label = list(range(150))
    for _ in range(6):
        for a in range(150):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in minhash.components(df).collect()} == dict(enumerate(label))


def test_packing(docs, corpus):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = []
    for d, t, *_ in corpus:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        wanted += [(d, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    rows = packing.pack(docs, capacity=64).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * sum(w[3] for w in wanted) / 64 + 2


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randrange(1, 33) for _ in range(rng.randrange(1, 120))]
        free = []
        for n in sorted(lengths, reverse=True):
            fit = min((f for f in free if f >= n), default=None)
            if fit is None:
                free.append(32 - n)
            else:
                free[free.index(fit)] = fit - n
        slots = packing.plan(dict(Counter(lengths)), 32)
        used = {s for _, _, n, first, _ in slots for s in range(first, first + n)}
        assert len(used) == len(free) and sum(n for _, _, n, _, _ in slots) == len(lengths)


def test_token_counts(docs, corpus):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {d: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in corpus}
    for head in (0, 50):  # with all, and with few pre-tokens by the shuffle
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, head=head).collect()} == wanted


def test_pretokens_of_odd_text():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    alphabet = "ab Z9  \n\t  'sé—😀ñ́½_<|>\x1c\u0085٣漢"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert sum(len(tok.encode(p, add_special_tokens=False).ids) for p in token_counts.pretokens(text, tok)) == len(tok.encode(text, add_special_tokens=False).ids)


def test_mixing(spark, docs, corpus):
    rows = mixing.copies(docs).collect()
    sizes = Counter()
    for _, t, _, s, _ in corpus:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, total, open_ = {}, 1.5 * sum(sizes.values()), list(order)
    while open_:
        share = {s: total * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * sizes[s]]
        goal |= {s: share[s] for s in open_} if not full else {s: 2.0 * sizes[s] for s in full}
        total -= sum(goal[s] for s in full)
        open_ = [s for s in open_ if s in full and False] if not full else [s for s in open_ if s not in full]
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 2, (s, taken[s], goal[s])
    for n in (4, 7, 211):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.copies(docs.repartition(2)).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_language(spark):
    rng = random.Random(4)
    own = {"aa": "kalo mira tune".split(), "bb": "schrift ünder wagen".split()}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(df.filter("doc_id < 80"), per_language=30, clusters=2)
    found = {r.doc_id: r for r in language_id.predict(df.filter("doc_id >= 80"), model).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows if i >= 80)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!")], "doc_id bigint, text string")
    assert {(r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()} == {("und", 0.0)}
    assert {r.lang_pred for r in language_id.predict(df, language_id.fit(df.limit(0))).collect()} == {"und"}


def test_personal_data(spark):
    texts = ["mail a.b@c-d.org, x@y no", "ip 1.2.3.4 and 1.2.3.400 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111111111111112", "call +1 (743) 555-3824 or +1 22", None, "", "a@b.c_d@e.f", "9" * 3000 + "." + "x" * 3000 + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def base(s):
        out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
        out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s) if 13 <= len(g := re.sub("[ -]", "", m[0])) <= 19 and personal_data.luhn(g)]
        out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)

    for r in personal_data.find(df, personal_data.fit(df)).collect():
        wanted = base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(wanted.encode()).hexdigest()
        assert set(filter(None, wanted.split(","))) <= set(r.spans.split(","))


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(0)
    graph = personal_data.Graph(["1 22 333"], [[(0, 1), (2, 4), (5, 8)]])
    field = personal_data.Field(rng.normal(size=(personal_data.FEATURES, personal_data.LABELS)), [rng.normal(size=(5, 5)) for _ in range(2)])
    unary = field.weights[graph.features].sum(axis=1)
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + field.pairs[0][:, :, None] + field.pairs[0][None, :, :])
    joint /= joint.sum()
    assert np.allclose(field.marginals(graph, rounds=80), [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))], atol=1e-6)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)) * rng.uniform(0.5, 2, (400, 1))
    x[7] = x[9]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = nearest.search(df, k=10).collect()
    hits = total = 0
    for q in range(0, 400, 20):
        score = x @ x[q]
        score[q] = -np.inf
        top = set(np.lexsort((np.arange(400), -score))[:10])
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert len(own) == 10 and all(a.score >= b.score for a, b in zip(own, own[1:]))
        hits += len(top & {r.vec_id for r in own})
        total += 10
    assert hits / total >= 0.9
    assert nearest.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["outlier", "outliers", "long tail"])
def test_nearest_with_uneven_norms(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "long tail":
        x *= 1 + rng.pareto(1.5, (2000, 1))
    else:
        x[17 : 18 if kind == "outlier" else 57] *= 20
    found = {}
    for r in nearest.search(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in range(0, 2000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        assert len(found[q]) == 20
        recall.append(len(found[q] & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def plain_neighbours(x, k):
    found = set()
    for q in range(0, len(x), 20):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:k].tolist()
        found |= {(q, n, i) for n, i in enumerate(best, 1) if i != q}
    return found


def test_nearest_completes_what_the_tables_miss(spark, monkeypatch):
    """Queries whose buckets are empty are compared with all vectors; so are all queries on request."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 16)) * 1e-3
    x[:, 0] -= 1
    x[20] = -x[20]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows = lambda **kw: {(r.query_id, r["rank"], r.vec_id) for r in nearest.search(df, k=5, **kw).collect()}
    plain = plain_neighbours(x, 5)
    assert rows(exhaustive=True) == plain
    monkeypatch.setattr(nearest, "SHALLOW", 0)
    assert {r for r in rows(tables=2, probes=2) if r[0] == 20} == {r for r in plain if r[0] == 20}


def test_nearest_of_few_vectors(spark):
    x = np.random.default_rng(5).normal(size=(9, 8))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>")
    assert {(r.query_id, r["rank"], r.vec_id) for r in nearest.search(df).collect()} == plain_neighbours(x, 20)


def test_quality(spark):
    rng = random.Random(6)
    good = [" ".join(rng.choice(WORDS) for _ in range(60)).capitalize() + "." for _ in range(200)]
    junk = [" ".join(f"{rng.choice(WORDS).upper()}$$#{rng.randrange(99)}" for _ in range(40)) for _ in range(10)]
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate(good + junk + [None, " "])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id bigint, quality int, toxic int")
    one = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    assert all(one[i].kept == (i < 200) for i in range(212))


def test_perplexity_equals_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 30))) + rng.choice("!?.ä") for _ in range(60)]
    model = kneser_ney(texts)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(5)
    trained = quality.train(df, df.select("doc_id"))
    others = ["river stone", "zzz unknown Ω words", "the the the the", "", None, "x", "winter  street\t!"]
    asked = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts + others)], "doc_id bigint, text string, lang string").repartition(3)
    found = {r.doc_id: (r.n, r.nll) for r in quality.score(asked, trained).collect()}
    for i, t in enumerate(texts + others):
        p = model((t or "").strip())
        assert found[i][0] == len(p) and found[i][1] == pytest.approx(-sum(map(np.log, p)), rel=1e-4)


def test_quality_of_rows_that_share_an_id(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(160)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(3, "@@## 11!! " * 30, 2), (None, good[5], 3), (None, "%%% $$ " * 40, 4), (3, None, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n bigint").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 160)], "doc_id bigint, quality int, toxic int")
    kept = quality.keep_rows(df, labels)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.n) for r in kept.collect()) == Counter((i, n) for i, _, n in rows if n in (1, 3))


def test_quality_learns_from_all_trusted_texts(spark):
    # One character for each two texts: all that train must be seen for all of them to be known.
    texts = [f"{chr(0x4E00 + i // 2)} ab" for i in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    vocabulary, _, _ = quality.train(df, df.select("doc_id"))
    assert (vocabulary[0x4E00 : 0x4E00 + 3000] > 0).all()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for found in (suffix_dedup.remove_repeats(empty), exact_dedup.dedup(empty), minhash.components(empty), packing.pack(empty), token_counts.count_tokens(empty), mixing.copies(empty), mixing.mix(empty), personal_data.find(empty, personal_data.fit(empty)), quality.judge(empty, labels), language_id.predict(empty, language_id.fit(empty))):
        assert found.count() == 0


def test_the_largest_id_is_not_null(spark):
    rng = random.Random(31)
    a, b = (" ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(30)) for _ in range(2))
    last = 2**63 - 1
    df = spark.createDataFrame([(1, a), (last, a), (None, a), (last, b), (None, "x " + b)], "doc_id bigint, text string")
    found = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert found == sorted([("1", 0), (str(last), len(a)), ("None", len(a)), (str(last), 0), ("None", len(b))])
