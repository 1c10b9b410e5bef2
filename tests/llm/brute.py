"""Plain versions of what operators compute, for small inputs."""

import math
import re
import zlib
from collections import Counter

import numpy as np


def kneser_ney(texts, order=4):
    """Brute force: the probability of each character after order - 1 others, with characters that occur once as one."""
    seen = Counter("".join(texts))
    name = lambda c: c if seen[c] > 1 else "unknown"
    grams = lambda t: [tuple((["^"] * (order - 1) + list(map(name, t)))[k : k + order]) for k in range(len(t))]
    counts = {order: Counter(g for t in texts for g in grams(t))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0.5
        discount[n] = [0, *(min(max(k - (k + 1) * y * m[k + 1] / m[k] if m[k] else k * 0.5, 0.05), k - 0.05) for k in (1, 2, 3))]
    size, total = len({c for c in seen if seen[c] > 1}) + 2, sum(counts[1].values())
    cut = lambda n, c: discount[n][min(c, 3)]
    back = sum(cut(1, c) for c in counts[1].values())
    sums = {n: (Counter(), Counter()) for n in range(2, order + 1)}
    for n in sums:
        for g, c in counts[n].items():
            sums[n][0][g[:-1]] += c
            sums[n][1][g[:-1]] += cut(n, c)

    def p(g):
        if len(g) == 1:
            c = counts[1][g]
            return (c - cut(1, c) + back / size) / total if c else back / size / total
        whole, taken = sums[len(g)]
        if not whole[g[:-1]]:
            return p(g[1:])
        c = counts[len(g)][g]
        return (c - cut(len(g), c) if c else 0) / whole[g[:-1]] + taken[g[:-1]] / whole[g[:-1]] * p(g[1:])

    return lambda t: [p(g) for g in grams(t)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(texts):
    """The smallest id that each id (a dict of texts) is linked with, by all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Each source's target, by handing out the excess again and again."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    goal, total, open_ = {}, share * sum(sizes.values()), list(order)
    while open_:
        part = {s: total * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if part[s] > cap * sizes[s]]
        goal |= {s: cap * sizes[s] for s in full} if full else part
        total -= sum(goal[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    return goal


def systematic(rows, goal, offset):
    """Copies of rows (size, order key, name) of one source, in order of size up through every second one and down through the others."""
    ranked = sorted(rows, key=lambda r: (math.floor(math.log2(r[0] + 1) * 8), *r[1]))
    line = ranked[0::2] + ranked[1::2][::-1]
    each = goal / sum(r[0] for r in rows) if sum(r[0] for r in rows) else 0.0
    return {r[2]: math.floor((k + 1) * each + offset) - math.floor(k * each + offset) for k, r in enumerate(line)}


def pieces(docs, encode, capacity):
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text)."""
    out = []
    for d, t in docs:
        ids = np.array([*encode(t or ""), 0], "<u4")
        out += [(d, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    return out


def best_fit(lengths, capacity):
    """How many bins best-fit decreasing fills."""
    free = []
    for n in sorted(lengths, reverse=True):
        fit = min((f for f in free if f >= n), default=None)
        if fit is None:
            free.append(capacity - n)
        else:
            free[free.index(fit)] = fit - n
    return len(free)


def quality(rows, good, calibrating, quantile=0.995, prior=60, slack=0.2, least=30):
    """Ids of rows (doc_id, text, lang) that the classifier keeps."""
    text = {i: t for i, t, _ in rows}
    model = kneser_ney([text[i] for i in good - calibrating if text.get(i)])
    score = {i: (len(p := model((t or "").strip())), -sum(map(math.log, p))) for i, t, _ in rows}
    lang = {i: x or "" for i, _, x in rows}
    held = [i for i in good & calibrating if i in score and score[i][0]]
    mean = lambda ids: sum(score[i][1] for i in ids) / sum(score[i][0] for i in ids)
    of = {x: [i for i in held if lang[i] == x] for x in set(lang.values())}
    means = {x: mean(ids) for x, ids in of.items() if len(ids) >= least}
    even = {i: (nll + prior * means.get(lang[i], mean(held))) / (n + prior) for i, (n, nll) in score.items()}
    top = lambda ids: sorted(even[i] for i in ids)[max(0, math.ceil(quantile * len(ids)) - 1)] + slack
    limits = {x: top(of[x]) for x in means}
    return {i for i, (n, _) in score.items() if n and even[i] <= limits.get(lang[i], top(held))}
