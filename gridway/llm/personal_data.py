"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give each text's base spans, which always stay. The field labels tokens that hold a digit or an at sign; all
others are outside for certain, which cuts the chain into short stretches. Neighbours in a stretch share a potential, and
so do tokens of a document that repeat or resemble another one (the same digits, or the same letters): each is linked with the
one before and with the first. What the patterns found is observed. Loopy message passing over all edges at once gives each
token's marginals; confident tokens outside the base spans become spans. So a number that the document gives once in full is
found again where it stands without its sign, with other separators, or cut short.

Learning is piecewise, from at most `sample` documents with base spans and as many with such tokens but none, of at most
`tokens` such tokens in all; documents with over a tenth of that are not drawn. A softmax over token features learns what the
patterns say, and from copies with a digit changed or the sign left out that such tokens alone are nothing. Pair potentials are
counted along each kind of edge, in the documents and in copies that mention their spans once more in other forms.

Null texts count as empty. Rows that share an id are read each by itself. Without any base span in the table the field
adds nothing. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
FEATURES = 1 << 12
#: How sure the patterns are, as a log potential.
OBSERVED = 12.0
# The base patterns. An address is looked for from its at sign, so that long runs cost no more than their length.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\+?[0-9@]\S*")
SPACE = re.compile(r"\s")
EDGES = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def tokens(text: str) -> list[tuple[int, int]]:
    """The white-space-separated tokens that hold a digit or an at sign."""
    out = []
    for m in TOKEN.finditer(text):
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        out.append((start, m.end()))
    return out


def shape(token: str) -> str:
    """Runs of digits by their length, letters, and other characters as they are."""
    token = token.strip(EDGES[:6])
    token = re.sub(r"[^\W\d_]+", "a", token)
    return re.sub(r"[0-9]+", lambda m: f"<{min(len(m.group()), 20)}>", token)


def key(token: str) -> str:
    """Tokens with the same key resemble each other: the name before an at sign, the last digits, else letters and digits."""
    if "@" in token:
        return token.strip(EDGES).partition("@")[0].lower() + "@"
    digits = re.sub(r"[^0-9]", "", token)
    return f"d{digits[-7:]}" if len(digits) >= 7 else f"d{digits}" if len(digits) > 3 and token.count(".") + token.count(":") == 3 else token.strip(EDGES + "+").lower()


def sound(token: str) -> str:
    """What can be said of a token's digits by counting: card numbers by their check digit, addresses by their parts."""
    digits = re.sub(r"[^0-9]", "", token)
    parts = token.strip(EDGES).split(".")
    octets = len(parts) == 4 and all(p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    return f"{luhn(digits) if 13 <= len(digits) <= 19 else '-'}{octets}"


class Graph:
    """Tokens of some documents with their features and edges."""

    def __init__(self, texts: list[str], found: list[list[tuple[int, int]]]):
        self.document, self.spans, rows, chain, skip = [], [], [], [], []
        for d, (text, places) in enumerate(zip(texts, found, strict=True)):
            shapes = [shape(text[a:b]) for a, b in places]
            before: dict[str, int] = {}
            first: dict[str, int] = {}
            for i, (a, b) in enumerate(places):
                at = len(self.spans)
                near = i > 0 and a - places[i - 1][1] <= 3
                follows = i + 1 < len(places) and places[i + 1][0] - b <= 3
                if near:
                    chain.append((at - 1, at))
                k = key(text[a:b])
                skip += [(x, at) for x in {before.get(k), first.get(k)} - {None}]
                before[k] = at
                first.setdefault(k, at)
                word = text[max(0, a - 24) : a].split()
                names = (f"s{shapes[i]}", f"p{shapes[i - 1] if near else ''}|{shapes[i]}", f"n{shapes[i]}|{shapes[i + 1] if follows else ''}", f"@{'@' in text[a:b]}{text[a:b].count('.')}{text[a] == '+'}", f"#{sum(map(str.isdigit, text[a:b]))}", f"v{sound(text[a:b])}", f"w{word[-1].lower() if word else ''}", "bias")
                rows.append([zlib.crc32(x.encode()) % FEATURES for x in names])
                self.document.append(d)
                self.spans.append((a, b))
        self.features = np.array(rows, np.int64).reshape(-1, 8)
        self.edges = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip)]


class Field:
    """Weights (feature, label) and a log potential (label, label) for each kind of edge."""

    def __init__(self, weights: np.ndarray, pairs: list[np.ndarray]):
        self.weights, self.pairs = weights, pairs

    def marginals(self, graph: Graph, observed: np.ndarray | None = None, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Loopy belief propagation, all messages at once. observed: the label of each token that the patterns found, else 0."""
        unary = self.weights[graph.features].sum(axis=1)
        if observed is not None:
            known = np.flatnonzero(observed)
            unary[known, observed[known]] += OBSERVED
        ends = np.concatenate([e for e in graph.edges] + [e[:, ::-1] for e in graph.edges])
        if len(ends):
            half = len(ends) // 2
            kind = np.concatenate([np.full(len(e), k) for k, e in enumerate(graph.edges)] * 2)
            potential = np.stack(self.pairs)[kind]
            potential[half:] = potential[half:].transpose(0, 2, 1)
            back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
            messages = np.zeros((len(ends), LABELS))
            for _ in range(rounds):
                belief = unary.copy()
                np.add.at(belief, ends[:, 1], messages)
                out = belief[ends[:, 0]] - messages[back]
                new = np.logaddexp.reduce(out[:, :, None] + potential, axis=1)
                new -= new.max(axis=1, keepdims=True)
                messages = damping * messages + (1 - damping) * new
            unary = unary.copy()
            np.add.at(unary, ends[:, 1], messages)
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def touching(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int | None]:
    """For each of the spans, which ascend, the last of base's (kind, start, end) that overlaps it: one sweep over both."""
    order = sorted(range(len(base)), key=lambda k: base[k][1])
    out, at, begun = [], 0, []
    for a, b in spans:
        while at < len(order) and base[order[at]][1] < b:
            begun.append(order[at])
            at += 1
        begun = [k for k in begun if base[k][2] > a]
        out.append(max(begun, default=None))
    return out


def by_document(graph: Graph) -> Iterator[tuple[int, int, int]]:
    """(document, first token, end) of each document that has tokens."""
    document = np.asarray(graph.document, np.int64)
    at = np.flatnonzero(np.diff(document, prepend=-1))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(document)], strict=False):
        yield int(document[a]), a, b


def labels(graph: Graph, base: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """The label of each token: the base span that it overlaps."""
    out = np.zeros(len(graph.spans), np.int64)
    for d, a, b in by_document(graph):
        out[a:b] = [0 if k is None else base[d][k][0] + 1 for k in touching(graph.spans[a:b], base[d])]
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in EDGES:
        a += 1
    while b > a and text[b - 1] in EDGES:
        b -= 1
    return a, b


def otherwise(kind: int, mention: str) -> str:
    """The same entity in a form that no pattern finds."""
    name, at, domain = mention.partition("@")
    forms = (name + at + domain.replace(".", "_"), mention.replace(".", ":"), f"{mention[:-4].rstrip(' -')}/{mention[-4:]}", mention.lstrip("+"))
    return forms[kind]


def spoilt(kind: int, mention: str) -> str:
    """A mention with its last digit changed, so that it is no card number any more."""
    return mention[:-1] + str((int(mention[-1]) + 1) % 10) if kind == 2 and mention[-1].isdigit() else otherwise(kind, mention)


def lessons(texts: list[str]) -> Iterator[tuple[str, list[tuple[int, int, int]], bool]]:
    """(text, labelled spans, whether single tokens are to be learnt from it) of each text and of its copies."""
    for text in texts:
        base = base_spans(text)
        yield text, base, True
        if not base:
            continue
        more, alone, spans = text + " ; ", "", list(base)
        for kind, a, b in base[:6]:
            form = otherwise(kind, text[a:b])
            if form and CUE.search(form) and not base_spans(form):
                spans.append((kind, len(more), len(more) + len(form)))
                more += form + " and "
            alone += f"number {spoilt(kind, text[a:b])} ; "
        yield more, spans, False
        yield alone, base_spans(alone), True


def learn(texts: list[str], rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> Field | None:
    taught = list(lessons(texts))
    graph = Graph([t for t, _, _ in taught], [tokens(t) for t, _, _ in taught])
    y = labels(graph, [spans for _, spans, _ in taught])
    if not y.any():
        return None
    single = np.array([taught[d][2] for d in graph.document])
    features, known = graph.features[single], y[single]
    hot, weights, speed = np.eye(LABELS)[known], np.zeros((FEATURES, LABELS)), np.full((FEATURES, LABELS), 1e-6)
    for _ in range(rounds):
        z = weights[features].sum(axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) - hot
        step = decay * weights
        for column in features.T:
            np.add.at(step, column, p / len(known))
        speed += step**2
        weights -= rate * step / np.sqrt(speed)
    # What a pair says beyond what is known of its ends: seen by the patterns, or from their features alone.
    z = weights[graph.features].sum(axis=1)
    ends = np.exp(z - z.max(axis=1, keepdims=True))
    ends /= ends.sum(axis=1, keepdims=True)
    seen = labels(graph, [base_spans(t) for t, _, _ in taught])
    ends[seen > 0] = np.eye(LABELS)[seen[seen > 0]]
    pairs = []
    for e in graph.edges:
        alone = ends[e[:, 0]].T @ ends[e[:, 1]] + 0.01
        alone /= alone.sum()
        n = 5 * alone
        np.add.at(n, (y[e[:, 0]], y[e[:, 1]]), 1)
        pairs.append(np.clip(np.log(n / n.sum()) - np.log(alone), -6, 6))
    return Field(weights, pairs)


def fit(docs: DataFrame, sample: int = 1500, most: int = 40_000) -> Field | None:
    """Learn from a bounded sample of docs (doc_id, text): those with the smallest hash of their id, `most` tokens of each kind of document."""

    def cues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            found = [2 if base_spans(t) else 1 if CUE.search(t) else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32()), pa.array([sum(1 for _ in TOKEN.finditer(t)) for t in texts], pa.int64())], ["doc_id", "cue", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    usable = docs.select("doc_id", "text").filter("text RLIKE '[0-9@]'")
    cued = common.checkpoint(usable.mapInArrow(cues, f"doc_id {kind}, cue int, n bigint").filter(F.col("n") <= most // 10))
    order = [F.xxhash64("doc_id"), "doc_id"]

    def drawn(cue: int) -> DataFrame:
        rows = cued.filter(F.col("cue") == cue).orderBy(*order).limit(sample)  # few rows, of which the first are taken
        return rows.withColumn("sum", F.sum("n").over(Window.orderBy(*order))).filter(F.col("sum") <= most).select("doc_id")

    ids = drawn(2).unionByName(drawn(1)).distinct()
    picked = usable.join(F.broadcast(ids), "doc_id", "left_semi")

    # Only stretches around tokens are kept of the sampled texts; what is between them carries no feature.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in (x.as_py() for x in batch.column(1)):
                places = [(a, b) for _, a, b in base_spans(t)] or tokens(t)
                out.append(" \n\n\n ".join(t[max(0, a - 60) : b + 60] for a, b in places))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = picked.mapInArrow(cut, f"doc_id {kind}, text string").collect()
    return learn([r.text for r in sorted(rows, key=lambda r: (str(r.doc_id), r.text))])


def find(docs: DataFrame, field: Field | None, confidence: float = 0.9) -> DataFrame:
    """Per row of docs (doc_id, text): counts of base spans, base_sha256, spans, n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def added(texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        graph = Graph(texts, [tokens(t) for t in texts])
        if shared.value is None or not graph.spans:
            return out
        p = shared.value.marginals(graph, labels(graph, base))
        best, sure = p.argmax(axis=1), p.max(axis=1) >= confidence
        # Parts of a number that are likely enough go with a part that is sure.
        for way in (graph.edges[0], graph.edges[0][::-1, ::-1]):
            for i, j in way.tolist():
                sure[j] |= sure[i] and best[i] == best[j] > 0 and p[j, best[j]] >= confidence / 2
        own = [trimmed(texts[d], *span) for d, span in zip(graph.document, graph.spans, strict=True)]
        free = np.zeros(len(own), bool)
        for d, first, end in by_document(graph):
            free[first:end] = [k is None for k in touching(own[first:end], base[d])]
        for d, (a, b), label, taken, alone in zip(graph.document, own, best, sure, free, strict=True):
            if not label or not taken or a == b or not alone:
                continue
            last = out[d][-1] if out[d] else None
            if last and last[0] == label - 1 and a - last[2] <= 3:  # one number in several tokens
                out[d][-1] = (last[0], last[1], b)
            else:
                out[d].append((int(label) - 1, a, b))
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [t if t and CUE.search(t) else "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                cued = [i for i, t in enumerate(texts) if t]
                more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for i, spans in zip(cued, added([texts[i] for i in cued], [base[i] for i in cued]), strict=True):
                    more[i] = spans
                counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in range(len(KINDS))]
                sha = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
                spans = [joined(b + m) for b, m in zip(base, more, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(sha), pa.array(spans, pa.string()), pa.array(list(map(len, more)), pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return find(docs, fit(docs))
