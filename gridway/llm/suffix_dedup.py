"""Removal of byte strings that occur in earlier documents, by merging Burrows-Wheeler transforms of shards.

Documents are dealt to batches. A window is `width` bytes; its anchor is the smallest hash of the `gram`-byte strings in
it, so equal windows have equal anchors wherever they stand. Messages go from batches to buckets of anchors and back:

1. Each batch sends its anchors; buckets answer which of them other documents have too.
   Copies of a whole text take no part; they lose everything.
2. Each batch sends the stretches whose windows share such an anchor, equal stretches once with their smallest doc_id.
   Where a bucket finds several different stretches under one anchor, it builds Burrows-Wheeler transforms of shards of
   them and merges these by refining their interleave symbol by symbol, up to the width. The borders that appear on the
   way are the common prefixes; what is left at the full width are the repeated intervals, and the smallest doc_id of
   each is where its string occurs first. No suffixes are sorted across shards.
3. Batches remove what is covered by windows that start in a document with a smaller doc_id.

Everything is exact: hashes only choose who meets, bytes decide. Equal stretches of a batch travel once, so a string that
a third of all documents hold costs one record per batch, not one per document. Two cases need no transform, as equality says
all about them: copies of whole texts, and anchors under which all stretches are equal.

Null texts count as empty. Documents that share an id do not remove each other. A null id counts as larger than all others. Ids
may be of any type that has an order. Texts shorter than the width lose nothing. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .shingles import mix

WIDTH, GRAM = 50, 24
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20
STRETCH = 1 << 18
SHARD, COLLECTION = 1 << 16, 1 << 18
LAST = np.iinfo(np.int64).max
LOW48 = np.uint64((1 << 48) - 2)


def anchors(data: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The smallest hash of the gram-byte strings in each window; data has one window at least."""
    powers = {1: np.array([0x9E3779B97F4A7C15 | 1], np.uint64)}
    h = {1: data.astype(np.uint64) + np.uint64(1)}
    n = 1
    while 2 * n <= gram:
        powers[2 * n] = powers[n] * powers[n]
        h[2 * n] = h[n][:-n] * powers[n] + h[n][n:]
        n *= 2
    out, have = h[n], n
    for n in sorted(h, reverse=True):
        if have + n <= gram and n < have or (have + n == gram):
            size = len(data) - have - n + 1
            out = out[:size] * powers[n] + h[n][have : have + size]
            have += n
    out = mix(out)
    windows, span = width - gram + 1, 1
    while 2 * span <= windows:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = windows - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one document with the same anchor: first and last start, anchor. bounds: the documents' starts, and the end."""
    firsts, lasts, values = [], [], []
    lengths = np.diff(bounds)
    ends = np.repeat(bounds[1:], lengths) if len(data) else np.zeros(0, np.int64)
    for at in range(0, max(0, len(data) - width + 1), STRETCH):
        part = data[at : at + STRETCH + width - 1]
        value = anchors(part, width, gram)
        n = len(value)
        end = ends[at : at + n]
        valid = np.arange(at + width, at + width + n) <= end
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (value[1:] != value[:-1]) | (valid[1:] != valid[:-1]) | (end[1:] != end[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        keep = valid[first]
        firsts.append(first[keep] + at)
        lasts.append(last[keep] + at)
        values.append(value[first[keep]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(values)


def bwt(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of one shard (its rotations), the transform, and each row's row one symbol earlier.

    Ranks double their depth in each round; only rows that still tie are sorted again.
    """
    n = len(symbols)
    wide = np.resize(symbols, n + 6).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(6):
        key = (key << 9) | wide[k : n + k]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ties, depth = np.arange(n), 6
    while depth < 2 * n:
        alone = new & np.concatenate([new[1:], [True]])
        ties = ties[~alone]
        if not len(ties):
            break
        rows = order[ties]
        key = rank[rows] * n + rank[(rows + depth) % n]
        step = np.argsort(key)
        key, rows = key[step], rows[step]
        order[ties] = rows
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[rows] = np.maximum.accumulate(np.where(new, ties, 0))
        depth *= 2
    before = order - 1
    before[before < 0] = n - 1
    rank[order] = np.arange(n)
    return order, symbols[before], rank[before]


def merged(shards: list[np.ndarray], left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated intervals of all shards' suffixes at `depth` symbols, from their transforms.

    The interleave of the shards' rows is refined symbol by symbol: a stable deal of the rows by the symbol before them
    orders the rows one symbol earlier. Rows that have become alone, or whose stretch ends (left: symbols up to its end),
    leave; what they shared with their neighbours is then their common prefix. Returns the positions in the shards'
    concatenation, their intervals ascending, and for every position the longest prefix it shares, up to depth.
    """
    places, symbols, earlier, base = [], [], [], 0
    for s in shards:
        order, last, back = bwt(s)
        places.append(order + base)
        symbols.append(last)
        earlier.append(back + base)
        base += len(s)
    place, symbol, back = np.concatenate(places).astype(np.int32), np.concatenate(symbols), np.concatenate(earlier).astype(np.int32)
    room = left[place]
    rows, block = np.arange(base, dtype=np.int32), np.zeros(base, np.int32)
    prefix = np.zeros(base, np.int16)
    for h in range(1, depth + 1):
        s = symbol[rows]
        step = np.argsort(s, kind="stable")
        s, block, rows = s[step], block[step], back[rows[step]]
        new = np.empty(len(rows) + 1, bool)
        new[0] = new[-1] = True
        new[1:-1] = (s[1:] != s[:-1]) | (block[1:] != block[:-1])
        stays = ~(new[:-1] & new[1:]) & (room[rows] >= h)
        block = np.cumsum(new[:-1], dtype=np.int32)[stays]
        rows = rows[stays]
        prefix[rows] = h
        if not len(rows):
            break
    out = np.zeros(base, np.int16)
    out[place] = prefix
    return place[rows], block, out


def earliest(stretches: list[bytes], documents: np.ndarray, width: int) -> list[np.ndarray]:
    """For each window of each stretch the smallest of the stretches' documents that hold it."""
    groups, one, size = [], [], 0
    for s in stretches:
        one.append(s)
        size += len(s) + 1
        if size >= SHARD:
            groups.append(one)
            one, size = [], 0
    if one:
        groups.append(one)
    shards = []
    for group in groups:
        flat = np.frombuffer(b"\0".join(group) + b"\0", np.uint8).astype(np.int16) + 1
        flat[np.cumsum([len(s) + 1 for s in group]) - 1] = 0
        shards.append(flat)
    lengths = np.array([len(s) + 1 for s in stretches])
    owner = np.repeat(np.arange(len(stretches)), lengths)
    left = (np.repeat(np.cumsum(lengths) - 1, lengths) - np.arange(lengths.sum())).astype(np.int32)
    place, interval, _ = merged(shards, left, width)
    at = documents[owner]  # a string that occurs once is its own document's
    if len(place):
        document = at[place]
        heads = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
        at[place] = np.repeat(np.minimum.reduceat(document, heads), np.diff(np.append(heads, len(interval))))
    starts = np.cumsum(lengths) - lengths
    return [at[a : a + n - width] for a, n in zip(starts, lengths, strict=True)]


class Batch:
    """The documents of a batch by ascending id, and their runs of windows; documents that are copies have none."""

    def __init__(self, table: pa.Table, messages: pa.Table):
        order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
        self.ids = table["doc_id"].to_numpy()[order]
        data = table["data"]
        parts = [data[int(i)].as_py() for i in order]
        # Rows with different texts can share an id, so a copy is a row with this id and this text.
        copies = {(i, d) for i, d in zip(messages["copy"].to_pylist(), messages["digest"].to_pylist(), strict=True) if d is not None}
        named = {i for i, _ in copies}
        self.copy = np.fromiter((i in named and (i, hashlib.sha256(x).digest()) in copies for i, x in zip(self.ids.tolist(), parts, strict=True)), bool, len(parts))
        self.bounds = np.cumsum([0, *map(len, parts)])
        self.bytes = b"".join(parts)
        first, last, value = runs(np.frombuffer(self.bytes, np.uint8), self.bounds)
        document = np.searchsorted(self.bounds, first, side="right") - 1
        mine = ~self.copy[document]
        self.first, self.last, self.document, value = first[mine], last[mine], document[mine], value[mine]
        self.value, self.high = value & LOW48, value >> np.uint64(48)

    def stretches(self, mine: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The different stretches of the runs `mine` in order of appearance: bytes, the first run of each; and the stretch of each run."""
        known: dict[bytes, int] = {}
        data = self.bytes
        which = np.fromiter((known.setdefault(data[a:b], len(known)) for a, b in zip(self.first[mine].tolist(), (self.last[mine] + WIDTH).tolist(), strict=True)), np.int64, len(mine))
        _, head = np.unique(which, return_index=True)  # documents ascend, so the first holder has the smallest id
        return list(known), mine[head], which

    def among(self, values: np.ndarray) -> np.ndarray:
        """Runs whose anchor is one of the ascending values."""
        if not len(values):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(values, self.value), len(values) - 1)
        return np.flatnonzero(values[at] == self.value)

    def several(self) -> np.ndarray:
        """Ascending anchors that different documents of the batch have."""
        order = np.argsort(self.value, kind="stable")
        value, document = self.value[order], self.document[order]
        at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        return value[at[np.maximum.reduceat(document, at) != np.minimum.reduceat(document, at)]] if len(at) else value[:0]


def six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def cut_at(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if not len(sorted_keys):
        return
    heads = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    for a, b in zip(heads, np.append(heads[1:], len(sorted_keys)), strict=True):
        yield int(sorted_keys[a]), int(a), int(b)


def shared_of(table: pa.Table) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(from_six(x) for x in table["shared"].to_pylist() if x)]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    # The largest long stands for null below, so that a table that has it goes by places too.
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) and docs.filter(F.col("doc_id") == int(LAST)).isEmpty():
        return without_repeats(docs)
    # Other ids are replaced by their places in order.
    names = docs.filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy("doc_id")
    names = common.checkpoint(names.select("doc_id", F.monotonically_increasing_id().alias("place")))
    found = without_repeats(docs.select("doc_id", "text").join(names, "doc_id", "left").select(F.col("place").alias("doc_id"), "text"))
    return found.withColumnRenamed("doc_id", "place").join(names, "place", "left").drop("place").select(*found.columns)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The same for docs with integer ids."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    size = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(common.partitions(spark), -(-size // BUCKET_BYTES))
    dealt = rows.withColumn("batch", common.salt(max(buckets, -(-size // BATCH_BYTES)), "doc_id", "data"))

    def send_anchors(table: pa.Table, messages: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if table.num_rows:
            batch = Batch(table, messages)
            bucket = batch.high % np.uint64(buckets)
            order = np.lexsort((batch.value, bucket))
            value, bucket, document = batch.value[order], bucket[order].astype(np.int64), batch.document[order]
            if len(value):
                at = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])]))
                several = np.maximum.reduceat(document, at) != np.minimum.reduceat(document, at)
                value, bucket = value[at] | several.astype(np.uint64), bucket[at]
                for k, a, b in cut_at(bucket):
                    out[0].append(k)
                    out[2].append(six(value[a:b]))
            out[1] = [table["batch"][0].as_py()] * len(out[0])
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "batch": pa.array(out[1], pa.int32()), "values": pa.array(out[2], pa.binary())})

    def answer_anchors(table: pa.Table) -> pa.Table:
        blobs = table["values"].to_pylist()
        value = np.concatenate([from_six(x) for x in blobs])
        batch = np.repeat(np.arange(len(blobs)), [len(x) // 6 for x in blobs])
        several, value = value & np.uint64(1) == 1, value & LOW48
        order = np.argsort(value, kind="stable")
        value, batch, several = value[order], batch[order], several[order]
        same = np.concatenate([[False], value[1:] == value[:-1]])
        keep = several | same | np.concatenate([same[1:], [False]])
        value, batch = value[keep], batch[keep]
        order = np.argsort(batch, kind="stable")
        value, batch = value[order], batch[order]
        found = [(k, six(value[a:b])) for k, a, b in cut_at(batch)]
        ids = table["batch"].to_numpy()
        return pa.table({"batch": pa.array([ids[k] for k, _ in found], pa.int32()), "shared": pa.array([x for _, x in found], pa.binary())})

    def send_stretches(table: pa.Table, messages: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("bucket", "batch", "values", "runs", "sizes", "documents", "data")}
        if table.num_rows and messages.num_rows:
            batch = Batch(table, messages)
            found, head, _ = batch.stretches(batch.among(shared_of(messages)))
            bucket = (batch.high[head] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            pack = zstandard.ZstdCompressor(level=3)
            for k, a, b in cut_at(bucket[order]):
                own = order[a:b]
                out["bucket"].append(k)
                out["values"].append(six(batch.value[head[own]]))
                out["runs"].append(pack.compress(head[own].astype(np.int32).tobytes()))
                out["sizes"].append(pack.compress(np.array([len(found[i]) for i in own], np.int32).tobytes()))
                out["documents"].append(pack.compress(batch.ids[batch.document[head[own]]].tobytes()))
                out["data"].append(pack.compress(b"".join(found[i] for i in own)))
            out["batch"] = [table["batch"][0].as_py()] * len(out["bucket"])
        return pa.table({c: pa.array(v, pa.int32() if c in ("bucket", "batch") else pa.binary()) for c, v in out.items()})

    def answer_stretches(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        known: dict[tuple[int, bytes], int] = {}
        where, documents = [], []
        for row in table.to_pylist():
            sizes, data = np.frombuffer(unpack.decompress(row["sizes"]), np.int32), unpack.decompress(row["data"])
            ends = np.cumsum(sizes).tolist()
            where.append(np.array([known.setdefault((v, data[a:b]), len(known)) for v, a, b in zip(from_six(row["values"]).tolist(), [0, *ends], ends, strict=False)], np.int64))
            documents.append(np.frombuffer(unpack.decompress(row["documents"]), np.int64))
        low = np.full(len(known), LAST)
        np.minimum.at(low, np.concatenate(where), np.concatenate(documents))
        # Anchors with several different stretches go through the merge, some anchors at a time.
        value = np.fromiter((v for v, _ in known), np.uint64, len(known))
        contents = [s for _, s in known]
        order = np.argsort(value, kind="stable")
        windows: dict[int, np.ndarray] = {}
        group, total = [], 0
        pieces = [(a, b) for _, a, b in cut_at(value[order]) if b - a > 1]
        for n, (a, b) in enumerate(pieces):
            group += order[a:b].tolist()
            total += sum(len(contents[i]) for i in order[a:b])
            if total >= COLLECTION or n == len(pieces) - 1:
                windows.update(zip(group, earliest([contents[i] for i in group], low[group], WIDTH), strict=True))
                group, total = [], 0
        out: dict[str, list] = {c: [] for c in ("batch", "run", "window", "low")}
        for k, (own, mine) in enumerate(zip(where, documents, strict=True)):
            run, at, window, lows = np.frombuffer(unpack.decompress(table["runs"][k].as_py()), np.int32), [], [], []
            for i in np.flatnonzero(low[own] < mine).tolist():
                if own[i] not in windows:
                    at.append(run[i])
                    window.append(0)
                    lows.append(low[own[i]])
            for i, n in enumerate(own.tolist()) if windows else ():
                if n in windows and (windows[n] < mine[i]).any():
                    w = np.minimum(windows[n], mine[i])
                    for _, a, _ in cut_at(w):
                        at.append(run[i])
                        window.append(a)
                        lows.append(w[a])
            if at:
                out["batch"].append(table["batch"][k].as_py())
                for name, values, kind in (("run", at, np.int32), ("window", window, np.int32), ("low", lows, np.int64)):
                    out[name].append(np.array(values, kind).tobytes())
        return pa.table({c: pa.array(v, pa.int32() if c == "batch" else pa.binary()) for c, v in out.items()})

    def apply(table: pa.Table, messages: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        if table.num_rows:
            batch = Batch(table, messages)
            answers = [[np.frombuffer(x, kind) for x in messages[c].drop_null().to_pylist()] for c, kind in (("run", np.int32), ("window", np.int32), ("low", np.int64))]
            answered, window, lows = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in answers)
            mine = batch.among(np.union1d(batch.several(), batch.value[answered]))
            covered = np.zeros(len(batch.bytes) + 1, np.int32)
            if len(mine):
                _, head, which = batch.stretches(mine)
                low, cut = batch.ids[batch.document[head]].copy(), {}
                order = np.lexsort((window, answered))
                answered, window, lows = answered[order], window[order], lows[order]
                stretch = np.searchsorted(mine, answered)
                for k, a, b in cut_at(answered):
                    if b - a == 1:
                        low[which[stretch[a]]] = lows[a]
                    else:
                        cut[int(which[stretch[a]])] = (window[a:b], lows[a:b])
                document = batch.ids[batch.document[mine]]
                plain = low[which] < document
                if cut:
                    parted = np.isin(which, np.fromiter(cut, np.int64))
                    plain &= ~parted
                    for r, w, d in zip(*(x[parted].tolist() for x in (mine, which, document)), strict=True):
                        window, lows = cut[w]
                        starts = batch.first[r] + window
                        ends = np.append(starts[1:], batch.last[r] + 1)
                        np.add.at(covered, starts[lows < d], 1)
                        np.add.at(covered, ends[lows < d] - 1 + WIDTH, -1)
                np.add.at(covered, batch.first[mine[plain]], 1)
                np.add.at(covered, batch.last[mine[plain]] + WIDTH, -1)
            for k in np.flatnonzero(batch.copy):
                a, b = batch.bounds[k : k + 2]
                if b - a >= WIDTH:
                    covered[a] += 1
                    covered[b] -= 1
            gone = np.cumsum(covered[:-1]) > 0
            data = np.frombuffer(batch.bytes, np.uint8)
            for k, doc in enumerate(batch.ids.tolist()):
                a, b = batch.bounds[k : k + 2]
                mask = gone[a:b]
                removed = int(mask.sum())
                kept = data[a:b][~mask].tobytes() if removed else batch.bytes[a:b]
                out["doc_id"].append(None if doc == LAST else doc)
                out["n_bytes"].append(b - a)
                out["n_removed"].append(removed)
                out["n_spans"].append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    # Copies of a whole text with a smaller id lose everything and are nowhere the first to hold a string.
    digests = dealt.select("batch", "doc_id", F.unhex(F.sha2("data", 256)).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = common.checkpoint(digests.join(first, "digest").filter("doc_id > first").select(F.col("batch").alias("to"), F.col("doc_id").alias("copy"), "digest").distinct())
    # One job from here on, so that the texts are dealt once and the three steps at the batches share that exchange.
    by_batch = dealt.groupBy("batch")

    def told(*messages: DataFrame):
        out = copies.withColumns({c: F.lit(None).cast("binary") for c in ("shared", "run", "window", "low")})
        for m in messages:
            out = out.unionByName(m.withColumnRenamed("batch", "to"), allowMissingColumns=True)
        return out.groupBy("to")

    sent = by_batch.cogroup(told()).applyInArrow(send_anchors, "bucket int, batch int, values binary")
    known = sent.groupBy("bucket").applyInArrow(answer_anchors, "batch int, shared binary")
    stretches = by_batch.cogroup(told(known)).applyInArrow(send_stretches, "bucket int, batch int, values binary, runs binary, sizes binary, documents binary, data binary")
    found = stretches.groupBy("bucket").applyInArrow(answer_stretches, "batch int, run binary, window binary, low binary")
    return by_batch.cogroup(told(found)).applyInArrow(apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir)).drop("kept")
