"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Learning takes all trusted documents but the quarter that sets the limits. Their character n-grams are counted in tables dealt
by n-gram; discounts, continuation counts and back-off weights are group sums over those tables, which stay where they are.

To score the corpus, documents are dealt to batches. Each batch sends its distinct n-grams to shards; the distinct n-grams of
all batches are joined with the tables, order by order, which gives each its cost; shards answer every batch with the costs of
its n-grams, and a document's perplexity is a sum over them. What travels is one number for each distinct n-gram of a batch,
not of a document, and texts travel once.

A document is rejected when its perplexity, smoothed towards its language's mean by `prior` characters, lies above what nearly
all trusted documents of its language reach. The limits come from trusted documents that did not train; languages with
few of them, and null languages, use those of all languages.

The model's alphabet is the 32,766 characters that trusted texts use most, twice at least; all others are one unknown
character. Null and blank texts have no perplexity and are rejected. Rows that share an id are scored and kept each by itself.
Without trusted documents nothing is rejected but blank texts. An empty table gives an empty result. Extra columns are ignored
by judge() and kept by keep_rows(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Ids: 0 unknown, 1 the start of a text, then characters. ORDER of them make one key.
UNKNOWN, START, BITS, ORDER = 0, 1, 15, 4
MASK = (1 << BITS) - 1
#: Bytes of text in a batch, and n-grams handled at once.
BATCH_BYTES, STRETCH = 4 << 20, 1 << 20


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ngrams(text: str, ids: np.ndarray) -> Iterator[np.ndarray]:
    """The n-grams that end at the characters of the text, in stretches."""
    w = np.concatenate([np.full(ORDER - 1, START, ids.dtype), ids[codes(text)]])
    for at in range(0, len(w) - ORDER + 1, STRETCH):
        part = w[at : at + STRETCH + ORDER - 1].astype(np.int64)
        n = len(part) - ORDER + 1
        keys = part[:n]
        for k in range(1, ORDER):
            keys = (keys << BITS) | part[k : n + k]
        yield keys


def distinct(texts: Iterator[str], ids: np.ndarray) -> np.ndarray:
    """The distinct n-grams of some texts, ascending."""
    known, held, size = np.zeros(0, np.int64), [], 0
    for text in texts:
        for keys in ngrams(text, ids):
            held.append(keys)
            size += len(keys)
            if size >= 4 * STRETCH:
                known, held, size = np.union1d(known, np.concatenate(held)), [], 0
    return np.union1d(known, np.concatenate(held)) if held else known


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the counts of counts of (key, n)."""
    n = counts.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    y = n.n1 / (n.n1 + 2 * n.n2) if n.n1 else 0.5
    out = [k - (k + 1) * y * n[f"n{k + 1}"] / n[f"n{k}"] if n[f"n{k}"] else k * 0.5 for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), out, strict=True)]


def smoothed(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """alpha (key, v) and lambda (context, v) of counts (key, n), context being all but the last word."""
    d = discounts(counts)
    taken = F.element_at(F.array(*map(F.lit, d)), F.least("n", F.lit(3)).cast("int"))
    context = F.shiftright("key", BITS).alias("context")
    sums = counts.groupBy(context).agg(F.sum("n").alias("total"), F.sum(taken).alias("back"))
    alpha = counts.withColumn("context", F.shiftright("key", BITS)).join(sums, "context").select("key", ((F.col("n") - taken) / F.col("total")).alias("v"))
    return alpha, sums.select(F.col("context").alias("key"), (F.col("back") / F.col("total")).alias("v"))


def wide(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams that end at the characters of the text as pairs of numbers, two code points in each; a text starts with 0s."""
    w = np.concatenate([np.zeros(ORDER - 1, np.int64), codes(text).astype(np.int64) + 1])
    for at in range(0, len(w) - ORDER + 1, STRETCH):
        part = w[at : at + STRETCH + ORDER - 1]
        n = len(part) - ORDER + 1
        yield part[:n] << 21 | part[1 : n + 1], part[2 : n + 2] << 21 | part[3 : n + 3]


def train(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, dict[str, DataFrame], np.ndarray] | None:
    """Ids by character, tables and unigrams of docs (doc_id, text) whose id is trusted (doc_id); None without any character.

    Texts are read once: their n-grams are counted by code points, and the characters' counts follow from those of n-grams.
    """
    spark = docs.sparkSession
    maybe = common.may_contain(docs.filter("text IS NOT NULL").select("doc_id", "text"), common.id_filter(trusted, F.col("doc_id")), F.col("doc_id"))
    text = maybe.join(trusted.distinct(), "doc_id").select("text")  # a semi join would be moved before the filter

    def count_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("a", np.int64), ("b", np.int64)])
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                held, size = [], 0
                texts = batch.column(0).slice(start, 256)
                for k, t in enumerate(texts):
                    for x, y in wide(t.as_py()):
                        pairs = np.empty(len(x), kind)
                        pairs["a"], pairs["b"] = x, y
                        held.append(pairs)
                        size += len(x)
                    if held and (size >= STRETCH or k == len(texts) - 1):
                        one = np.concatenate(held)
                        one = one[np.lexsort((one["b"], one["a"]))]
                        at = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
                        yield pa.RecordBatch.from_pydict({"a": np.ascontiguousarray(one["a"][at]), "b": np.ascontiguousarray(one["b"][at]), "n": np.diff(np.append(at, len(one))).astype(np.int64)})
                        held, size = [], 0

    grams = common.checkpoint(text.mapInArrow(count_wide, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")))
    counted = grams.groupBy((F.col("b").bitwiseAND(F.lit((1 << 21) - 1)) - 1).alias("code")).agg(F.sum("n").alias("n"))
    known = counted.filter("n > 1").orderBy(F.desc("n"), "code").limit(MASK - 1).collect()  # at most 2 ** BITS characters
    if not known:
        return None
    vocabulary = np.zeros(0x110000, np.uint16)
    vocabulary[[r.code for r in known]] = np.arange(2, len(known) + 2)
    shared = spark.sparkContext.broadcast(vocabulary)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([[START], shared.value]).astype(np.int64)
        low = (1 << 21) - 1
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in (0, 1))
            key = np.zeros(len(a), np.int64)
            for part in (a >> 21, a & low, b >> 21, b & low):
                key = key << BITS | ids[part]
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(2)], ["key", "n"])

    counts = common.checkpoint(grams.mapInArrow(named, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    tables = {}
    for n in range(ORDER, 1, -1):
        tables[f"alpha{n}"], tables[f"lambda{n - 1}"] = smoothed(counts)
        # Below the highest order an n-gram counts once for each different word before it.
        shorter = F.col("key").bitwiseAND(F.lit((1 << ((n - 1) * BITS)) - 1)).alias("key")
        counts = common.checkpoint(counts.groupBy(shorter).agg(F.count("*").alias("n")))
    size = len(known) + 2
    one = {r.key: r.n for r in counts.collect()}  # one row per character
    n = np.zeros(size)
    n[list(one)] = list(one.values())
    d = np.array([0, *discounts(counts)])[np.minimum(n, 3).astype(int)]
    unigram = ((n - d) + d.sum() / size) / n.sum()
    return vocabulary, tables, unigram.astype(np.float32)


def costs(keys: DataFrame, tables: dict[str, DataFrame], unigram: np.ndarray) -> DataFrame:
    """keys (key and any other columns) with cost: minus the log probability of the last character after the others."""
    spark = keys.sparkSession
    one = spark.createDataFrame([(i, float(p)) for i, p in enumerate(unigram)], "last bigint, p double")  # a row for each character
    out = keys.withColumn("last", F.col("key").bitwiseAND(F.lit(MASK))).join(F.broadcast(one), "last", "left").drop("last")
    for n in range(2, ORDER + 1):
        own = F.col("key").bitwiseAND(F.lit((1 << (n * BITS)) - 1))
        for name, key in ((f"alpha{n}", own), (f"lambda{n - 1}", F.shiftright(own, BITS))):
            table = tables[name].select(F.col("key").alias("at"), F.col("v").alias(name))
            out = out.withColumn("at", key).join(F.broadcast(table) if name == "lambda1" else table, "at", "left").drop("at")
        p = F.coalesce(f"alpha{n}", F.lit(0.0)) + F.coalesce(f"lambda{n - 1}", F.lit(1.0)) * F.col("p")
        out = out.withColumn("p", p).drop(f"alpha{n}", f"lambda{n - 1}")
    return out.withColumn("cost", -F.log("p").cast("float")).drop("p")


def score(docs: DataFrame, trained) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, lang, hash (of the text), n (characters), nll (minus the log probability)."""
    spark = docs.sparkSession
    vocabulary, tables, unigram = trained
    shards = common.partitions(spark)
    names = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.withColumn("batch", common.salt(max(shards, -(-size // BATCH_BYTES)), "doc_id", "hash"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What goes from one task to a batch of documents, in one row, texts compressed together."""
        pack = zstandard.ZstdCompressor(level=3)
        for found in batches:
            to = found.column("batch").to_numpy()
            order = np.argsort(to, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0])) if len(to) else np.zeros(0, np.int64)
            for a, b in zip(at, np.append(at[1:], len(to)), strict=True):
                own = found.take(pa.array(order[a:b]))
                texts = [t.encode() for t in own.column("text").to_pylist()]
                listed = [pa.array([own.column(c).to_pylist()], pa.list_(found.schema.field(c).type)) for c in ("doc_id", "lang", "hash")]
                sizes = pa.array([list(map(len, texts))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([to[order[a]]], pa.int32()), *listed, sizes, pa.array([pack.compress(b"".join(texts))], pa.binary())], ["batch", "doc_id", "lang", "hash", "sizes", "texts"])

    batches = dealt.mapInArrow(packed, f"batch int, doc_id array<{kind}>, lang array<string>, hash array<bigint>, sizes array<int>, texts binary").groupBy("batch")

    def texts_of(table: pa.Table) -> Iterator[str]:
        unpack = zstandard.ZstdDecompressor()
        for sizes, blob in zip(table["sizes"].to_pylist(), table["texts"].to_pylist(), strict=True):
            data, at = unpack.decompress(blob), 0
            for n in sizes:
                yield data[at : at + n].decode().strip()
                at += n

    def told(*answers: DataFrame):
        """The messages to batches; without any, the same dealing, so that texts are dealt once."""
        none = spark.createDataFrame([], "to int, keys binary, costs binary")
        return (answers[0] if answers else none).groupBy("to")

    def ask(table: pa.Table, _: pa.Table) -> pa.Table:
        out: list[list] = [[], []]
        if table.num_rows:
            keys = distinct(texts_of(table), names.value)
            shard = (keys ^ (keys >> BITS) * 31 ^ (keys >> 2 * BITS) * 17) % shards
            order = np.argsort(shard, kind="stable")
            at = np.searchsorted(shard[order], np.arange(shards + 1))
            pack = zstandard.ZstdCompressor(level=1)
            for k in np.flatnonzero(np.diff(at)).tolist():
                out[0].append(k)
                out[1].append(pack.compress(np.diff(keys[order[at[k] : at[k + 1]]], prepend=0).tobytes()))
        batch = table["batch"][0].as_py() if len(out[0]) else 0
        return pa.table({"shard": pa.array(out[0], pa.int32()), "from": pa.array([batch] * len(out[0]), pa.int32()), "keys": pa.array(out[1], pa.binary())})

    def unpacked(blob: bytes) -> np.ndarray:
        return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64))

    def gather(table: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64)
        for blob in table["keys"].to_pylist():
            found = np.union1d(found, unpacked(blob))
        return pa.table({"shard": pa.array(np.full(len(found), table["shard"][0].as_py(), np.int32)), "key": found})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        keys, cost = known["key"].to_numpy(), known["cost"].to_numpy()
        order = np.argsort(keys)
        keys, cost = keys[order], cost[order].astype(np.float32)
        for to, blob in zip(asked["from"].to_pylist(), asked["keys"].to_pylist(), strict=True):
            out[0].append(to)
            out[1].append(blob)
            out[2].append(cost[np.searchsorted(keys, unpacked(blob))].tobytes())
        return pa.table({"to": pa.array(out[0], pa.int32()), "keys": pa.array(out[1], pa.binary()), "costs": pa.array(out[2], pa.binary())})

    def add_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        n, nll = [], []
        if table.num_rows:
            keys = np.concatenate([np.zeros(0, np.int64), *map(unpacked, answers["keys"].to_pylist())])
            cost = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(c, np.float32) for c in answers["costs"].to_pylist())])
            order = np.argsort(keys)
            keys, cost = keys[order], cost[order].astype(float)
            for t in texts_of(table):
                parts = list(ngrams(t, names.value))
                n.append(sum(map(len, parts)))
                nll.append(sum(float(cost[np.searchsorted(keys, p)].sum()) for p in parts))
        own = [pc.list_flatten(table[c]) for c in ("doc_id", "lang", "hash")]
        return pa.table([*own, pa.array(n, pa.int64()), pa.array(nll, pa.float64())], ["doc_id", "lang", "hash", "n", "nll"])

    asked = batches.cogroup(told()).applyInArrow(ask, "shard int, from int, keys binary")
    known = costs(asked.groupBy("shard").applyInArrow(gather, "shard int, key bigint"), tables, unigram)
    answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "to int, keys binary, costs binary")
    return batches.cogroup(told(answers)).applyInArrow(add_up, f"doc_id {kind}, lang string, hash bigint, n bigint, nll double")


def limits(scored: DataFrame, good: DataFrame, quantile: float, prior: int, slack: float, least: int) -> tuple[Column, Column]:
    """(nats per character, smoothed; the limit) of scored rows (lang, n, nll), from all trusted documents that did not train."""
    held = scored.filter("n > 0").filter(calibrates()).join(good, "doc_id", "left_semi")
    mean = F.sum("nll") / F.sum("n")
    # One row per language, and one for all.
    means = {r.lang: r.mean for r in held.groupBy("lang").agg(mean.alias("mean"), F.count("*").alias("texts")).filter(F.col("texts") >= least).collect()}
    overall = held.agg(mean.alias("mean")).first().mean
    even = (F.col("nll") + prior * by_language(means, overall or 0.0)) / (F.col("n") + prior)
    limit = F.percentile_approx(even, quantile, 10_000).alias("limit")
    own = {r.lang: r.limit + slack for r in held.groupBy("lang").agg(limit).collect() if r.lang in means}
    general = held.agg(limit).first().limit
    return even, by_language(own, float("inf") if general is None else general + slack)


def by_language(values: dict[str, float], default: float) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("lang")), F.lit(default))


def calibrates() -> Column:
    """A quarter of the trusted documents set the limits, the others train."""
    return F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0


def judged(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, prior: int = 60, slack: float = 0.2, least: int = 30) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, hash (of the text), n_chars, perplexity, limit, kept."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()
    trained = train(docs.select("doc_id", "text"), good.filter(~calibrates()))
    if trained is None:
        n = F.coalesce(F.length(F.trim("text")), F.lit(0)).cast("long")
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", F.xxhash64("text").alias("hash"), n.alias("n_chars"), nothing.alias("perplexity"), nothing.alias("limit"), (n > 0).alias("kept"))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    scored = common.checkpoint(score(rows, trained))
    even, limit = limits(scored, good, quantile, prior, slack, least)
    kept = (F.col("n") > 0) & (even <= limit)
    return scored.select("doc_id", "hash", F.col("n").alias("n_chars"), F.when(F.col("n") > 0, F.exp(F.col("nll") / F.col("n"))).alias("perplexity"), F.exp(limit).alias("limit"), kept.alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, n_chars, perplexity, limit, kept. labels: (doc_id, quality, toxic)."""
    return judged(docs, labels, **options).drop("hash")


def keep_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs' rows that are not rejected, with all their columns."""
    good = judged(docs, labels, **options).filter("kept").select(F.col("doc_id").alias("__good_id"), F.col("hash").alias("__good_hash")).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["__good_id"]) & (F.xxhash64(docs["text"]) == good["__good_hash"]), "left_semi")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
