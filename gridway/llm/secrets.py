"""Secret scans: fixed patterns, and strings that a Markov model of random characters explains better than one of identifiers.

Base spans are leftmost non-overlapping matches of three patterns. The places of matches follow from the lengths of what a split
by the pattern leaves between them. Runs of at least `least` letters, digits, +, /, _ and - that have a letter and that no base span
touches are candidates: each is scored by the logarithm of how much likelier a character Markov model of random strings makes it
than one of ordinary identifiers, and becomes a span of kind `random` where that passes log(odds).

Both models are learnt from labelled strings, at most `per_label` distinct ones each, those with the smallest hash. Random are what
the base patterns find in all documents, and digests in the alphabets of common keys, which are random by construction. Ordinary are
runs of 6 to `least` - 1 characters outside base spans, from about `documents` documents, also in capitals. Models are counts of pairs of ASCII
characters, 128 x 128 numbers whatever the data, smoothed by single characters.

Null texts count as empty. Rows that share an id are scanned each by itself. An empty table gives an empty result. Extra columns are
ignored, whatever their names. Texts are scanned whole; places count code points. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The kinds in order, their patterns and the characters a match, or its second group, has to have.
BASE = {
    "assign": (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]{24,}", 24),
}
KINDS = [*BASE, "random"]
CODES = 128


def runs(least: int, most: int | None = None) -> str:
    """Whole runs of the characters of keys, with a letter, next to no other letter."""
    return rf"(?<![A-Za-z0-9+/_\x{{80}}-\x{{10FFFF}}-])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{{least},{most or ''}}}(?![A-Za-z0-9+/_\x{{80}}-\x{{10FFFF}}-])"


def matches(text: Column, kind: int, pattern: str) -> Column:
    """An array of (kind, nth, gap, size, value): gap is the number of characters between a match and the one before."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    row = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["value"]).alias("size"), x["value"].alias("value"))
    each = F.filter(F.transform(F.arrays_zip(between.alias("gap"), found.alias("value")), row), lambda x: x["value"].isNotNull())
    return F.when(F.regexp_like(text, F.lit(pattern)), each)


def extracted(docs: DataFrame, least: int) -> DataFrame:
    """(row, doc_id, kind, nth, gap, size, value), one for each match of a pattern or run, and one without kind where there is none."""
    text = F.coalesce("text", F.lit(""))
    patterns = [p for p, _ in BASE.values()] + [runs(least)]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    each = F.flatten(F.array_compact(F.array(*(matches(F.col("text"), k, p) for k, p in enumerate(patterns)))))
    return rows.select("row", "doc_id", F.explode_outer(each).alias("match")).select("row", "doc_id", "match.*")


def secret(value: Column, kind: Column) -> Column:
    """What of a base match is the secret; null where the match is too short."""
    pattern, n = BASE["assign"]
    group = F.regexp_extract(value, pattern, 2)
    found = F.when(kind == 0, F.when(F.length(group) >= n, group))
    for k, (_, least) in list(enumerate(BASE.values()))[1:]:
        found = found.when((kind == k) & (F.length(value) >= least), value)
    return found


def samples(docs: DataFrame, found: DataFrame, least: int = 16, per_label: int = 20_000, documents: int = 4_000, generated: int = 1_000) -> DataFrame:
    """(value, random): labelled strings to learn from. found is extracted(docs)."""
    spark = docs.sparkSession
    bounded = lambda df: df.distinct().orderBy(F.xxhash64("value"), "value").limit(per_label)
    known = bounded(found.filter("kind < 3").select(secret(F.col("value"), F.col("kind")).alias("value")).filter("value IS NOT NULL"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    base36 = F.concat(*(F.conv(F.substring(digest, at, 12), 16, 36) for at in (1, 13, 25, 37)))
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    made = spark.range(generated).select(F.explode(F.array(digest, F.upper(digest), base36, base64, F.translate(base64, "+/", "-_"))).alias("value"))
    n = docs.count()
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1, documents / max(n, 1))))
    rest = F.coalesce("text", F.lit(""))
    for pattern, _ in BASE.values():
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = bounded(some.select(F.explode(F.regexp_extract_all(rest, F.lit(runs(6, least - 1)), F.lit(0))).alias("value")))
    # Constants are identifiers in capitals, which prose has few of.
    written = ordinary.select(F.explode(F.array("value", F.upper("value"))).alias("value"))
    return known.unionByName(made).select("value", F.lit(True).alias("random")).unionByName(written.select("value", F.lit(False).alias("random")))


def fit(labelled: DataFrame, weight: float = 4.0) -> list[float]:
    """At 128 * code before (0 at the start) + code: how much likelier a random string has that pair than an ordinary one, as a
    logarithm. Counts of pairs leave Spark, no more than 2 x 128 x 128."""
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    pairs = labelled.select("random", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), chars).alias("before"), chars.alias("own"))).alias("pair")).filter("pair.own IS NOT NULL")
    codes = pairs.select("random", F.ascii("pair.before").alias("before"), F.ascii("pair.own").alias("own")).filter(f"before < {CODES} AND own < {CODES}")
    counts = {(r.random, r.before, r.own): r.n for r in codes.groupBy("random", "before", "own").agg(F.count("*").alias("n")).collect()}
    logs = {}
    for label in (True, False):
        single, start, total = [0.0] * CODES, [0.0] * CODES, 0
        for (own, before, code), n in counts.items():
            if own == label:
                single[code], start[before], total = single[code] + n, start[before] + n, total + n
        share = [(s + 0.5) / (total + 0.5 * CODES) for s in single]
        logs[label] = [math.log((counts.get((label, b, c), 0) + weight * share[c]) / (start[b] + weight)) for b in range(CODES) for c in range(CODES)]
    return [a - b for a, b in zip(logs[True], logs[False], strict=True)]


def ratio(value: Column, model: list[float]) -> Column:
    """The logarithm of the likelihood ratio of the whole string, in one pass over its characters."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c))
    begin = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    step = lambda held, code: F.struct(code.alias("before"), (held["sum"] + F.get(table, held["before"] * CODES + code)).alias("sum"))
    return F.aggregate(codes, begin, step, lambda held: held["sum"])


def placed(found: DataFrame, model: list[float], odds: float) -> DataFrame:
    """Per row: its spans (kind, start, end, score) by start and kind."""
    kind = F.col("kind")
    stays = F.when(kind < 3, secret(F.col("value"), kind).isNotNull()).when(kind == 3, F.col("score") > math.log(odds))
    scored = found.withColumn("score", F.when(kind == 3, ratio(F.col("value"), model)))
    sized = scored.select("row", "doc_id", "kind", "nth", "gap", "size", "score", stays.alias("stays")).repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("nth")
    start = F.sum("gap").over(before) + F.coalesce(F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sized.withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))
    # A candidate gives way to the base spans that it touches: those that start no later and end after its start, or start within it.
    along = Window.partitionBy("row").orderBy("start")
    base = (kind < 3) & F.col("stays")
    reach = F.max(F.when(base, F.col("end"))).over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(base, F.col("start"))).over(along.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end"))
    kept = spans.withColumn("free", (kind < 3) | free)
    span = F.struct("start", "kind", "end", "score")
    return kept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("stays") & F.col("free"), span))).alias("spans"))


def scan(docs: DataFrame, least: int = 16, odds: float = 1e6, **bounds: int) -> DataFrame:
    """Per row of docs (doc_id, text): its spans (kind, start, end, score); score is null for base spans."""
    found = common.checkpoint(extracted(docs, least))
    model = fit(samples(docs, found, least, **bounds))
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    named = F.transform("spans", lambda s: F.struct(name(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return placed(found, model, odds).select("doc_id", named.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts and joined spans of scan()'s rows."""
    is_kind = lambda kind: lambda s: s["kind"] == kind
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [F.size(F.filter("spans", is_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(common.documents(spark, sf_dir)))
