"""How the sources of each language differ in their terms: a sort-based streaming audit.

Three passes over sorted rows, each of constant memory but for the sources of one term or of one block:

1. Tasks count terms by language and source over blocks of documents, so that a frequent term leaves a block once for each source
   and not once for each document. The rows are repartitioned by (lang, term) and sorted by (lang, term, source, document); a
   run-length scan yields each run's document frequency and counts and drops rare terms.
2. Totals of the kept terms by group (lang, source) and by language.
3. Sources of a language stand in blocks of `BLOCK`; kept counts are repartitioned by language, pair of blocks and share of the terms
   and sorted by (lang, pair, share, term, source). A scan fills rows of terms by sources, and emits for each share a partial sum for
   each pair of sources, and the best partial terms of each source. What both blocks lack adds the same for every term and is added
   once. No table of terms, groups or pairs is broadcast or collected.

Probabilities are p = 1 + floor(unit * (count + smooth) / (N + smooth * V)), in integers. Null text, lang and source count as empty.
Rows that share an id are documents of their own. A language without kept terms has pairs of value 0 and no terms; a source that is
alone in its language has no pairs. An empty table gives an empty result. Long texts are counted in stretches. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A-Z as a-z; letters and all bytes of other characters stay, the rest separates terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STRETCH = 1 << 20
#: Counters a task holds before it passes them on.
ENTRIES = 1 << 18
#: Sources compared at a time, and terms.
BLOCK, TERMS = 128, 256

COUNTED = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("document", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])
KEPT = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64())])
PARTIAL = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.binary()), ("value", pa.int64())])


def stretches(text: bytes) -> Iterator[list[bytes]]:
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + STRETCH)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, term, source, document, docs, n): in how many documents of a block the term occurs and how often; document is the
    block's first. Each group has a row with the empty term as well, so that groups without terms are known."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size, first = 0, None

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (docs, n) in held.items():
                terms = list(docs)
                same = lambda v, m=len(terms): [v] * m
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([same(lang), terms, same(source), same(first), list(docs.values()), [n[t] for t in terms]], COUNTED, strict=True)], schema=COUNTED)

        for batch in batches:
            for lang, source, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = row if first is None else first
                docs, n = held.setdefault((lang, source), (Counter(), Counter()))
                seen, before = {b""}, len(docs)
                for words in stretches(text):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                size += len(docs) - before
                if size > ENTRIES:
                    yield from flushed()
                    held, size, first = {}, 0, None
        yield from flushed()

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain("lang").alias("lang"), plain("source").alias("source"), plain("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(blocks, "lang string, term binary, source string, document bigint, docs bigint, n bigint")


def starts(table: pa.Table, *columns: str) -> np.ndarray:
    """Where runs of equal values begin."""
    other = np.zeros(max(len(table) - 1, 0), bool)
    for c in columns:
        values = table[c].combine_chunks()
        other |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(other) + 1]) if len(table) else np.zeros(0, np.int64)


def numbers(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().to_numpy(zero_copy_only=False)


def scanned(rows: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, n, lang_n) of terms in at least so many documents of their language, and of the empty term."""

    def summed(table: pa.Table) -> pa.Table:
        """One row for each run of lang, term, source."""
        at = starts(table, "lang", "term", "source")
        out = table.take(pa.array(at))
        for c in ("docs", "n"):
            out = out.set_column(out.schema.get_field_index(c), c, pa.array(np.add.reduceat(numbers(table, c), at)))
        return out

    def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole runs of terms."""
        if not len(table):
            return
        at = starts(table, "lang", "term")
        lengths = np.diff(np.append(at, len(table)))
        docs, n = (np.repeat(np.add.reduceat(numbers(table, c), at), lengths) for c in ("docs", "n"))
        stay = (docs >= least) | (pc.binary_length(table["term"].combine_chunks()).to_numpy(zero_copy_only=False) == 0)
        out = table.append_column("lang_n", pa.array(n)).select(KEPT.names).filter(pa.array(stay))
        yield from out.cast(KEPT).to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = COUNTED.empty_table()
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last run may go on; what is carried on is one row for each of its sources.
            table = summed(pa.concat_tables([rest, pa.Table.from_batches([batch]).cast(COUNTED)]))
            cut = int(starts(table, "lang", "term")[-1])
            yield from finished(table.slice(0, cut))
            rest = table.slice(cut)
        yield from finished(rest)

    # A hash leads the sort: numbers decide nearly all comparisons, and runs stay together.
    dealt = rows.repartition(common.partitions(rows.sparkSession), "lang", "term").withColumn("hash", F.xxhash64("lang", "term"))
    return dealt.sortWithinPartitions("hash", "lang", "term", "source", "document").drop("hash").mapInArrow(scan, "lang string, term binary, source string, n bigint, lang_n bigint")


def probability(n: np.ndarray, total: np.ndarray, unit_digits: int) -> np.ndarray:
    """1 + floor(10 ** digits * n / total) by long division, three digits at a time: exact while total stays below 9e15."""
    whole, rest = np.zeros_like(n + total), n + np.zeros_like(total)
    for _ in range(unit_digits // 3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return whole + 1


class Share:
    """The terms of one language, pair of source blocks and share: rows of terms by sources until they are added up."""

    def __init__(self, lang: str, i: int, j: int, share: int, smooth: int, digits: int, top: int):
        self.lang, self.i, self.j, self.share, self.smooth, self.digits, self.top = lang, i, j, share, smooth, digits, top
        self.sources: list[str] = []
        self.block, self.total, self.place = [], [], {}
        self.v = self.lang_total = 0
        self.terms: list[bytes] = []
        self.cells: list[tuple[int, int, int]] = []
        self.lang_n: list[int] = []
        self.best: list[tuple[np.ndarray, list[bytes]]] = []
        self.none = self.sums = None

    def header(self, source: str, block: int, total: int, lang_total: int, v: int) -> None:
        self.place[source] = len(self.sources)
        self.sources.append(source)
        self.block.append(block)
        self.total.append(total)
        self.lang_total, self.v = lang_total, v

    def open(self) -> None:
        """All headers are in."""
        self.size = np.array(self.total, np.int64) + self.smooth * self.v
        block = np.array(self.block)
        self.left, self.right = np.flatnonzero(block == self.i), np.flatnonzero(block == self.j)
        self.sums = np.zeros((len(self.left), len(self.right)), np.int64)
        if self.v:
            self.none = probability(np.full(len(self.size), self.smooth, np.int64), self.size, self.digits)
            # The share that holds no term adds what every kept term would add were it absent in both.
            if self.share < 0:
                self.sums += self.v * np.abs(self.none[self.left][:, None] - self.none[self.right][None, :])
        self.best = [(np.zeros(0, np.int64), []) for _ in self.left]

    def add(self, term: bytes, source: str, n: int, lang_n: int) -> None:
        if not self.terms or self.terms[-1] != term:
            if len(self.terms) == TERMS:
                self.settle()
            self.terms.append(term)
            self.lang_n.append(lang_n)
        self.cells.append((len(self.terms) - 1, self.place[source], n))

    def settle(self) -> None:
        if not self.terms:
            return
        n = np.zeros((len(self.terms), len(self.sources)), np.int64)
        row, column, count = np.array(self.cells, np.int64).T
        n[row, column] = count
        p = probability(n + self.smooth, self.size[None, :], self.digits)
        base = np.abs(self.none[self.left][:, None] - self.none[self.right][None, :])
        for k, a in enumerate(self.left):
            self.sums[k] += np.abs(p[:, self.right] - p[:, a : a + 1]).sum(axis=0) - len(self.terms) * base[k]
        if self.i == self.j:
            q = probability(np.array(self.lang_n, np.int64) + self.smooth, np.int64(self.lang_total + self.smooth * self.v), self.digits)
            for k, a in enumerate(self.left):
                at = np.flatnonzero((n[:, a] > 0) & (p[:, a] > q))
                value, terms = np.concatenate([self.best[k][0], p[at, a] - q[at]]), self.best[k][1] + [self.terms[t] for t in at]
                if len(value) > self.top:
                    first = sorted(range(len(value)), key=lambda x: (-value[x], terms[x]))[: self.top]
                    value, terms = value[first], [terms[x] for x in first]
                self.best[k] = value, terms
        self.terms, self.cells, self.lang_n = [], [], []

    def partial(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for k, a in enumerate(self.left):
            rows = [("pair", self.sources[b].encode(), int(self.sums[k, m])) for m, b in enumerate(self.right) if self.i < self.j or a < b]
            rows += [("term", t, int(v)) for v, t in zip(*self.best[k], strict=True)]
            if rows:
                part, item, value = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(rows)), pa.array(part), pa.array([self.sources[a]] * len(rows)), pa.array(item, pa.binary()), pa.array(value, pa.int64())], schema=PARTIAL)


def partials(kept: DataFrame, groups: DataFrame, shares: int, smooth: int, digits: int, top: int) -> DataFrame:
    """(lang, part, source, item, value): sums of pairs by share, and each share's best terms of each source."""
    share = F.pmod(F.xxhash64("term"), F.lit(shares)).cast("int")
    pairs = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    # Headers sort first, as no term is empty; the share -1 has headers alone.
    header = pairs(groups).withColumn("share", F.explode(F.sequence(F.lit(-1), F.lit(shares - 1))))
    header = header.select("lang", "i", "j", "share", F.lit(b"").alias("term"), "source", F.col("total").alias("n"), "lang_total", "v", "block")
    rows = pairs(kept.filter(F.length("term") > 0).join(groups.select("lang", "source", "block", "blocks"), ["lang", "source"]))
    rows = rows.select("lang", "i", "j", share.alias("share"), "term", "source", "n", F.col("lang_n").alias("lang_total"), F.lit(0).cast("long").alias("v"), "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            for lang, i, j, part, term, source, n, lang_n, v, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, i, j, part) != key:
                    if held:
                        if held.sums is None:
                            held.open()
                        yield from held.partial()
                    key, held = (lang, i, j, part), Share(lang, i, j, part, smooth, digits, top)
                if term == b"":
                    held.header(source, block, n, lang_n, v)
                else:
                    if held.sums is None:
                        held.open()
                    held.add(term, source, n, lang_n)
        if held:
            if held.sums is None:
                held.open()
            yield from held.partial()

    keys = ["lang", "i", "j", "share"]
    dealt = header.unionByName(rows).repartition(common.partitions(kept.sparkSession), *keys).sortWithinPartitions(*keys, "term", "source")
    return dealt.mapInArrow(scan, "lang string, part string, source string, item binary, value bigint")


def audit(docs: DataFrame, least: int = 30, smooth: int = 5, unit_digits: int = 9, top: int = 50, share_rows: int = 100_000) -> DataFrame:
    """(lang, source, part, item, value, rank) over rows (text, lang, source). A share of the terms has `share_rows` rows, or as many as
    there are pairs, so that partial sums are no more than the counts that they come from."""
    kept = common.checkpoint(scanned(counted(docs), least))
    term = F.length("term") > 0
    by_group = kept.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(term, F.col("n"))), F.lit(0)).alias("total"))
    by_lang = kept.filter(term).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.countDistinct("term").alias("v"))
    every, order = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("source")
    place = (F.row_number().over(order) - 1).cast("int")
    numbered = by_group.withColumns({"block": F.floor(place / BLOCK).cast("int"), "blocks": F.ceil(F.count("*").over(every) / BLOCK).cast("int")})
    groups = common.checkpoint(numbered.join(by_lang, "lang", "left").fillna(0, ["lang_total", "v"]))
    pairs = groups.groupBy("lang").agg((F.count("*") * F.count("*")).alias("pairs")).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).first().pairs
    shares = -(-kept.count() // max(share_rows, pairs)) or 1
    found = common.checkpoint(partials(kept, groups, shares, smooth, unit_digits, top))
    pairs = found.filter("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", "part", F.col("item").cast("string").alias("source"), F.col("source").cast("binary").alias("item"), "value"))
    terms = found.filter("part = 'term'")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = both.unionByName(terms).withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))


ORACLE = {
    "op12_source_divergence": r"""
        WITH rows AS (
            SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        words AS (
            SELECT row_no, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM rows),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT row_no) >= 30),
        langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM rows) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
        cells AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total + 5 * l.v)::HUGEINT AS p,
                   1 + (1000000000 * (k.lang_n + 5)::HUGEINT) // (l.lang_total + 5 * l.v)::HUGEINT AS q
            FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d
            ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
        found AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
        FROM found QUALIFY part = 'pair' OR rank <= 50""",
}
