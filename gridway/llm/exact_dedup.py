"""Exact dedup as a log-structured merge index over text digests.

Rows go to memtables by a hash of their id. Each memtable is flushed as a run: its distinct digests with the identifier to
keep and the number of rows, sorted and written to the shared folder, with a filter of fixed size over them. A digest that no
other run's filter has is settled where it is. The others are hits; compaction reads `fanin` runs at a time, merges their
hits, and writes the next level, until one run is left. Digests of several rows are verified byte by byte.

Null texts count as empty and are equal to each other. Of rows that share text and id, each is reported by dedup() and one
kept by keep_rows(); ties on the id cannot change the identifier kept. An identifier that is null loses to any other. An empty
table gives an empty result. Extra columns are ignored by dedup() and kept by keep_rows(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Runs, the runs merged at a time, and the groups of 32,768 bits (4 KB) of each run's filter: 4 MB in all.
RUNS, FANIN, BUCKETS = 16, 4, 64
#: Digests of more than a part in so many of all rows are joined apart: there are no more than that.
FREQUENT = 1000


def digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def written(level: DataFrame, folder: str) -> DataFrame:
    """Runs in the shared folder, each sorted by digest."""
    level.sortWithinPartitions("run", "digest").write.parquet(folder)
    return level.sparkSession.read.schema(level.schema).parquet(folder)


def filters(runs: DataFrame) -> DataFrame:
    """(bucket, filters): the filter of each run that has digests in the bucket, as (run, bits)."""
    h = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS * 32768))
    bits = runs.groupBy("run", F.bitmap_bucket_number(h).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits"))
    return bits.groupBy("bucket").agg(F.collect_list(F.struct("run", "bits")).alias("filters"))


def marked(runs: DataFrame) -> DataFrame:
    """runs with hit: whether another run's filter has the digest."""
    h = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS * 32768))
    position = F.bitmap_bit_position(h)
    byte = lambda bits: F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = F.col("run")
    has = F.exists("filters", lambda f: (f["run"] != own) & ((byte(f["bits"]).bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (position % 8).cast("int") + 1))) != 0))
    return runs.join(F.broadcast(filters(runs)), F.bitmap_bucket_number(h) == F.col("bucket")).withColumn("hit", has).drop("bucket", "filters")


def build_index(rows: DataFrame, keep: str = "largest", runs: int = RUNS, fanin: int = FANIN) -> DataFrame:
    """(digest, keep_id, n) for each digest of rows (doc_id, digest)."""
    best = {"largest": F.max, "smallest": F.min}[keep]
    folder = common.shared_folder(rows.sparkSession, "exact-dedup")
    flushed = rows.groupBy(common.salt(runs, "doc_id").alias("run"), "digest").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n"))
    level = marked(written(flushed, f"{folder}/0"))
    level = written(level, f"{folder}/0-marked") if runs > 1 else level.withColumn("hit", F.lit(False))
    settled, hits, height = level.filter("NOT hit"), level.filter("hit").drop("hit"), 0
    while runs > 1:
        runs, height = -(-runs // fanin), height + 1
        run = F.expr(f"run div {fanin}").cast("int").alias("run")
        hits = written(hits.groupBy(run, "digest").agg(best("keep_id").alias("keep_id"), F.sum("n").alias("n")), f"{folder}/{height}")
    return settled.select("digest", "keep_id", "n").unionByName(hits.select("digest", "keep_id", "n"))


def verified(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Digests that different texts share: rows that pass the filter of digests of several rows are grouped by their very bytes."""
    several = common.id_filter(index.filter("n > 1"), F.col("digest"))
    rows = common.may_contain(docs, several, F.col("digest"))
    texts = rows.groupBy("digest", "text").agg(F.count("*").alias("n"))
    return texts.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1")


def looked_up(rows: DataFrame, index: DataFrame, total: int) -> DataFrame:
    """rows with keep_id and n of their digest; frequent digests, which a bound keeps few, need no shuffle of their rows."""
    often = F.col("n") * FREQUENT > total
    frequent = rows.join(F.broadcast(index.filter(often)), "digest")
    other = rows.join(F.broadcast(index.filter(often).select("digest")), "digest", "left_anti").join(index.filter(~often), "digest")
    return frequent.unionByName(other)


def dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """Per row of docs (doc_id, text): keep_id, group_size, kept, text_sha256."""
    rows = digested(docs)
    short = common.checkpoint(rows.select("doc_id", "digest"))
    index = common.checkpoint(build_index(short, keep))
    result = lambda df, n: df.select("doc_id", "keep_id", F.col(n).alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    collisions = common.checkpoint(verified(rows, index))
    if collisions.isEmpty():
        return result(looked_up(short, index, short.count()), "n")
    best = {"largest": F.max, "smallest": F.min}[keep]
    apart = rows.join(collisions.select("digest"), "digest", "left_semi")
    groups = apart.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n"))
    plain = looked_up(short.join(collisions.select("digest"), "digest", "left_anti"), index, short.count())
    return result(plain, "n").unionByName(result(apart.join(groups, ["digest", "text"]), "n"))


def keep_rows(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs' rows that stay, with all their columns: one for each text. Only the texts' digests decide here unless the
    byte verification finds a digest that different texts share."""
    rows = digested(docs)
    index = common.checkpoint(build_index(common.checkpoint(rows.select("doc_id", "digest")), keep))
    collisions = common.checkpoint(verified(rows, index))
    if not collisions.isEmpty():
        best = {"largest": F.max, "smallest": F.min}[keep]
        apart = rows.join(collisions.select("digest"), "digest", "left_semi").groupBy("digest", "text").agg(best("doc_id").alias("keep_id"))
        index = index.join(collisions.select("digest"), "digest", "left_anti").select("digest", "keep_id").unionByName(apart.select("digest", "keep_id"))
    named = docs.withColumns({"__dedup_digest": F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), "__dedup_text": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))})
    stays = index.select(F.col("keep_id").alias("__dedup_id"), F.col("digest").alias("__dedup_key"))
    kept = named.join(stays, named["doc_id"].eqNullSafe(stays["__dedup_id"]) & (F.col("__dedup_digest") == F.col("__dedup_key")), "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id", "__dedup_digest", "__dedup_text").orderBy(F.lit(0)))
    return kept.withColumn("__dedup_n", once).filter("__dedup_n = 1").select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir))


ORACLE = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
