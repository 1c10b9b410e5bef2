"""Mixing sources to target weights by systematic sampling.

Each source's target is its weight's part of the wanted total, no more than `cap` times its size; the excess goes to the
others by weight. Within a source every document expects target / size copies; the expected copies are summed along the
documents, one random offset is added, and a document is emitted once for each integer that its stretch crosses. The order
goes up through every second size and down through the others, so that the emitted words are near the target wherever the
offset falls: both ends hold the smallest documents. Of `OFFSETS` random offsets each source takes the one whose words come nearest
to its target, which keeps small sources close as well.

Nothing depends on the session: documents are ranked in a fixed number of parts, so that a mix is the same on every cluster.

Null texts have size 0; null sources form one source, the last. Rows that share an id are sampled each by itself; rows that
share id, source and text are interchangeable. A source of size 0 has target 0 and is not emitted. An empty table gives an
empty result. Extra columns are ignored by copies() and kept by mix(), whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Parts of each size class of a source, each ranked by itself; and the random offsets that a source chooses from.
PARTS, OFFSETS = 64, 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, so the unpartitioned windows here
    run over as many rows as there are sources, not documents.

    Reshared excess settles at min(cap x size, weight x level): sources reach their cap in the order of cap x size / weight,
    and the level is what the sources beyond the last full one get per weight.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({"full": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "wanted": F.sum("source_size").over(everything) * float(share)})
    level = (F.col("wanted") - F.col("full")) / F.col("open")
    # The first source, in this order, whose cap is not reached sets the level of all that follow.
    below = F.when(F.col("most") > level * F.col("weight"), level)
    level = F.coalesce(F.first(below, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(float("inf")))
    return rows.select("source", "source_size", F.least(F.col("most"), level * F.col("weight")).alias("target"))


KEY = ("id", "source", "size", "hash", "crc")


def key_of(docs: DataFrame) -> Column:
    """What tells rows apart that are not interchangeable."""
    text = F.col("text")
    return F.struct(F.col("doc_id").alias("id"), F.col("source").alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("hash"), F.crc32(text.cast("binary")).alias("crc"))


def offset_of(key: Column, seed: int, k: int) -> Column:
    """The kth random offset of a source, from 0 to 1."""
    return (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(1 << 20)) + 0.5) / float(1 << 20)


def copies(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2, seed: int = 7) -> DataFrame:
    """Per row of docs (doc_id, text, source): size, source_size, target, copies, taken. hash and crc are of the text; rows with all
    this in common are numbered nth `of` so many."""
    same = Window.partitionBy(*KEY)
    numbered = docs.select(key_of(docs).alias("row")).select("row.*").withColumns({"of": F.count("*").over(same), "nth": F.row_number().over(same.orderBy(F.lit(0)))})
    sized = common.checkpoint(numbered.withColumnRenamed("id", "doc_id"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap).withColumn("key", key).drop("source")
    # Parts of a source: size classes of an eighth of an octave, each in PARTS shares. Ranks within parts follow from the parts' counts.
    rows = sized.withColumns({"class": F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int"), "part": common.salt(PARTS, "doc_id", "hash", "nth"), "key": key})
    parts = rows.groupBy("key", "class", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("key").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    begin = parts.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("key"))}).join(goals, "key").select("key", "class", "part", "before", "all", "source_size", "target")
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy("key", "class", "part").orderBy("size", "doc_id", "hash", "crc", "nth")))
    placed = ranked.join(begin, ["key", "class", "part"]).withColumn("rank", F.col("own") + F.col("before"))
    place = F.when(F.col("rank") % 2 == 1, (F.col("rank") + 1) / 2).otherwise(F.col("all") + 1 - F.col("rank") / 2)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = common.checkpoint(placed.withColumns({"place": place, "each": each}).drop("rank", "own", "before", "all", "class", "part"))

    def crossed(offset: Column) -> Column:
        steps = F.floor(F.col("place") * F.col("each") + offset) - F.floor((F.col("place") - 1) * F.col("each") + offset)
        return F.least(steps, F.ceil("each")).cast("long")

    tried = [offset_of(F.col("key"), seed, k) for k in range(OFFSETS)]
    words = placed.groupBy("key", "target").agg(*(F.sum(crossed(o) * F.col("size")).alias(f"w{k}") for k, o in enumerate(tried)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("miss"), F.lit(k).alias("k"), o.alias("offset")) for k, o in enumerate(tried))))
    out = placed.join(words.select("key", best["offset"].alias("offset")), "key").withColumn("copies", crossed(F.col("offset")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "hash", "crc", "nth", "of")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, each as often as the mix takes it."""
    found = copies(docs, **options).withColumnRenamed("doc_id", "id")
    times = common.checkpoint(found.select(*(F.col(c).alias(f"__mix_{c}") for c in (*KEY, "nth", "of", "copies"))))
    rows = docs.withColumn("__mix", key_of(docs))

    def same(left: DataFrame, right: DataFrame) -> Column:
        return functools.reduce(Column.__and__, (left[f"__mix.{c}"].eqNullSafe(right[f"__mix_{c}"]) for c in KEY))

    alone, several = times.filter("__mix_of = 1 AND __mix_copies > 0"), times.filter("__mix_of > 1")
    once = rows.join(alone, same(rows, alone)).select(*docs.columns, "__mix_copies")
    # Interchangeable rows are few: only they are numbered, and each takes the copies of its number.
    names = several.filter("__mix_nth = 1")
    again = rows.join(names, same(rows, names), "left_semi").withColumn("__mix_row", F.row_number().over(Window.partitionBy(*(f"__mix.{c}" for c in KEY)).orderBy(F.lit(0))))
    again = again.join(several, same(again, several) & (again["__mix_row"] == several["__mix_nth"])).select(*docs.columns, "__mix_copies")
    out = once.unionByName(again).filter("__mix_copies > 0")
    return out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
