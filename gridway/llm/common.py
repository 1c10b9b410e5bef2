"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridway.session import checkpoint, shared_folder

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, checkpointed, in as many partitions as its rows fill: small tables then don't shuffle through many tiny files."""
    kept = checkpoint(df)
    return kept.coalesce(min(partitions(df.sparkSession), -(-kept.count() // rows) or 1))


def salt(n: int, *columns: str) -> Column:
    """A number below n that spreads rows evenly and stays the same in every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def id_filter(ids: DataFrame, key: Column, buckets: int = 512) -> DataFrame:
    """A filter of fixed size (buckets x 4 KB) over key's hashes: rows (bucket, bits).

    It has no false negatives. Its size does not depend on the number of keys, so it may be broadcast;
    when it fills up, it lets more rows through and the joins behind it still decide.
    """
    h = F.pmod(F.xxhash64(key), F.lit(buckets * 32768))
    return ids.select(F.bitmap_bucket_number(h).alias("bucket"), F.bitmap_bit_position(h).alias("position")).groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("bits"))


def may_contain(df: DataFrame, flt: DataFrame, key: Column, buckets: int = 512) -> DataFrame:
    """df's rows whose key may be among those of id_filter()."""
    h = F.pmod(F.xxhash64(key), F.lit(buckets * 32768))
    position = F.bitmap_bit_position(h)
    probe = df.withColumns({"__bucket": F.bitmap_bucket_number(h), "__position": position})
    byte = F.conv(F.hex(F.substring("bits", (F.col("__position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(__byte, cast(__position % 8 as int)) & 1") == 1
    out = probe.join(F.broadcast(flt), F.col("__bucket") == F.col("bucket")).withColumn("__byte", byte).filter(hit)
    return out.select(*df.columns)
