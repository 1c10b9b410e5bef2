"""Heartbeats and feeds as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "7 days") -> DataFrame:
    """Sessions by user. Two beats exactly the gap apart are one session here; the batch form makes two of them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("hits")).select("user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ends_at"), "hits")


def per_day(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events of each type and day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


def online(events: DataFrame, span: str = "3 minutes", slide: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Users seen in each sliding window, each once."""
    seen = events.withWatermark("ts", late).select(F.window("ts", span, slide).alias("w"), "user_id").dropDuplicates(["w", "user_id"])
    return seen.groupBy("w").agg(F.count("*").alias("users")).select(F.col("w.end").alias("at"), "users")


def drain(df: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all there is; each micro-batch writes the result so far to a folder of its own, the last is returned.

    Only executors write and read results; the driver sees none. A batch that is replayed writes the same folder again.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{n}")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out/{query.lastProgress['batchId']}")


def upsert(items: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame, DataFrame | None], DataFrame]) -> StreamingQuery:
    """Each micro-batch takes the snapshot under path one step on. A batch that is replayed writes the same folder again."""

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/{n - 1}") if n else None
        step(batch, before).write.mode("overwrite").parquet(f"{path}/{n}")

    return items.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
