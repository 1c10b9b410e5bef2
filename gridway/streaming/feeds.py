"""Feeds as streams: import runs by micro-batch, and the life of each imported row as keyed state with timers.

What a run decides across the rows of a source (drift, guard, numbering) are joins, in imports.run(). What a row does by itself as time
goes on (its days of grace after its validity) is state keyed by source and external id, with a timer of its own.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from gridway.operators import imports, ingest
from gridway.session import checkpoint as cut

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "source_id bigint, externe_id string, obstacle_id bigint, action string, aktiv boolean, gueltig_bis date, at timestamp"
KEPT = "obstacle_id bigint, aktiv boolean, gueltig_bis date"


def stored(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def newest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(source_id, version): each source's last version, a row for each source that was ever read."""
    runs = spark.read.parquet(f"{folder}/runs").select("source_id", "version")
    if before is not None:
        runs = runs.filter(F.col("version") < before)
    return runs.groupBy("source_id").agg(F.max("version").alias("version"))


def snapshot(spark: SparkSession, folder: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The rows of all sources as of now, or as of the micro-batches before one. Partitions of older versions are pruned."""
    if not exists(spark, f"{folder}/runs"):
        return spark.createDataFrame([], schema)
    rows = spark.read.parquet(f"{folder}/rows").join(newest(spark, folder, before), ["source_id", "version"])
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in schema))


def follow(messages: DataFrame, folder: str, checkpoint: str, schema: StructType, today: Column, now: Column) -> StreamingQuery:
    """Import runs from a stream of messages: items with run (ascending for each source), full and complete; a run without items is one
    message without ord. schema is the snapshot's.

    Each micro-batch writes the sources that it reads, and no others, as a version of their own: rows by version and source, what has
    changed, and the runs with their figures. Runs that one batch holds of a source are taken one after the other. A batch that is
    replayed reads what was there before it and overwrites what it wrote.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch.withColumn("__nth", F.dense_rank().over(Window.partitionBy("source_id").orderBy("run"))))
        before = snapshot(spark, folder, schema, n)
        for k in range(1, (batch.agg(F.max("__nth")).first()[0] or 0) + 1):
            part = batch.filter(F.col("__nth") == k)
            heads = part.groupBy("source_id").agg(F.first("run").alias("run"), F.bool_and("full").alias("full"), F.bool_and("complete").alias("complete"))
            items = part.filter("ord IS NOT NULL").drop("run", "full", "complete", "__nth")
            done = imports.run(items, heads, before, today, now)
            rows = cut(done.rows)
            place = lambda what, k=k: f"{folder}/{what}/version={n}/part={k}"
            rows.filter("action <> 'keep'").withColumn("at", now).write.mode("overwrite").parquet(place("changes"))
            done.stats.join(heads.select("source_id", "run"), "source_id").write.mode("overwrite").parquet(place("runs"))
            others = before.join(heads.select("source_id"), "source_id", "left_anti")
            read = batch.select("source_id").distinct()
            before = cut(others.unionByName(rows.drop("action")).join(read, "source_id", "left_semi")).unionByName(before.join(read, "source_id", "left_anti"))
        read = batch.select("source_id").distinct()
        # A large source is dealt to several tasks and files.
        mine = before.join(read, "source_id", "left_semi").hint("rebalance", "source_id")
        mine.write.mode("overwrite").partitionBy("source_id").parquet(f"{folder}/rows/version={n}")

    return messages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due(valid_to: datetime.date) -> int:
    """When a row's days of grace are over, as milliseconds: the first day on which its end lies before them."""
    day = datetime.datetime.combine(valid_to, datetime.time(), datetime.UTC) + datetime.timedelta(days=ingest.GRACE_DAYS + 1)
    return int(day.timestamp() * 1000)


class Life(StatefulProcessor):
    """One imported row: its last change, and a timer for the end of its grace. Changes pass through; a row that is still active when
    its timer fires yields one more, `expire`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Changes of one row, the newest last; the timer follows the last one."""
        parts = [p for p in rows if len(p)]
        if not parts:
            return
        changes = pd.concat(parts).sort_values("at", kind="stable")
        last = changes.iloc[-1]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        valid_to = None if pd.isna(last.gueltig_bis) else last.gueltig_bis
        self.row.update((int(last.obstacle_id), bool(last.aktiv), valid_to))
        if last.aktiv and valid_to is not None:
            self.handle.registerTimer(due(valid_to))
        yield changes[[c.split()[0] for c in CHANGE.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.row.get()
        if found is None or not found[1]:
            return
        obstacle_id, _, valid_to = found
        self.row.update((obstacle_id, False, valid_to))
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame({"source_id": [key[0]], "externe_id": [key[1]], "obstacle_id": [obstacle_id], "action": ["expire"], "aktiv": [False], "gueltig_bis": [valid_to], "at": [at]})

    def close(self) -> None:
        pass


def lives(changes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """changes (CHANGE) and, as event time passes, an `expire` for each row whose grace ends while it is active. Needs RocksDB as the
    session's state store."""
    rows = changes.selectExpr(*(c.split()[0] for c in CHANGE.split(", "))).withWatermark("at", late)
    return rows.groupBy("source_id", "externe_id").transformWithStateInPandas(Life(), CHANGE, "append", "EventTime")
