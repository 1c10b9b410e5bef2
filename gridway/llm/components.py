"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected_components(edges: DataFrame, rows: int = 100_000) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its smallest node.

    Each round every node tells its larger neighbours of the smallest one it knows, then its smaller ones. Only a count
    and a checksum of the links come to the driver. Links go through no more tasks than their number asks for.
    """
    most = common.partitions(edges.sparkSession)
    links = common.checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, now = None, links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while now != before:
        before, tasks = now, min(most, -(-2 * now[0] // rows) or 1)
        links = links.coalesce(tasks)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").coalesce(tasks).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(least, "u").coalesce(tasks).select("u", "v", "m")
        links = common.checkpoint(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().coalesce(tasks))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    tails = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return tails.unionByName(tails.select(F.col("component").alias("node"), "component").distinct())
