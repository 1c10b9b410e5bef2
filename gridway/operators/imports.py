"""Import runs: feed items of any number of sources against the snapshot, as joins.

A snapshot has source_id, externe_id, obstacle_id, aktiv, fach_id, realer_start, updated_at and the fields of a feed's items; items
have those fields, source_id, externe_id, realer_start and ord, their place in the source's feed. Headers have a row for each source
that was read: full (the feed lists all there is) and complete (nothing was cut; null is true). Rows and items of other sources are
left alone. Of several items for one row the last one's values win; identity, number and start stay those of the first.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridway.functions import rules, text
from gridway.operators import ingest
from gridway.session import checkpoint

IDENTITY = ("source_id", "externe_id", "obstacle_id", "aktiv", "fach_id", "realer_start", "created_at", "updated_at")
#: New rows that are numbered in one task.
PART = 100_000


class Run(NamedTuple):
    """rows: the sources' rows after the run, with the snapshot's columns and action (insert, update, reactivate, deactivate, keep).
    stats: per source found, new, updated, skipped, deactivated, reactivated and status."""

    rows: DataFrame
    stats: DataFrame


def numbered(new: DataFrame) -> DataFrame:
    """new (source_id, first) with nth, counting from 1 within a source by first, and place, counting over all sources.

    A source's rows are ranked in parts of its feed, so that a first load does not meet in one task.
    """
    rows = new.withColumn("part", F.floor(F.col("first") / PART).cast("long"))
    sizes = rows.groupBy("source_id", "part").agg(F.count("*").alias("n"))
    earlier = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*[c for c in ("source_id", "part") if c not in keys]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each part here: the window over all of them is as long as there are parts.
    begin = sizes.withColumns({"own": earlier("source_id"), "over_all": earlier()}).drop("n")
    rank = F.row_number().over(Window.partitionBy("source_id", "part").orderBy("first"))
    placed = rows.withColumn("rank", rank).join(begin, ["source_id", "part"])
    return placed.withColumns({"nth": F.col("own") + F.col("rank"), "place": F.col("over_all") + F.col("rank")}).drop("part", "rank", "own", "over_all")


def run(items: DataFrame, headers: DataFrame, snapshot: DataFrame, today: Column, now: Column) -> Run:
    """One run of all sources with a header."""
    fields = [c for c in snapshot.columns if c not in IDENTITY]
    missing = [c for c in (*fields, "realer_start", "ord") if c not in items.columns]
    if missing:
        raise ValueError(f"items lack {', '.join(missing)}")
    heads = headers.select("source_id", F.coalesce("full", F.lit(False)).alias("full"), F.coalesce("complete", F.lit(True)).alias("complete"))
    fed = items.withColumn("externe_id", F.trim("externe_id")).join(heads.select("source_id", "full"), "source_id")
    usable = ingest.reason().isNull() & ~rules.infrastructure_only() & ~ingest.live_message()
    before = snapshot.join(heads.select("source_id"), "source_id", "left_semi")
    # A column rather than a filter: the optimiser would restate the rules for each name that a column had.
    judged = checkpoint(fed.withColumn("__usable", usable))
    found = judged.groupBy("source_id").agg(F.count("*").alias("found"))
    # Read by updates, inserts and counts.
    matched = checkpoint(ingest.match(judged.filter("__usable"), before).select("source_id", "externe_id", "ord", "full", "exact_active", "target_id", "realer_start", *fields))
    alive = F.coalesce(F.col("gueltig_bis") >= F.date_sub(today, ingest.GRACE_DAYS), F.lit(True))
    back = F.col("full") & F.coalesce(~F.col("exact_active"), F.lit(False)) & alive
    value = F.max_by(F.struct(*fields), "ord").alias("value")
    updates = matched.filter("target_id IS NOT NULL").groupBy("source_id", "target_id").agg(value, F.bool_or(back).alias("back"), F.count("*").alias("times"), F.count_if(back).alias("returns"))
    inserts = matched.filter("target_id IS NULL").groupBy("source_id", "externe_id").agg(value, F.min("ord").alias("first"), F.min_by(F.struct("realer_start"), "ord")["realer_start"].alias("start"), F.count("*").alias("times"))

    seen = updates.select("source_id", F.col("target_id").alias("obstacle_id"), F.lit(True).alias("seen"))
    listed = before.filter("aktiv AND externe_id IS NOT NULL").select("source_id", "obstacle_id").join(seen, ["source_id", "obstacle_id"], "left")
    counts = listed.groupBy("source_id").agg(F.count("*").alias("active"), F.count_if(F.col("seen").isNull()).alias("gone"))
    took = updates.groupBy("source_id").agg(F.sum("times").alias("to_old"), F.sum("returns").alias("reactivated"))
    added = inserts.groupBy("source_id").agg(F.count("*").alias("new"), F.sum("times").alias("to_new"))
    index = F.when(F.col("fach_id").rlike("^[0-9]{4}"), F.expr("try_cast(substring(fach_id, 1, length(fach_id) - 10) AS bigint)"))
    tops = before.groupBy("source_id").agg(F.max(index).alias("top"))
    facts = heads
    for other in (found, counts, took, added, tops):
        facts = facts.join(other, "source_id", "left")
    facts = facts.fillna(0, ["found", "active", "gone", "to_old", "reactivated", "new", "to_new", "top"])
    reads = F.col("full") & F.col("complete") & (F.col("to_old") + F.col("to_new") > 0)
    guarded = reads & (F.col("active") >= ingest.GUARD_ROWS) & (F.col("gone") > ingest.GUARD_SHARE * F.col("active"))
    facts = checkpoint(facts.withColumns({"guarded": guarded, "drops": reads & ~guarded}))  # a row for each source that was read

    state = before.join(updates.select("source_id", F.col("target_id").alias("obstacle_id"), "value", "back"), ["source_id", "obstacle_id"], "left")
    state = state.join(facts.select("source_id", "drops"), "source_id")
    updated = F.col("value").isNotNull()
    gone = ~updated & F.col("drops") & F.col("aktiv") & F.col("externe_id").isNotNull()
    action = F.when(updated & F.col("back"), "reactivate").when(updated, "update").when(gone, "deactivate").otherwise("keep")
    own = {c: F.when(updated, F.col(f"value.{c}")).otherwise(F.col(c)) for c in fields}
    own |= {"aktiv": F.when(updated & F.col("back"), True).when(gone, False).otherwise(F.col("aktiv")), "updated_at": F.when(updated | gone, now).otherwise(F.col("updated_at"))}
    old = state.select(*(own.get(c, F.col(c)).alias(c) for c in snapshot.columns), action.alias("action"))

    last = snapshot.agg(F.coalesce(F.max("obstacle_id"), F.lit(0)).alias("last"))
    start = F.coalesce("start", today)
    rows = numbered(inserts).join(facts.select("source_id", "top"), "source_id").crossJoin(F.broadcast(last))
    named = {c: F.col(f"value.{c}") for c in fields} | {"source_id": F.col("source_id"), "externe_id": F.col("externe_id"), "obstacle_id": F.col("last") + F.col("place"), "aktiv": F.lit(True), "realer_start": start, "created_at": now, "updated_at": now}
    named["fach_id"] = F.concat(text.pad_index(F.col("top") + F.col("nth")), F.lpad(F.col("source_id").cast("string"), 4, "0"), F.date_format(start, "ddMMyy"))
    new = rows.select(*(named[c].cast(snapshot.schema[c].dataType).alias(c) for c in snapshot.columns), F.lit("insert").alias("action"))

    status = F.when(~F.col("complete") | F.col("guarded"), "partial").when(F.col("full") & (F.col("found") == 0), "warn").otherwise("ok")
    stats = facts.select(
        "source_id", "found", "new", (F.col("to_old") + F.col("to_new") - F.col("new")).alias("updated"), (F.col("found") - F.col("to_old") - F.col("to_new")).alias("skipped"),
        F.when(F.col("drops"), F.col("gone")).otherwise(0).alias("deactivated"), "reactivated", status.alias("status"),
    )
    return Run(old.unionByName(new), stats)
