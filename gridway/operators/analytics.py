"""Roll-ups, search and monitoring over projects, findings, sessions and import runs.

"Now" and "today" are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def visible(tenant: str, tenant_id: int) -> Column:
    """Global rows and those of the tenant."""
    return F.col(tenant).isNull() | (F.col(tenant) == tenant_id)


def shared_or_own(owner: str, email: str) -> Column:
    """Rows without owner and the user's own."""
    return F.col(owner).isNull() | (F.col(owner) == email)


def tenant_stats(projects: DataFrame, findings: DataFrame, tenant_id: int, email: str) -> DataFrame:
    """One row: projects, finished ones, findings and each severity, of what the user may see."""
    mine = projects.filter((F.col("tenant_id") == tenant_id) & shared_or_own("owner_email", email))
    own = mine.agg(F.count("*").alias("projects"), F.count_if(F.col("status") == "fertig").alias("finished"))
    found = findings.join(mine.select("project_id"), "project_id")
    of = lambda n, r: F.count_if(F.col("rank") == r).alias(n)
    return own.join(found.agg(F.count("*").alias("findings"), of("kritisch", 3), of("warnung", 2), of("hinweis", 1)))


def sessions(events: DataFrame, minutes: int) -> DataFrame:
    """Heartbeats (user_id, ts) as sessions: a beat extends the open one only if it comes before `minutes` have passed."""
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(along)
    number = F.sum(F.when(gap < minutes * 60_000_000, 0).otherwise(1)).over(along)
    return events.withColumn("n", number).groupBy("user_id", "n").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_seen"), F.count("*").alias("hits")).withColumnRenamed("n", "session_no")


def users_overview(rows: DataFrame) -> DataFrame:
    """Per user: sessions, hits, active minutes, first and last time."""
    seconds = F.sum((micros(F.col("last_seen")) - micros(F.col("started_at"))) / 1e6)
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("hits").alias("hits"), F.floor(seconds / 60.0 + 0.5).alias("active_min"), F.min("started_at").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def daily_series(rows: DataFrame, last_day: Column, days: int = 14) -> DataFrame:
    """Users and sessions of each of the last days, days without use as 0."""
    spine = rows.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    per_day = rows.withColumn("day", F.to_date("last_seen")).groupBy("day").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("sessions"))
    return spine.join(per_day, "day", "left").select("day", F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("sessions", F.lit(0)).alias("sessions"))


def online(rows: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Users seen within the last minutes, with when."""
    return rows.filter((F.col("last_seen") > now - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("last_seen") <= now)).groupBy("user_id").agg(F.max("last_seen").alias("last_seen"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each source."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id")))
    return runs.withColumn("__n", n).filter("__n = 1").drop("__n")


def stale_sources(sources: DataFrame, runs: DataFrame, obstacles: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """Active sources, but manual ones, that never ran, ran long ago or badly, or have no active row: with the reason that counts first."""
    last = latest_run(runs).select("source_id", F.col("status").alias("last_status"), F.col("started_at").alias("last_run"))
    active = obstacles.filter("aktiv").groupBy("source_id").agg(F.count("*").alias("active_rows"))
    rows = sources.filter(F.col("aktiv") & ~F.col("kind").eqNullSafe(F.lit("manuell"))).join(last, "source_id", "left").join(active, "source_id", "left").withColumn("active_rows", F.coalesce("active_rows", F.lit(0)))
    age = (micros(now) - micros(F.col("last_run"))) / 86_400_000_000
    why = F.when(F.col("last_run").isNull(), "never ran").when(F.col("last_status").isin("warn", "error"), F.concat(F.lit("last run "), "last_status")).when(F.col("active_rows") == 0, "no active rows").when(F.col("last_run") < now - F.expr(f"INTERVAL {days} DAYS"), "old")
    return rows.withColumns({"age_days": F.floor(age + 0.5), "reason": why}).filter("reason IS NOT NULL").select("source_id", "last_status", "age_days", "active_rows", "reason")


def search(rows: DataFrame, needle: str | None, columns: list[str], **equal) -> DataFrame:
    """Rows where any column holds the needle, in any case, and whose other columns have the wanted values; None means any."""
    out = rows
    if needle is not None:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))
        out = out.filter(hit)
    for c, v in equal.items():
        if v is not None:
            out = out.filter(F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    return out


def notices_for(notices: DataFrame, projects: DataFrame, prefs: DataFrame, email: str) -> DataFrame:
    """Notices of projects the user may see, or of none, whose severity the user wants (without a wish, all)."""
    mine = projects.filter(shared_or_own("owner_email", email)).select("project_id")
    wish = prefs.filter(F.col("email") == email).select("severities")
    open_ones = notices.filter("project_id IS NULL").unionByName(notices.join(mine, "project_id", "left_semi"))
    return open_ones.join(F.broadcast(wish.limit(1)), F.lit(True), "left").filter(F.col("severities").isNull() | F.array_contains("severities", F.col("severity"))).drop("severities")


def hidden_counts(hidden: DataFrame) -> DataFrame:
    """How often each reason hides findings."""
    return hidden.groupBy("reason").agg(F.count("*").alias("n"))


def without_hidden(findings: DataFrame, hidden: DataFrame, key: Column) -> DataFrame:
    """Findings but for hidden ones."""
    return findings.withColumn("__key", key).join(hidden.select(F.col("finding_key").alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def presence(rows: DataFrame, now: Column) -> DataFrame:
    """One row: users seen within the last day, week and month."""
    seen = lambda days: F.count_distinct(F.when(F.col("last_seen") > now - F.expr(f"INTERVAL {days} DAYS"), F.col("user_id")))
    return rows.filter(F.col("last_seen") <= now).agg(seen(1).alias("day"), seen(7).alias("week"), seen(30).alias("month"))


def project_counts(projects: DataFrame, findings: DataFrame) -> DataFrame:
    """Per project: findings, critical ones, and the average kilometre; projects without findings have 0."""
    per = findings.groupBy("project_id").agg(F.count("*").alias("findings"), F.count_if(F.col("rank") == 3).alias("kritisch"), F.avg("km").alias("avg_km"))
    return projects.select("project_id").join(per, "project_id", "left").select("project_id", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("kritisch", F.lit(0)).alias("kritisch"), "avg_km")


def severity_by_category(findings: DataFrame) -> DataFrame:
    """A row per category, a column per severity."""
    names = {3: "kritisch", 2: "warnung", 1: "hinweis"}
    wide = findings.groupBy("kategorie").pivot("rank", list(names)).count()
    return wide.select("kategorie", *(F.coalesce(str(r), F.lit(0)).alias(n) for r, n in names.items()))


def health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: active sources, and those whose newest run is ok, partial, warn or error, or that never ran."""
    last = sources.filter("aktiv").join(latest_run(runs).select("source_id", "status"), "source_id", "left")
    return last.agg(F.count("*").alias("active"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "partial", "warn", "error")), F.count_if(F.col("status").isNull()).alias("never"))


def eta(sources: DataFrame, runs: DataFrame, default_s: float = 8.0) -> DataFrame:
    """One row: seconds that a run of all sources takes, by each one's last good run."""
    good = latest_run(runs.filter("status = 'ok'")).select("source_id", ((micros(F.col("finished_at")) - micros(F.col("started_at"))) / 1e6).alias("s"))
    return sources.filter("aktiv").join(good, "source_id", "left").agg(F.sum(F.coalesce("s", F.lit(default_s))).alias("eta_s"))


def every_nth(findings: DataFrame, n: int) -> DataFrame:
    """All critical findings, and every n-th other along its route."""
    k = F.row_number().over(Window.partitionBy("route_id", F.col("rank") == 3).orderBy("km", "ord")) - 1
    return findings.withColumn("__k", k).filter((F.col("rank") == 3) | (F.col("__k") % n == 0)).drop("__k")


def anonymised(rows: DataFrame, identity: list[str], dropped: list[str], salt: str) -> DataFrame:
    """Identity columns as salted hashes, others emptied."""
    out = rows.withColumns({c: F.when(F.col(c).isNotNull(), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.col(c).cast("string")), 256), 1, 16)) for c in identity})
    return out.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in dropped})
