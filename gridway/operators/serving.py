"""What pages, exports and jobs ask of findings, projects, runs and members, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Measures of which 0 says nothing, and measures that a text must not fill while the other one is known.
NO_ZERO = ("restbreite_m", "max_breite_m", "max_hoehe_m", "max_gewicht_t", "max_laenge_m", "radius_m")
EXCLUSIVE = {"max_gewicht_t": "max_achslast_t", "restbreite_m": "max_breite_m"}
#: Rows of a page at most.
LARGEST_PAGE = 5000


def haystack(columns: list[str], attrs: Column | None = None) -> Column:
    """All that a search may find, lower case, with decimal points; attrs is a map of labels to shown values."""
    parts = [F.col(c).cast("string") for c in columns]
    if attrs is not None:
        parts.append(F.array_join(F.transform(F.map_entries(attrs), lambda e: F.concat_ws(" ", e["key"], e["value"])), " "))
    return F.replace(F.lower(F.concat_ws(" ", *parts)), F.lit(","), F.lit("."))


def found_by(needle: str, columns: list[str], attrs: Column | None = None) -> Column:
    """Whether a text is found in any of the columns or attributes; a blank one finds all."""
    wanted = needle.strip().lower().replace(",", ".")
    return F.contains(haystack(columns, attrs), F.lit(wanted)) if wanted else F.lit(True)


def outside_accounts(column: str, addresses: list[str], patterns: list[str]) -> Column:
    """Addresses that are none of a list and like none of its patterns; null is not known to be."""
    out = ~F.col(column).isin(*addresses)
    for p in patterns:
        out &= ~F.col(column).like(p)
    return out


def in_export(start: Column, end: Column) -> Column:
    """Findings without dates always count; others if they meet a window whose ends may be open."""
    lasting = F.col("gueltig_von").isNull() & F.col("gueltig_bis").isNull()
    late, early = F.coalesce(F.col("gueltig_von") > end, F.lit(False)), F.coalesce(F.col("gueltig_bis") < start, F.lit(False))
    return (start.isNull() & end.isNull()) | lasting | (~late & ~early)


def in_timeline(start: Column, end: Column) -> Column:
    """Findings in force between two moments; the last day counts to its last second, and open ends reach for ever."""
    begins = F.coalesce(F.col("gueltig_von").cast("timestamp") <= end, F.lit(True))
    lasts = F.coalesce(F.col("gueltig_bis").cast("timestamp") + F.expr("INTERVAL 86399 SECONDS") >= start, F.lit(True))
    return begins & lasts


def last_analysis(runs: DataFrame, projects: DataFrame) -> DataFrame:
    """(tenant_id, last_at): when the last finished run of a tenant's projects ended."""
    done = runs.filter("status = 'done'").join(projects.select("project_id", "tenant_id"), "project_id")
    return done.groupBy("tenant_id").agg(F.max("finished_at").alias("last_at"))


def last_seen(members: DataFrame, sessions: DataFrame) -> DataFrame:
    """members with the last beat of their sessions, null if they have none."""
    return members.join(sessions.groupBy("user_id").agg(F.max("last_seen").alias("last_seen")), "user_id", "left")


def message_counts(messages: DataFrame, tenant: int) -> DataFrame:
    """Per finding: its public messages, those internal to the tenant, and when the last of either came."""
    public, own = F.col("scope") == "public", (F.col("scope") == "internal") & (F.col("tenant_id") == tenant)
    return messages.groupBy("finding_id").agg(F.count_if(public).alias("public"), F.count_if(own).alias("internal"), F.max(F.when(public | F.coalesce(own, F.lit(False)), F.col("created_at"))).alias("latest"))


def sync_totals(runs: DataFrame) -> DataFrame:
    """One row: what a synchronisation looked at and changed, over the statistics of its runs."""
    total = lambda c: F.coalesce(F.sum(f"stats.{c}"), F.lit(0)).alias(c)
    sums = runs.agg(*map(total, ("gefunden", "neu", "aktualisiert", "deaktiviert", "reaktiviert"))).withColumnRenamed("gefunden", "geprueft")
    return sums.withColumn("geaendert", F.expr("neu + aktualisiert + deaktiviert + reaktiviert"))


def placed_in(findings: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """findings with place, their number in an order within their keys."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def page(rows: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """A page of at most LARGEST_PAGE rows and how many rows there are in all; the rows are counted, not collected."""
    if size > LARGEST_PAGE:
        raise ValueError(f"a page of {size} rows; the most is {LARGEST_PAGE}")
    return rows.orderBy(*order).offset(size * number).limit(size).crossJoin(rows.agg(F.count("*").alias("total")))


def usable_routes(routes: DataFrame, points: DataFrame) -> DataFrame:
    """points (route_id, i, lat, lng) that are sane, of routes with two such points that need no check or have passed it."""
    sane = points.filter("lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lng)")
    enough = sane.groupBy("route_id").agg(F.count("*").alias("n")).filter("n >= 2").select("route_id")
    checked = routes.filter(~(F.coalesce(F.col("source") == "bescheid", F.lit(False)) & ~F.coalesce("verified", F.lit(False)))).select("route_id")
    return sane.join(enough, "route_id", "left_semi").join(checked, "route_id", "left_semi")


def stated(name: str) -> Column:
    """A measure, null if it is the zero that says nothing."""
    return F.nullif(F.col(name), F.lit(0.0)) if name in NO_ZERO else F.col(name)


def filled(items: DataFrame, extracted: dict[str, Column]) -> DataFrame:
    """items whose gaps are filled by what their text says; what is stated is never overwritten, nor its opposite filled in."""
    known = {c: stated(c) for c in items.columns if c in NO_ZERO}
    items = items.withColumns(known)
    fills = {}
    for name, value in extracted.items():
        value = F.nullif(value, F.lit(0.0)) if name in NO_ZERO else value
        other = EXCLUSIVE.get(name)
        free = F.col(other).isNull() if other in items.columns else F.lit(True)
        fills[name] = F.coalesce(F.col(name), F.when(free, value))
    return items.withColumns(fills)


def straight_range(start: Column, end: Column) -> Column:
    """The end of a range; null if it lies before the start."""
    return F.when(~F.coalesce(start > end, F.lit(False)), end)


def without_keys(attrs: Column, *keys: str) -> Column:
    return F.map_filter(attrs, lambda k, v: ~k.isin(*keys))


def shown_details(detail: Column, more: Column) -> Column:
    """A map for display: more fills what detail lacks, values start with a capital letter."""
    both = F.map_concat(F.map_filter(more, lambda k, v: v.isNotNull() & ~F.coalesce(F.map_contains_key(detail, k), F.lit(False))), F.coalesce(detail, F.create_map().cast("map<string,string>")))
    capital = lambda v: F.when(v.rlike("^[a-zäöüß]"), F.concat(F.upper(F.substring(v, 1, 1)), F.substr(v, F.lit(2)))).otherwise(v)
    return F.transform_values(both, lambda k, v: capital(v))
