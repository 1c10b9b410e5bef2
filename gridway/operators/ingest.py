"""From feed items to the next snapshot of obstacles: validation, grouping, upsert, reconciliation, and housekeeping.

Every step is set-based. Items carry ord, their place in the feed; of several items for one target the last one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridway.functions import geo, rules, text
from gridway.session import checkpoint

# Categories a feed may use, and how far an item may have moved to be the same obstacle.
CATEGORIES = ("bruecke", "engstelle", "baustelle", "sperrung", "gewicht", "bahnuebergang", "kreisverkehr", "ampel", "steigung", "tunnel", "sonstige")
DRIFT_LAT, DRIFT_LNG = 0.003, 0.0045
GUARD_ROWS, GUARD_SHARE = 50, 0.4
GRACE_DAYS = 7
#: Days that stand for an open end.
FAR_DAYS = 1 << 40
PROFILE = ("restbreite_m", "max_hoehe_m", "max_breite_m", "max_gewicht_t", "vollsperrung", "gesperrt_komplett", "gst_sperre")
# What messages about the moment say; what they say that notices of works may say as well; and what works say.
LIVE_ALWAYS = (
    "gefahr durch", "liegengeblieb", "liegen geblieb", "bergung", "geborgen", "rettungseinsatz", "rettungsdienst", "umgestürzt", "umgekippte", "ölspur", "verloren ladung",
    "verlorene ladung", "gegenstand auf der fahrbahn", "hindernis auf der fahrbahn", "tier auf der", "tiere auf der", "falschfahrer", "geisterfahrer", "aquaplaning", "glätte", "glatteis",
    "witterungsbedingt", "fahrzeugbrand", "in brand geraten", "lkw-brand", "pkw-brand", "notfallumfahr", "notfall-umfahr",
)
LIVE_ALWAYS_WORDS = ("panne",)
BROKEN, VEHICLES = ("defekte", "defekten", "defektes"), ("pkw", "lkw", "kfz", "fahrzeug", "lastwagen", "transporter", "ampel")
BURNING, BURNT = ("brennende", "brennender", "brennendes"), ("pkw", "lkw", "fahrzeug")
DETOURS = ("ortskundige", "weiträumig", "großräumig", "grossräumig")
LIVE_MAYBE = ("straßenschäden", "straßenschaden", "strassenschäden", "strassenschaden", "fahrbahnschäden", "fahrbahnschaden")
LIVE_MAYBE_STARTS, LIVE_MAYBE_WORDS = ("unfall", "defekt"), ("stau",)
WORKS = (
    "baustelle", "bauarbeit", "baumaßnahme", "baumassnahme", "sanierung", "erneuerung", "bauphase", "instandsetzung", "instandhaltung", "unterhaltung", "beseitigung", "leitung", "sondernutzung",
    "straßenbau", "strassenbau", "fahrbahnerhalt", "deckenbau", "fahrbahndecke", "brücke", "gültig", "zeitraum dieser", "umleitung", "sperrung wegen", "vollsperrung", "halbseitig", "markierung",
)


def reason() -> Column:
    """Why an item is not accepted; null if it is."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return (
        F.when(F.trim(F.coalesce("externe_id", F.lit(""))) == "", "no id")
        .when(~F.coalesce(F.col("kategorie").isin(*CATEGORIES), F.lit(False)), "unknown category")
        .when(~finite("lat") | ~finite("lng"), "no position")
        .when(~F.col("lat").between(-90, 90) | ~F.col("lng").between(-180, 180), "position off the map")
        .when(F.length(F.trim(F.coalesce("name", F.lit("")))) < 3, "no name")
        .when(F.col("gueltig_bis") < F.col("gueltig_von"), "ends before it starts")
    )


def live_message() -> Column:
    """Messages about the traffic of the moment, not about the road."""
    return text.once(F.lower(F.concat_ws(" ", "name", "beschreibung")), _live)


def _live(said: Column) -> Column:
    pairs = [f"(?:{text.either(first)}) (?:{text.either(second)})" for first, second in ((BROKEN, VEHICLES), (BURNING, BURNT))]
    # A detour is one for those who know the place if it comes within twenty characters, in the same sentence.
    detour = f"(?:{text.either(DETOURS)})[^.]{{0,20}}umfahr"
    # Plain words first; patterns only where one of their words stands.
    where = lambda parts, pattern: text.holds(said, parts) & said.rlike(pattern)
    always = text.holds(said, LIVE_ALWAYS) | where(LIVE_ALWAYS_WORDS, text.words(LIVE_ALWAYS_WORDS)) | where((*BROKEN, *BURNING), "|".join(pairs)) | where(DETOURS, detour)
    maybe = text.holds(said, LIVE_MAYBE) | where(LIVE_MAYBE_STARTS, text.words(LIVE_MAYBE_STARTS, whole=False)) | where(LIVE_MAYBE_WORDS, text.words(LIVE_MAYBE_WORDS))
    return always | (maybe & ~text.holds(said, WORKS))


def accepted(items: DataFrame) -> DataFrame:
    return items.filter(reason().isNull() & ~rules.infrastructure_only() & ~live_message())


def profile() -> Column:
    """The restrictions that decide severity, as one text."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PROFILE))


def group_key() -> Column:
    """Category, name and place to about a hundred metres."""
    at = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.format_string("%.3f,%.3f", "lat", "lng")).otherwise("?")
    return F.concat_ws("|", F.coalesce("kategorie", F.lit("")), text.norm_name(F.col("name")), at)


# Limits of which a group has the least or the most, and its flags.
LEAST = ("restbreite_m", "max_hoehe_m", "max_breite_m", "max_gewicht_t", "max_achslast_t", "max_laenge_m", "spuren_frei")
MOST = ("spuren_gesperrt", "sperrlaenge_m", "radius_m")
FLAGS = ("vollsperrung", "gesperrt_komplett", "gst_sperre", "gst_route", "halbseitig", "havarie", "sackgasse", "einbahn", "verengt")
ATTRIBUTES = ("steigung_pct", "verkehrsverbot_t", "richtung", "sperrung_art")


def group_duplicates(items: DataFrame) -> DataFrame:
    """items with one row for those of a source that share category, name, place and profile, and members.

    Such a row has the tightest limits, flags that any member sets, the longest validity (which also is its start), the first
    description and attributes that are there, all lines one after the other, and for the rest what its first member has. Its
    externe_id comes from the group's key, so that it is the same in every run; where a place has several profiles (phases of works),
    each keeps its own limits and has its profile in the id. Items alone and without a name stay as they are.
    """
    named = F.trim(F.coalesce("name", F.lit(""))) != ""
    keyed = items.filter(named).withColumns({"__key": group_key(), "__profile": profile()})
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    how = {c: F.min(c) for c in LEAST} | {c: F.max(c) for c in MOST} | {c: F.coalesce(F.max(F.when(F.col(c), True)), F.lit(None)) for c in FLAGS} | {c: first(c) for c in ATTRIBUTES}
    how |= {"gueltig_von": F.min("gueltig_von"), "gueltig_bis": F.max("gueltig_bis"), "ord": F.min("ord")}
    if "beschreibung" in items.columns:
        how["beschreibung"] = F.min_by("beschreibung", F.when(F.trim("beschreibung") != "", F.col("ord")))
    if "realer_start" in items.columns:
        how["realer_start"] = F.coalesce(F.min("gueltig_von"), F.min_by("realer_start", "ord"))
    if "lines" in items.columns:
        how["lines"] = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("lines").isNotNull(), F.struct("ord", "lines")))), lambda x: x["lines"]))
    rest = [c for c in items.columns if c not in how and c != "source_id"]
    # The first member's own values, missing ones too; a group of one keeps all of them.
    whole = F.min_by(F.struct(*items.columns), "ord").alias("__first")
    merged = [f.alias(f"__{c}") for c, f in how.items() if c in items.columns and c != "ord"]
    groups = keyed.groupBy("source_id", "__key", "__profile").agg(whole, *merged, F.count("*").alias("members"))
    place = Window.partitionBy("source_id", "__key")
    groups = groups.withColumns({"__phases": F.count("*").over(place), "__all": F.sum("members").over(place)})
    lone = F.col("__all") == 1
    ident = F.concat(F.lit("dup#"), text.fnv_base36(F.col("__key")), F.when(F.col("__phases") > 1, F.concat(F.lit("@"), text.fnv_base36(F.col("__profile")))).otherwise(""))
    kept = {c: F.when(lone, F.col(f"__first.{c}")).otherwise(F.col(f"__{c}")) for c in how if c in items.columns and c != "ord"} | {c: F.col(f"__first.{c}") for c in (*rest, "ord") if c in items.columns}
    kept["externe_id"] = F.when(lone, F.col("__first.externe_id")).otherwise(ident)
    out = groups.select("source_id", *(kept[c].alias(c) for c in items.columns if c != "source_id"), "members")
    return out.unionByName(items.filter(~named).withColumn("members", F.lit(1).cast("long"))).select(*items.columns, "members")


def works_number() -> Column:
    """The number of the works that an id starts with, else what stands before its phase, without its part."""
    number = F.nullif(F.regexp_extract("externe_id", "^([0-9]{4}-[0-9]{5,6})", 1), F.lit(""))
    return F.coalesce(number, F.regexp_replace(F.element_at(F.split("externe_id", "--"), 1), r"(?i)\.de[0-9]+$", ""))


def merge_segments(items: DataFrame) -> DataFrame:
    """The parts and nights of works on a motorway as one row for each source, works, road, direction, category and profile: phases with
    limits of their own stay apart. Items without id are no works."""
    keyed = items.filter("externe_id IS NOT NULL").withColumns({"project": works_number(), "road": F.coalesce(F.try_element_at(text.road_refs(F.col("name")), F.lit(1)), F.lit("")), "direction": F.coalesce("richtung", F.lit("")), "profile": profile()})
    return keyed.groupBy("source_id", "project", "road", "direction", "kategorie", "profile").agg(F.count("*").alias("parts"), F.min("restbreite_m").alias("restbreite_m"), F.min("gueltig_von").alias("gueltig_von"), F.max("gueltig_bis").alias("gueltig_bis"))


def lowest_per_cell(points: DataFrame, degrees: float = 0.0003) -> DataFrame:
    """The lowest clearance of each cell of about 33 m: (cx, cy, max_hoehe_m, obstacle_id, n)."""
    at = lambda c: geo.half_up(F.col(c) / degrees).cast("long")
    rows = points.filter("max_hoehe_m IS NOT NULL").withColumns({"cx": at("lng"), "cy": at("lat")})
    best = F.min(F.struct("max_hoehe_m", "obstacle_id"))
    return rows.groupBy("cx", "cy").agg(best.alias("best"), F.count("*").alias("n")).select("cx", "cy", "best.max_hoehe_m", "best.obstacle_id", "n")


def match(items: DataFrame, existing: DataFrame) -> DataFrame:
    """items with target_id: their source's row with their externe_id, else its nearest active one that drifted; null for new ones.

    exact_id and exact_active tell of the former. Drift is an equi-join on source, category, name, profile and grid cell; the box decides.
    """
    exact = existing.select("source_id", "externe_id", F.col("obstacle_id").alias("exact_id"), F.col("aktiv").alias("exact_active"))
    left = items.join(exact, ["source_id", "externe_id"], "left")
    cell = lambda c, size: F.floor(F.col(c) / size)
    key = lambda df: df.withColumns({"name_key": text.norm_name(F.col("name")), "profile": profile()})
    open_items = key(left.filter("exact_id IS NULL")).select("source_id", "ord", "kategorie", "name_key", "profile", "lat", "lng")
    around = open_items.withColumn("cx", F.explode(F.sequence(cell("lng", DRIFT_LNG) - 1, cell("lng", DRIFT_LNG) + 1))).withColumn("cy", F.explode(F.sequence(cell("lat", DRIFT_LAT) - 1, cell("lat", DRIFT_LAT) + 1)))
    there = key(existing.filter("aktiv")).select("source_id", "kategorie", "name_key", "profile", F.col("obstacle_id").alias("near_id"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), cell("lng", DRIFT_LNG).alias("cx"), cell("lat", DRIFT_LAT).alias("cy"))
    d_lat, d_lng = F.col("lat") - F.col("o_lat"), F.col("lng") - F.col("o_lng")
    close = around.join(there, ["source_id", "kategorie", "name_key", "profile", "cx", "cy"]).filter((F.abs(d_lat) <= DRIFT_LAT) & (F.abs(d_lng) <= DRIFT_LNG))
    nearest = close.groupBy("source_id", "ord").agg(F.min(F.struct((d_lat * d_lat + d_lng * d_lng).alias("d"), "near_id"))["near_id"].alias("near_id"))
    return left.join(nearest, ["source_id", "ord"], "left").withColumn("target_id", F.coalesce("exact_id", "near_id")).drop("near_id")


def run_status(runs: DataFrame) -> DataFrame:
    """runs (error, complete, guarded, full, found) with their status."""
    status = F.when(F.col("error"), "error").when(F.col("full") & (F.col("found") == 0) & F.coalesce("complete", F.lit(True)) & ~F.col("guarded"), "warn").when(~F.coalesce("complete", F.lit(True)) | F.col("guarded"), "partial").otherwise("ok")
    return runs.withColumn("status", status)


def expired(obstacles: DataFrame, today: Column) -> DataFrame:
    """Active rows whose validity ended before the days of grace."""
    return obstacles.filter(F.col("aktiv") & (F.col("gueltig_bis") < F.date_sub(today, GRACE_DAYS)))


def purged(obstacles: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """What is left after imported rows that are inactive for so many days are gone."""
    return obstacles.filter(~(~F.col("aktiv") & F.col("externe_id").isNotNull() & (F.col("updated_at") < now - F.expr(f"INTERVAL {days} DAYS"))))


def pruned_runs(runs: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Runs that are young, and the newest of each source."""
    newest = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_id")))
    return runs.withColumn("__n", newest).filter((F.col("started_at") >= now - F.expr(f"INTERVAL {days} DAYS")) | (F.col("__n") == 1)).drop("__n")


def orphans(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """Findings whose route is no longer among their project's routes; a project without routes has none."""
    there = projects.select("project_id", F.explode_outer("routes").alias("route_id"))
    return findings.join(there, ["project_id", "route_id"], "left_anti")


def renumbered(obstacles: DataFrame) -> DataFrame:
    """(obstacle_id, fach_id, new_id) for all but the first row of each repeated number: the source's next free indices.

    First is active before inactive, older before younger, smaller id before larger.
    """
    rows = obstacles.filter("fach_id IS NOT NULL")
    order = Window.partitionBy("source_id", "fach_id").orderBy(F.desc("aktiv"), "created_at", "obstacle_id")
    extra = rows.withColumn("n", F.row_number().over(order)).filter("n > 1")
    index = F.when(F.col("fach_id").rlike("^[0-9]{4}"), F.expr("try_cast(substring(fach_id, 1, length(fach_id) - 10) AS bigint)"))
    top = rows.groupBy("source_id").agg(F.coalesce(F.max(index), F.lit(0)).alias("top"))
    following = F.row_number().over(Window.partitionBy("source_id").orderBy("fach_id", "n"))
    return extra.join(top, "source_id").withColumn("k", F.col("top") + following).select("obstacle_id", "fach_id", F.concat(text.pad_index(F.col("k")), F.substring("fach_id", -10, 10)).alias("new_id"))


def lasting(rows: DataFrame, place: list[str]) -> DataFrame:
    """(place, since, until) of rows' validities, in days, that lie within no other one of their place; open ends are the far past and
    future. What overlaps any validity of a place overlaps one of these."""
    day = lambda c, open_end: F.coalesce(F.unix_date(c).cast("long"), F.lit(open_end))
    spans = rows.select(*place, day("gueltig_von", -FAR_DAYS).alias("since"), day("gueltig_bis", FAR_DAYS).alias("until"))
    # One row for each start: the last end. Of these, only those count that end later than all that start before.
    last = spans.groupBy(*place, "since").agg(F.max("until").alias("until"))
    before = Window.partitionBy(*place).orderBy("since").rowsBetween(Window.unboundedPreceding, -1)
    return last.withColumn("__before", F.max("until").over(before)).filter("__before IS NULL OR until > __before").drop("__before")


def announced_only(future: DataFrame, current: DataFrame, metres: float = 300.0) -> DataFrame:
    """Announced works that no current row on the same road, within so many metres and overlapping in time, stands for.

    Current rows of one place count by their lasting() validities, announced ones of one place and validity are asked for once, so that
    repeated places do not meet row by row.
    """
    size = metres / geo.METRES_PER_DEGREE * 2
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    there = lasting(current, ["road", "lat", "lng"]).withColumnsRenamed({"lat": "o_lat", "lng": "o_lng", "since": "o_since", "until": "o_until"})
    there = there.withColumns({"cx": F.floor(F.col("o_lng") / size).cast("long"), "cy": F.floor(F.col("o_lat") / size).cast("long")})
    dated = future.withColumns({"__from": F.coalesce(F.unix_date("gueltig_von").cast("long"), F.lit(-FAR_DAYS)), "__to": F.coalesce(F.unix_date("gueltig_bis").cast("long"), F.lit(FAR_DAYS))})
    key = ["road", "lat", "lng", "__from", "__to"]
    asked = dated.select(*key).distinct()
    around = asked.withColumn("cx", F.explode(F.sequence(cell("lng") - 1, cell("lng") + 1))).withColumn("cy", F.explode(F.sequence(cell("lat") - 1, cell("lat") + 1)))
    meets = (F.col("__from") <= F.col("o_until")) & (F.col("o_since") <= F.col("__to"))
    away = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng")) * 1000
    known = around.join(there, ["road", "cx", "cy"]).filter(meets & (away <= metres)).select(*key).distinct()
    return dated.join(known, key, "left_anti").drop("__from", "__to")
