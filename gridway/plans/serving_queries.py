"""Queries of what pages, exports and jobs ask for, and of smaller geometry and text steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridway.functions import geo, text
from gridway.operators import corridor, serving
from gridway.plans import fixtures as fx
from gridway.plans.data_queries import fnv
from gridway.plans.geo_queries import CUM, LINE_GEO, SEG, hav, nearest

O = fx.with_(fx.OBSTACLES)  # noqa: E741
FD = fx.with_(fx.FINDINGS)


def date(s: str) -> Column:
    return F.lit(s).cast("date")


def attributes() -> Column:
    shown = lambda c: F.when(F.col(c).isNotNull(), F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(",")))
    return F.map_filter(F.create_map(F.lit("Höhe"), shown("max_hoehe_m"), F.lit("Gewicht"), shown("max_gewicht_t")), lambda k, v: v.isNotNull())


def attribute_search(spark: SparkSession, d: str) -> DataFrame:
    return fx.obstacles(spark, d).filter(serving.found_by("HÖHE 4,", ["name", "beschreibung"], attributes())).select("obstacle_id")


def outside_accounts(spark: SparkSession, d: str) -> DataFrame:
    mail = F.concat(F.when(F.col("user_id") % 7 == 0, "test-").otherwise("u"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 5 == 0, "@own.test").otherwise("@example.com"))
    rows = fx.events(spark, d).select("user_id").distinct().withColumn("email", mail)
    return rows.filter(serving.outside_accounts("email", ["u1@example.com"], ["test-%", "%@own.test"]))


def analysis_runs(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders", {"project_id": "o_custkey % 60", "status": "CASE WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'done' END", "finished_at": "CAST(o_orderdate AS TIMESTAMP)"})


def members(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 3).alias("tenant_id"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "lineitem", {"finding_id": "l_partkey", "scope": "CASE l_linenumber % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'note' END", "tenant_id": "l_suppkey % 3", "created_at": "CAST(l_shipdate AS TIMESTAMP)"})


def job_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.runs(spark, d)
    part = lambda k: F.when(F.col("found") % (k + 3) != 0, F.col("found") % k)
    return rows.select(F.struct(F.col("found").alias("gefunden"), part(5).alias("neu"), part(7).alias("aktualisiert"), part(3).alias("deaktiviert"), part(2).alias("reaktiviert")).alias("stats"))


def paged(spark: SparkSession, d: str) -> DataFrame:
    return serving.page(fx.findings(spark, d), [F.desc("rank"), F.col("ord")], 50, 2).select("ord", "total")


def stale_order(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.findings(spark, d).withColumn("age", F.when(F.col("ord") % 4 != 0, F.col("ord") % 50))
    return serving.placed_in(rows, ["route_id"], (F.col("rank") == 3).desc(), F.col("age").desc_nulls_first(), F.col("ord")).select("ord", "route_id", "place")


def verified_routes(spark: SparkSession, d: str) -> DataFrame:
    routes = fx.routes(spark, d)
    kinds = routes.select("route_id").distinct().withColumns({"source": F.when(F.col("route_id") % 3 == 0, "bescheid"), "verified": F.when(F.col("route_id") % 2 == 0, F.lit(True))})
    points = routes.filter("route_id <> 5 OR i = 7").withColumn("lat", F.when(F.col("i") % 50 == 3, F.lit(191.0)).otherwise(F.col("lat")))
    return serving.usable_routes(kinds, points).groupBy("route_id").agg(F.count("*").alias("points"))


def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.obstacles(spark, d).withColumns({"max_achslast_t": F.when(F.col("ord") % 5 == 0, 11.5), "restbreite_m": F.when(F.col("ord") % 3 == 0, F.lit(0.0)).otherwise(F.col("restbreite_m"))})
    extracted = {"max_gewicht_t": F.when(F.col("ord") % 2 == 0, 16.0), "restbreite_m": F.lit(3.25), "max_hoehe_m": F.lit(0.0)}
    return serving.filled(rows, extracted).select("obstacle_id", "max_gewicht_t", "restbreite_m", "max_hoehe_m")


def detail_map(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.obstacles(spark, d)
    detail = F.create_map(F.lit("Lage"), F.lower("kategorie"), F.lit("Kontakt"), F.lit("x"))
    more = F.create_map(F.lit("Lage"), F.lit("anders"), F.lit("Höhe"), F.format_string("%.2f m", "max_hoehe_m"))
    more = F.map_filter(more, lambda k, v: (k != "Höhe") | F.col("max_hoehe_m").isNotNull())
    m = serving.shown_details(serving.without_keys(detail, "Kontakt"), more)
    return rows.select("obstacle_id", F.try_element_at(m, F.lit("Lage")).alias("lage"), F.try_element_at(m, F.lit("Höhe")).alias("hoehe"), F.size(m).alias("n"))


def lateral_points(spark: SparkSession, d: str) -> DataFrame:
    at = fx.routes(spark, d).alias("p").filter("i BETWEEN 3 AND 397 AND i % 10 = 3")
    a, b = (fx.routes(spark, d).select("route_id", (F.col("i") + k).alias("i"), F.col("lat").alias(f"{n}_lat"), F.col("lng").alias(f"{n}_lng")) for n, k in (("a", 3), ("b", -3)))
    lat, lng = geo.beside(*(F.col(c) for c in ("lat", "lng", "a_lat", "a_lng", "b_lat", "b_lng")), F.lit(1.5), F.when(F.col("i") % 20 == 3, 1).otherwise(-1))
    return at.join(a, ["route_id", "i"]).join(b, ["route_id", "i"]).select("route_id", "i", F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"))


def trips(spark: SparkSession, d: str) -> DataFrame:
    end = lambda f, c, k: f(c, "i").alias(k)
    return fx.routes(spark, d).groupBy(F.col("route_id").alias("trip_id")).agg(end(F.min_by, "lat", "from_lat"), end(F.min_by, "lng", "from_lng"), end(F.max_by, "lat", "to_lat"), end(F.max_by, "lng", "to_lng"))


def detour_points(spark: SparkSession, d: str) -> DataFrame:
    blocked = fx.obstacles(spark, d).filter("kategorie = 'sperrung'").select((F.col("obstacle_id") % 25).cast("int").alias("trip_id"), F.col("obstacle_id").alias("ord"), "lat", "lng")
    out = corridor.detours(blocked, trips(spark, d))
    return out.select("trip_id", "n", "side", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def slice_by_km(spark: SparkSession, d: str) -> DataFrame:
    wanted = fx.routes(spark, d).filter("i % 40 = 0").select((F.col("route_id") * 1000 + F.col("i")).alias("slice_id"), "route_id", (F.col("i").cast("double") * 0.41 + 0.7).alias("from_km"), (F.col("i").cast("double") * 0.4).alias("to_km"))
    return corridor.slices(fx.routes(spark, d), wanted).groupBy("slice_id").agg(F.count("*").alias("points"), F.round(F.min("lng"), 6).alias("west"), F.round(F.max("lng"), 6).alias("east"))


def jumps(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.lines(spark, d).withColumn("lng", F.col("lng") + F.when((F.col("obstacle_id") % 3 == 0) & (F.col("j") == 2), 0.1).otherwise(0.0))
    return corridor.implausible(rows)


def route_key(spark: SparkSession, d: str) -> DataFrame:
    whole = fx.routes(spark, d).select("route_id", "i", (F.col("route_id") + F.col("i") / 8).alias("lat"), (F.col("i") / 16).alias("lng"))
    return corridor.route_keys(whole)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return fx.lines(spark, d).select("obstacle_id", "route_id").distinct()


def marker_snap(spark: SparkSession, d: str) -> DataFrame:
    out = corridor.snapped(fx.lines(spark, d).drop("route_id"), pairs(spark, d), fx.routes(spark, d))
    return out.select("obstacle_id", "route_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


# Notices and what they say: from, to, stated end, heading.
NOTICES = (
    ("Stand: 01.02.2026. Sperrung vom 03.04.2026 bis 05.04.2026, Gesamtmaßnahme: 31.12.2029", "2026-04-03", "2026-04-05", None, None),
    ("Planungsstand 2026-01-15, ab 2026-03-01 Richtung Kassel gesperrt", "2026-03-01", None, None, "Kassel"),
    ("Ende: 31.08.26 um 15:00 Uhr, Hamburg → Kassel, Beginn 01.08.26", "2026-08-01", "2026-08-31", "2026-08-31", "Hamburg → Kassel"),
    ("Gültig: 07.05.26 von 20:00 bis 05:00 Uhr in beide Richtungen", "2026-05-07", None, "2026-05-07", "beide Richtungen"),
    ("Verkehrseinrichtung Nord, stadtauswärts frei", None, None, None, "stadtauswärts"),
    ("Fahrtrichtung Bad Hersfeld eingeengt; letzte Aktualisierung 2026-02-03", None, None, None, "Bad Hersfeld"),
)


def notice_table(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    said = F.get(F.array(*(F.lit(n[0]) for n in NOTICES)), (F.col("doc_id") % len(NOTICES)).cast("int"))
    return rows.withColumn("text", said).select("doc_id", text.validity(F.col("text")).alias("v"), text.stated_end(F.col("text")).alias("ends"), text.heading(F.col("text")).alias("heading")).select("doc_id", "v.valid_from", "v.valid_to", "ends", "heading")


CITIES = ("Freiburg im Breisgau, Stadt", "Hansestadt Lübeck", "Kassel (kreisfreie Stadt)", "Neustadt a.d. Weinstraße", "Landeshauptstadt München", "Bad Homburg")
CITY_KEYS = ("freiburg", "lübeck", "kassel", "neu", "münchen", "badhomburg")


def city_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, CITIES)), (F.col("c_custkey") % len(CITIES)).cast("int"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", text.city_key(name).alias("city"))


QUERIES = {
    "attribute_search": attribute_search,
    "outside_accounts": outside_accounts,
    "export_window": lambda s, d: fx.obstacles(s, d).filter(serving.in_export(date("1996-06-01"), date("1997-06-01"))).select("ord"),
    "timeline_filter": lambda s, d: fx.obstacles(s, d).filter(serving.in_timeline(F.expr("TIMESTAMP '1995-03-01 12:00:00'"), F.expr("TIMESTAMP '1995-03-02 00:00:00'"))).select("obstacle_id"),
    "last_analysis": lambda s, d: serving.last_analysis(analysis_runs(s, d), fx.projects(s, d)),
    "members_last_seen": lambda s, d: serving.last_seen(members(s, d), fx.events(s, d).select("user_id", F.col("ts").alias("last_seen"))),
    "message_counts": lambda s, d: serving.message_counts(messages(s, d), 1),
    "sync_totals": lambda s, d: serving.sync_totals(job_runs(s, d)),
    "severity_order": lambda s, d: serving.placed_in(fx.findings(s, d), ["project_id"], F.desc("rank"), F.col("km"), F.col("ord")).select("ord", "place"),
    "km_order": lambda s, d: serving.placed_in(fx.findings(s, d), ["route_id"], F.col("km"), F.col("ord")).select("ord", "place"),
    "stale_order": stale_order,
    "page_with_total": paged,
    "usable_routes": verified_routes,
    "gap_fill": gap_fill,
    "straight_range": lambda s, d: fx.obstacles(s, d).select("obstacle_id", serving.straight_range(F.when(F.col("ord") % 5 == 0, F.date_add("gueltig_bis", 3)).otherwise(F.col("gueltig_von")), F.col("gueltig_bis")).alias("ends")),
    "detail_map": detail_map,
    "lateral_points": lateral_points,
    "detour_points": detour_points,
    "slice_by_km": slice_by_km,
    "implausible_jump": jumps,
    "line_middle": lambda s, d: corridor.middles(fx.lines(s, d)).select("obstacle_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng")),
    "route_key": route_key,
    "marker_snap": marker_snap,
    "notice_validity": notice_table,
    "city_key": city_keys,
    "displaced_id": lambda s, d: fx.obstacles(s, d).select("obstacle_id", text.displaced(F.col("externe_id"), F.col("kategorie")).alias("id")),
}


def listed(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def told(k: int, cast: str = "VARCHAR") -> str:
    return f"CAST({listed([n[k] for n in NOTICES])}[1 + doc_id % {len(NOTICES)}] AS {cast})"


ORACLES = {
    "attribute_search": f"{O} SELECT obstacle_id FROM obstacle WHERE max_hoehe_m >= 4 AND max_hoehe_m < 5",
    "outside_accounts": "WITH u AS (SELECT DISTINCT user_id, (CASE WHEN user_id % 7 = 0 THEN 'test-' ELSE 'u' END) || user_id || (CASE WHEN user_id % 5 = 0 THEN '@own.test' ELSE '@example.com' END) AS email FROM events) SELECT * FROM u WHERE user_id % 7 <> 0 AND user_id % 5 <> 0 AND user_id <> 1",
    "export_window": f"{O} SELECT ord FROM obstacle WHERE (gueltig_von IS NULL AND gueltig_bis IS NULL) OR (coalesce(gueltig_von <= DATE '1997-06-01', true) AND coalesce(gueltig_bis >= DATE '1996-06-01', true))",
    "timeline_filter": f"{O} SELECT obstacle_id FROM obstacle WHERE coalesce(gueltig_von <= DATE '1995-03-02', true) AND coalesce(gueltig_bis >= DATE '1995-03-01', true)",
    "last_analysis": f"{fx.with_(fx.PROJECTS)} SELECT tenant_id, max(CAST(o_orderdate AS TIMESTAMP)) AS last_at FROM orders JOIN project ON project_id = o_custkey % 60 WHERE o_orderkey % 3 <> 0 GROUP BY 1",
    "members_last_seen": "SELECT c_custkey AS user_id, c_custkey % 3 AS tenant_id, (SELECT max(ts) FROM events WHERE user_id = c_custkey) AS last_seen FROM customer",
    "message_counts": "SELECT l_partkey AS finding_id, count(*) FILTER (l_linenumber % 3 = 0) AS public, count(*) FILTER (l_linenumber % 3 = 1 AND l_suppkey % 3 = 1) AS internal, max(CAST(l_shipdate AS TIMESTAMP)) FILTER (l_linenumber % 3 = 0 OR (l_linenumber % 3 = 1 AND l_suppkey % 3 = 1)) AS latest FROM lineitem GROUP BY 1",
    "sync_totals": f"{fx.with_(fx.RUNS)}, s AS (SELECT sum(found) AS geprueft, sum(found % 5) FILTER (found % 8 <> 0) AS neu, sum(found % 7) FILTER (found % 10 <> 0) AS aktualisiert, sum(found % 3) FILTER (found % 6 <> 0) AS deaktiviert, sum(found % 2) FILTER (found % 5 <> 0) AS reaktiviert FROM run) SELECT *, neu + aktualisiert + deaktiviert + reaktiviert AS geaendert FROM s",
    "severity_order": f"{FD} SELECT ord, row_number() OVER (PARTITION BY project_id ORDER BY rank DESC, km, ord) AS place FROM finding",
    "km_order": f"{FD} SELECT ord, row_number() OVER (PARTITION BY route_id ORDER BY km, ord) AS place FROM finding",
    "stale_order": f"{FD} SELECT ord, route_id, row_number() OVER (PARTITION BY route_id ORDER BY rank = 3 DESC, CASE WHEN ord % 4 <> 0 THEN ord % 50 END DESC NULLS FIRST, ord) AS place FROM finding",
    "page_with_total": f"{FD} SELECT ord, (SELECT count(*) FROM finding) AS total FROM finding ORDER BY rank DESC, ord LIMIT 50 OFFSET 100",
    "usable_routes": f"{fx.with_(fx.ROUTES)} SELECT route_id, count(*) AS points FROM route WHERE route_id <> 5 AND i % 50 <> 3 AND (route_id % 3 <> 0 OR route_id % 2 = 0) GROUP BY 1",
    "gap_fill": f"{O} SELECT obstacle_id, coalesce(max_gewicht_t, CASE WHEN ord % 5 <> 0 AND ord % 2 = 0 THEN 16 END) AS max_gewicht_t, coalesce(CASE WHEN ord % 3 <> 0 THEN restbreite_m END, CASE WHEN max_breite_m IS NULL THEN 3.25 END) AS restbreite_m, max_hoehe_m FROM obstacle",
    "straight_range": f"{O} SELECT obstacle_id, CASE WHEN ord % 5 = 0 THEN NULL WHEN coalesce(gueltig_von > gueltig_bis, false) THEN NULL ELSE gueltig_bis END AS ends FROM obstacle",
    "detail_map": f"{O} SELECT obstacle_id, upper(kategorie[1]) || kategorie[2:] AS lage, CASE WHEN max_hoehe_m IS NOT NULL THEN printf('%.2f m', max_hoehe_m) END AS hoehe, CAST(CASE WHEN max_hoehe_m IS NULL THEN 1 ELSE 2 END AS INT) AS n FROM obstacle",
    "lateral_points": f"""{fx.with_(fx.ROUTES)}, x AS (SELECT *, lead(lat, 3) OVER w - lag(lat, 3) OVER w AS dy, (lead(lng, 3) OVER w - lag(lng, 3) OVER w) * cos(radians(lat)) AS dx FROM route WINDOW w AS (PARTITION BY route_id ORDER BY i)), u AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, CASE WHEN i % 20 = 3 THEN 1 ELSE -1 END AS side FROM x)
        SELECT route_id, i, round(lat + dx / len * side * 1.5 / 111.32, 6) AS lat, round(lng - dy / len * side * 1.5 / 111.32 / cos(radians(lat)), 6) AS lng FROM u WHERE i BETWEEN 3 AND 397 AND i % 10 = 3""",
    "detour_points": f"""{fx.with_(fx.OBSTACLES, fx.ROUTES)}, t AS (SELECT route_id AS trip_id, arg_min(lat, i) AS a, arg_min(lng, i) AS b, arg_max(lat, i) AS c, arg_max(lng, i) AS d FROM route GROUP BY 1), v AS (SELECT *, cos(radians((a + c) / 2)) AS w, c - a AS y, (d - b) * cos(radians((a + c) / 2)) AS x FROM t),
        n AS (SELECT obstacle_id % 25 AS trip_id, lat, lng, row_number() OVER (PARTITION BY obstacle_id % 25 ORDER BY obstacle_id) AS n FROM obstacle WHERE kategorie = 'sperrung')
        SELECT CAST(trip_id AS INT) AS trip_id, CAST(n AS INT) AS n, side, round(lat - side * x / sqrt(x * x + y * y) * 20 / 111, 6) AS lat, round(lng + side * y / sqrt(x * x + y * y) * 20 / 111 / w, 6) AS lng FROM n JOIN v USING (trip_id), (SELECT unnest([-1, 1]) AS side) WHERE n <= 3""",
    "slice_by_km": f"""{fx.with_(fx.ROUTES, CUM, SEG)}, w AS (SELECT route_id * 1000 + i AS slice_id, route_id, greatest(0, least(CAST(i AS DOUBLE) * 0.41::DOUBLE + 0.7::DOUBLE, CAST(i AS DOUBLE) * 0.4::DOUBLE)) AS low, greatest(CAST(i AS DOUBLE) * 0.41::DOUBLE + 0.7::DOUBLE, CAST(i AS DOUBLE) * 0.4::DOUBLE) AS high FROM route WHERE i % 40 = 0),
        m AS (SELECT w.slice_id, w.low, w.high, seg.* FROM w JOIN seg ON seg.route_id = w.route_id AND b_km >= low AND a_km <= high), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY i) AS n, coalesce(max(b_km >= high) OVER (PARTITION BY slice_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM m) WHERE NOT done)
        SELECT slice_id, count(*) + 1 AS points, round(min(CASE WHEN n = 1 THEN a_lng + least(1, greatest(0, (low - a_km) / (b_km - a_km))) * (b_lng - a_lng) ELSE b_lng END), 6) AS west, round(max(a_lng + least(1, greatest(0, (high - a_km) / (b_km - a_km))) * (b_lng - a_lng)), 6) AS east FROM k GROUP BY 1""",
    "implausible_jump": f"{fx.with_(fx.LINES)} SELECT DISTINCT obstacle_id, obstacle_id % 3 = 0 AS jumps FROM line",
    "line_middle": f"{fx.with_(fx.LINES)} SELECT obstacle_id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM line WHERE j = 2",
    "route_key": f"{fx.with_(fx.ROUTES)} SELECT route_id, sha1(string_agg(printf('%.5f,%.5f', route_id + i / 8, i / 16), ';' ORDER BY i)) AS key FROM route GROUP BY 1",
    "marker_snap": f"""{LINE_GEO}, hit AS MATERIALIZED {nearest('line', 'obstacle_id, j', 60, True)}, best AS (SELECT h.obstacle_id, h.route_id, arg_min(l.lat, h.dist_m * 1e6 + h.j) AS lat, arg_min(l.lng, h.dist_m * 1e6 + h.j) AS lng FROM hit h JOIN line l ON l.obstacle_id = h.obstacle_id AND l.j = h.j GROUP BY 1, 2)
        SELECT b.obstacle_id, b.route_id, round(arg_min(r.lat, d), 6) AS lat, round(arg_min(r.lng, d), 6) AS lng FROM (SELECT b.*, r.i, {hav('b.lat', 'b.lng', 'r.lat', 'r.lng')} AS d FROM best b JOIN route r ON r.route_id = b.route_id AND abs(r.lng - b.lng) < 0.03) b JOIN route r ON r.route_id = b.route_id AND r.i = b.i GROUP BY 1, 2""",
    "notice_validity": f"SELECT doc_id, {told(1, 'DATE')} AS valid_from, {told(2, 'DATE')} AS valid_to, {told(3, 'DATE')} AS ends, {told(4)} AS heading FROM documents",
    "city_key": f"SELECT c_custkey, {listed(list(CITY_KEYS))}[1 + c_custkey % {len(CITY_KEYS)}] AS city FROM customer",
    "displaced_id": f"{O} SELECT obstacle_id, externe_id || '@' || {fnv('kategorie')} AS id FROM obstacle",
}
