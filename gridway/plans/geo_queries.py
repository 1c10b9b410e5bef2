"""Corridor, line and geometry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridway.functions import geo
from gridway.operators import corridor, ingest, lines
from gridway.plans import fixtures as fx

R3 = lambda c: F.round(c, 3).alias(c)


def hav(a: str, b: str, c: str, d: str) -> str:
    """Great-circle kilometres in the oracle's SQL."""
    return f"(2 * CAST(6371 AS DOUBLE) * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + pow(sin(radians({d} - {b}) / 2), 2) * cos(radians({a})) * cos(radians({c})))))"


def course(a: str, b: str, c: str, d: str) -> str:
    turn = f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
    return f"(({turn}) + 360 - 360 * floor((({turn}) + 360) / 360))"


def delta(x: str, y: str) -> str:
    return f"(CASE WHEN abs({x} - {y}) > 180 THEN 360 - abs({x} - {y}) ELSE abs({x} - {y}) END)"


CUM = f"""cum AS (SELECT route_id, i, lat, lng, sum(step) OVER (PARTITION BY route_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cum_km
    FROM (SELECT *, coalesce({hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')}, 0) AS step FROM route WINDOW w AS (PARTITION BY route_id ORDER BY i)))"""
SEG = """seg AS (SELECT * FROM (SELECT route_id, i, lat AS a_lat, lng AS a_lng, cum_km AS a_km, lead(lat) OVER w AS b_lat, lead(lng) OVER w AS b_lng, lead(cum_km) OVER w AS b_km
    FROM cum WINDOW w AS (PARTITION BY route_id ORDER BY i)) WHERE b_lat IS NOT NULL)"""


def nearest(points: str, keys: str, radius: float, same_route: bool) -> str:
    """(keys, route_id, dist_m, km): the oracle's nearest segment of each route within the radius, without any grid."""
    east = "(cos(radians(p.lat)) * 111320)"
    ax, ay, bx, by = f"((a_lng - p.lng) * {east})", "((a_lat - p.lat) * 111320)", f"((b_lng - p.lng) * {east})", "((b_lat - p.lat) * 111320)"
    route = "p.route_id = s.route_id AND" if same_route else ""
    pad = radius / 111320 * 2.2 + 1e-4
    keyed = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""(SELECT {keys}, route_id, dist_m, floor(km * 50 + 0.5) / 50 AS km FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys}, route_id ORDER BY dist_m, i) AS rn FROM (
          SELECT {keys}, route_id, i, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) AS dist_m, a_km + t * (b_km - a_km) AS km FROM (
            SELECT *, CASE WHEN pow(bx - ax, 2) + pow(by_ - ay, 2) = 0 THEN 0 ELSE least(1, greatest(0, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) END AS t FROM (
              SELECT {keyed}, s.route_id, s.i, s.a_km, s.b_km, {ax} AS ax, {ay} AS ay, {bx} AS bx, {by} AS by_ FROM {points} p JOIN seg s
              ON {route} p.lat BETWEEN least(a_lat, b_lat) - {pad} AND greatest(a_lat, b_lat) + {pad} AND p.lng BETWEEN least(a_lng, b_lng) - {pad} AND greatest(a_lng, b_lng) + {pad})))
          WHERE dist_m <= {radius}) WHERE rn = 1)"""


def place(at: str, total: str = "total") -> str:
    """Latitude and longitude at a kilometre of the joined segment; ends are clamped."""
    t = f"(CASE WHEN b_km = a_km THEN 0 ELSE (greatest(0, least({at}, {total})) - a_km) / (b_km - a_km) END)"
    return t


def courses(wanted: str) -> str:
    """(route_id, km, course) for wanted (route_id, km), from points 0.3 km back and ahead."""
    side = lambda name, at: f"""{name} AS (SELECT w.route_id, w.km, a_lat + t * (b_lat - a_lat) AS lat, a_lng + t * (b_lng - a_lng) AS lng FROM (
        SELECT w.route_id, w.km, s.*EXCLUDE(route_id), least(1, greatest(0, (greatest(0, least(w.km {at}, total)) - a_km) / (b_km - a_km))) AS t FROM {wanted} w JOIN (SELECT route_id, max(b_km) AS total FROM seg GROUP BY 1) e USING (route_id)
        JOIN seg s ON s.route_id = w.route_id AND ((greatest(0, least(w.km {at}, total)) > a_km AND greatest(0, least(w.km {at}, total)) <= b_km) OR (w.km {at} <= 0 AND s.i = 0))) w)"""  # noqa: E731
    return f"{side('back', '- 0.3')}, {side('ahead', '+ 0.3')}, courses AS (SELECT b.route_id, b.km, CASE WHEN {hav('b.lat', 'b.lng', 'a.lat', 'a.lng')} >= 1e-4 THEN {course('b.lat', 'b.lng', 'a.lat', 'a.lng')} END AS route_course FROM back b JOIN ahead a ON a.route_id = b.route_id AND a.km = b.km)"


GEO = fx.with_(fx.OBSTACLES, fx.ROUTES, fx.LINES, CUM, SEG)


def corridor_match(spark: SparkSession, d: str) -> DataFrame:
    found = corridor.corridor_match(fx.obstacles(spark, d), fx.lines(spark, d), fx.routes(spark, d))
    return found.select("obstacle_id", "route_id", "vertex", R3("dist_m"), R3("km"))


def wanted_km(spark: SparkSession, d: str) -> DataFrame:
    return fx.routes(spark, d).select("route_id", (F.col("i").cast("double") * 0.37 - 1.0).alias("km")).filter("km < 151")


WANTED = "wanted AS (SELECT route_id, CAST(i AS DOUBLE) * CAST(0.37 AS DOUBLE) - 1.0 AS km FROM route WHERE CAST(i AS DOUBLE) * CAST(0.37 AS DOUBLE) - 1.0 < 151)"


def point_at_km(spark: SparkSession, d: str) -> DataFrame:
    at = corridor.point_at_km(fx.routes(spark, d), wanted_km(spark, d))
    return at.select("route_id", R3("km"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def route_bearing(spark: SparkSession, d: str) -> DataFrame:
    return corridor.course_at_km(fx.routes(spark, d), wanted_km(spark, d)).select("route_id", R3("km"), R3("course"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return fx.lines(spark, d).select("obstacle_id", "route_id").distinct()


def relation(spark: SparkSession, d: str) -> DataFrame:
    out = lines.relation(fx.lines(spark, d).drop("route_id"), pairs(spark, d), fx.routes(spark, d))
    return out.select("obstacle_id", "route_id", "relation", R3("on_km"), R3("opposite_km"), R3("parallel_km"))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return lines.alignment(fx.lines(spark, d).drop("route_id"), pairs(spark, d), fx.routes(spark, d))


def coincident(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("obstacle_id", "route_id", R3("coincident_km"))


def crosses(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("obstacle_id", "route_id", R3("along_km"), R3("across_km"), "crosses")


def off_route(spark: SparkSession, d: str) -> DataFrame:
    return aligned(spark, d).select("obstacle_id", "route_id", R3("far_km"), "off_route")


def clip_runs(spark: SparkSession, d: str) -> DataFrame:
    return lines.clip(fx.lines(spark, d).drop("route_id"), pairs(spark, d), fx.routes(spark, d))


PIECE = f"""piece AS (SELECT *, {hav('a_lat', 'a_lng', 'b_lat', 'b_lng')} AS piece_km, {course('a_lat', 'a_lng', 'b_lat', 'b_lng')} AS course FROM (
    SELECT obstacle_id, route_id, j, lat AS a_lat, lng AS a_lng, lead(lat) OVER w AS b_lat, lead(lng) OVER w AS b_lng FROM line WINDOW w AS (PARTITION BY obstacle_id ORDER BY j)) WHERE b_lat IS NOT NULL)"""
SAMPLE = """sample AS (SELECT obstacle_id, route_id, j, s, a_lat + CAST(s AS DOUBLE) / steps * (b_lat - a_lat) AS lat, a_lng + CAST(s AS DOUBLE) / steps * (b_lng - a_lng) AS lng, piece_km / (steps + 1) AS weight, course
    FROM (SELECT *, unnest(range(steps + 1)) AS s FROM (SELECT *, greatest(1, CAST(floor(piece_km * 1000 / 12 + 0.5) AS INT)) AS steps FROM piece WHERE piece_km > 0)))"""
LINE_GEO = fx.with_(fx.ROUTES, fx.LINES, CUM, SEG, PIECE, SAMPLE)
ALIGNED = f"""{LINE_GEO}, hit AS MATERIALIZED {nearest('sample', 'obstacle_id, j, s', 60, True)}, wanted AS (SELECT DISTINCT route_id, km FROM hit), {courses('wanted')},
    placed AS (SELECT sa.obstacle_id, sa.route_id, sa.weight, h.dist_m, c.route_course, least({delta('sa.course', 'c.route_course')}, 180 - {delta('sa.course', 'c.route_course')}) AS folded
    FROM sample sa LEFT JOIN hit h ON h.obstacle_id = sa.obstacle_id AND h.j = sa.j AND h.s = sa.s AND h.route_id = sa.route_id LEFT JOIN courses c ON c.route_id = h.route_id AND c.km = h.km),
    sums AS (SELECT obstacle_id, route_id, coalesce(sum(weight) FILTER (WHERE dist_m <= 8 AND (route_course IS NULL OR folded <= 40)), 0) AS coincident_km,
      coalesce(sum(weight) FILTER (WHERE dist_m <= 20 AND folded <= 40), 0) AS along_km, coalesce(sum(weight) FILTER (WHERE dist_m <= 20 AND folded >= 50), 0) AS across_km,
      coalesce(sum(weight) FILTER (WHERE dist_m IS NULL), 0) AS far_km FROM placed GROUP BY 1, 2)"""


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, (k * 7) % 40, 47.5 + k * 0.17, 7.0 + (k * 11 % 40) * 0.05, 0.5 + k % 9) for k in range(40)], "zone_id int, ord int, lat double, lng double, radius_km double")


def zone_violation(spark: SparkSession, d: str) -> DataFrame:
    return corridor.zone_violations(fx.routes(spark, d), zones(spark)).select("route_id", "zone_id", R3("km_from_centre"))


def nodes_in_corridor(spark: SparkSession, d: str) -> DataFrame:
    nodes = fx.routes(spark, d).select((F.col("route_id") * 1000 + F.col("i")).alias("node_id"), "lat", "lng")
    trips = fx.routes(spark, d).filter("i IN (0, 400)").groupBy("route_id").agg(F.min_by("lat", "i").alias("from_lat"), F.min_by("lng", "i").alias("from_lng"), F.max_by("lat", "i").alias("to_lat"), F.max_by("lng", "i").alias("to_lng")).withColumnRenamed("route_id", "trip_id")
    return corridor.nodes_between(nodes, trips).select("trip_id", "node_id", R3("detour_km"), "n")


def blockers_on_edge(spark: SparkSession, d: str) -> DataFrame:
    found = corridor.near(fx.obstacles(spark, d).filter("kategorie = 'sperrung'"), fx.routes(spark, d), 150.0, ["obstacle_id"])
    return found.groupBy("route_id").agg(F.count("*").alias("blockers"), F.round(F.min("km"), 3).alias("first_km"))


def polygon_edges(spark: SparkSession, d: str) -> DataFrame:
    rings = spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey < 25").select(F.col("n_nationkey").alias("polygon_id"), (F.col("n_nationkey") * 7 % 25).alias("ord"))
    corner = F.explode(F.sequence(F.lit(0), F.lit(4)))
    rows = rings.withColumn("c", corner)
    at = lambda c, shift: F.expr(f"CASE ({c} + {shift}) % 5 WHEN 0 THEN 0.0D WHEN 1 THEN 0.1D WHEN 2 THEN 0.9D WHEN 3 THEN 0.5D ELSE 0.75D END")
    lat = lambda k: F.col("polygon_id").cast("double") * 0.3 + 47.3 + at("c", k)
    lng = lambda k: F.lit(7.2) + F.col("polygon_id").cast("double") * 0.01 + at("c", k + 2)
    return rows.select("polygon_id", "ord", lat(0).alias("a_lat"), lng(0).alias("a_lng"), lat(1).alias("b_lat"), lng(1).alias("b_lng"))


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return corridor.in_polygon(fx.obstacles(spark, d).select(F.col("obstacle_id").alias("point_id"), "lat", "lng"), polygon_edges(spark, d))


def utm(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "orders", {"obstacle_id": "o_orderkey", "east": "300000 + CAST((o_orderkey * 977) % 400000 AS DOUBLE)", "north": "5200000 + CAST((o_orderkey * 7919) % 900000 AS DOUBLE)", "zone": "32 + o_orderkey % 2"})
    lat, lng = geo.utm_to_wgs84(F.col("east"), F.col("north"), F.col("zone"))
    return rows.select("obstacle_id", F.round(lat, 7).alias("lat"), F.round(lng, 7).alias("lng"))


def utm_sql() -> str:
    f = 1 / 298.257223563
    e2 = f * (2 - f)
    ep, e1 = e2 / (1 - e2), (1 - (1 - e2) ** 0.5) / (1 + (1 - e2) ** 0.5)
    mu = f"(north / 0.9996 / {6378137.0 * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)!r}::DOUBLE)"
    return f"""WITH o AS (SELECT o_orderkey AS obstacle_id, 300000 + CAST((o_orderkey * 977) % 400000 AS DOUBLE) AS east, 5200000 + CAST((o_orderkey * 7919) % 900000 AS DOUBLE) AS north, 32 + o_orderkey % 2 AS zone FROM orders),
    m AS (SELECT *, {mu} + {3 * e1 / 2 - 27 * e1**3 / 32!r}::DOUBLE * sin(2 * {mu}) + {21 * e1**2 / 16 - 55 * e1**4 / 32!r}::DOUBLE * sin(4 * {mu}) + {151 * e1**3 / 96!r}::DOUBLE * sin(6 * {mu}) AS f FROM o),
    n AS (SELECT *, {ep!r}::DOUBLE * pow(cos(f), 2) AS c, pow(tan(f), 2) AS t, 6378137 / sqrt(1 - {e2!r}::DOUBLE * pow(sin(f), 2)) AS n, 6378137 * {1 - e2!r}::DOUBLE / pow(1 - {e2!r}::DOUBLE * pow(sin(f), 2), 1.5) AS r FROM m),
    x AS (SELECT *, (east - 500000) / (n * 0.9996::DOUBLE) AS d FROM n)
    SELECT obstacle_id, round(degrees(f - n * tan(f) / r * (pow(d, 2) / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {ep!r}::DOUBLE) * pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {ep!r}::DOUBLE - 3 * c * c) * pow(d, 6) / 720)), 7) AS lat,
      round(degrees((d - (1 + 2 * t + c) * pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * {ep!r}::DOUBLE + 24 * t * t) * pow(d, 5) / 120) / cos(f)) + zone * 6 - 183, 7) AS lng FROM x"""


def looping(spark: SparkSession, d: str) -> DataFrame:
    """Routes that turn back half way, so that every second one meets itself."""
    rows = fx.routes(spark, d)
    back = F.when((F.col("route_id") % 2 == 0) & (F.col("i") > 200), 400 - F.col("i")).otherwise(F.col("i"))
    return rows.withColumn("lng", F.lit(7.0) + back.cast("double") * 0.005).withColumn("lat", F.lit(47.5) + F.col("route_id").cast("double") * 0.3)


QUERIES = {
    "corridor_match": corridor_match,
    "cumulative_km": lambda s, d: corridor.cumulative(fx.routes(s, d)).select("route_id", "i", F.round("cum_km", 6).alias("cum_km")),
    "route_bbox": lambda s, d: corridor.boxes(fx.routes(s, d), 20.0).select("route_id", *(F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lng", "max_lng"))),
    "point_at_km": point_at_km,
    "route_bearing": route_bearing,
    "bearing_delta": lambda s, d: corridor.segments(fx.routes(s, d)).select("route_id", "i", F.round(geo.angle_delta(geo.bearing(*(F.col(c) for c in ("a_lat", "a_lng", "b_lat", "b_lng"))), F.lit(350.0)), 3).alias("delta"), F.round(geo.folded_angle(geo.bearing(*(F.col(c) for c in ("a_lat", "a_lng", "b_lat", "b_lng"))), F.lit(350.0)), 3).alias("folded")),
    "relation_opposite": relation,
    "coincident_km": coincident,
    "line_crosses": crosses,
    "line_off_route": off_route,
    "clip_runs": clip_runs,
    "loop_check": lambda s, d: corridor.loops(looping(s, d)),
    "detour_factor": lambda s, d: corridor.detour_factor(fx.routes(s, d)).select("route_id", R3("length_km"), R3("air_km"), R3("factor")),
    "downsample": lambda s, d: corridor.downsample(fx.routes(s, d), 150).select("route_id", "i"),
    "zone_violation": zone_violation,
    "nodes_in_corridor": nodes_in_corridor,
    "blockers_on_edge": blockers_on_edge,
    "point_in_polygon": point_in_polygon,
    "grid_min_height": lambda s, d: ingest.lowest_per_cell(fx.obstacles(s, d)),
    "utm_to_wgs84": utm,
}

CORNER = lambda k: f"CASE (c + {k}) % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 0.9::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END"
TRACK = "SELECT route_id, i, 47.5::DOUBLE + CAST(route_id AS DOUBLE) * 0.3::DOUBLE AS lat, 7.0::DOUBLE + CAST(CASE WHEN route_id % 2 = 0 AND i > 200 THEN 400 - i ELSE i END AS DOUBLE) * 0.005::DOUBLE AS lng FROM route"

ORACLES = {
    "corridor_match": f"""{GEO}, every AS (SELECT obstacle_id, -1 AS vertex, lat, lng FROM obstacle UNION ALL SELECT obstacle_id, j, lat, lng FROM line), hit AS {nearest('every', 'obstacle_id, vertex', 20, False)}
        SELECT obstacle_id, route_id, vertex, round(dist_m, 3) AS dist_m, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY obstacle_id, route_id ORDER BY vertex) AS n FROM hit) WHERE n = 1""",
    "cumulative_km": f"{fx.with_(fx.ROUTES, CUM)} SELECT route_id, i, round(cum_km, 6) AS cum_km FROM cum",
    "route_bbox": f"""{fx.with_(fx.ROUTES)}, b AS (SELECT route_id, min(lat) a, max(lat) b, min(lng) c, max(lng) d FROM route GROUP BY 1), p AS (SELECT *, 20::DOUBLE / 111320 AS m, greatest(0.2, cos(radians(greatest(abs(a), abs(b))))) AS k FROM b)
        SELECT route_id, round(a - m, 6) AS min_lat, round(b + m, 6) AS max_lat, round(c - m / k, 6) AS min_lng, round(d + m / k, 6) AS max_lng FROM p""",
    "point_at_km": f"""{fx.with_(fx.ROUTES, CUM, SEG, WANTED)} SELECT w.route_id, round(w.km, 3) AS km, round(a_lat + t * (b_lat - a_lat), 6) AS lat, round(a_lng + t * (b_lng - a_lng), 6) AS lng FROM (
        SELECT w.*, s.* EXCLUDE (route_id), least(1, greatest(0, (w.km - a_km) / (b_km - a_km))) AS t FROM wanted w JOIN seg s ON s.route_id = w.route_id AND ((w.km > a_km AND w.km <= b_km) OR (w.km <= 0 AND s.i = 0) OR (s.i = 399 AND w.km > b_km))) w""",
    "route_bearing": f"{fx.with_(fx.ROUTES, CUM, SEG, WANTED, courses('wanted'))} SELECT route_id, round(km, 3) AS km, round(route_course, 3) AS course FROM courses",
    "bearing_delta": f"""{fx.with_(fx.ROUTES, CUM, SEG)}, x AS (SELECT route_id, i, {course('a_lat', 'a_lng', 'b_lat', 'b_lng')} AS c FROM seg) SELECT route_id, i, round({delta('c', '350')}, 3) AS delta, round(least({delta('c', '350')}, 180 - {delta('c', '350')}), 3) AS folded FROM x""",
    "relation_opposite": f"""{LINE_GEO}, mid AS (SELECT obstacle_id, route_id, j, (a_lat + b_lat) / 2 AS lat, (a_lng + b_lng) / 2 AS lng, piece_km, course FROM piece WHERE piece_km > 0), hit AS MATERIALIZED {nearest('mid', 'obstacle_id, j', 60, True)}, wanted AS (SELECT DISTINCT route_id, km FROM hit), {courses('wanted')},
        placed AS (SELECT m.obstacle_id, m.route_id, m.piece_km, h.dist_m, {delta('m.course', 'c.route_course')} AS dl FROM mid m LEFT JOIN hit h ON h.obstacle_id = m.obstacle_id AND h.j = m.j AND h.route_id = m.route_id LEFT JOIN courses c ON c.route_id = h.route_id AND c.km = h.km),
        s AS (SELECT obstacle_id, route_id, coalesce(sum(piece_km) FILTER (WHERE dist_m <= 8), 0) AS on_km, coalesce(sum(piece_km) FILTER (WHERE dist_m > 8 AND dl > 120), 0) AS opposite_km, coalesce(sum(piece_km) FILTER (WHERE dist_m > 8 AND dl < 60), 0) AS parallel_km FROM placed GROUP BY 1, 2)
        SELECT obstacle_id, route_id, CASE WHEN on_km >= 0.1 THEN 'parallel' WHEN opposite_km >= 0.1 AND opposite_km > parallel_km THEN 'opposite' ELSE 'none' END AS relation, round(on_km, 3) AS on_km, round(opposite_km, 3) AS opposite_km, round(parallel_km, 3) AS parallel_km FROM s""",
    "coincident_km": f"{ALIGNED} SELECT obstacle_id, route_id, round(coincident_km, 3) AS coincident_km FROM sums",
    "line_crosses": f"{ALIGNED} SELECT obstacle_id, route_id, round(along_km, 3) AS along_km, round(across_km, 3) AS across_km, across_km >= 0.03 AND across_km > along_km AND along_km < 0.05 AS crosses FROM sums",
    "line_off_route": f"{ALIGNED} SELECT obstacle_id, route_id, round(far_km, 3) AS far_km, along_km < 0.035 AND far_km >= 0.12 AS off_route FROM sums",
    "clip_runs": f"""{LINE_GEO}, step AS (SELECT *, greatest(15::DOUBLE, floor(sum(piece_km) OVER (PARTITION BY obstacle_id) * 1000 / 300 + 0.5)) AS step FROM piece WHERE piece_km > 0),
        dense AS (SELECT obstacle_id, route_id, j, s, step, a_lat + CAST(s AS DOUBLE) / n * (b_lat - a_lat) AS lat, a_lng + CAST(s AS DOUBLE) / n * (b_lng - a_lng) AS lng FROM (SELECT *, unnest(range(n)) AS s FROM (SELECT *, greatest(1, CAST(ceil(piece_km * 1000 / step) AS INT)) AS n FROM step))
          UNION ALL SELECT obstacle_id, route_id, j + 1, 0, step, b_lat, b_lng FROM step QUALIFY row_number() OVER (PARTITION BY obstacle_id ORDER BY j DESC) = 1),
        k AS (SELECT *, row_number() OVER (PARTITION BY obstacle_id ORDER BY j, s) - 1 AS k FROM dense), hit AS MATERIALIZED {nearest('k', 'obstacle_id, k', 60, True)},
        f AS (SELECT k.obstacle_id, k.route_id, k.k, k.step, h.k IS NOT NULL AS inside FROM k LEFT JOIN hit h ON h.obstacle_id = k.obstacle_id AND h.k = k.k AND h.route_id = k.route_id),
        i AS (SELECT *, sum(turn) OVER (PARTITION BY obstacle_id, route_id ORDER BY k) AS island FROM (SELECT *, CASE WHEN lag(inside) OVER (PARTITION BY obstacle_id, route_id ORDER BY k) = inside THEN 0 ELSE 1 END AS turn FROM f)),
        g AS (SELECT * EXCLUDE (inside), inside OR (count(*) OVER (PARTITION BY obstacle_id, route_id, island) <= greatest(1, ceil(60 / step)) AND island > 1 AND island < max(island) OVER (PARTITION BY obstacle_id, route_id)) AS inside FROM i),
        r AS (SELECT *, sum(turn2) OVER (PARTITION BY obstacle_id, route_id ORDER BY k) AS run0 FROM (SELECT *, CASE WHEN lag(inside) OVER (PARTITION BY obstacle_id, route_id ORDER BY k) = inside THEN 0 ELSE 1 END AS turn2 FROM g)),
        o AS (SELECT obstacle_id, route_id, run0, count(*) AS points, min(k) AS first_n, max(k) AS last_n FROM r WHERE inside GROUP BY 1, 2, 3 HAVING count(*) >= 2)
        SELECT obstacle_id, route_id, row_number() OVER (PARTITION BY obstacle_id, route_id ORDER BY first_n) AS run, points, first_n, last_n FROM o""",
    "loop_check": f"""{fx.with_(fx.ROUTES)}, track AS ({TRACK}), cum AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY i) AS km FROM (SELECT *, coalesce({hav('lag(lat) OVER w', 'lag(lng) OVER w', 'lat', 'lng')}, 0) AS step FROM track WINDOW w AS (PARTITION BY route_id ORDER BY i))),
        back AS (SELECT DISTINCT a.route_id, a.i FROM cum a JOIN cum b ON a.route_id = b.route_id AND a.km - b.km >= 1 AND abs(a.lng - b.lng) < 0.002 AND {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} * 1000 <= 60),
        isl AS (SELECT *, i - row_number() OVER (PARTITION BY route_id ORDER BY i) AS g FROM back) SELECT route_id, min(i) AS first_i, count(*) AS samples FROM isl GROUP BY route_id, g HAVING count(*) >= 3""",
    "detour_factor": f"""{fx.with_(fx.ROUTES, CUM)}, e AS (SELECT route_id, max(cum_km) AS length_km, {hav('arg_min(lat, i)', 'arg_min(lng, i)', 'arg_max(lat, i)', 'arg_max(lng, i)')} AS air_km FROM cum GROUP BY 1)
        SELECT route_id, round(length_km, 3) AS length_km, round(air_km, 3) AS air_km, round(CASE WHEN air_km > 1 THEN length_km / air_km END, 3) AS factor FROM e""",
    "downsample": f"{fx.with_(fx.ROUTES)} SELECT route_id, i FROM route WHERE i IN (SELECT CAST(floor(k * 400::DOUBLE / 149 + 0.5) AS INT) FROM (SELECT range AS k FROM range(150)))",
    "zone_violation": f"""{fx.with_(fx.ROUTES)}, zone AS (SELECT CAST(range AS INT) AS zone_id, (range * 7) % 40 AS ord, 47.5::DOUBLE + range * 0.17::DOUBLE AS z_lat, 7.0::DOUBLE + (range * 11 % 40) * 0.05::DOUBLE AS z_lng, 0.5::DOUBLE + range % 9 AS radius FROM range(40)),
        dist AS (SELECT route_id, zone_id, ord, radius, min({hav('lat', 'lng', 'z_lat', 'z_lng')}) AS km FROM route, zone GROUP BY ALL) SELECT route_id, arg_min(zone_id, ord) AS zone_id, round(arg_min(km, ord), 3) AS km_from_centre FROM dist WHERE km < radius GROUP BY 1""",
    "nodes_in_corridor": f"""{fx.with_(fx.ROUTES)}, node AS (SELECT route_id * 1000 + i AS node_id, lat, lng FROM route), trip AS (SELECT route_id AS trip_id, arg_min(lat, i) AS f_lat, arg_min(lng, i) AS f_lng, arg_max(lat, i) AS t_lat, arg_max(lng, i) AS t_lng FROM route GROUP BY 1),
        x AS (SELECT trip_id, node_id, {hav('f_lat', 'f_lng', 'lat', 'lng')} + {hav('t_lat', 't_lng', 'lat', 'lng')} - {hav('f_lat', 'f_lng', 't_lat', 't_lng')} AS detour FROM trip, node)
        SELECT trip_id, node_id, round(detour, 3) AS detour_km, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY floor(detour * 10 + 0.5), node_id) AS n FROM x WHERE detour <= 60) WHERE n <= 120""",
    "blockers_on_edge": f"{GEO}, block AS (SELECT * FROM obstacle WHERE kategorie = 'sperrung'), hit AS {nearest('block', 'obstacle_id', 150, False)} SELECT route_id, count(*) AS blockers, round(min(km), 3) AS first_km FROM hit GROUP BY 1",
    "point_in_polygon": f"""{fx.with_(fx.OBSTACLES)}, e AS (SELECT n_nationkey AS polygon_id, n_nationkey * 7 % 25 AS ord, CAST(n_nationkey AS DOUBLE) * 0.3::DOUBLE + 47.3::DOUBLE + {CORNER(0)} AS a_lat, 7.2::DOUBLE + CAST(n_nationkey AS DOUBLE) * 0.01::DOUBLE + {CORNER(2)} AS a_lng,
          CAST(n_nationkey AS DOUBLE) * 0.3::DOUBLE + 47.3::DOUBLE + {CORNER(1)} AS b_lat, 7.2::DOUBLE + CAST(n_nationkey AS DOUBLE) * 0.01::DOUBLE + {CORNER(3)} AS b_lng FROM nation, (SELECT range AS c FROM range(5)) WHERE n_nationkey < 25),
        odd AS (SELECT obstacle_id, polygon_id, e.ord FROM obstacle JOIN e ON (a_lat > lat) <> (b_lat > lat) AND lng < (b_lng - a_lng) * (lat - a_lat) / (b_lat - a_lat) + a_lng GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
        SELECT obstacle_id AS point_id, arg_min(polygon_id, ord) AS polygon_id FROM odd GROUP BY 1""",
    "grid_min_height": f"""{fx.with_(fx.OBSTACLES)}, c AS (SELECT CAST(floor(lng / 0.0003::DOUBLE + 0.5) AS BIGINT) AS cx, CAST(floor(lat / 0.0003::DOUBLE + 0.5) AS BIGINT) AS cy, max_hoehe_m, obstacle_id FROM obstacle WHERE max_hoehe_m IS NOT NULL)
        SELECT cx, cy, max_hoehe_m, obstacle_id, n FROM (SELECT *, count(*) OVER (PARTITION BY cx, cy) AS n, row_number() OVER (PARTITION BY cx, cy ORDER BY max_hoehe_m, obstacle_id) AS rn FROM c) WHERE rn = 1""",
    "utm_to_wgs84": utm_sql(),
}
