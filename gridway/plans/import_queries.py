"""Import runs over many sources, duplicates within feeds, and imports as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridway.operators import imports, ingest
from gridway.plans import data_queries as dq
from gridway.plans import fixtures as fx
from gridway.session import shared_folder
from gridway.streaming import feeds

SOURCES = 37
NUMBER = f"CAST(floor({fx.d('o_orderkey')} / {fx.d(str(SOURCES))}) AS BIGINT)"

#: Rows of 37 sources whose external ids repeat from source to source.
ROW = {k: v for k, v in fx.OBSTACLE.items() if k != "tenant_id"} | {"source_id": f"o_orderkey % {SOURCES}", "externe_id": f"concat('x', CAST({NUMBER} AS VARCHAR(20)))"}
SNAPSHOT = f"before AS (SELECT * EXCLUDE (ord) FROM (SELECT {fx.select(ROW)} FROM orders) WHERE ord % 6 <> 5)"

#: A later state of the feeds: rows gone, new ones, moved ones under new ids, changed ones, spoilt ones, and ids that occur twice.
#: Some sources have lost most of their rows, some all.
LEFT = f"ord % 9 <> 3 AND NOT (ord % {SOURCES} % 5 = 2 AND ord % 10 < 6) AND ord % {SOURCES} % 11 <> 3"
CHANGES = {
    "externe_id": "CASE WHEN ord % 19 = 2 THEN concat('n', externe_id) WHEN ord % 53 = 1 THEN NULL ELSE externe_id END",
    "lat": f"CASE WHEN ord % 19 = 2 THEN lat + {fx.d('0.001')} WHEN ord % 53 = 2 THEN NULL ELSE lat END",
    "name": "CASE WHEN ord % 53 = 3 THEN 'x' WHEN ord % 17 = 1 THEN concat(name, ' verlängert') ELSE name END",
    "kategorie": "CASE WHEN ord % 53 = 4 THEN 'unbekannt' ELSE kategorie END",
    "gueltig_bis": "CASE WHEN ord % 53 = 5 THEN DATE '1980-01-01' WHEN ord % 3 = 1 THEN DATE '1999-12-31' ELSE gueltig_bis END",
}
AGAIN = {"ord": "ord + 100000000", "name": "concat(name, ' zweiter Teil')", "realer_start": "DATE '1990-01-01'"}
FEED = f"""once AS (SELECT * REPLACE ({fx.select(CHANGES)}) FROM (SELECT {fx.select(ROW)} FROM orders) WHERE {LEFT}),
    feed AS (SELECT * FROM once UNION ALL SELECT * REPLACE ({fx.select(AGAIN)}) FROM once WHERE ord % 23 = 0)"""
HEAD = {"full": "source_id % 4 <> 0", "complete": fx.some("source_id % 3 <> 0", "source_id % 7 <> 0")}
HEADERS = f"header AS (SELECT source_id, {fx.select(HEAD)} FROM (SELECT DISTINCT o_orderkey % {SOURCES} AS source_id FROM orders) WHERE source_id % 13 <> 5)"


def rows(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders", ROW)


def before(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).filter("ord % 6 <> 5").drop("ord")


def replaced(df: DataFrame, changes: dict[str, str]) -> DataFrame:
    return df.select(*(F.expr(changes.get(c, c)).alias(c) for c in df.columns))


def feed(spark: SparkSession, d: str) -> DataFrame:
    once = replaced(rows(spark, d).filter(LEFT), CHANGES)
    return once.unionByName(replaced(once.filter("ord % 23 = 0"), AGAIN))


def headers(spark: SparkSession, d: str) -> DataFrame:
    there = spark.read.parquet(f"{d}/orders.parquet").selectExpr(f"o_orderkey % {SOURCES} AS source_id").distinct().filter("source_id % 13 <> 5")
    return there.selectExpr("source_id", *(f"{e} AS {n}" for n, e in HEAD.items()))


def run(spark: SparkSession, d: str) -> imports.Run:
    return imports.run(feed(spark, d), headers(spark, d), before(spark, d), dq.today(), dq.now())




def padded(number: str) -> str:
    """A number of four digits at least in the oracle's SQL, whose lpad cuts longer ones."""
    return f"CASE WHEN {number} < 10000 THEN lpad(CAST({number} AS VARCHAR), 4, '0') ELSE CAST({number} AS VARCHAR) END"


OLD_VALUE = ("name", "kategorie", "lat", "restbreite_m", "gueltig_bis")
RUN = f"""{fx.with_(SNAPSHOT, FEED, HEADERS)},
    fed AS (SELECT f.*, h."full" FROM feed f JOIN header h USING (source_id)),
    there AS (SELECT b.* FROM before b SEMI JOIN header h USING (source_id)),
    good AS (SELECT * FROM fed WHERE ({dq.REASON}) IS NULL AND NOT ({dq.BARE}) AND NOT ({dq.LIVE_SQL})),
    exact AS (SELECT g.*, t.obstacle_id AS exact_id, t.aktiv AS was_active FROM good g LEFT JOIN there t ON t.source_id = g.source_id AND t.externe_id = g.externe_id),
    near AS (SELECT e.ord, t.obstacle_id AS near_id FROM (SELECT *, {dq.NAME} AS nk, {dq.PROFILE} AS pk FROM exact WHERE exact_id IS NULL) e
        JOIN (SELECT *, {dq.NAME} AS nk, {dq.PROFILE} AS pk FROM there WHERE aktiv) t ON t.source_id = e.source_id AND t.kategorie = e.kategorie AND t.nk = e.nk AND t.pk = e.pk AND abs(e.lat - t.lat) <= 0.003 AND abs(e.lng - t.lng) <= 0.0045
        QUALIFY row_number() OVER (PARTITION BY e.ord ORDER BY pow(e.lat - t.lat, 2) + pow(e.lng - t.lng, 2), t.obstacle_id) = 1),
    matched AS (SELECT e.*, coalesce(e.exact_id, n.near_id) AS target_id, e."full" AND NOT e.was_active AND coalesce(e.gueltig_bis >= DATE '{fx.TODAY}' - 7, true) AS back FROM exact e LEFT JOIN near n USING (ord)),
    latest AS (SELECT * FROM matched WHERE target_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY ord DESC) = 1),
    returned AS (SELECT DISTINCT target_id FROM matched WHERE back),
    fresh AS (SELECT *, first_value(realer_start) OVER w AS start0, min(ord) OVER (PARTITION BY source_id, externe_id) AS first FROM matched WHERE target_id IS NULL WINDOW w AS (PARTITION BY source_id, externe_id ORDER BY ord) QUALIFY row_number() OVER (PARTITION BY source_id, externe_id ORDER BY ord DESC) = 1),
    count_active AS (SELECT source_id, count(*) AS active, count(*) FILTER (obstacle_id NOT IN (SELECT target_id FROM latest)) AS gone FROM there WHERE aktiv GROUP BY source_id),
    fact AS (SELECT h.source_id, h."full", coalesce(h.complete, true) AS complete, coalesce(c.active, 0) AS active, coalesce(c.gone, 0) AS gone,
        (SELECT count(*) FROM fed WHERE fed.source_id = h.source_id) AS found, (SELECT count(*) FROM matched m WHERE m.source_id = h.source_id) AS taken,
        (SELECT count(*) FROM fresh f WHERE f.source_id = h.source_id) AS new, (SELECT count(*) FROM matched m WHERE m.source_id = h.source_id AND m.back) AS reactivated,
        (SELECT max(CAST(substr(fach_id, 1, length(fach_id) - 10) AS BIGINT)) FROM there t WHERE t.source_id = h.source_id) AS top FROM header h LEFT JOIN count_active c USING (source_id)),
    judged AS (SELECT *, "full" AND complete AND taken > 0 AS reads, "full" AND complete AND taken > 0 AND active >= 50 AND gone > 0.4 * active AS guarded FROM fact)"""
RUN_ROWS = f"""{RUN}
    SELECT t.source_id, t.externe_id, t.obstacle_id, t.fach_id, t.realer_start, {", ".join(f"CASE WHEN l.target_id IS NULL THEN t.{c} ELSE l.{c} END AS {c}" for c in OLD_VALUE)},
        CASE WHEN r.target_id IS NOT NULL THEN true WHEN l.target_id IS NULL AND j.reads AND NOT j.guarded THEN false ELSE t.aktiv END AS aktiv,
        CASE WHEN r.target_id IS NOT NULL THEN 'reactivate' WHEN l.target_id IS NOT NULL THEN 'update' WHEN t.aktiv AND j.reads AND NOT j.guarded THEN 'deactivate' ELSE 'keep' END AS action
    FROM there t JOIN judged j USING (source_id) LEFT JOIN latest l ON l.target_id = t.obstacle_id LEFT JOIN returned r ON r.target_id = t.obstacle_id
    UNION ALL BY NAME
    SELECT f.source_id, f.externe_id, (SELECT coalesce(max(obstacle_id), 0) FROM before) + row_number() OVER (ORDER BY f.source_id, f.first) AS obstacle_id,
        concat({padded('coalesce(j.top, 0) + row_number() OVER (PARTITION BY f.source_id ORDER BY f.first)')}, lpad(CAST(f.source_id AS VARCHAR), 4, '0'), strftime(coalesce(f.start0, DATE '{fx.TODAY}'), '%d%m%y')) AS fach_id,
        coalesce(f.start0, DATE '{fx.TODAY}') AS realer_start, {", ".join(f"f.{c}" for c in OLD_VALUE)}, true AS aktiv, 'insert' AS action FROM fresh f JOIN judged j USING (source_id)"""
RUN_STATS = f"""{RUN} SELECT source_id, found, new, taken - new AS updated, found - taken AS skipped, CASE WHEN reads AND NOT guarded THEN gone ELSE 0 END AS deactivated, reactivated,
    CASE WHEN NOT complete OR guarded THEN 'partial' WHEN "full" AND found = 0 THEN 'warn' ELSE 'ok' END AS status FROM judged"""



def stream_import(spark: SparkSession, d: str) -> DataFrame:
    """The feeds as messages of a stream, into an empty snapshot."""
    folder = shared_folder(spark, "stream")
    heads = headers(spark, d).withColumn("run", F.lit(1).cast("long"))
    messages = feed(spark, d).join(heads, "source_id", "right")
    messages.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(messages.schema).parquet(f"{folder}/in")
    feeds.follow(stream, f"{folder}/out", f"{folder}/checkpoint", before(spark, d).schema, dq.today(), dq.now()).awaitTermination()
    return feeds.snapshot(spark, f"{folder}/out", before(spark, d).schema).select("source_id", "externe_id", "obstacle_id", "fach_id", "realer_start", *OLD_VALUE, "aktiv")


#: Features of which several tell of one place, in two spellings, and some of several phases of works.
MEMBER = {
    "source_id": f"o_orderkey % {SOURCES}",
    "externe_id": "concat('s', CAST(o_orderkey AS VARCHAR(20)))",
    "ord": "o_orderkey",
    "kategorie": "CASE o_custkey % 2 WHEN 0 THEN 'sperrung' ELSE 'baustelle' END",
    "name": f"CASE WHEN o_orderkey % 29 = 7 THEN ' ' WHEN o_orderkey % 2 = 0 THEN concat('L', CAST({NUMBER} % 4 AS VARCHAR(20)), ' Tunnelwartung') ELSE concat(' l', CAST({NUMBER} % 4 AS VARCHAR(20)), '   TUNNELWARTUNG ') END",
    "beschreibung": "CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN concat('Teil ', CAST(o_orderkey AS VARCHAR(20))) END",
    "lat": f"{fx.d('48.123')} + {fx.d(NUMBER + ' % 4')} * {fx.d('0.01')} + {fx.d('o_orderkey % 3')} * {fx.d('0.0001')}",
    "lng": f"{fx.d('9.5001')} + {fx.d('o_orderkey % 3')} * {fx.d('0.0001')}",
    "restbreite_m": fx.some("o_custkey % 4 > 1", f"{fx.d('300 + (o_custkey % 4) * 25')} / {fx.d('100')}"),
    "max_hoehe_m": "CAST(NULL AS DOUBLE)",
    "max_breite_m": "CAST(NULL AS DOUBLE)",
    "max_gewicht_t": "CAST(NULL AS DOUBLE)",
    "max_laenge_m": fx.some("o_orderkey % 5 = 1", f"{fx.d('10 + o_orderkey % 9')}"),
    "radius_m": fx.some("o_orderkey % 4 = 1", f"{fx.d('5 + o_orderkey % 12')}"),
    "vollsperrung": "CAST(NULL AS BOOLEAN)",
    "gesperrt_komplett": "CAST(NULL AS BOOLEAN)",
    "gst_sperre": "CAST(NULL AS BOOLEAN)",
    "sackgasse": fx.some("o_orderkey % 3 <> 0", "o_orderkey % 5 = 0"),
    "gueltig_von": fx.some("o_orderkey % 6 <> 0", "CAST(o_orderdate AS DATE)"),
    "gueltig_bis": fx.some("o_orderkey % 7 <> 0", "CAST(CAST(o_orderdate AS DATE) + INTERVAL '90' DAY AS DATE)"),
    "realer_start": "CAST(NULL AS DATE)",
}
MEMBERS = fx.cte("member", MEMBER, "orders")


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    line = F.array(F.array(F.struct("lng", "lat"), F.struct((F.col("lng") + 0.001).alias("lng"), F.col("lat").alias("lat"))))
    found = ingest.group_duplicates(fx.table(spark, d, "orders", MEMBER).withColumn("lines", F.when(F.col("ord") % 2 == 0, line)))
    start = F.array_join(F.transform("lines", lambda p: F.round(p[0]["lng"], 4).cast("string")), ",")
    return found.select("source_id", "externe_id", "ord", "kategorie", "members", "beschreibung", "restbreite_m", "max_laenge_m", "radius_m", "sackgasse", "gueltig_von", "gueltig_bis", "realer_start", F.coalesce(start, F.lit("")).alias("lines_at"))


KEY = f"concat(kategorie, '|', {dq.NAME}, '|', printf('%.3f,%.3f', lat, lng))"
DUPLICATES = f"""{fx.with_(MEMBERS)}, keyed AS (SELECT *, {KEY} AS k, {dq.PROFILE} AS p, CASE WHEN ord % 2 = 0 THEN CAST(round(lng, 4) AS VARCHAR) END AS line_at FROM member),
    counted AS (SELECT *, count(*) OVER (PARTITION BY source_id, k) AS n FROM keyed WHERE trim(name) <> ''),
    phase AS (SELECT source_id, k, count(DISTINCT p) AS phases FROM counted GROUP BY ALL)
    SELECT source_id, externe_id, ord, kategorie, 1 AS members, beschreibung, restbreite_m, max_laenge_m, radius_m, sackgasse, gueltig_von, gueltig_bis, realer_start, coalesce(line_at, '') AS lines_at FROM keyed WHERE trim(name) = ''
    UNION ALL SELECT source_id, externe_id, ord, kategorie, 1, beschreibung, restbreite_m, max_laenge_m, radius_m, sackgasse, gueltig_von, gueltig_bis, realer_start, coalesce(line_at, '') FROM counted WHERE n = 1
    UNION ALL SELECT source_id, concat('dup#', {dq.fnv("k")}, CASE WHEN phases > 1 THEN concat('@', {dq.fnv("p")}) ELSE '' END), ord, kategorie, members, beschreibung, restbreite_m, max_laenge_m, radius_m, sackgasse, gueltig_von, gueltig_bis, gueltig_von, lines_at FROM (
        SELECT source_id, k, p, min(ord) AS ord, any_value(kategorie) AS kategorie, count(*) AS members, first(beschreibung ORDER BY ord) FILTER (trim(beschreibung) <> '') AS beschreibung, min(restbreite_m) AS restbreite_m, min(max_laenge_m) AS max_laenge_m, max(radius_m) AS radius_m,
            CASE WHEN bool_or(sackgasse) THEN true END AS sackgasse, min(gueltig_von) AS gueltig_von, max(gueltig_bis) AS gueltig_bis, coalesce(string_agg(line_at, ',' ORDER BY ord), '') AS lines_at FROM counted WHERE n > 1 GROUP BY source_id, k, p) JOIN phase USING (source_id, k)"""

#: Parts and nights of works: three quarters with a number at the start of their ids.
WORKS = MEMBER | {
    "externe_id": "CASE WHEN o_custkey % 4 = 3 THEN concat('Umbau ', CAST(o_custkey % 30 AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN '.de' ELSE '.DE' END, CAST(o_orderkey % 5 AS VARCHAR(20))) ELSE concat('2026-', lpad(CAST(o_custkey % 40 AS VARCHAR(20)), 6, '0'), '--vi.2026-06-', CAST(o_orderkey % 28 AS VARCHAR(20)), '_de', CAST(o_orderkey % 3 AS VARCHAR(20))) END",
    "source_id": "o_custkey % 3",
    "kategorie": "'baustelle'",
    "name": "concat('A', CAST(o_custkey % 3 + 1 AS VARCHAR(20)), ' Ausbau')",
    "richtung": "CASE WHEN o_custkey % 5 = 1 THEN 'Nord' END",
}
SEGMENTS = f"""{fx.with_(fx.cte("works", WORKS, "orders"))}, keyed AS (SELECT *, CASE WHEN regexp_matches(externe_id, '^[0-9]{{4}}-[0-9]{{5,6}}') THEN regexp_extract(externe_id, '^[0-9]{{4}}-[0-9]{{5,6}}') ELSE regexp_replace(split_part(externe_id, '--', 1), '\\.de[0-9]+$', '', 'i') END AS project FROM works)
    SELECT source_id, project, split_part(name, ' ', 1) AS road, coalesce(richtung, '') AS direction, kategorie, {dq.PROFILE} AS profile, count(*) AS parts, min(restbreite_m) AS restbreite_m, min(gueltig_von) AS gueltig_von, max(gueltig_bis) AS gueltig_bis FROM keyed GROUP BY ALL"""

QUERIES = {
    "segment_merge": lambda s, d: ingest.merge_segments(fx.table(s, d, "orders", WORKS)),
    "import_rows": lambda s, d: run(s, d).rows.select("source_id", "externe_id", "obstacle_id", "fach_id", "realer_start", *OLD_VALUE, "aktiv", "action"),
    "stream_import": stream_import,
    "import_stats": lambda s, d: run(s, d).stats,
    "group_duplicates": duplicates,
}
ORACLES = {"import_rows": RUN_ROWS, "stream_import": f"SELECT * EXCLUDE (action) FROM ({RUN_ROWS.replace('WHERE ord % 6 <> 5)', 'WHERE false)')})", "import_stats": RUN_STATS, "group_duplicates": DUPLICATES, "segment_merge": SEGMENTS}
