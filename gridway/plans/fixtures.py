"""Obstacles, routes, vehicles and the rest of the engine's inputs, derived from the driver's tables.

Every table is a list of SQL expressions that both engines understand; Spark selects them and the oracle SQL starts with
the same expressions as common table expressions. Integer arithmetic comes first, one cast last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "1997-06-15"
NOW = "TIMESTAMP '1997-06-15 12:00:00'"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


#: Kinds of obstacle by order key.
KINDS = ["bruecke", "engstelle", "baustelle", "sperrung", "gewicht", "bahnuebergang", "kreisverkehr", "ampel", "steigung", "tunnel", "sonstige"]
KIND = "CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
ROUTE, VERTEX = "(o_orderkey % 25)", "((o_orderkey * 13) % 400)"


def some(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {value} END"


OBSTACLE = {
    "obstacle_id": "o_orderkey",
    "source_id": "o_custkey % 40",
    "externe_id": "concat('x', CAST(o_orderkey AS VARCHAR(20)))",
    "tenant_id": some("o_custkey % 5 = 0", "o_custkey % 3"),
    "kategorie": KIND,
    "name": "concat(CASE WHEN o_orderkey % 4 = 0 THEN 'A' WHEN o_orderkey % 4 = 1 THEN 'B ' ELSE 'L' END, CAST(o_orderkey % 90 + 1 AS VARCHAR(20)), ' Bauwerk  ', CAST((o_orderkey * 7) % 50 AS VARCHAR(20)))",
    "beschreibung": "CASE o_orderkey % 6 WHEN 0 THEN 'Radweg gesperrt' WHEN 1 THEN 'Vollsperrung der Fahrbahn' WHEN 2 THEN 'Stau nach Unfall' WHEN 3 THEN 'Bauarbeiten, Gefahr' ELSE 'Sanierung' END",
    "lat": f"{d('47.5')} + {d(ROUTE)} * {d('0.3')} + {d(VERTEX + ' % 5')} * {d('0.0004')} + {d('(o_orderkey * 37) % 41 - 20')} * {d('0.00002')}",
    "lng": f"{d('7')} + {d(VERTEX)} * {d('0.005')}",
    "max_hoehe_m": some("o_orderkey % 3 = 0", f"{d('390 + (o_orderkey % 17) * 7')} / {d('100')}"),
    "max_breite_m": some("o_orderkey % 5 = 1", f"{d('250 + (o_orderkey % 23) * 6')} / {d('100')}"),
    "max_gewicht_t": some("o_orderkey % 4 = 2", f"{d('30 + (o_orderkey % 61)')}"),
    "max_laenge_m": some("o_orderkey % 13 = 0", f"{d('200 + (o_orderkey % 9) * 15')} / {d('10')}"),
    "restbreite_m": some("o_orderkey % 7 = 3", f"{d('240 + (o_orderkey % 31) * 5')} / {d('100')}"),
    "steigung_pct": some("o_orderkey % 2 = 0", f"{d('o_orderkey % 11')}"),
    "radius_m": some("o_orderkey % 3 = 1", f"{d('6 + o_orderkey % 12')}"),
    "verkehrsverbot_t": some("o_orderkey % 17 = 5", f"{d('12')}"),
    "spuren_gesperrt": some("o_orderkey % 19 = 4", f"{d('0')}"),
    "vollsperrung": "o_orderkey % 8 = 1",
    "gesperrt_komplett": some("o_orderkey % 2 = 0", "o_orderkey % 29 = 0"),
    "gst_sperre": "o_orderkey % 12 = 7",
    "gst_route": "o_orderkey % 31 = 2",
    "havarie": "o_orderkey % 37 = 3",
    "sackgasse": "o_orderkey % 41 = 3",
    "einbahn": "o_orderkey % 43 = 3",
    "verengt": "o_orderkey % 23 = 3",
    "sperrung_art": some("o_orderkey % 10 = 1", "'roadClosed'"),
    "richtung": "CASE WHEN o_orderkey % 2 = 0 THEN 'in Fahrtrichtung' END",
    "gueltig_von": some("o_orderkey % 6 <> 0", "CAST(o_orderdate AS DATE)"),
    "gueltig_bis": some("o_orderkey % 9 <> 0", "CAST(CAST(o_orderdate AS DATE) + INTERVAL '90' DAY AS DATE)"),
    "realer_start": some("o_orderkey % 6 = 0", "CAST(o_orderdate AS DATE)"),
    "aktiv": "o_orderkey % 5 <> 4",
    "created_at": "CAST(o_orderdate AS TIMESTAMP)",
    "updated_at": "CAST(o_orderdate AS TIMESTAMP)",
    "fach_id": some("o_orderkey % 20 <> 0", "concat(lpad(CAST(o_orderkey % 300 AS VARCHAR(20)), 4, '0'), lpad(CAST(o_custkey % 40 AS VARCHAR(20)), 4, '0'), '010126')"),
    "ord": "o_orderkey",
}

#: The vehicle, and the travel window of a run.
VEHICLE = {"t_laenge": d("24.5"), "t_breite": d("3.0"), "t_hoehe": d("4.2"), "t_gewicht": d("68")}
WINDOW = {"von": "DATE '1997-03-01'", "bis": "DATE '1997-09-30'"}
NO_WINDOW = {"von": "CAST(NULL AS DATE)", "bis": "CAST(NULL AS DATE)"}

#: Findings as a run leaves them, straight from orders; two or more orders share a place.
FINDING = {
    "project_id": "o_custkey % 60",
    "obstacle_id": some("o_orderkey % 10 <> 0", "(o_orderkey * 3) % 4000"),
    "route_id": "o_orderkey % 25",
    "kategorie": KIND,
    "titel": "concat('Stelle  ', CAST((o_orderkey * 11) % 40 AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END)",
    "rank": "CAST(1 + (o_orderkey * 7) % 3 AS INT)",
    "km": f"floor({d('(o_orderkey * 31) % 6000')}) / {d('50')}",
    "lat": f"{d('47.5')} + {d('(o_orderkey * 31) % 6000')} * {d('0.00018')}",
    "lng": f"{d('7')} + {d('o_orderkey % 25')} * {d('0.1')}",
    "geom": some("o_orderkey % 4 = 0", "concat('g', CAST(o_orderkey % 13 AS VARCHAR(20)))"),
    "quelle": "concat('Quelle ', CAST(o_custkey % 4 AS VARCHAR(20)))",
    "herkunft": "CASE WHEN o_orderkey % 9 = 0 THEN 'eigen' ELSE 'import' END",
    "restbreite_m": some("o_orderkey % 3 <> 0", f"{d('250 + (o_orderkey % 5) * 25')} / {d('100')}"),
    "gueltig_von": some("o_orderkey % 6 <> 0", "DATE '1997-01-01'"),
    "gueltig_bis": some("o_orderkey % 2 = 0", "DATE '1997-12-31'"),
    "ord": "o_orderkey",
}

PROJECT = {
    "project_id": "c_custkey % 60",
    "tenant_id": "min(c_custkey) % 3",
    "owner_email": some("min(c_custkey) % 4 = 1", "concat('u', CAST(min(c_custkey) % 5 AS VARCHAR(20)), '@example.com')"),
    "status": "CASE WHEN min(c_custkey) % 2 = 0 THEN 'fertig' ELSE 'offen' END",
}

SOURCE = {
    "source_id": "s_suppkey",
    "kind": some("s_suppkey % 7 <> 0", "CASE WHEN s_suppkey % 11 = 0 THEN 'manuell' ELSE 'feed' END"),
    "aktiv": "s_suppkey % 9 <> 0",
}

#: Import runs: one per source and month that has line items.
RUN = {
    "run_id": "min(l_suppkey) * 1000 + min(year(l_shipdate) * 12 + month(l_shipdate)) - 23000",
    "source_id": "l_suppkey",
    "started_at": "max(l_shipdate)",
    "finished_at": "max(l_shipdate) + INTERVAL '7' SECOND",
    "status": "CASE count(*) % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' WHEN 2 THEN 'partial' ELSE 'ok' END",
    "found": "count(*)",
}


def select(expressions: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in expressions.items())


def cte(name: str, expressions: dict[str, str], source: str) -> str:
    return f"{name} AS (SELECT {select(expressions)} FROM {source})"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


OBSTACLES = cte("obstacle", OBSTACLE, "orders")
VEHICLES = cte("obstacle", {**OBSTACLE, **VEHICLE, **WINDOW}, "orders")
FINDINGS = cte("finding", FINDING, "orders")
PROJECTS = f"project AS (SELECT {select(PROJECT)} FROM customer GROUP BY c_custkey % 60)"
SOURCES = cte("source", SOURCE, "supplier")
RUNS = f"run AS (SELECT {select(RUN)} FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate))"
ROUTES = f"""route AS (SELECT n_nationkey AS route_id, i, {d('47.5')} + {d('n_nationkey')} * {d('0.3')} + {d('i % 5')} * {d('0.0004')} AS lat,
    {d('7')} + {d('i')} * {d('0.005')} AS lng FROM nation, (SELECT CAST(range AS INT) AS i FROM range(401)) WHERE n_nationkey < 25)"""
#: Lines of four points: along the route, reversed beside it, across it, and a ramp that leaves it.
LINE_LAT = f"CASE (obstacle_id / 7) % 4 WHEN 0 THEN lat0 + {d('0.00002')} WHEN 1 THEN lat0 + {d('0.00025')} WHEN 2 THEN lat0 + {d('2 * j - 3')} * {d('0.00025')} ELSE lat0 + {d('j')} * {d('0.0008')} END"
LINE_LNG = f"CASE (obstacle_id / 7) % 4 WHEN 0 THEN lng0 + {d('j')} * {d('0.001')} WHEN 1 THEN lng0 + {d('3 - j')} * {d('0.001')} WHEN 2 THEN lng0 + {d('0.0001')} ELSE lng0 + {d('j')} * {d('0.001')} END"
LINE_BASE = {"obstacle_id": "o_orderkey", "route_id": ROUTE, "lat0": f"{d('47.5')} + {d(ROUTE)} * {d('0.3')} + {d(VERTEX + ' % 5')} * {d('0.0004')}", "lng0": OBSTACLE["lng"]}
LINES = f"""line AS (SELECT obstacle_id, route_id, j, {LINE_LAT.replace('/ 7', '// 7')} AS lat, {LINE_LNG.replace('/ 7', '// 7')} AS lng
    FROM (SELECT {select(LINE_BASE)} FROM orders WHERE o_orderkey % 7 = 0), (SELECT CAST(range AS INT) AS j FROM range(4)))"""


def spark_type(e: str) -> str:
    return e.replace("VARCHAR(20)", "STRING")


def table(spark: SparkSession, sf_dir: str, name: str, expressions: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*(f"{spark_type(e)} AS {n}" for n, e in expressions.items()))


def obstacles(spark: SparkSession, sf_dir: str, vehicle: bool = False, window: bool = True) -> DataFrame:
    extra = {**VEHICLE, **(WINDOW if window else NO_WINDOW)} if vehicle else {}
    return table(spark, sf_dir, "orders", {**OBSTACLE, **extra})


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", FINDING)


def grouped(spark: SparkSession, sf_dir: str, name: str, keys: list[str], expressions: dict[str, str]) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out = {n: e for n, e in expressions.items() if e not in keys}
    own = {n: e for n, e in expressions.items() if e in keys}
    groups = [F.expr(e).alias(n) for n, e in own.items()] + [F.expr(k).alias(f"__{i}") for i, k in enumerate(keys) if k not in own.values()]
    return rows.groupBy(*groups).agg(*(F.expr(spark_type(e)).alias(n) for n, e in out.items())).select(*expressions)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir, "customer", ["c_custkey % 60"], PROJECT)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier", SOURCE)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir, "lineitem", ["l_suppkey", "date_trunc('month', l_shipdate)"], RUN)


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey < 25").select(F.col("n_nationkey").alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(400))).alias("i"))
    return rows.selectExpr("route_id", "i", f"{d('47.5')} + {d('route_id')} * {d('0.3')} + {d('i % 5')} * {d('0.0004')} AS lat", f"{d('7')} + {d('i')} * {d('0.005')} AS lng")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders", {**LINE_BASE, "k": "o_orderkey % 7"}).filter("k = 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    whole = lambda e: e.replace("(obstacle_id / 7)", "(obstacle_id div 7)")
    return base.selectExpr("obstacle_id", "route_id", "j", f"{whole(LINE_LAT)} AS lat", f"{whole(LINE_LNG)} AS lng")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")
