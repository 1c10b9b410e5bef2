"""Authorities of obstacles by road, district and state, over polygons derived from the nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridway.functions import text
from gridway.operators import competence
from gridway.plans import fixtures as fx
from gridway.plans import geo_queries as gq

REF = "CASE o_orderkey % 8 WHEN 0 THEN 'BAB A7' WHEN 1 THEN 'B 27' WHEN 2 THEN 'L1100 (Ortsdurchfahrt)' WHEN 3 THEN 'K9' WHEN 4 THEN ' Hauptstraße ' WHEN 5 THEN '' WHEN 6 THEN 'B14/A 81' END"
#: Every other district is a city with a contact, three of four states have one.
DISTRICT = {"polygon_id": "n_nationkey", "kreis": "concat(translate(n_name, '0123456789', 'abcdefghij'), CASE WHEN n_nationkey % 2 = 0 THEN ' (Stadtkreis)' ELSE ' Land' END)", "nlz": "CASE WHEN n_nationkey % 6 <> 5 THEN concat('N', CAST(n_nationkey % 6 AS VARCHAR(20))) END"}


def districts(spark: SparkSession, d: str) -> DataFrame:
    names = fx.table(spark, d, "nation", DISTRICT).filter("polygon_id < 25")
    return gq.polygon_edges(spark, d).join(names, "polygon_id")


def states(spark: SparkSession, d: str) -> DataFrame:
    """Four bands of the map, as rings of four edges."""
    land = spark.read.parquet(f"{d}/region.parquet").filter("r_regionkey < 4").select(F.col("r_regionkey").alias("polygon_id"), F.col("r_regionkey").alias("ord"), "r_name")
    s = 47.011 + F.col("polygon_id") * 2
    corners = [(s, F.lit(6.0)), (s, F.lit(12.0)), (s + 2, F.lit(12.0)), (s + 2, F.lit(6.0))]
    edges = F.array(*(F.struct(a[0].alias("a_lat"), a[1].alias("a_lng"), b[0].alias("b_lat"), b[1].alias("b_lng")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)))
    return land.select("polygon_id", "ord", F.col("r_name").alias("land"), F.explode(edges).alias("e")).select("polygon_id", "ord", "land", "e.*")


def competences(spark: SparkSession, d: str) -> DataFrame:
    places = fx.table(spark, d, "orders", {"place_id": "o_orderkey", "lat": fx.OBSTACLE["lat"], "lng": fx.OBSTACLE["lng"], "strassen_ref": REF})
    nations = spark.read.parquet(f"{d}/nation.parquet")
    branches = nations.filter("n_nationkey < 4").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("nlz"), F.concat(F.lit("Niederlassung "), "n_name").alias("niederlassung"), F.lit("gst@example.com").alias("email"))
    cities = nations.filter("n_nationkey % 2 = 0").select(text.city_key(F.translate("n_name", "0123456789", "abcdefghij")).alias("city_key"), F.concat(F.lit("Tiefbauamt "), "n_name").alias("stelle"), F.lit("Stadt").alias("rolle"), F.concat(F.lit("0"), F.col("n_nationkey").cast("string")).alias("telefon"))
    lands = spark.read.parquet(f"{d}/region.parquet").filter("r_regionkey <> 2").select(F.col("r_name").alias("land"), F.concat(F.lit("Land "), "r_name").alias("stelle"), F.lit("Baulast").alias("rolle"))
    return competence.resolve(places, districts(spark, d), states(spark, d), branches, lands, cities)


def district_drift(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' districts against the customers': each name's branch is the largest number there."""
    side = lambda name, key: spark.read.parquet(f"{d}/{name}.parquet").groupBy((F.col(key) % 5000 + F.col(key) % 3 * 10000).cast("string").alias("kreis")).agg(F.max(F.col(key) % 7).cast("string").alias("nlz"))
    return competence.drift(side("supplier", "s_suppkey"), side("customer", "c_custkey").withColumn("nlz", F.when(F.col("kreis").cast("long") % 11 == 0, None).otherwise(F.col("nlz"))))


COMPETENCE = f"""WITH {fx.OBSTACLES}, ref AS (SELECT o_orderkey AS place_id, trim(coalesce({REF}, '')) AS r FROM orders),
    district AS (SELECT {fx.select(DISTRICT)}, n_name FROM nation), hit AS (SELECT * FROM ({gq.ORACLES["point_in_polygon"]})),
    land AS (SELECT obstacle_id AS place_id, r_name, r_regionkey FROM obstacle JOIN region ON r_regionkey < 4 AND lat >= 47.011::DOUBLE + r_regionkey * 2 AND lat < 47.011::DOUBLE + r_regionkey * 2 + 2 AND lng >= 6 AND lng < 12),
    seen AS (SELECT ref.place_id, r, CASE WHEN r IN ('BAB A7', 'B14/A 81') THEN 'autobahn' WHEN r = 'K9' OR r = '' THEN NULL WHEN r = 'Hauptstraße' THEN 'gemeinde' ELSE 'land' END AS class, d.n_name, d.polygon_id AS k, l.r_name, l.r_regionkey
        FROM ref LEFT JOIN hit ON hit.point_id = ref.place_id LEFT JOIN district d ON d.polygon_id = hit.polygon_id LEFT JOIN land l ON l.place_id = ref.place_id),
    tiered AS (SELECT *, CASE WHEN class = 'autobahn' AND k % 6 < 4 THEN 'autobahn' WHEN class IN ('land', 'gemeinde') AND k % 2 = 0 THEN 'stadt' WHEN class = 'land' AND r_regionkey <> 2 THEN 'land' END AS tier FROM seen)
    SELECT place_id, tier, CASE tier WHEN 'autobahn' THEN 'Autobahn GmbH – Niederlassung ' || (SELECT n.n_name FROM nation n WHERE n.n_nationkey = k % 6) WHEN 'stadt' THEN 'Tiefbauamt ' || n_name WHEN 'land' THEN 'Land ' || r_name END AS stelle,
        CASE tier WHEN 'autobahn' THEN 'Großraum- & Schwertransport (GST)' WHEN 'stadt' THEN 'Stadt' WHEN 'land' THEN 'Baulast' END AS rolle, CASE tier WHEN 'autobahn' THEN 'gst@example.com' END AS email, CASE tier WHEN 'stadt' THEN '0' || k END AS telefon, NULL::VARCHAR AS adresse FROM tiered"""
DRIFT = """WITH s AS (SELECT CAST(s_suppkey % 5000 + s_suppkey % 3 * 10000 AS VARCHAR) AS kreis, CAST(max(s_suppkey % 7) AS VARCHAR) AS nlz FROM supplier GROUP BY 1),
    c AS (SELECT kreis, CASE WHEN CAST(kreis AS BIGINT) % 11 = 0 THEN NULL ELSE nlz END AS nlz FROM (SELECT CAST(c_custkey % 5000 + c_custkey % 3 * 10000 AS VARCHAR) AS kreis, CAST(max(c_custkey % 7) AS VARCHAR) AS nlz FROM customer GROUP BY 1))
    SELECT kreis, 'neu' AS change, NULL AS before, nlz AS after FROM c WHERE kreis NOT IN (SELECT kreis FROM s) UNION ALL SELECT kreis, 'entfernt', nlz, NULL FROM s WHERE kreis NOT IN (SELECT kreis FROM c)
    UNION ALL SELECT kreis, 'geaendert', s.nlz, c.nlz FROM s JOIN c USING (kreis) WHERE s.nlz IS DISTINCT FROM c.nlz"""

QUERIES = {"competence": competences, "district_drift": district_drift}
ORACLES = {"competence": COMPETENCE, "district_drift": DRIFT}
