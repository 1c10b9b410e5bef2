"""Who is to be asked about a place: the authority by class of road, district and state, and how two assignments differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridway.functions import text
from gridway.operators import corridor

CONTACT = ("stelle", "rolle", "email", "telefon", "adresse")
# How the roads of each class start in a reference, and what the motorway company's branches are asked for.
CLASSES = {"autobahn": ("A",), "kreis": ("K",), "land": ("B", "L", "St")}
COMPANY, COMPANY_ROLE = "Autobahn GmbH – ", "Großraum- & Schwertransport (GST)"


def road_class(ref: Column) -> Column:
    """autobahn, kreis or land by the first of these classes that a reference names, gemeinde for any other road, null without one."""
    said = F.trim(F.coalesce(ref, F.lit("")))
    out = F.when(said == "", None)
    for name, letters in CLASSES.items():
        out = out.when(said.rlike(rf"(?:^|[\s(/])(?:{'|'.join(letters)}) ?[0-9]"), name)
    return out.otherwise("gemeinde")


def resolve(places: DataFrame, districts: DataFrame, states: DataFrame, branches: DataFrame, state_contacts: DataFrame, city_contacts: DataFrame) -> DataFrame:
    """(place_id, tier, stelle, rolle, email, telefon, adresse) of places (place_id, lat, lng, strassen_ref); without contact all but
    the id are null.

    districts and states are edges of rings as in_polygon() takes them, districts with kreis and nlz, states with land. Motorways go to
    the branch of their district (branches: nlz, niederlassung and contact); federal and state roads to the city there, else to the
    state; other named roads to the city; district roads and places without a road to nobody, rather than to the wrong one. Cities are
    found by the key of their district's name. Of several contacts with one key the last in
    their order counts. Only places that a tier may concern are looked up.
    """
    rows = places.select("place_id", "lat", "lng", road_class(F.col("strassen_ref")).alias("class"))
    asked = rows.filter("class IN ('autobahn', 'land', 'gemeinde') AND lat IS NOT NULL AND lng IS NOT NULL")
    facts = lambda rings, *columns: rings.groupBy("polygon_id").agg(*(F.first(c).alias(c) for c in columns))
    points = lambda df: df.select(F.col("place_id").alias("point_id"), "lat", "lng")

    def located(df: DataFrame, rings: DataFrame, *columns: str) -> DataFrame:
        hits = corridor.in_polygon(points(df), rings).join(facts(rings, *columns), "polygon_id")
        return hits.select(F.col("point_id").alias("place_id"), *columns)

    there = asked.join(located(asked, districts, "kreis", "nlz"), "place_id", "left")

    def contact(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(key, F.struct(*((F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in CONTACT)).alias("c"))
        return rows.groupBy(key).agg(F.max("c").alias("c")).select(key, "c.*")

    company = branches.withColumns({"stelle": F.concat(F.lit(COMPANY), "niederlassung"), "rolle": F.lit(COMPANY_ROLE)})
    motorway = there.filter("class = 'autobahn'").join(contact(company, "nlz"), "nlz").select("place_id", F.lit("autobahn").alias("tier"), *CONTACT)
    keyed = there.filter("class IN ('land', 'gemeinde')").withColumn("city_key", text.city_key(F.col("kreis")))
    city = keyed.join(contact(city_contacts, "city_key"), "city_key").select("place_id", F.lit("stadt").alias("tier"), *CONTACT)
    rest = keyed.filter("class = 'land'").join(city.select("place_id"), "place_id", "left_anti")
    state = rest.join(located(rest, states, "land"), "place_id").join(contact(state_contacts, "land"), "land").select("place_id", F.lit("land").alias("tier"), *CONTACT)
    return places.select("place_id").join(motorway.unionByName(city).unionByName(state), "place_id", "left")


def drift(committed: DataFrame, live: DataFrame) -> DataFrame:
    """(kreis, change, before, after): districts (kreis, nlz) that are new, assigned anew or gone."""
    both = committed.select("kreis", F.col("nlz").alias("before"), F.lit(True).alias("was")).join(live.select("kreis", F.col("nlz").alias("after"), F.lit(True).alias("is")), "kreis", "full_outer")
    change = F.when(F.col("was").isNull(), "neu").when(F.col("is").isNull(), "entfernt").when(~F.col("before").eqNullSafe(F.col("after")), "geaendert")
    return both.withColumn("change", change).filter("change IS NOT NULL").select("kreis", "change", "before", "after")
