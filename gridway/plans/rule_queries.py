"""Rule book and finding queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridway.functions import rules, text
from gridway.operators import findings
from gridway.plans import fixtures as fx

RULED = fx.with_(fx.VEHICLES)


def today() -> Column:
    return F.lit(fx.TODAY).cast("date")


def by_rule(category: tuple[str, ...], rank: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = fx.obstacles(spark, d, vehicle=True).filter(F.col("kategorie").isin(*category))
        return rows.select("obstacle_id", rank().cast("int").alias("rank"))

    return query


def margin(limit: str, measure: str) -> str:
    return f"(floor(({limit} - {measure}) * 100 + 0.5) / 100)"


def graded(x: str, first: float, second: float) -> str:
    return f"CASE WHEN {x} < {first} THEN 3 WHEN {x} < {second} THEN 2 ELSE 1 END"


HEIGHT, WIDTH = graded(margin("max_hoehe_m", "t_hoehe"), 0.1, 0.5), graded(margin("max_breite_m", "t_breite"), 0.1, 0.5)
LOAD, LENGTH = graded(margin("max_gewicht_t", "t_gewicht"), 0, 10), graded(margin("max_laenge_m", "t_laenge"), 0, 2)
WORST = f"greatest({HEIGHT}, {WIDTH}, {LOAD})"
OVERLAP = "(coalesce(gueltig_von, realer_start, DATE '0001-01-01') <= bis AND von <= coalesce(gueltig_bis, DATE '9999-12-31'))"
# The fixture's texts hold none of the words for ramps, and roads and paths never together.
BESIDE = "(beschreibung = 'Radweg gesperrt' AND sperrung_art IS NULL)"
BLOCK = "(havarie OR sackgasse OR einbahn OR verengt)"


def event_sql(height: str) -> str:
    small = f"(coalesce(restbreite_m < t_breite, false) OR coalesce(max_gewicht_t < t_gewicht, false){height})"
    return f"CASE WHEN (vollsperrung AND NOT {BESIDE} AND {OVERLAP}) OR {small} THEN 3 WHEN {OVERLAP} OR {BLOCK} THEN 2 ELSE 1 END"


SQL_RULES = {
    "bruecke": f"CASE WHEN coalesce(gesperrt_komplett, false) THEN 3 WHEN gst_sperre THEN greatest({WORST}, 2) ELSE {WORST} END",
    "engstelle": WIDTH,
    "gewicht": f"CASE WHEN coalesce(gesperrt_komplett, false) THEN 3 WHEN verkehrsverbot_t IS NOT NULL OR gst_sperre THEN 2 ELSE {LOAD} END",
    "steigung": "CASE WHEN steigung_pct >= 8 THEN (CASE WHEN t_gewicht > 60 THEN 3 ELSE 2 END) WHEN steigung_pct >= 5 AND t_gewicht > 100 THEN 2 ELSE 1 END",
    "kreisverkehr": "CASE WHEN t_laenge > 2.2::DOUBLE * radius_m THEN 3 WHEN t_laenge > 1.6::DOUBLE * radius_m THEN 2 ELSE 1 END",
    "baustelle": event_sql(" OR coalesce(max_hoehe_m < t_hoehe, false)"),
    "sperrung": event_sql(""),
    "bahnuebergang": "CASE WHEN t_hoehe > max_hoehe_m THEN 3 ELSE 1 END",
    "ampel": "CASE WHEN t_hoehe > max_hoehe_m THEN 2 ELSE 1 END",
}
SQL_RULES["tunnel"] = SQL_RULES["bruecke"]
ANY_RULE = "CASE kategorie " + " ".join(f"WHEN '{k}' THEN {e}" for k, e in SQL_RULES.items()) + " END"
FORCE = "coalesce(gueltig_bis >= von, true) AND coalesce(coalesce(gueltig_von, realer_start) <= bis, true)"


def evaluated(window: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = rules.evaluate(fx.obstacles(spark, d, vehicle=True, window=window), today())
        return rows.select("obstacle_id", "kategorie", F.col("rank").cast("int").alias("rank"), rules.severity(F.col("rank")).alias("severity"))

    return query


def evaluated_sql(window: bool) -> str:
    rule = ANY_RULE if window else ANY_RULE.replace(OVERLAP, "true")
    force = FORCE if window else f"(kategorie NOT IN ('baustelle', 'sperrung') OR (coalesce(gueltig_bis >= DATE '{fx.TODAY}', true) AND coalesce(coalesce(gueltig_von, realer_start) <= DATE '{fx.TODAY}', true)))"
    return f"""{RULED}, r AS (SELECT obstacle_id, kategorie, greatest({rule}, {LENGTH}) AS rank, max_gewicht_t IS NOT NULL OR verkehrsverbot_t IS NOT NULL OR coalesce(gesperrt_komplett, false) OR gst_sperre AS load FROM obstacle WHERE kategorie <> 'sonstige' AND {force})
        SELECT obstacle_id, kategorie, CAST(rank AS INT) AS rank, CASE rank WHEN 3 THEN 'kritisch' WHEN 2 THEN 'warnung' ELSE 'hinweis' END AS severity FROM r WHERE rank > 1 OR kategorie IN ('baustelle', 'sperrung') OR load"""


def conditions(spark: SparkSession, d: str) -> DataFrame:
    place, needed = rules.conditions()
    return fx.obstacles(spark, d, vehicle=True).select("obstacle_id", rules.drivability(place).alias("drivability"), F.array_join(F.array_sort(needed), "; ").alias("conditions"))


def conditions_sql() -> str:
    h, g = margin("max_hoehe_m", "t_hoehe"), margin("max_gewicht_t", "t_gewicht")
    s = "(floor((least(max_breite_m, restbreite_m) - t_breite) * 100 + 0.5) / 100)"
    parts = [
        (f"{h} < 0", 3, ""), (f"{h} >= 0 AND {h} < 0.1", 1, "height check;walking pace;centre or opposite lane"), (f"{h} >= 0.1 AND {h} < 0.5", 1, "height check"),
        (f"{g} < 0", 2, "structural proof;alone on the bridge;walking pace;centre of the bridge"), (f"{g} >= 0 AND {g} < 10", 1, "alone on the bridge;walking pace;centre of the bridge"),
        ("restbreite_m < t_breite", 2, "agree with the works;change the traffic layout"), (f"{s} < 0 AND max_breite_m < t_breite", 1, "escort vehicle;use of the opposite lane;short closure by the police"),
        (f"{s} >= 0 AND {s} < 0.5", 1, "escort vehicle"), ("gesperrt_komplett", 3, ""), ("NOT coalesce(gesperrt_komplett, false) AND gst_sperre", 2, "proof of load capacity"),
        ("kategorie = 'sperrung' AND vollsperrung", 3, ""), ("kategorie = 'sperrung' AND NOT vollsperrung", 1, "follow the traffic layout"),
    ]
    place = "greatest(" + ", ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in parts) + ")"
    texts = " || ".join(f"CASE WHEN {c} THEN {t.split(';')!r} ELSE []::VARCHAR[] END" for c, _, t in parts if t)
    return f"""{RULED}, c AS (SELECT obstacle_id, kategorie, {place} AS p, {texts} AS t FROM obstacle), w AS (SELECT obstacle_id, CASE WHEN kategorie = 'baustelle' AND p = 0 THEN 1 ELSE p END AS p, t || CASE WHEN kategorie = 'baustelle' AND p = 0 THEN ['check the remaining width on site'] ELSE []::VARCHAR[] END AS t FROM c)
        SELECT obstacle_id, ['frei', 'mit-auflagen', 'einzelfallpruefung', 'nicht-fahrbar'][p + 1] AS drivability, array_to_string(list_sort(list_distinct(t)), '; ') AS conditions FROM w"""


def crossing(spark: SparkSession, d: str) -> DataFrame:
    """Bridges and tunnels whose name speaks of a road the route does not use."""
    rows = fx.obstacles(spark, d).filter(F.col("kategorie").isin("bruecke", "tunnel"))
    used = F.array(F.concat(F.lit("A"), (F.col("obstacle_id") % 25 + 1).cast("string")), F.concat(F.lit("B"), (F.col("obstacle_id") % 25 + 2).cast("string")))
    refs = text.road_refs(F.col("name"))
    return rows.select("obstacle_id", F.array_join(refs, ",").alias("refs"), ((F.size(refs) > 0) & ~F.arrays_overlap(refs, used)).alias("crossing"))


def later(spark: SparkSession, d: str) -> DataFrame:
    """The same findings a run later: some gone, some worse, some new."""
    rows = fx.findings(spark, d).filter("ord % 11 <> 5")
    worse = F.when(F.col("ord") % 13 == 0, F.lit(3)).otherwise(F.col("rank")).cast("int")
    return rows.withColumn("rank", worse).withColumn("obstacle_id", F.when(F.col("ord") % 17 == 1, F.col("obstacle_id") + 100_000).otherwise(F.col("obstacle_id")))


LATER = "later AS (SELECT * REPLACE (CASE WHEN ord % 13 = 0 THEN 3 ELSE rank END AS rank, CASE WHEN ord % 17 = 1 THEN obstacle_id + 100000 ELSE obstacle_id END AS obstacle_id) FROM finding WHERE ord % 11 <> 5)"
NORM = "regexp_replace(lower(trim(coalesce(titel, ''))), '\\s+', ' ', 'g')"
KEY = f"CASE WHEN obstacle_id IS NOT NULL THEN concat_ws('|', CAST(obstacle_id AS VARCHAR), CAST(route_id AS VARCHAR)) ELSE sha256(concat_ws('|', kategorie, {NORM}, CAST(CAST(floor(km + 0.5) AS BIGINT) AS VARCHAR))) END"
F1 = fx.with_(fx.FINDINGS)


QUERIES = {
    "rule_bridge": by_rule(rules.STRUCTURES, rules.structure),
    "rule_narrow": by_rule(("engstelle",), rules.narrow),
    "rule_weight": by_rule(("gewicht",), rules.weight),
    "rule_gradient": by_rule(("steigung",), rules.gradient),
    "rule_roundabout": by_rule(("kreisverkehr",), rules.roundabout),
    "rule_roadworks": by_rule(("baustelle",), lambda: rules.event(True)),
    "rule_closure": by_rule(("sperrung",), lambda: rules.event(False)),
    "rule_crossing": by_rule(("bahnuebergang",), lambda: rules.overhead(3)),
    "rule_light": by_rule(("ampel",), lambda: rules.overhead(2)),
    "rule_length": by_rule(tuple(fx.KINDS), rules.too_long),
    "rules_evaluate": evaluated(True),
    "rules_evaluate_open": evaluated(False),
    "conditions": conditions,
    "crossing_structure": crossing,
    "dedupe_obstacle": lambda s, d: findings.dedupe_obstacle(fx.findings(s, d)).select("obstacle_id", "ord", "rank", "route_id", "km"),
    "route_ids": lambda s, d: findings.route_sets(fx.findings(s, d)).select("obstacle_id", F.array_join(F.transform("route_ids", lambda x: x.cast("string")), ",").alias("route_ids")),
    "finding_diff": lambda s, d: findings.diff(fx.findings(s, d), later(s, d)),
    "finding_signature": lambda s, d: findings.signature(fx.findings(s, d)),
    "finding_key": lambda s, d: fx.findings(s, d).select("ord", findings.stable_key().alias("key")),
    "finding_stats": lambda s, d: findings.stats(fx.findings(s, d)),
}


def rule_sql(category: str, expression: str) -> str:
    return f"{RULED} SELECT obstacle_id, CAST({expression} AS INT) AS rank FROM obstacle WHERE kategorie IN ({category})"


ORACLES = {
    "rule_bridge": rule_sql("'bruecke', 'tunnel'", SQL_RULES["bruecke"]),
    "rule_narrow": rule_sql("'engstelle'", WIDTH),
    "rule_weight": rule_sql("'gewicht'", SQL_RULES["gewicht"]),
    "rule_gradient": rule_sql("'steigung'", SQL_RULES["steigung"]),
    "rule_roundabout": rule_sql("'kreisverkehr'", SQL_RULES["kreisverkehr"]),
    "rule_roadworks": rule_sql("'baustelle'", SQL_RULES["baustelle"]),
    "rule_closure": rule_sql("'sperrung'", SQL_RULES["sperrung"]),
    "rule_crossing": rule_sql("'bahnuebergang'", SQL_RULES["bahnuebergang"]),
    "rule_light": rule_sql("'ampel'", SQL_RULES["ampel"]),
    "rule_length": f"{RULED} SELECT obstacle_id, CAST({LENGTH} AS INT) AS rank FROM obstacle",
    "rules_evaluate": evaluated_sql(True),
    "rules_evaluate_open": evaluated_sql(False),
    "conditions": conditions_sql(),
    "crossing_structure": f"""{fx.with_(fx.OBSTACLES)}, r AS (SELECT obstacle_id, upper(regexp_replace(regexp_extract(name, '^([ABL] ?[0-9]+)', 1), ' ', '')) AS ref FROM obstacle WHERE kategorie IN ('bruecke', 'tunnel'))
        SELECT obstacle_id, ref AS refs, ref <> concat('A', CAST(obstacle_id % 25 + 1 AS VARCHAR)) AND ref <> concat('B', CAST(obstacle_id % 25 + 2 AS VARCHAR)) AS crossing FROM r""",
    "dedupe_obstacle": f"""{F1} SELECT obstacle_id, place AS ord, rank, route_id, km FROM (SELECT *, min(ord) OVER (PARTITION BY obstacle_id) AS place, row_number() OVER (PARTITION BY obstacle_id ORDER BY rank DESC, ord) AS n FROM finding WHERE obstacle_id IS NOT NULL) WHERE n = 1
        UNION ALL SELECT obstacle_id, ord, rank, route_id, km FROM finding WHERE obstacle_id IS NULL""",
    "route_ids": f"{F1} SELECT obstacle_id, array_to_string(list_sort(list(DISTINCT route_id)), ',') AS route_ids FROM finding WHERE obstacle_id IS NOT NULL GROUP BY 1",
    "finding_diff": f"""{fx.with_(fx.FINDINGS, LATER)}, b AS (SELECT {KEY} AS key, max(rank) AS rank_before FROM finding GROUP BY 1), a AS (SELECT {KEY} AS key, max(rank) AS rank_after FROM later GROUP BY 1)
        SELECT key, CASE WHEN rank_before IS NULL THEN 'neu' ELSE 'geaendert' END AS change, rank_before, rank_after FROM a LEFT JOIN b USING (key) WHERE rank_before IS NULL OR rank_before <> rank_after""",
    "finding_signature": f"{F1}, k AS (SELECT route_id, {KEY} AS key FROM finding) SELECT route_id, count(*) AS n, sha256(count(*) || '|' || sum(CAST('0x' || substr(sha256(key), 1, 15) AS BIGINT))) AS signature FROM k GROUP BY 1",
    "finding_key": f"{F1} SELECT ord, {KEY} AS key FROM finding",
    "finding_stats": f"{F1} SELECT route_id, count(*) AS n, count(*) FILTER (WHERE rank = 3) AS kritisch, count(*) FILTER (WHERE rank = 2) AS warnung, count(*) FILTER (WHERE rank = 1) AS hinweis, min(km) FILTER (WHERE rank = 3) AS first_critical_km FROM finding GROUP BY 1",
}
