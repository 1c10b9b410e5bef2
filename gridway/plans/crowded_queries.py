"""Duplicate findings where they are crowded: passes in order of ord, each held against a fold over the rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridway.operators import findings
from gridway.plans import fixtures as fx

#: Findings on six kilometres of each route, on slots of twenty metres: three titles, four sources, few geometries.
SLOT = "((o_orderkey * o_orderkey * 7 + o_orderkey * 13 + o_custkey) % 300)"
FINDING = fx.FINDING | {
    "titel": "concat('Stelle  ', CAST((o_orderkey * o_orderkey + o_custkey) % 3 AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END)",
    "kategorie": "CASE (o_custkey * 3 + o_orderkey) % 5 WHEN 0 THEN 'baustelle' WHEN 1 THEN 'sperrung' WHEN 2 THEN 'bruecke' ELSE 'engstelle' END",
    "rank": "CAST(1 + (o_orderkey * 7 + o_custkey) % 3 AS INT)",
    "km": f"{fx.d(SLOT)} / {fx.d('50')}",
    "lat": f"{fx.d('47.5')} + {fx.d(SLOT)} * {fx.d('0.00018')} + {fx.d('o_custkey % 3')} * {fx.d('0.00015')}",
    "restbreite_m": fx.some("o_custkey % 3 <> 0", f"{fx.d('250 + (o_custkey % 5) * 25')} / {fx.d('100')}"),
    "gueltig_von": fx.some("o_custkey % 2 = 0", "DATE '1997-01-01'"),
    "gueltig_bis": "DATE '1997-12-31'",
    "geom": fx.some("o_custkey % 5 = 0", "concat('g', CAST(o_orderkey % 3 AS VARCHAR(20)))"),
}
NORM = "regexp_replace(lower(trim(coalesce({c}, ''))), '\\s+', ' ', 'g')"
BASE = f"{fx.cte('finding', FINDING, 'orders')}, named AS (SELECT *, {NORM.format(c='titel')} AS t, {NORM.format(c='quelle')} AS q FROM finding)"


def crowded(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders", FINDING)


def fold(keys: str, row: str, begin: str, step: str, out: str) -> str:
    """SQL that takes each key's rows in order of ord: r is the row, s the state so far; step gives the next state."""
    return f"""WITH RECURSIVE {BASE},
        line AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY ord) AS n, {row} AS r FROM named),
        went AS (SELECT {keys}, n, {begin} AS s FROM line WHERE n = 1
            UNION ALL SELECT {", ".join(f"w.{k.strip()}" for k in keys.split(","))}, w.n + 1, {step} FROM went w JOIN line l ON {" AND ".join(f"l.{k.strip()} = w.{k.strip()}" for k in keys.split(","))} AND l.n = w.n + 1),
        final AS (SELECT * FROM went QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC) = 1)
        {out}"""


def representatives(close: str, better: str, skip: str = "false") -> str:
    """The next state of a pass that keeps representatives: a new one, one that is replaced, or as it was."""
    at = f"list_position(list_transform(w.s, lambda k: {close}), true)"
    return f"CASE WHEN ({skip}) OR {at} IS NULL OR {at} = 0 THEN list_append(w.s, l.r) WHEN {better.format(k=f'w.s[{at}]')} THEN w.s[:{at} - 1] || [l.r] || w.s[{at} + 1:] ELSE w.s END"


METRES = "2 * 6371 * asin(sqrt(pow(sin(radians(l.r.lat - k.lat) / 2), 2) + cos(radians(k.lat)) * cos(radians(l.r.lat)) * pow(sin(radians(l.r.lng - k.lng) / 2), 2))) * 1000"
KEPT = "SELECT r.ord, r.rank, r.km FROM (SELECT unnest(s) AS r FROM final)"
POINTS = fold(
    "route_id, kategorie, t", "{'ord': ord, 'rank': rank, 'km': km, 'geom': geom}", "[r]",
    representatives("abs(k.km - l.r.km) <= 0.15 AND (k.geom IS NULL OR l.r.geom IS NULL OR k.geom = l.r.geom)", "l.r.rank > {k}.rank OR (l.r.rank = {k}.rank AND l.r.geom IS NOT NULL AND {k}.geom IS NULL)"), KEPT,
)
PLACES = fold(
    "route_id, kategorie", "{'ord': ord, 'rank': rank, 'km': km, 'geom': geom, 'lat': lat, 'lng': lng}", "[r]",
    representatives(f"k.geom IS NULL AND abs(k.km - l.r.km) <= 0.15 AND {METRES} <= 25", "l.r.rank > {k}.rank", "l.r.geom IS NOT NULL"), KEPT,
)
GROUPS = fold(
    "route_id, kategorie, t", "{'ord': ord, 'lat': lat, 'lng': lng}", "[{'ord': r.ord, 'lat': r.lat, 'lng': r.lng, 'g': r.ord}]",
    f"list_append(w.s, {{'ord': l.r.ord, 'lat': l.r.lat, 'lng': l.r.lng, 'g': coalesce(list_min(list_transform(list_filter(w.s, lambda k: {METRES} <= 600), lambda k: k.g)), l.r.ord)}})",
    'SELECT r.ord, route_id, kategorie, r.g AS "group" FROM (SELECT route_id, kategorie, unnest(s) AS r FROM final)',
)
#: Rows of a key whose sources may meet, all in a list; the state is the list of those that are gone.
SOURCES = f"""WITH RECURSIVE {BASE},
    whole AS (SELECT route_id, kategorie, list({{'ord': ord, 'rank': rank, 'km': km, 'q': q}} ORDER BY ord) AS rows FROM named WHERE herkunft <> 'eigen' GROUP BY ALL),
    went AS (SELECT route_id, kategorie, rows, 0 AS n, []::BIGINT[] AS gone FROM whole
        UNION ALL SELECT route_id, kategorie, rows, n + 1, CASE WHEN list_contains(gone, i.ord) THEN gone ELSE list_concat(gone, list_concat(
            CASE WHEN worse IS NULL THEN []::BIGINT[] ELSE [i.ord] END, [k.ord FOR k IN met IF k.rank < i.rank AND (worse IS NULL OR k.ord < worse)])) END FROM (
            SELECT *, list_min([k.ord FOR k IN met IF k.rank > i.rank]) AS worse FROM (
                SELECT *, rows[n + 1] AS i, list_filter(rows, lambda k: k.ord <> rows[n + 1].ord AND abs(k.km - rows[n + 1].km) <= 0.15 AND k.q <> rows[n + 1].q AND NOT list_contains(gone, k.ord)) AS met FROM went WHERE n < len(rows)))),
    dropped AS (SELECT unnest(gone) AS ord FROM went WHERE n = len(rows))
    SELECT ord, rank, km FROM finding ANTI JOIN dropped USING (ord)"""
GAP = f"""WITH {BASE}, g AS (SELECT *, sum(turn) OVER (PARTITION BY route_id, kategorie, t ORDER BY km, ord) AS s FROM (SELECT *, CASE WHEN km - lag(km) OVER (PARTITION BY route_id, kategorie, t ORDER BY km, ord) <= 0.15 THEN 0 ELSE 1 END AS turn FROM named))
    SELECT ord, route_id, kategorie, km, rank FROM g QUALIFY row_number() OVER (PARTITION BY route_id, kategorie, t, s ORDER BY rank DESC, ord) = 1"""
WIDTHS = f"""WITH {BASE}, k AS (SELECT *, floor(km * 10 + 0.5) AS place FROM finding), m AS (SELECT route_id, kategorie, place, gueltig_von, gueltig_bis, min(restbreite_m) AS least FROM k WHERE restbreite_m IS NOT NULL GROUP BY ALL)
    SELECT ord, restbreite_m, rank FROM k f WHERE NOT EXISTS (SELECT 1 FROM k g JOIN m ON m.route_id = g.route_id AND m.kategorie = g.kategorie AND m.place = g.place AND m.gueltig_von IS NOT DISTINCT FROM g.gueltig_von AND m.gueltig_bis IS NOT DISTINCT FROM g.gueltig_bis
      WHERE g.route_id = f.route_id AND g.kategorie = f.kategorie AND g.place = f.place AND g.gueltig_von IS NOT DISTINCT FROM f.gueltig_von AND g.gueltig_bis IS NOT DISTINCT FROM f.gueltig_bis
      AND f.restbreite_m > least + 0.01 AND g.restbreite_m <= least + 0.01 AND g.rank >= f.rank)"""

QUERIES = {
    "dedupe_findings_greedy": lambda s, d: findings.dedupe_points(crowded(s, d)).select("ord", "rank", "km"),
    "dedupe_location_greedy": lambda s, d: findings.dedupe_places(crowded(s, d)).select("ord", "rank", "km"),
    "cross_source_greedy": lambda s, d: findings.dedupe_sources(crowded(s, d)).select("ord", "rank", "km"),
    "notification_groups": lambda s, d: findings.groups_within(crowded(s, d)).select("ord", "route_id", "kategorie", "group"),
    "dedupe_points_gap": lambda s, d: findings.dedupe_points_by_gap(crowded(s, d)).select("ord", "route_id", "kategorie", "km", "rank"),
    "dedupe_dominated_width": lambda s, d: findings.drop_dominated_widths(crowded(s, d)).select("ord", "restbreite_m", "rank"),
}
ORACLES = {"dedupe_findings_greedy": POINTS, "dedupe_location_greedy": PLACES, "cross_source_greedy": SOURCES, "notification_groups": GROUPS, "dedupe_points_gap": GAP, "dedupe_dominated_width": WIDTHS}
