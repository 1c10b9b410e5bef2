"""Ingest, analytics, text, graph and streaming queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridway.functions import rules, text
from gridway.operators import analytics, graph, imports, ingest, serving
from gridway.plans import fixtures as fx
from gridway.plans.rule_queries import KEY as FINDING_KEY
from gridway.session import shared_folder
from gridway.sources import sinks
from gridway.streaming import beats

O = fx.with_(fx.OBSTACLES)  # noqa: E741
NAME = "regexp_replace(lower(trim(name)), '\\s+', ' ', 'g')"


def today() -> Column:
    return F.lit(fx.TODAY).cast("date")


def now() -> Column:
    return F.expr(fx.NOW)


def stream_now() -> Column:
    return F.expr("TIMESTAMP '2024-01-20 12:00:00'")


# Ingest


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Items of a feed: orders some of which have lost their id, category, name or position."""
    rows = fx.obstacles(spark, d)
    gone = lambda c, k: F.when(F.col("ord") % 53 != k, F.col(c)).alias(c)
    spoilt = {"externe_id": gone("externe_id", 1), "lat": gone("lat", 2), "name": F.when(F.col("ord") % 53 == 3, "x").otherwise(F.col("name")), "kategorie": F.when(F.col("ord") % 53 == 4, "unbekannt").otherwise(F.col("kategorie")), "gueltig_bis": F.when(F.col("ord") % 53 == 5, F.lit("1980-01-01").cast("date")).otherwise(F.col("gueltig_bis"))}
    return rows.withColumns(spoilt)


FEED = f"""feed AS (SELECT * REPLACE (CASE WHEN ord % 53 <> 1 THEN externe_id END AS externe_id, CASE WHEN ord % 53 <> 2 THEN lat END AS lat, CASE WHEN ord % 53 = 3 THEN 'x' ELSE name END AS name,
    CASE WHEN ord % 53 = 4 THEN 'unbekannt' ELSE kategorie END AS kategorie, CASE WHEN ord % 53 = 5 THEN DATE '1980-01-01' ELSE gueltig_bis END AS gueltig_bis) FROM obstacle)"""
REASON = """CASE WHEN externe_id IS NULL THEN 'no id' WHEN kategorie = 'unbekannt' THEN 'unknown category' WHEN lat IS NULL THEN 'no position' WHEN length(trim(name)) < 3 THEN 'no name' WHEN gueltig_bis < gueltig_von THEN 'ends before it starts' END"""
BARE = "coalesce(max_hoehe_m, 0) <= 0 AND coalesce(max_breite_m, 0) <= 0 AND coalesce(max_gewicht_t, 0) <= 0 AND coalesce(max_laenge_m, 0) <= 0 AND coalesce(restbreite_m, 0) <= 0 AND coalesce(verkehrsverbot_t, 0) <= 0 AND NOT vollsperrung AND NOT coalesce(gesperrt_komplett, false) AND NOT gst_sperre AND (kategorie IN ('bruecke', 'tunnel', 'sonstige') OR gst_route)"
#: Messages of the moment and notices of works, by order key.
MESSAGES = ("Stau nach Unfall", "Bauarbeiten, Gefahr", "Sanierung von Fahrbahnschäden", "Straßenschäden", "Ölspur", "defekter LKW", "defektes Fahrzeug", "Rückstau vor Brückenarbeiten", "Ortskundige bitte umfahren", "Ortskundige. Bitte umfahren", "Panne", "Pannenbucht gesperrt", "Unfallschwerpunkt: Erneuerung der Decke", "Straßenglätte", "glatte Fahrbahn", "Brennender Pkw", "Vollsperrung der Fahrbahn", "Tiere auf der Fahrbahn", "Staustufe", "Notfall-Umfahrung")
LIVE = """regexp_matches(lower(said), 'gefahr durch|liegen ?geblieb|bergung|geborgen|umgestürzt|ölspur|falschfahrer|glätte|glatteis|fahrzeugbrand|tiere? auf der|notfall-?umfahr|ortskundige[^.]{0,20}umfahr|(^|[^a-z])panne([^a-z]|$)|defekte[ns]? (pkw|lkw|kfz|fahrzeug)|brennende[sr]? (pkw|lkw|fahrzeug)')
    OR (regexp_matches(lower(said), '(^|[^a-z])(unfall|defekt|stau([^a-z]|$))|straßenschäden|fahrbahnschäden') AND NOT regexp_matches(lower(said), 'baustelle|bauarbeit|sanierung|erneuerung|brücke|vollsperrung'))"""
LIVE_SQL = LIVE.replace("said", "concat_ws(' ', name, beschreibung)")


def next_feed(spark: SparkSession, d: str, keep: int = 10) -> DataFrame:
    """The obstacles a run later: one in `keep` missing, some under a new id and a little off."""
    rows = fx.obstacles(spark, d).filter(f"ord % {keep} <> 3")
    moved = F.col("ord") % 19 == 2
    return rows.withColumns({"externe_id": F.when(moved, F.concat(F.lit("n"), "externe_id")).otherwise(F.col("externe_id")), "lat": F.when(moved, F.col("lat") + 0.001).otherwise(F.col("lat"))})


def fnv(x: str) -> str:
    """The oracle's hash in base 36: over the codes of a text's characters."""
    return f"lower(to_base(list_reduce(list_prepend(2166136261::BIGINT, [CAST(ascii(c) AS BIGINT) FOR c IN string_split({x}, '')]), lambda h, c: (xor(h, c) * 16777619) & 4294967295), 36))"


def next_feed_sql(keep: int = 10, more: str = "true") -> str:
    return f"nextfeed AS (SELECT * REPLACE (CASE WHEN ord % 19 = 2 THEN concat('n', externe_id) ELSE externe_id END AS externe_id, CASE WHEN ord % 19 = 2 THEN lat + 0.001::DOUBLE ELSE lat END AS lat) FROM obstacle WHERE ord % {keep} <> 3 AND {more})"


PROFILE = "concat_ws('|', coalesce(CAST(restbreite_m AS VARCHAR), ''), coalesce(CAST(max_hoehe_m AS VARCHAR), ''), coalesce(CAST(max_breite_m AS VARCHAR), ''), coalesce(CAST(max_gewicht_t AS VARCHAR), ''), coalesce(CAST(vollsperrung AS VARCHAR), ''), coalesce(CAST(gesperrt_komplett AS VARCHAR), ''), coalesce(CAST(gst_sperre AS VARCHAR), ''))"
SAME_SOURCE = "o.source_id = e.source_id AND "
MATCHED = f"""exact AS (SELECT f.*, o.obstacle_id AS exact_id FROM nextfeed f LEFT JOIN (SELECT source_id, externe_id, obstacle_id FROM obstacle) o USING (source_id, externe_id)),
    near AS (SELECT e.ord, o.obstacle_id AS near_id, row_number() OVER (PARTITION BY e.ord ORDER BY pow(e.lat - o.lat, 2) + pow(e.lng - o.lng, 2), o.obstacle_id) AS n FROM (SELECT *, {NAME} AS nk, {PROFILE} AS pk FROM exact WHERE exact_id IS NULL) e
      JOIN (SELECT *, {NAME} AS nk, {PROFILE} AS pk FROM obstacle WHERE aktiv) o ON o.source_id = e.source_id AND o.kategorie = e.kategorie AND o.nk = e.nk AND o.pk = e.pk AND abs(e.lat - o.lat) <= 0.003 AND abs(e.lng - o.lng) <= 0.0045),
    matched AS (SELECT e.*, coalesce(e.exact_id, n.near_id) AS target_id FROM exact e LEFT JOIN (SELECT ord, near_id FROM near WHERE n = 1) n USING (ord))"""


def upsert_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    found = ingest.match(next_feed(spark, d), fx.obstacles(spark, d))
    return found.filter("exact_id IS NULL").select("ord", "target_id")


def transition(items: DataFrame, before: DataFrame) -> DataFrame:
    """(key, action) of a full feed that all rows come from."""
    one = F.lit(0).cast("long").alias("source_id")
    header = items.sparkSession.range(1).select(one, F.lit(True).alias("full"), F.lit(True).alias("complete"))
    rows = imports.run(items.withColumn("source_id", one), header, before.drop("ord").withColumn("source_id", one), today(), now()).rows.filter("action <> 'keep'")
    key = F.when(F.col("action") == "insert", F.concat(F.lit("x"), "externe_id")).otherwise(F.concat(F.lit("o"), F.col("obstacle_id").cast("string")))
    return rows.select(key.alias("key"), "action")


def transition_sql(keep: int, more: str = "true") -> str:
    return f"""{fx.with_(fx.OBSTACLES, next_feed_sql(keep, more), MATCHED.replace(SAME_SOURCE, '').replace('USING (source_id, externe_id)', 'USING (externe_id)').replace('SELECT source_id, externe_id', 'SELECT externe_id'))}, ok AS (SELECT * FROM matched WHERE NOT ({BARE}) AND NOT ({LIVE_SQL})),
    last AS (SELECT coalesce('o' || CAST(target_id AS VARCHAR), 'x' || externe_id) AS key, arg_max(target_id, ord) AS target_id, arg_max(gueltig_bis, ord) AS bis0, max(ord) AS ord FROM ok GROUP BY 1),
    seen AS (SELECT l.key, l.target_id, (SELECT gueltig_bis FROM ok WHERE ok.ord = l.ord) AS bis, o.aktiv FROM last l LEFT JOIN obstacle o ON o.obstacle_id = l.target_id),
    gone AS (SELECT obstacle_id FROM obstacle WHERE aktiv AND obstacle_id NOT IN (SELECT target_id FROM seen WHERE target_id IS NOT NULL)), c AS (SELECT (SELECT count(*) FROM obstacle WHERE aktiv) AS a, (SELECT count(*) FROM gone) AS g, (SELECT count(*) FROM seen) AS s)
    SELECT key, CASE WHEN target_id IS NULL THEN 'insert' WHEN NOT aktiv AND coalesce(bis >= DATE '{fx.TODAY}' - 7, true) THEN 'reactivate' ELSE 'update' END AS action FROM seen
    UNION ALL SELECT 'o' || CAST(obstacle_id AS VARCHAR), 'deactivate' FROM gone, c WHERE s > 0 AND NOT (a >= 50 AND g > 0.4 * a)"""


def run_rows(spark: SparkSession, d: str) -> DataFrame:
    return fx.runs(spark, d).select("run_id", (F.col("status") == "error").alias("error"), (F.col("found") % 3 != 0).alias("complete"), (F.col("found") % 5 == 0).alias("guarded"), (F.col("found") % 2 == 0).alias("full"), F.when(F.col("found") % 4 == 0, F.lit(0)).otherwise(F.col("found")).alias("found"))


def projects_with_routes(spark: SparkSession, d: str) -> DataFrame:
    return fx.projects(spark, d).withColumn("routes", F.when(F.col("project_id") % 9 == 4, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: (F.col("project_id") + x) % 25)))


def future_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.obstacles(spark, d).withColumn("road", F.concat(F.lit("A"), (F.col("obstacle_id") % 25).cast("string")))
    return ingest.announced_only(rows.filter("kategorie = 'baustelle' AND lat IS NOT NULL"), rows.filter("kategorie <> 'baustelle' AND aktiv")).select("obstacle_id", "road")


def snapshot(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """Latest event of each user, over all batches."""
    rows = batch.select("user_id", "ts", "event_id", "value")
    rows = rows if before is None else rows.unionByName(before)
    return rows.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id")).alias("last")).select("user_id", "last.*")


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "stream")
    query = beats.upsert(beats.read_events(spark, d + "/events.parque[t]"), f"{folder}/snapshot", f"{folder}/checkpoint", snapshot)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/snapshot/{query.lastProgress['batchId']}")


def streamed(make):
    return lambda spark, d: beats.drain(make(beats.read_events(spark, d + "/events.parque[t]")), shared_folder(spark, "stream"))


#: Beats at most the gap apart are one session of a stream, unlike in the batch form.
STREAM_SESSIONS = """WITH beat AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 6 * 3600000000 THEN 0 ELSE 1 END AS new FROM events))
    SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 6 HOUR AS ends_at, count(*) AS hits FROM beat GROUP BY user_id, session_no"""
STREAM_SLIDING = """SELECT date_trunc('hour', ts) + (1 + k) * INTERVAL 1 HOUR AS at, count(DISTINCT user_id) AS users FROM events, (SELECT range AS k FROM range(2)) GROUP BY 1"""


# Text

NOTICES = [
    "Vollsperrung der L123 vom 03.04.2026 bis 17.05.2026, Umleitung ausgeschildert, Restbreite 3,25 m",
    "Brücke: zulässiges Gesamtgewicht 16 t, Durchfahrtshöhe 3,80 m, halbseitig gesperrt bis zum 2026-09-30",
    "Überholverbot für Lkw über 7,5 t auf der A 7",
    "Verbot für Fahrzeuge über 12 t auf der B96, nachts gesperrt, 1. Okt. 2026",
    "Kran mit 60 t im Einsatz, keine Einschränkung",
    "Sackgasse, Einbahnstraße auf einer Strecke von 120 m, Ende Dez. 2029",
    "",
]


def notices(spark: SparkSession, d: str) -> DataFrame:
    """Notices, one for each document, and the documents' own numbers behind them."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    texts = F.array(*map(F.lit, NOTICES))
    return rows.withColumn("text", F.concat(F.element_at(texts, (F.col("doc_id") % len(NOTICES) + 1).cast("int")), F.lit(" Länge "), ((F.col("doc_id") * 7) % 90).cast("string"), F.lit(" m. B "), (F.col("doc_id") % 80 + 1).cast("string")))


NOTICE = "notice AS (SELECT doc_id, concat([" + ", ".join("'" + n + "'" for n in NOTICES) + f"][doc_id % {len(NOTICES)} + 1], ' Länge ', CAST((doc_id * 7) % 90 AS VARCHAR), ' m. B ', CAST(doc_id % 80 + 1 AS VARCHAR)) AS text FROM documents)"
N = fx.with_(NOTICE)


def lifted(pattern: str) -> str:
    """The oracle's first group of a pattern as a number."""
    return f"TRY_CAST(nullif(regexp_extract(replace(text, ',', '.'), '{pattern}', 1), '') AS DOUBLE)"


def entities(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    s = F.concat(F.lit("a &lt;b&gt; &#"), (F.col("doc_id") % 900 + 60).cast("string"), F.lit("; &auml;&amp;uuml; &#x"), F.lower(F.hex(F.col("doc_id") % 500 + 400)), F.lit("; &unknown;"))
    return rows.select("doc_id", text.decode_entities(s).alias("decoded"))


def csv_row(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.findings(spark, d)
    quoted = F.when(F.col("ord") % 3 == 0, F.concat(F.col("titel"), F.lit(';"x"'))).otherwise(F.col("titel"))
    return rows.select("ord", sinks.csv_line([F.col("route_id"), quoted, text.comma(F.col("km"), 2)]).alias("line"))


# Graph


def folders(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/supplier.parquet")
    return rows.select(F.col("s_suppkey").alias("child"), F.when(F.col("s_suppkey") > 0, F.floor((F.col("s_suppkey") - 1) / 2)).alias("parent"))


def chains(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Twenty roads through all part keys, those of every fourth closed to a ring; from each location to another of its road."""
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("code"))
    road, k = F.col("code") % 20, F.expr("code div 20")
    per = Window.partitionBy("road")
    chain = rows.select(road.alias("road"), "code", k.alias("k")).withColumns({"first": F.min("k").over(per), "n": F.count("*").over(per)})
    last = F.col("k") == F.col("first") + F.col("n") - 1
    links = chain.select("road", "code", F.when(~last, F.col("code") + 20).when(F.col("road") % 4 == 1, F.col("first") * 20 + F.col("road")).alias("pos"))
    pairs = chain.select(F.col("code").alias("pair_id"), "road", F.col("code").alias("a"), ((F.col("first") + F.col("k") * 7 % F.col("n")) * 20 + F.col("road")).alias("b"))
    return links, pairs


def chain_walk(spark: SparkSession, d: str) -> DataFrame:
    return graph.chain_between(*chains(spark, d))


CHAIN = """WITH c AS (SELECT p_partkey % 20 AS road, p_partkey AS code, p_partkey // 20 AS k, min(p_partkey // 20) OVER w AS first, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_partkey % 20)),
    p AS (SELECT code AS pair_id, road % 4 = 1 AS ring, n, (first + k * 7 % n) - k AS step FROM c), h AS (SELECT *, CASE WHEN ring THEN (step % n + n) % n WHEN step >= 0 THEN step END AS ahead, CASE WHEN ring THEN (-step % n + n) % n WHEN step <= 0 THEN -step END AS back FROM p),
    w AS (SELECT *, least(CASE WHEN ahead <= 600 THEN ahead END, CASE WHEN back <= 600 THEN back END) AS best FROM h)
    SELECT pair_id, CAST(best AS INT) AS hops, CASE WHEN ahead = best THEN 'pos' WHEN back = best THEN 'neg' ELSE 'straight' END AS direction FROM w"""


def corridor_search(spark: SparkSession, d: str) -> DataFrame:
    """A search over twelve nodes for each customer, each with lengths and blockers of its own."""
    steps = F.explode(F.expr("flatten(transform(sequence(0, 10), a -> transform(sequence(a + 1, least(a + 3, 11)), b -> struct(a, b))))")).alias("e")
    edges = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("trip_id"), steps).select("trip_id", F.col("e.a").cast("long").alias("a"), F.col("e.b").cast("long").alias("b"))
    edges = edges.withColumns({"km": (10 + (F.col("trip_id") * 31 + F.col("a") * 17 + F.col("b") * 13) % 40).cast("double"), "blockers": F.when((F.col("trip_id") + F.col("a") * F.col("b")) % 5 == 0, 1).otherwise(0), "zones": F.lit(0)})
    trips = edges.select("trip_id").distinct().withColumns({"start": F.lit(0).cast("bigint"), "goal": F.lit(11).cast("bigint")})
    return graph.cheapest_paths(edges, trips).select("trip_id", "cost", "km", "blockers", "cut")


SEARCH = """WITH RECURSIVE edge AS (SELECT c_custkey AS trip_id, a, b, 10 + (c_custkey * 31 + a * 17 + b * 13) % 40 AS km, CASE WHEN (c_custkey + a * b) % 5 = 0 THEN 1 ELSE 0 END AS blockers FROM customer, (SELECT range AS a FROM range(11)), (SELECT range AS b FROM range(12)) WHERE b > a AND b <= a + 3),
    way AS (SELECT c_custkey AS trip_id, 0::BIGINT AS node, 0::BIGINT AS km, 0::BIGINT AS blockers FROM customer UNION ALL SELECT w.trip_id, e.b, w.km + e.km, w.blockers + e.blockers FROM way w JOIN edge e ON e.trip_id = w.trip_id AND e.a = w.node)
    SELECT trip_id, CAST(km + 250 * blockers AS DOUBLE) AS cost, CAST(km AS DOUBLE) AS km, CAST(blockers AS INT) AS blockers, false AS cut FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY km + 250 * blockers, km, blockers) AS n FROM way WHERE node = 11) WHERE n = 1"""


def sessions(minutes: int):
    return lambda s, d: analytics.sessions(fx.events(s, d), minutes)


def with_key(df: DataFrame) -> DataFrame:
    from gridway.operators import findings

    return df.withColumn("finding_key", findings.stable_key())


def hidden(spark: SparkSession, d: str) -> DataFrame:
    return with_key(fx.findings(spark, d).filter("ord % 31 = 4")).select("finding_key", F.concat(F.lit("reason "), (F.col("ord") % 3).cast("string")).alias("reason"))


def notice_rows(spark: SparkSession, d: str) -> DataFrame:
    return fx.findings(spark, d).select("ord", F.when(F.col("ord") % 5 != 0, F.col("project_id")).alias("project_id"), rules.severity(F.col("rank")).alias("severity"))


def prefs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("u1@example.com", ["kritisch", "warnung"])], "email string, severities array<string>")


def page_obstacles(spark: SparkSession, d: str) -> DataFrame:
    return serving.page(fx.obstacles(spark, d).filter("aktiv"), [F.desc("created_at"), F.col("obstacle_id")], 100, 3).select("obstacle_id", "created_at", "kategorie")


SESSIONS = """beat AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < CAST({m} AS BIGINT) * 60000000 THEN 0 ELSE 1 END AS new FROM events)),
    session AS (SELECT user_id, session_no, min(ts) AS started_at, max(ts) AS last_seen, count(*) AS hits FROM beat GROUP BY 1, 2)"""
S360 = "WITH " + SESSIONS.format(m=360)
LATEST = "lastrun AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1)"

#: What each notice says, by its number; the length and the second road are the documents' own.
NOTICE_SQL = """SELECT doc_id, CASE k WHEN 0 THEN 3.25 END AS width_m, CASE k WHEN 1 THEN 3.8 END AS height_m, CAST(CASE k WHEN 5 THEN 120 ELSE doc_id * 7 % 90 END AS DOUBLE) AS length_m, CASE k WHEN 1 THEN 16 WHEN 3 THEN 12 END AS weight_t,
    CASE k WHEN 0 THEN 'L123' WHEN 2 THEN 'A7' WHEN 3 THEN 'B96' ELSE 'B' || (doc_id % 80 + 1) END AS road, CASE k WHEN 0 THEN DATE '2026-04-03' WHEN 3 THEN DATE '2026-10-01' END AS valid_from, CASE k WHEN 0 THEN DATE '2026-05-17' WHEN 1 THEN DATE '2026-09-30' END AS valid_to,
    k = 0 AS closed, k = 1 AS half_closed, k = 5 AS one_way, k = 5 AS dead_end, k = 0 AS diverted, k = 3 AS at_night FROM (SELECT doc_id, doc_id % 7 AS k FROM documents)"""


QUERIES = {
    "validate_obstacles": lambda s, d: feed(s, d).select("ord", ingest.reason().alias("reason")).filter("reason IS NOT NULL"),
    "infra_filter": lambda s, d: fx.obstacles(s, d).filter(rules.infrastructure_only()).select("obstacle_id", "kategorie"),
    "live_filter": lambda s, d: fx.obstacles(s, d).withColumn("beschreibung", F.get(F.array(*map(F.lit, MESSAGES)), (F.col("obstacle_id") % len(MESSAGES)).cast("int"))).filter(ingest.live_message()).select("obstacle_id", "beschreibung"),
    "upsert_exact": lambda s, d: ingest.match(next_feed(s, d), fx.obstacles(s, d)).filter("exact_id IS NOT NULL").select("ord", "target_id"),
    "upsert_fuzzy": upsert_fuzzy,
    "reconcile_anti": lambda s, d: transition(next_feed(s, d), fx.obstacles(s, d)),
    "reconcile_guard": lambda s, d: transition(next_feed(s, d).filter("ord % 3 = 0"), fx.obstacles(s, d)).groupBy("action").agg(F.count("*").alias("n")),
    "run_status": lambda s, d: ingest.run_status(run_rows(s, d)).select("run_id", "status"),
    "expire": lambda s, d: ingest.expired(fx.obstacles(s, d), today()).select("obstacle_id", "gueltig_bis"),
    "purge": lambda s, d: ingest.purged(fx.obstacles(s, d), now()).select("obstacle_id"),
    "prune_runs": lambda s, d: ingest.pruned_runs(fx.runs(s, d), now()).select("run_id", "source_id"),
    "orphan_findings": lambda s, d: ingest.orphans(fx.findings(s, d), projects_with_routes(s, d)).select("ord", "project_id", "route_id"),
    "renumber_ids": lambda s, d: ingest.renumbered(fx.obstacles(s, d)),
    "future_dedupe": future_dedupe,
    "tenant_stats": lambda s, d: analytics.tenant_stats(fx.projects(s, d), fx.findings(s, d), 1, "u1@example.com"),
    "users_overview": lambda s, d: analytics.users_overview(sessions(360)(s, d)),
    "sessions_gap": sessions(360),
    "sessions_gap_5": sessions(5),
    "sessions_day_gapfill": lambda s, d: analytics.daily_series(sessions(360)(s, d), F.lit("2024-02-03").cast("date")),
    "online_window": lambda s, d: analytics.online(sessions(360)(s, d), stream_now(), 180),
    "events_per_day": lambda s, d: fx.events(s, d).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")),
    "latest_run": lambda s, d: analytics.latest_run(fx.runs(s, d)).select("source_id", "run_id", "status", "found"),
    "stale_sources": lambda s, d: analytics.stale_sources(fx.sources(s, d), fx.runs(s, d), fx.obstacles(s, d), F.expr("TIMESTAMP '1998-12-01 00:00:00'"), 60),
    "search_findings": lambda s, d: analytics.search(fx.findings(s, d), "STELLE  1", ["titel", "quelle"], kategorie=["tunnel", "ampel"], rank=3, route_id=None).select("ord", "titel"),
    "search_obstacles": lambda s, d: analytics.search(fx.obstacles(s, d).filter(analytics.visible("tenant_id", 1)), "bauwerk", ["name"], aktiv=True, kategorie=None).select("obstacle_id", "tenant_id"),
    "page_obstacles": page_obstacles,
    "notifications_visible": lambda s, d: analytics.notices_for(notice_rows(s, d), fx.projects(s, d), prefs(s), "u1@example.com").select("ord", "severity"),
    "hidden_counts": lambda s, d: analytics.hidden_counts(hidden(s, d)),
    "hidden_excluded": lambda s, d: analytics.without_hidden(with_key(fx.findings(s, d)), hidden(s, d), F.col("finding_key")).groupBy("kategorie").agg(F.count("*").alias("n")),
    "presence_counts": lambda s, d: analytics.presence(sessions(360)(s, d), stream_now()),
    "project_counts": lambda s, d: analytics.project_counts(fx.projects(s, d), fx.findings(s, d).filter("project_id % 10 <> 3")).withColumn("avg_km", F.round("avg_km", 6)),
    "severity_by_category": lambda s, d: analytics.severity_by_category(fx.findings(s, d)),
    "mail_events": lambda s, d: fx.events(s, d).filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_at")),
    "health_counts": lambda s, d: analytics.health(fx.sources(s, d), fx.runs(s, d)),
    "sync_eta": lambda s, d: analytics.eta(fx.sources(s, d), fx.runs(s, d).filter("source_id % 3 <> 1")),
    "stratified_pick": lambda s, d: analytics.every_nth(fx.findings(s, d), 5).select("ord", "route_id"),
    "anonymised": lambda s, d: analytics.anonymised(fx.projects(s, d), ["owner_email"], ["status"], "pepper").select("project_id", "owner_email", "status"),
    "strip_html": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2(text.strip_html(F.col("html")), 256).alias("text_sha256")),
    "decode_entities": entities,
    "norm_name": lambda s, d: fx.obstacles(s, d).select("obstacle_id", text.norm_name(F.col("name")).alias("name_key")),
    "road_refs": lambda s, d: notices(s, d).select("doc_id", F.array_join(text.road_refs(F.col("text")), ",").alias("refs")),
    "extract_weight": lambda s, d: notices(s, d).select("doc_id", text.tonnes(F.col("text")).alias("weight_t")),
    "extract_metres": lambda s, d: notices(s, d).select("doc_id", text.metres_after(F.col("text"), "restbreite").alias("width_m"), text.metres_after(F.col("text"), "länge").alias("length_m")),
    "extract_dates": lambda s, d: notices(s, d).select("doc_id", F.array_join(F.transform(text.dates(F.col("text")), lambda x: x.cast("string")), ",").alias("dates")),
    "extract_notice": lambda s, d: notices(s, d).select("doc_id", text.notice(F.col("text")).alias("n")).select("doc_id", "n.*"),
    "month_end": lambda s, d: notices(s, d).select("doc_id", text.month_end(F.regexp_extract("text", "Ende [A-Z][a-z]+\\.? [0-9]{4}", 0)).alias("day")),
    "title_humanise": lambda s, d: fx.findings(s, d).select("ord", text.human_title(F.concat(F.lit("sperrung - "), F.upper("kategorie"), F.lit(" - Sperrung - A1/A1"))).alias("title")),
    "fnv_hash": lambda s, d: fx.obstacles(s, d).select("obstacle_id", text.fnv_base36(F.col("name")).alias("hash")),
    "content_hash": lambda s, d: fx.findings(s, d).select("ord", F.sha2(F.concat_ws("|", "kategorie", "titel", F.col("route_id").cast("string")), 256).alias("hash")),
    "csv_row": csv_row,
    "folder_descendants": lambda s, d: graph.closure(folders(s, d)),
    "chain_walk": chain_walk,
    "corridor_search": corridor_search,
    "stream_sessions": streamed(lambda e: beats.sessions(e, "6 hours")),
    "stream_tumbling": streamed(beats.per_day),
    "stream_sliding": streamed(lambda e: beats.online(e, "2 hours", "1 hour")),
    "stream_upsert": stream_upsert,
}

REFS = "[upper(regexp_replace(x, '^([a-z]+) ?0*', '\\1')) FOR x IN regexp_extract_all(lower(text), '(?:^|[^a-zäöüß0-9_])((?:a|b|l|k|st) ?0*[0-9]{1,4})(?:[^a-z0-9_]|$)', 1)]"
ORACLES = {
    "validate_obstacles": f"{fx.with_(fx.OBSTACLES, FEED)} SELECT ord, {REASON} AS reason FROM feed WHERE {REASON} IS NOT NULL",
    "infra_filter": f"{O} SELECT obstacle_id, kategorie FROM obstacle WHERE {BARE}",
    "live_filter": f"{O}, message AS (SELECT obstacle_id, name, {list(MESSAGES)!r}[1 + obstacle_id % {len(MESSAGES)}] AS beschreibung FROM obstacle) SELECT obstacle_id, beschreibung FROM message WHERE {LIVE_SQL}",
    "upsert_exact": f"{fx.with_(fx.OBSTACLES, next_feed_sql())} SELECT f.ord, o.obstacle_id AS target_id FROM nextfeed f JOIN obstacle o USING (externe_id)",
    "upsert_fuzzy": f"{fx.with_(fx.OBSTACLES, next_feed_sql(), MATCHED)} SELECT ord, target_id FROM matched WHERE exact_id IS NULL",
    "reconcile_anti": transition_sql(10),
    "run_status": f"""{fx.with_(fx.RUNS)}, r AS (SELECT run_id, status = 'error' AS e, found % 3 <> 0 AS c, found % 5 = 0 AS g, found % 2 = 0 AS f, CASE WHEN found % 4 = 0 THEN 0 ELSE found END AS n FROM run) SELECT run_id, CASE WHEN e THEN 'error' WHEN f AND n = 0 AND c AND NOT g THEN 'warn' WHEN NOT c OR g THEN 'partial' ELSE 'ok' END AS status FROM r""",
    "expire": f"{O} SELECT obstacle_id, gueltig_bis FROM obstacle WHERE aktiv AND gueltig_bis < DATE '{fx.TODAY}' - 7",
    "purge": f"{O} SELECT obstacle_id FROM obstacle WHERE aktiv OR updated_at >= {fx.NOW} - INTERVAL 30 DAY",
    "prune_runs": f"{fx.with_(fx.RUNS)} SELECT run_id, source_id FROM run QUALIFY started_at >= {fx.NOW} - INTERVAL 90 DAY OR row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1",
    "orphan_findings": f"""{fx.with_(fx.FINDINGS, fx.PROJECTS)}, r AS (SELECT project_id, unnest(CASE WHEN project_id % 9 = 4 THEN []::BIGINT[] ELSE [(project_id + x) % 25 FOR x IN range(10)] END) AS route_id FROM project) SELECT ord, project_id, route_id FROM finding f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.project_id = f.project_id AND r.route_id = f.route_id)""",
    "renumber_ids": f"""{O}, e AS (SELECT *, row_number() OVER (PARTITION BY source_id, fach_id ORDER BY aktiv DESC, created_at, obstacle_id) AS n FROM obstacle WHERE fach_id IS NOT NULL), t AS (SELECT source_id, max(CAST(substr(fach_id, 1, length(fach_id) - 10) AS BIGINT)) AS top FROM obstacle WHERE fach_id IS NOT NULL GROUP BY 1)
        SELECT obstacle_id, fach_id, lpad(CAST(k AS VARCHAR), CAST(greatest(4, length(CAST(k AS VARCHAR))) AS INT), '0') || right(fach_id, 10) AS new_id FROM (SELECT e.*, top + row_number() OVER (PARTITION BY e.source_id ORDER BY fach_id, n) AS k FROM e JOIN t ON t.source_id = e.source_id WHERE n > 1)""",
    "future_dedupe": f"""{O}, r AS (SELECT *, 'A' || CAST(obstacle_id % 25 AS VARCHAR) AS road FROM obstacle) SELECT obstacle_id, road FROM r f WHERE kategorie = 'baustelle' AND NOT EXISTS (SELECT 1 FROM r c WHERE c.kategorie <> 'baustelle' AND c.aktiv AND c.road = f.road AND abs(c.lat - f.lat) < 0.01 AND abs(c.lng - f.lng) < 0.01
        AND 2 * 6371 * asin(sqrt(pow(sin(radians(c.lat - f.lat) / 2), 2) + pow(sin(radians(c.lng - f.lng) / 2), 2) * cos(radians(c.lat)) * cos(radians(f.lat)))) * 1000 <= 300 AND coalesce(f.gueltig_von <= c.gueltig_bis, true) AND coalesce(c.gueltig_von <= f.gueltig_bis, true))""",
    "tenant_stats": f"""{fx.with_(fx.FINDINGS, fx.PROJECTS)}, p AS (SELECT * FROM project WHERE tenant_id = 1 AND (owner_email IS NULL OR owner_email = 'u1@example.com')), f AS (SELECT * FROM finding WHERE project_id IN (SELECT project_id FROM p))
        SELECT (SELECT count(*) FROM p) AS projects, (SELECT count(*) FROM p WHERE status = 'fertig') AS finished, count(*) AS findings, count(*) FILTER (WHERE rank = 3) AS kritisch, count(*) FILTER (WHERE rank = 2) AS warnung, count(*) FILTER (WHERE rank = 1) AS hinweis FROM f""",
    "users_overview": f"{S360} SELECT user_id, count(*) AS sessions, CAST(sum(hits) AS BIGINT) AS hits, CAST(floor(sum((epoch_us(last_seen) - epoch_us(started_at)) / 1e6) / 60 + 0.5) AS BIGINT) AS active_min, min(started_at) AS first_seen, max(last_seen) AS last_seen FROM session GROUP BY 1",
    "sessions_gap": f"{S360} SELECT user_id, session_no, started_at, last_seen, hits FROM session",
    "sessions_gap_5": f"WITH {SESSIONS.format(m=5)} SELECT user_id, session_no, started_at, last_seen, hits FROM session",
    "sessions_day_gapfill": f"{S360} SELECT day, count(DISTINCT user_id) AS users, count(user_id) AS sessions FROM (SELECT DATE '2024-02-03' - CAST(range AS INT) AS day FROM range(14)) d LEFT JOIN session s ON CAST(s.last_seen AS DATE) = d.day GROUP BY 1",
    "online_window": f"{S360} SELECT user_id, max(last_seen) AS last_seen FROM session WHERE last_seen > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 180 MINUTE AND last_seen <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1",
    "events_per_day": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "latest_run": f"{fx.with_(fx.RUNS, LATEST)} SELECT source_id, run_id, status, found FROM lastrun",
    "stale_sources": f"""{fx.with_(fx.OBSTACLES, fx.SOURCES, fx.RUNS, LATEST)}, a AS (SELECT source_id, count(*) AS n FROM obstacle WHERE aktiv GROUP BY 1), x AS (SELECT s.source_id, l.status AS last_status, l.started_at, coalesce(a.n, 0) AS active_rows FROM source s LEFT JOIN lastrun l ON l.source_id = s.source_id LEFT JOIN a ON a.source_id = s.source_id WHERE s.aktiv AND s.kind IS DISTINCT FROM 'manuell')
        SELECT * FROM (SELECT source_id, last_status, CAST(floor((epoch_us(TIMESTAMP '1998-12-01') - epoch_us(started_at)) / 86400000000 + 0.5) AS BIGINT) AS age_days, active_rows, CASE WHEN started_at IS NULL THEN 'never ran' WHEN last_status IN ('warn', 'error') THEN 'last run ' || last_status WHEN active_rows = 0 THEN 'no active rows' WHEN started_at < TIMESTAMP '1998-12-01' - INTERVAL 60 DAY THEN 'old' END AS reason FROM x) WHERE reason IS NOT NULL""",
    "search_findings": f"{fx.with_(fx.FINDINGS)} SELECT ord, titel FROM finding WHERE (titel ILIKE '%stelle  1%' OR quelle ILIKE '%stelle  1%') AND kategorie IN ('tunnel', 'ampel') AND rank = 3",
    "search_obstacles": f"{O} SELECT obstacle_id, tenant_id FROM obstacle WHERE (tenant_id IS NULL OR tenant_id = 1) AND name ILIKE '%bauwerk%' AND aktiv",
    "page_obstacles": f"{O} SELECT obstacle_id, created_at, kategorie FROM obstacle WHERE aktiv ORDER BY created_at DESC, obstacle_id LIMIT 100 OFFSET 300",
    "notifications_visible": f"""{fx.with_(fx.FINDINGS, fx.PROJECTS)}, n AS (SELECT ord, CASE WHEN ord % 5 <> 0 THEN project_id END AS project_id, CASE rank WHEN 3 THEN 'kritisch' WHEN 2 THEN 'warnung' ELSE 'hinweis' END AS severity FROM finding)
        SELECT ord, severity FROM n WHERE severity IN ('kritisch', 'warnung') AND (project_id IS NULL OR project_id IN (SELECT project_id FROM project WHERE owner_email IS NULL OR owner_email = 'u1@example.com'))""",
    "hidden_counts": f"{fx.with_(fx.FINDINGS)} SELECT 'reason ' || CAST(ord % 3 AS VARCHAR) AS reason, count(*) AS n FROM finding WHERE ord % 31 = 4 GROUP BY 1",
    "presence_counts": f"""{S360} SELECT count(DISTINCT user_id) FILTER (WHERE last_seen > t - INTERVAL 1 DAY) AS day, count(DISTINCT user_id) FILTER (WHERE last_seen > t - INTERVAL 7 DAY) AS week, count(DISTINCT user_id) FILTER (WHERE last_seen > t - INTERVAL 30 DAY) AS month FROM session, (SELECT TIMESTAMP '2024-01-20 12:00:00' AS t) WHERE last_seen <= t""",
    "project_counts": f"{fx.with_(fx.FINDINGS, fx.PROJECTS)} SELECT p.project_id, count(f.ord) AS findings, count(*) FILTER (WHERE f.rank = 3) AS kritisch, round(avg(f.km), 6) AS avg_km FROM project p LEFT JOIN (SELECT * FROM finding WHERE project_id % 10 <> 3) f ON f.project_id = p.project_id GROUP BY 1",
    "severity_by_category": f"{fx.with_(fx.FINDINGS)} SELECT kategorie, count(*) FILTER (WHERE rank = 3) AS kritisch, count(*) FILTER (WHERE rank = 2) AS warnung, count(*) FILTER (WHERE rank = 1) AS hinweis FROM finding GROUP BY 1",
    "mail_events": "SELECT user_id, count(*) AS n, max(ts) AS last_at FROM events WHERE event_type = 'signup' GROUP BY 1",
    "health_counts": f"""{fx.with_(fx.SOURCES, fx.RUNS, LATEST)} SELECT count(*) AS active, count(*) FILTER (WHERE l.status = 'ok') AS ok, count(*) FILTER (WHERE l.status = 'partial') AS "partial", count(*) FILTER (WHERE l.status = 'warn') AS warn, count(*) FILTER (WHERE l.status = 'error') AS error, count(*) FILTER (WHERE l.status IS NULL) AS never FROM source s LEFT JOIN lastrun l ON l.source_id = s.source_id WHERE s.aktiv""",
    "sync_eta": f"""{fx.with_(fx.SOURCES, fx.RUNS)}, g AS (SELECT * FROM run WHERE status = 'ok' AND source_id % 3 <> 1 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1) SELECT sum(coalesce((epoch_us(g.finished_at) - epoch_us(g.started_at)) / 1e6, 8)) AS eta_s FROM source s LEFT JOIN g ON g.source_id = s.source_id WHERE s.aktiv""",
    "stratified_pick": f"{fx.with_(fx.FINDINGS)} SELECT ord, route_id FROM finding QUALIFY rank = 3 OR (row_number() OVER (PARTITION BY route_id, rank = 3 ORDER BY km, ord) - 1) % 5 = 0",
    "anonymised": f"{fx.with_(fx.PROJECTS)} SELECT project_id, CASE WHEN owner_email IS NOT NULL THEN substr(sha256('pepper|' || owner_email), 1, 16) END AS owner_email, CAST(NULL AS VARCHAR) AS status FROM project",
    "strip_html": "SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'))) AS text_sha256 FROM pages",
    "decode_entities": "SELECT doc_id, concat('a <b> ', chr(CAST(doc_id % 900 + 60 AS INT)), ' ä&uuml; ', chr(CAST(doc_id % 500 + 400 AS INT)), ' &unknown;') AS decoded FROM documents",
    "norm_name": f"{O} SELECT obstacle_id, {NAME} AS name_key FROM obstacle",
    "road_refs": f"{N} SELECT doc_id, (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest({REFS}) AS x, unnest(range(len({REFS}))) AS i) GROUP BY x)) AS refs FROM notice",
    "extract_weight": f"""{N} SELECT doc_id, coalesce({lifted('(?i)(?:gesamtgewicht|zulässig)[^.0-9]{0,25}([0-9]+(?:[.][0-9]+)?) *t')}, CASE WHEN text NOT ILIKE '%überhol%' THEN {lifted('(?i)verbot[^.0-9]{0,30}[üu]ber *([0-9]+(?:[.][0-9]+)?) *t')} END) AS weight_t FROM notice""",
    "extract_metres": f"{N} SELECT doc_id, {lifted('(?i)restbreite[^0-9]{0,14}?([0-9]{1,3}(?:[.][0-9]{1,2})?) *m')} AS width_m, {lifted('(?i)länge[^0-9]{0,14}?([0-9]{1,3}(?:[.][0-9]{1,2})?) *m')} AS length_m FROM notice",
    "extract_dates": f"{N} SELECT doc_id, CASE doc_id % {len(NOTICES)} WHEN 0 THEN '2026-04-03,2026-05-17' WHEN 1 THEN '2026-09-30' WHEN 3 THEN '2026-10-01' ELSE '' END AS dates FROM notice",
    "month_end": f"{N} SELECT doc_id, CASE WHEN doc_id % {len(NOTICES)} = 5 THEN last_day(DATE '2029-12-01') END AS day FROM notice",
    "title_humanise": f"{fx.with_(fx.FINDINGS)} SELECT ord, concat('Sperrung - ', CASE WHEN kategorie = 'sperrung' THEN '' ELSE upper(substr(kategorie, 1, 1)) || substr(kategorie, 2) || ' - ' END, 'A1') AS title FROM finding",
    "content_hash": f"{fx.with_(fx.FINDINGS)} SELECT ord, sha256(concat_ws('|', kategorie, titel, CAST(route_id AS VARCHAR))) AS hash FROM finding",
    "csv_row": fx.with_(fx.FINDINGS) + """SELECT ord, concat_ws(';', CAST(route_id AS VARCHAR), CASE WHEN ord % 3 = 0 THEN chr(34) || titel || ';' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) ELSE titel END,
        replace(printf('%.2f', km), '.', ',')) AS line FROM finding""",
    "folder_descendants": """WITH RECURSIVE up AS (SELECT s_suppkey AS node, s_suppkey AS ancestor, 0 AS depth FROM supplier UNION ALL SELECT node, (ancestor - 1) // 2, depth + 1 FROM up WHERE ancestor > 0) SELECT node, ancestor, depth FROM up""",
    "fnv_hash": f"{O} SELECT obstacle_id, {fnv('name')} AS hash FROM obstacle",
    "reconcile_guard": f"SELECT action, count(*) AS n FROM ({transition_sql(10, 'ord % 3 = 0')}) GROUP BY 1",
    "hidden_excluded": f"{fx.with_(fx.FINDINGS)}, k AS (SELECT *, {FINDING_KEY} AS key FROM finding) SELECT kategorie, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM k WHERE ord % 31 = 4) GROUP BY 1",
    "extract_notice": NOTICE_SQL,
    "chain_walk": CHAIN,
    "stream_sessions": STREAM_SESSIONS,
    "stream_sliding": STREAM_SLIDING,
    "corridor_search": SEARCH,
    "stream_tumbling": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_upsert": "SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1",
}
