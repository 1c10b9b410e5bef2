"""Text rules over the whole texts of documents, each with a notice in its middle that is made of the document's own numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridway.functions import text

#: Sentences; {n} is a number of the document.
SENTENCES = (
    "Vollsperrung (Querweg {n}), halbseitige Führung auf der B {n}",
    "VSP. nach Wasserrohrbruch in Haus {n}, keine Umleitung",
    "Fahrbahn auf {n} m verengt, auf {n} Fahrstreifen reduziert",
    "Achslast höchstens {n},5 t, Umleitung über die L{n}",
    "Kanalsanierung am Rhein-Herne-Kanal, Haus {n}",
    "einseitiger Kragträger an der K {n}",
    "Fahrbahn einseitig gesperrt, {n} m Glasfaser",
    "auf zwei Fahrstreifen verengt, Umleitungsstrecke {n}",
    "Vollsperrung der A {n} (Nord), Umleitung ausgeschildert",
)
NUMBER = "coalesce(doc_id, 0) % 89 + 1"


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): whole texts, the notice after their first half."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    said = F.get(F.array(*map(F.lit, SENTENCES)), F.expr(f"CAST(coalesce(doc_id, 0) % {len(SENTENCES)} AS INT)"))
    half = F.expr("length(text) div 2")
    return rows.select("doc_id", F.concat(F.substr("text", F.lit(1), half), F.lit("\n"), F.replace(said, F.lit("{n}"), F.expr(f"CAST({NUMBER} AS STRING)")), F.lit(".\n"), F.substr("text", half + 1)).alias("text"))


def document_notices(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).withColumn("said", text.notice_details(F.col("text")))
    return rows.select("doc_id", F.length("text").cast("bigint").alias("chars"), "said.*", F.array_join(text.road_refs(F.col("text")), ",").alias("roads"))


def matches(pattern: str) -> str:
    return f"regexp_matches(text, '(?i){pattern}')"


def found(pattern: str) -> str:
    return f"nullif(regexp_extract(text, '(?i){pattern}', 1), '')"


LISTED = ", ".join("'" + s + "'" for s in SENTENCES)
ROADS = r"[regexp_replace(upper(regexp_replace(v, '^([a-z]+) ?0*', '\1')), '^S([0-9])', 'ST\1') for v in regexp_extract_all(lower(text), '(?:^|[^a-zäöüß0-9_])((?:a|b|l|k|st|s) ?0*[0-9]{1,4})\b', 1)]"
#: The rules once more, in the oracle's expressions, which know no looking back: what is denied is taken out first.
SQL = rf"""WITH n AS (SELECT doc_id, coalesce(text, '') AS t, replace([{LISTED}][CAST(coalesce(doc_id, 0) % {len(SENTENCES)} AS INT) + 1], '{{n}}', CAST({NUMBER} AS VARCHAR)) AS s FROM documents),
    d AS (SELECT doc_id, concat(substr(t, 1, length(t) // 2), chr(10), s, '.' || chr(10), substr(t, length(t) // 2 + 1)) AS text FROM n),
    h AS (SELECT *, {matches(r'halbseitig|einseitig\w*\s+(gesperrt|sperrung|fahrbahn|fahrstreifen|verkehr)|ein(en|es)?\s+fahrstreifen|(fahrbahn|fahrstreifen)\b[^.;]{0,15}\beinseitig')} AS half,
        {matches(r'vollsperrung|(voll|komplett) gesperrt|gesamtsperrung|\bvsp\b')} AS full_, regexp_matches(regexp_replace(text, '(?i)vollsperrung\s*\([^)]*\)', '', 'g'), '(?i)vollsperrung') AS plain,
        {matches(r'vollsperrung\s*\(')} AS bracketed FROM d),
    c AS (SELECT *, full_ AND NOT (half AND bracketed AND NOT plain) AS closed FROM h)
    SELECT doc_id, length(text) AS chars, closed, half AND NOT closed AS half_closed, {matches(r'fahrbahn\w*[^,.;]{0,40}(verengt|eingeengt)')} AS narrowed,
        CASE WHEN {matches(r'auf\s+zwei\s+fahrstreifen\s+verengt')} THEN 2 ELSE CAST({found(r'auf\s+([0-9]{1,2})\s+fahrstreifen\s+reduziert')} AS INT) END AS lanes,
        regexp_matches(regexp_replace(text, '(?i)(keine|ohne)\s+umleitung', '', 'g'), '(?i)\b(bedarfs)?umleitung(sstrecke)?\b') AS detour, {matches(r'\b(havarie|notma(ß|ss)nahme|wasserrohrbruch)\b')} AS urgent,
        {found(r'\b(glasfaser|kanalsanierung)\b')} AS supply, CAST(replace({found(r'achslast[^0-9]{0,25}([0-9]+(,[0-9]+)?) *t\b')}, ',', '.') AS DOUBLE) AS axle_t,
        coalesce((SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest({ROADS}) AS x, unnest(range(len({ROADS}))) AS i) GROUP BY x)), '') AS roads FROM c"""

QUERIES = {"document_notices": document_notices}
ORACLES = {"document_notices": SQL}
