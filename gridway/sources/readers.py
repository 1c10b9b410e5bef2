"""Landed files to rows: GeoJSON, GPX, KML, DATEX II, GML, zip archives, and paged services.

Feeds are landed as files first; each reader is one pattern of access, and a connector is a reader with a mapping to the
obstacle columns.
"""

from __future__ import annotations

import io
import json
import time
import urllib.request
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridway.functions import geo, text

POINT = "struct<lng:double,lat:double>"
#: A row holds less than 2 GB; archive members that would not fit fail the read.
LARGEST_MEMBER = (1 << 31) - (1 << 20)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties as JSON text, kind, parts) of each feature; parts are lines, a point is a part of one."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    raw, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    parts = (
        F.when(kind == "Point", F.array(F.array(F.from_json(raw, "array<double>"))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(F.from_json(raw, "array<array<double>>")))
        .when(kind.isin("MultiLineString", "Polygon"), F.from_json(raw, "array<array<array<double>>>"))
    )
    points = F.transform(parts, lambda p: F.transform(p, lambda x: F.struct(x[0].alias("lng"), x[1].alias("lat"))))
    return rows.select(F.col("f.properties").alias("properties"), kind.alias("kind"), points.alias("parts"))


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """Point features as rows (properties, lat, lng, reason); reason says why a feature is no obstacle."""
    rows = geojson(spark, path)
    first = F.try_element_at(F.try_element_at("parts", F.lit(1)), F.lit(1))
    out = rows.select("properties", "kind", first["lat"].alias("lat"), first["lng"].alias("lng"))
    reason = F.when(F.col("kind").isNull() | (F.col("kind") != "Point"), "no point").when(F.col("lat").isNull() | F.col("lng").isNull(), "no position")
    return out.withColumn("reason", reason).drop("kind")


def gpx(spark: SparkSession, path: str) -> DataFrame:
    """(i, lat, lng) of a track's points in order, per file."""
    schema = "trkseg array<struct<trkpt:array<struct<_lat:double,_lon:double>>>>"
    rows = spark.read.format("xml").option("rowTag", "trk").schema(schema).load(path).select(F.col("_metadata.file_path").alias("file"), F.flatten(F.col("trkseg.trkpt")).alias("points"))
    return rows.select("file", F.posexplode("points").alias("i", "p")).select("file", "i", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lng"))


def kml(spark: SparkSession, path: str) -> DataFrame:
    """(i, lat, lng) of a line's coordinates in order, per file."""
    rows = spark.read.format("xml").option("rowTag", "LineString").schema("coordinates string").load(path).select(F.col("_metadata.file_path").alias("file"), F.split(F.trim("coordinates"), r"\s+").alias("c"))
    at = rows.select("file", F.posexplode("c").alias("i", "x")).withColumn("v", F.split("x", ","))
    return at.select("file", "i", F.element_at("v", 2).cast("double").alias("lat"), F.element_at("v", 1).cast("double").alias("lng"))


# Words of record types and contents that tell a category, in the order in which they do; management types that
# close a road and parts of those that close a part of it; names of directions.
WORKS_TYPES, WORKS_WORDS = ("maintenanceworks", "roadworks", "constructionworks"), ("constructionworktype", "roadworks", "maintenanceworks")
CLOSURE_TYPES, CLOSURE_WORDS = ("roadorcarriageway", "closure"), ("carriagewayclosed", "roadclosed")
HEIGHT_WORDS, WIDTH_WORDS, WEIGHT_WORDS = ("heightlimit", "maximumheight", "durchfahrtshöhe"), ("widthlimit", "maximumwidth"), ("weightlimit", "maximumweight", "gewichtsbesch")
CLOSED, PARTLY = ("roadclosed", "carriagewayclosed"), ("lane", "partial", "alternate", "contraflow", "shoulder")
AHEAD, BACK = ("positive", "aligned", "alongdrivingdirection", "withdrivingdirection"), ("negative", "opposite", "againstdrivingdirection")
NO_DIRECTION = ("both", "alldirections", "unknown", "allcarriageways")


def element(xml: Column, *names: str) -> Column:
    """The content of the first element of one of the names, whatever its prefix and depth; null if there is none."""
    found = (F.trim(F.regexp_extract(xml, rf"(?is)<(?:[\w.-]+:)?{n}(?:\s[^>]*)?>(.*?)</(?:[\w.-]+:)?{n}>", 1)) for n in names)
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found))


def plain(xml: Column) -> Column:
    """The text of an element without what is nested around it; null if there is none."""
    return F.nullif(text.decode_entities(text.strip_html(xml)), F.lit(""))


def decimal(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


def datex2(spark: SparkSession, path: str) -> DataFrame:
    """Situation records as obstacle rows. Records without an id, suspended ones and cancelled ones ("entfällt") are left out.

    Files are cut where situations end, so that large ones are read by many tasks. Positions come from a display location, else
    from the first point of a line; both in their right order, null off the map. parts is the line. Records that have neither
    carry the codes of a location table.
    """
    cut = spark.read.option("lineSep", "situation>").text(path)
    pieces = F.split("value", r"(?i)<(?:[\w.-]+:)?situationRecord(?=[\s>])")
    said = lambda x: F.coalesce(plain(element(x, "generalPublicComment")), plain(element(x, "comment")))
    rows = cut.select(said(F.col("value")).alias("situation_comment"), F.explode(F.slice(pieces, 2, F.size(pieces))).alias("record"))
    opening, body = F.substring_index("record", ">", 1), F.regexp_replace("record", r"^[^>]*>|(?is)</(?:[\w.-]+:)?situationRecord>.*$", "")
    attribute = lambda name: F.nullif(F.regexp_extract("opening", rf'(?i)(?:^|\s){name}\s*=\s*"([^"]*)"', 1), F.lit(""))
    rows = rows.select("situation_comment", opening.alias("opening"), body.alias("body"))
    rows = rows.select("body", "situation_comment", attribute("(?:[\\w.-]+:)?type").alias("type"), F.coalesce(attribute("id"), attribute("version")).alias("externe_id"))
    x = F.col("body")
    cancelled = lambda c: F.coalesce(text.folded(F.col(c)).rlike(r"^[\s-]*entfallt[\s-]*$"), F.lit(False))
    rows = rows.withColumn("beschreibung", F.coalesce(said(x), "situation_comment")).filter(F.col("externe_id").isNotNull() & (F.lower(F.coalesce(element(x, "validityStatus"), F.lit(""))) != "suspended") & ~cancelled("beschreibung") & ~cancelled("situation_comment"))

    kind, low = F.lower(F.coalesce("type", F.lit(""))), F.lower(x)
    has = lambda c, words: text.any_of(words, lambda w: F.contains(c, w))
    kategorie = (
        F.when(has(kind, WORKS_TYPES) | has(low, WORKS_WORDS), "baustelle")
        .when(has(kind, CLOSURE_TYPES) | has(low, CLOSURE_WORDS), "sperrung")
        .when(F.contains(kind, F.lit("networkmanagement")) & has(low, ("weight", "gewicht")), "gewicht")
        .when(has(low, HEIGHT_WORDS), "bruecke").when(has(low, WIDTH_WORDS), "engstelle").when(has(low, WEIGHT_WORDS), "gewicht")
        .when(F.contains(low, F.lit("baustelle")), "baustelle").otherwise("sperrung")
    )
    number = lambda *names: decimal(element(x, *names))
    day = lambda *names: F.try_to_date(F.nullif(F.regexp_extract(element(x, *names), r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")))
    closures = F.transform(F.regexp_extract_all(x, F.lit(r"(?i)roadOrCarriagewayOrLaneManagementType[^>]*>([^<]+)<"), F.lit(1)), lambda t: F.trim(t))
    full = F.exists(closures, lambda t: F.lower(t).isin(*CLOSED))
    way = F.coalesce(element(x, "directionRelativeOnLinearSection"), element(x, "alertCDirectionCoded"))
    heading = F.when(F.lower(way).isin(*AHEAD), "in Fahrtrichtung").when(F.lower(way).isin(*BACK), "Gegenrichtung").when(~F.lower(way).isin(*NO_DIRECTION), way)

    shown = geo.swapped_right(number("latitude"), number("longitude"))
    values = F.transform(F.filter(F.split(element(x, "posList"), r"\s+"), lambda v: v.try_cast("double").isNotNull()), lambda v: v.cast("double"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(values) / 2).cast("int"))), lambda k: F.struct(F.try_element_at(values, 2 * k - 1).alias("lat"), F.try_element_at(values, 2 * k).alias("lng")))
    line = F.filter(pairs, lambda p: p["lat"].between(-90, 90) & p["lng"].between(-180, 180))
    first = F.get(line, F.lit(0))
    straight, crossed = geo.within(first["lat"], first["lng"], geo.NATIONWIDE), geo.within(first["lng"], first["lat"], geo.NATIONWIDE)
    line = F.when(straight, line).when(crossed, F.transform(line, lambda p: F.struct(p["lng"].alias("lat"), p["lat"].alias("lng"))))
    rows = rows.withColumns({"shown_lat": shown[0], "shown_lng": shown[1], "line": line})
    by_line = F.col("shown_lat").isNull() & (F.size("line") > 0)
    start = F.get("line", F.lit(0))

    road = F.nullif(F.regexp_replace(F.coalesce(plain(element(x, "roadNumber")), plain(element(x, "roadName"))), r"^[\[(]\s*|\s*[)\]]$", ""), F.lit(""))
    in_text = F.nullif(F.regexp_replace(F.regexp_extract("beschreibung", r"(?<![A-Za-z0-9_])((?:A|B|St|L|K|S) ?[0-9]{1,4}[a-z]?)(?![A-Za-z0-9_])", 1), " ", ""), F.lit(""))
    rows = rows.withColumns({"kategorie": kategorie, "road": F.coalesce(road, in_text)})
    name = text.without_repeated_block(F.coalesce("beschreibung", element(x, "situationRecordCreationReference"), F.concat(F.col("road"), F.lit(" — "), F.col("kategorie")), F.concat(F.col("kategorie"), F.lit(" (DATEX)"))))
    rows = rows.withColumn("window", text.time_window(F.concat_ws(" ", name, "beschreibung"), element(x, "startTimeOfPeriod"), element(x, "endTimeOfPeriod")))
    code = lambda end: decimal(element(F.coalesce(element(x, f"alertCMethod4{end}PointLocation"), x if end == "Primary" else F.lit(None)), "specificLocation")).cast("long")
    return rows.select(
        "externe_id", "kategorie", F.substring(name, 1, 200).alias("name"), text.without_repeated_block(F.col("beschreibung")).alias("beschreibung"), "road",
        F.coalesce("shown_lat", start["lat"]).alias("lat"), F.coalesce("shown_lng", start["lng"]).alias("lng"), F.when(by_line & (F.size("line") > 1), F.col("line")).alias("line"),
        day("overallStartTime", "validityStartTime").alias("gueltig_von"), day("overallEndTime", "validityEndTime").alias("gueltig_bis"), day("overallStartTime", "validityStartTime").alias("realer_start"),
        number("maximumHeight", "heightLimit", "vehicleHeight").alias("max_hoehe_m"), number("maximumWidth", "widthLimit", "vehicleWidth").alias("max_breite_m"),
        number("maximumWeight", "weightLimit", "totalWeight", "grossVehicleWeight").alias("max_gewicht_t"), number("maximumWeightPerAxle", "axleWeightLimit").alias("max_achslast_t"),
        F.get(closures, F.lit(0)).alias("sperrung_art"), full.alias("vollsperrung"), (~full & F.exists(closures, lambda t: has(F.lower(t), PARTLY))).alias("teilsperrung"),
        number("numberOfLanesRestricted").alias("spuren_gesperrt"), number("totalNumberOfLanes", "numberOfLanes").alias("spuren_gesamt"), heading.alias("richtung"),
        F.col("window.window").alias("zeitfenster"), F.col("window.at_night").alias("nur_nachts"), code("Primary").alias("tmc_primary"), code("Secondary").alias("tmc_secondary"),
    )


def gml(spark: SparkSession, path: str, row_tag: str, fields: dict[str, str], position: str = "pos") -> DataFrame:
    """Members of a GML collection: the wanted fields as text, and their UTM or geographic position as x and y."""
    schema = ", ".join(f"`{tag}` string" for tag in [*fields, position])
    rows = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)
    xy = F.split(F.trim(F.col(position)), r"\s+")
    return rows.select(*(F.col(tag).alias(name) for tag, name in fields.items()), F.try_element_at(xy, F.lit(1)).cast("double").alias("x"), F.try_element_at(xy, F.lit(2)).cast("double").alias("y"))


def zip_members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, member, content) of archive members whose name matches."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if re.search(pattern, info.filename):
                            if info.file_size > LARGEST_MEMBER:
                                raise ValueError(f"{info.filename} in {file} has {info.file_size} bytes")
                            yield pa.RecordBatch.from_pydict({"file": [file], "member": [info.filename], "content": [z.read(info)]})

    return rows.mapInArrow(members, "file string, member string, content binary")


def hrefs(pages: Column, suffix: str) -> Column:
    """Links of a page that end in the suffix."""
    return F.array_distinct(F.regexp_extract_all(pages, F.lit(rf'(?i)href="([^"]+{suffix})"'), F.lit(1)))


class Page(InputPartition):
    """One page; or, where the number of features is unknown, all pages from the first on."""

    def __init__(self, start: int, last: bool = False):
        self.start, self.walk = start, last


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.size, self.most = int(options.get("pagesize", 2000)), int(options.get("maxpages", 500))
        self.url, self.tries, self.timeout = options["url"], int(options.get("tries", 3)), float(options.get("timeout", 30))
        self.total = int(options["total"]) if "total" in options else None

    def page(self, start: int) -> dict:
        url, last = self.url.format(start=start, count=self.size), None
        for k in range(self.tries):
            time.sleep(k)
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    return json.load(answer)
            except (OSError, ValueError) as e:  # a service may answer with a page about maintenance
                last = e
        raise RuntimeError(f"page at {start} failed") from last  # a missing page fails the read

    def partitions(self) -> list[Page]:
        total = self.total if self.total is not None else self.page(0).get("numberMatched")
        if not isinstance(total, int):
            return [Page(0, True)]
        if total > self.size * self.most:
            raise ValueError(f"{total} features are more than {self.most} pages of {self.size}")
        return [Page(k) for k in range(0, total, self.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        at = partition.start
        while True:
            features = self.page(at).get("features", [])
            for feature in features:
                yield (json.dumps(feature.get("properties", {})), json.dumps(feature.get("geometry")))
            if not partition.walk or len(features) < self.size:
                return
            at += self.size
            if at >= self.size * self.most:
                raise ValueError(f"more than {self.most} pages of {self.size}; what a cut feed lacks would be taken for gone")


class PagedFeatures(DataSource):
    """spark.read.format("paged_features"): features of a paged service, one partition per page.

    Options: url with {start} and {count}, pagesize, maxpages, total, tries, timeout. Without total the service's
    numberMatched says how many there are; without that, one task reads until a page is short. More than maxpages pages are an
    error, as what is missing would be taken for gone.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "properties string, geometry string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)
