import json
import zipfile

import pytest
from gridway.sources import readers, sinks
from pyspark.sql import functions as F


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Point", "coordinates": [8.1, 50.2]}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "LineString", "coordinates": [[8, 50], [9, 51]]}},
        {"type": "Feature", "properties": {"name": "c"}, "geometry": {"type": "MultiLineString", "coordinates": [[[8, 50], [9, 51]], [[1, 2], [3, 4]]]}}]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    rows = {r.properties["name"]: r for r in readers.geojson(spark, str(tmp_path / "f.json")).collect()}
    assert [len(p) for p in rows["c"].parts] == [2, 2] and rows["a"].parts[0][0].lat == 50.2
    assert [r.reason for r in readers.geojson_points(spark, str(tmp_path / "f.json")).collect()] == [None, "no point", "no point"]


def test_gpx_and_kml(spark, tmp_path):
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="50.1" lon="8.1"/><trkpt lat="50.2" lon="8.2"/></trkseg></trk></gpx>')
    (tmp_path / "l.kml").write_text("<kml><Document><Placemark><LineString><coordinates>8.1,50.1,0 8.2,50.2,0</coordinates></LineString></Placemark></Document></kml>")
    for found in (readers.gpx(spark, str(tmp_path / "t.gpx")), readers.kml(spark, str(tmp_path / "l.kml"))):
        assert [(r.i, r.lat, r.lng) for r in found.orderBy("i").collect()] == [(0, 50.1, 8.1), (1, 50.2, 8.2)]


def test_datex2(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        '<payload xmlns:xsi="x"><situation id="S1"><situationRecord id="R1" xsi:type="MaintenanceWorks"><validity><validityTimeSpecification><overallStartTime>2026-04-01T05:00:00Z</overallStartTime>'
        "<overallEndTime>2026-05-01T05:00:00Z</overallEndTime></validityTimeSpecification></validity><generalPublicComment><comment><values><value>Bauarbeiten</value></values></comment></generalPublicComment>"
        "<groupOfLocations><locationForDisplay><latitude>8.6</latitude><longitude>50.1</longitude></locationForDisplay><roadNumber>A7</roadNumber></groupOfLocations></situationRecord></situation></payload>"
    )
    (r,) = readers.datex2(spark, str(tmp_path / "d.xml")).collect()
    assert (r.externe_id, r.kategorie, r.beschreibung, r.road, r.lat, r.lng, str(r.gueltig_bis)) == ("R1", "baustelle", "Bauarbeiten", "A7", 50.1, 8.6, "2026-05-01")


def record(name, kind, inner):
    return f'<d2:situationRecord id="{name}" version="3" xsi:type="{kind}">{inner}</d2:situationRecord>'


def test_datex2_records(spark, tmp_path):
    def at(lat, lng):
        return f"<d2:latitude>{lat}</d2:latitude><d2:longitude>{lng}</d2:longitude>"

    management = "<d2:roadOrCarriagewayOrLaneManagementType>{}</d2:roadOrCarriagewayOrLaneManagementType>"
    records = [
        record("suspended", "RoadOrCarriagewayOrLaneManagement", "<d2:validity><d2:validityStatus>suspended</d2:validityStatus></d2:validity>" + at(50, 8)),
        record("cancelled", "RoadOrCarriagewayOrLaneManagement", "<d2:comment> - entfällt - </d2:comment>" + at(50, 8)),
        record("closed", "RoadOrCarriagewayOrLaneManagement", management.format("roadClosed") + "<d2:numberOfLanesRestricted>2</d2:numberOfLanesRestricted><d2:alertCDirectionCoded>negative</d2:alertCDirectionCoded><d2:comment>X - Y - X - Y - Ende, 20h bis 5h</d2:comment><d2:roadNumber>[B169]</d2:roadNumber>" + at(46.5, 4.5)),
        record("lane", "RoadOrCarriagewayOrLaneManagement", management.format("laneClosures") + at(60, 8)),
        record("works", "RoadOrCarriagewayOrLaneManagement", "<d2:constructionWorkType>other</d2:constructionWorkType><g:posList>8.5 50.5 8.6 50.6</g:posList>"),
        record("weight", "GeneralNetworkManagement", "<d2:grossVehicleWeight>3,5</d2:grossVehicleWeight><d2:axleWeightLimit>2</d2:axleWeightLimit><d2:alertCMethod4SecondaryPointLocation><d2:specificLocation>7</d2:specificLocation></d2:alertCMethod4SecondaryPointLocation><d2:alertCMethod4PrimaryPointLocation><d2:specificLocation>5</d2:specificLocation></d2:alertCMethod4PrimaryPointLocation>"),
    ]
    (tmp_path / "d.xml").write_text(f'<d2:payload><d2:situation id="S"><d2:comment>Arbeiten an der A 7</d2:comment>{"".join(records[:4])}</d2:situation>\n<d2:situation id="T">{"".join(records[4:])}<d2:comment>danach</d2:comment></d2:situation></d2:payload>')
    found = {r.externe_id: r for r in readers.datex2(spark, str(tmp_path / "d.xml")).collect()}
    assert set(found) == {"closed", "lane", "works", "weight"}
    r = found["closed"]
    assert (r.kategorie, r.name, r.road, r.vollsperrung, r.teilsperrung, r.spuren_gesperrt, r.richtung, r.zeitfenster, r.nur_nachts) == ("sperrung", "X - Y - Ende, 20h bis 5h", "B169", True, False, 2.0, "Gegenrichtung", "20:00–05:00", True)
    assert (r.lat, r.lng) == (46.5, 4.5)  # near the border, and within the feeds' bounds
    r = found["lane"]
    assert (r.kategorie, r.beschreibung, r.road, r.teilsperrung, r.vollsperrung, r.lat) == ("sperrung", "Arbeiten an der A 7", "A7", True, False, None)
    r = found["works"]
    assert (r.kategorie, r.lat, r.lng, [(p.lat, p.lng) for p in r.line], r.beschreibung) == ("baustelle", 50.5, 8.5, [(50.5, 8.5), (50.6, 8.6)], "danach")
    r = found["weight"]
    assert (r.kategorie, r.max_gewicht_t, r.max_achslast_t, r.tmc_primary, r.tmc_secondary, r.name) == ("gewicht", 3.5, 2.0, 5, 7, "danach")


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "1")
        z.writestr("b.txt", "2")
    (r,) = readers.zip_members(spark, str(tmp_path / "z.zip"), r"\.csv$").collect()
    assert (r.member, bytes(r.content)) == ("a.csv", b"1")


def test_paged_features(spark, tmp_path):
    for start in (0, 2, 4):
        (tmp_path / f"p{start}.json").write_text(json.dumps({"features": [{"properties": {"n": start + k}, "geometry": None} for k in range(2 if start < 4 else 1)]}))
    spark.dataSource.register(readers.PagedFeatures)
    df = spark.read.format("paged_features").options(url=f"file://{tmp_path}/p{{start}}.json", pagesize="2", total="5").load()
    assert sorted(json.loads(r.properties)["n"] for r in df.collect()) == [0, 1, 2, 3, 4]


def test_paged_features_of_unknown_number(spark, tmp_path):
    def pages(sizes, **more):
        at = 0
        for n in sizes:
            (tmp_path / f"q{at}.json").write_text(json.dumps({"features": [{"properties": {"n": at + k}, "geometry": None} for k in range(n)], **more}))
            at += 2

    spark.dataSource.register(readers.PagedFeatures)
    read = lambda **o: spark.read.format("paged_features").options(url=f"file://{tmp_path}/q{{start}}.json", pagesize="2", tries="1", **o).load()
    pages([2] * 45 + [1])  # more pages than a small backstop has; the last one is short
    assert read().count() == 91
    with pytest.raises(Exception, match="taken for gone"):
        read(maxpages="40").count()
    pages([2, 2, 2], numberMatched=6)
    assert read().count() == 6 and read().rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="more than 2 pages"):
        read(maxpages="2").count()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.25)], "project_id int, t string, km double")
    sinks.replace_project(df, str(tmp_path / "f"))
    sinks.replace_project(df.filter("project_id = 2").withColumn("t", F.lit("c")), str(tmp_path / "f"))
    assert sorted((r.project_id, r.t) for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [(1, "a"), (2, "c")]
    sinks.write_csv(df, str(tmp_path / "c"))
    assert "1;a;1,50" in {r.value for r in spark.read.text(str(tmp_path / "c")).collect()}
    line = spark.range(1).select(sinks.kml_document(F.lit("A & B"), F.array(F.struct(F.lit(50.0).alias("lat"), F.lit(8.0).alias("lng")))).alias("k")).first().k
    assert "8.000000,50.000000" in line and "A &amp; B" in line
