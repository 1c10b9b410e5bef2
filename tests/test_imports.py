"""Import runs one after the other, in batch and as a stream."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from gridway.operators import imports, ingest
from gridway.streaming import feeds

FIELDS = "kategorie string, name string, beschreibung string, lat double, lng double, restbreite_m double, max_hoehe_m double, max_breite_m double, max_gewicht_t double, max_laenge_m double, verkehrsverbot_t double, vollsperrung boolean, gesperrt_komplett boolean, gst_sperre boolean, gst_route boolean, gueltig_von date, gueltig_bis date"
SNAPSHOT = f"source_id bigint, externe_id string, obstacle_id bigint, aktiv boolean, fach_id string, created_at timestamp, updated_at timestamp, realer_start date, {FIELDS}"
ITEM = f"source_id bigint, externe_id string, ord bigint, realer_start date, {FIELDS}"
MESSAGE = f"{ITEM}, run bigint, full boolean, complete boolean"
TODAY, NOW = datetime.date(2026, 6, 12), datetime.datetime(2026, 6, 12, 4, 0)
ID = "120626"


def today():
    return F.lit(TODAY)


def now():
    return F.lit(NOW)


def item(ext, source=9, **more):
    return {"source_id": source, "externe_id": ext, "kategorie": "baustelle", "name": "Baustelle A2", "lat": 52.3, "lng": 9.7} | more


def feed(*items, source=9, full=True, complete=None):
    return source, list(items), full, complete


def names(schema):
    return [c.split()[0] for c in schema.split(", ")]


def rows_of(items):
    return [tuple({"ord": k, **i}.get(c) for c in names(ITEM)) for k, i in enumerate(items)]


def in_batch(spark, tmp_path, runs):
    before = spark.createDataFrame([], SNAPSHOT)
    for run in runs:
        items = spark.createDataFrame([r for _, i, *_ in run for r in rows_of(i)], ITEM)
        heads = spark.createDataFrame([(s, f, c) for s, _, f, c in run], "source_id bigint, full boolean, complete boolean")
        done = imports.run(items, heads, before, today(), now())
        touched = spark.createDataFrame([(s,) for s, *_ in run], "source_id bigint")
        after = spark.createDataFrame(done.rows.drop("action").collect() + before.join(touched, "source_id", "left_anti").select(*names(SNAPSHOT)).collect(), SNAPSHOT)
        yield {(r.source_id, r.externe_id): r for r in after.collect()}, {r.source_id: r for r in done.stats.collect()}
        before = after


def in_stream(spark, tmp_path, runs):
    """Each run is a file of messages, and each file a micro-batch; folders are read after each."""
    schema = spark.createDataFrame([], SNAPSHOT).schema
    incoming, folder = tmp_path / "in", str(tmp_path / "out")
    for n, run in enumerate(runs):
        messages = []
        for source, items, full, complete in run:
            rows = rows_of(items) or [tuple({"source_id": source}.get(c) for c in names(ITEM))]
            messages += [r + (n, full, complete) for r in rows]
        if n:
            assert os.path.isdir(folder)
        spark.createDataFrame(messages, MESSAGE).coalesce(1).write.mode("append").parquet(str(incoming))
        stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(incoming))
        feeds.follow(stream, folder, str(tmp_path / "checkpoint"), schema, today(), now()).awaitTermination()
        after = feeds.snapshot(spark, folder, schema).collect()
        stats = spark.read.parquet(f"{folder}/runs").filter(F.col("version") == n).collect()
        yield {(r.source_id, r.externe_id): r for r in after}, {r.source_id: r for r in stats}


@pytest.fixture(params=[in_batch, in_stream])
def replay(request, spark, tmp_path):
    return lambda *runs: list(request.param(spark, tmp_path, runs))


def figures(stats, source=9):
    r = stats[source]
    return (r.found, r.new, r.updated, r.skipped, r.deactivated, r.reactivated, r.status)


def test_insert_then_update_keeps_identity(replay):
    a, b = item("a"), item("b", name="Baustelle A7")
    (first, s1), (second, s2) = replay([feed(a)], [feed(a | {"name": "Baustelle A2 (verlängert)", "lat": 52.31, "gueltig_bis": datetime.date(2026, 9, 30)}, b)])
    assert figures(s1) == (1, 1, 0, 0, 0, 0, "ok") and figures(s2) == (2, 1, 1, 0, 0, 0, "ok")
    old, new = first[9, "a"], second[9, "a"]
    assert (new.name, new.lat, new.gueltig_bis) == ("Baustelle A2 (verlängert)", 52.31, datetime.date(2026, 9, 30))
    assert (new.obstacle_id, new.fach_id, new.realer_start) == (old.obstacle_id, "00010009" + ID, TODAY)
    assert second[9, "b"].fach_id == "00020009" + ID and second[9, "b"].obstacle_id != old.obstacle_id


def test_equal_ids_of_two_sources_are_kept_apart(replay):
    a, c = item("a"), item("a", source=4, name="Sperrung B3")
    (both, s1), (later, s2), (last, _) = replay([feed(a), feed(c, source=4)], [feed(item("b", name="Baustelle A7"))], [feed(c | {"name": "Sperrung B4"}, source=4)])
    assert s1.keys() == {9, 4} and s2.keys() == {9}
    assert both[9, "a"].fach_id == "00010009" + ID and both[4, "a"].fach_id == "00010004" + ID
    assert not later[9, "a"].aktiv and later[4, "a"].aktiv and later[4, "a"].name == "Sperrung B3"
    assert last[4, "a"].name == "Sperrung B4" and last[9, "a"].name == "Baustelle A2"
    assert len({r.obstacle_id for r in last.values()}) == 3


def test_same_id_twice_is_one_row(replay):
    [(rows, stats)] = replay([feed(item("d", name="Baustelle Nord"), item("d", name="Baustelle Süd", lat=53.0, realer_start=datetime.date(2020, 1, 1)))])
    assert figures(stats) == (2, 1, 1, 0, 0, 0, "ok")
    assert rows[9, "d"].name == "Baustelle Süd" and rows[9, "d"].realer_start == TODAY


def test_drift_of_a_hundred_metres_is_the_same_row(replay):
    base = {"name": "B10 Kriegsstraße zw. Karlstraße und Ettlinger Tor", "lat": 49.006, "lng": 8.403}
    (one, _), (two, stats) = replay([feed(item("s1", **base))], [feed(item("s2", **base | {"lat": 49.0069}))])
    assert figures(stats) == (1, 0, 1, 0, 0, 0, "ok")
    assert two.keys() == {(9, "s1")} and two[9, "s1"].aktiv and two[9, "s1"].lat == 49.0069 and two[9, "s1"].obstacle_id == one[9, "s1"].obstacle_id


def test_no_merge_beyond_the_box_or_with_other_limits(replay):
    base = {"name": "Baustelle X", "lat": 49.006, "lng": 8.403}
    _, (rows, stats) = replay([feed(item("s1", **base))], [feed(item("s1", **base), item("s9", **base | {"lat": 49.03}), item("s8", **base | {"restbreite_m": 3.0}))])
    assert figures(stats) == (3, 2, 1, 0, 0, 0, "ok") and len(rows) == 3


def test_no_drift_to_another_source(replay):
    _, (rows, stats) = replay([feed(item("s1"))], [feed(item("s2", source=4), source=4)])
    assert figures(stats, 4) == (1, 1, 0, 0, 0, 0, "ok") and rows[9, "s1"].aktiv


def test_missing_rows_are_deactivated_and_return(replay):
    a, b = item("a"), item("b", name="Baustelle A7")
    ended = b | {"gueltig_bis": datetime.date(2026, 6, 4)}
    _, (two, s2), (three, s3), (four, s4), (_, s5) = replay([feed(a, b)], [feed(a)], [feed(a, ended)], [feed(a, b)], [feed(a)])
    assert figures(s2) == (1, 0, 1, 0, 1, 0, "ok") and not two[9, "b"].aktiv and two[9, "a"].aktiv
    assert figures(s3) == (2, 0, 2, 0, 0, 0, "ok") and not three[9, "b"].aktiv  # its validity has ended
    assert figures(s4) == (2, 0, 2, 0, 0, 1, "ok") and four[9, "b"].aktiv
    assert figures(s5)[4] == 1


def test_cut_empty_and_partial_feeds_deactivate_nothing(replay):
    a, b = item("a"), item("b", name="Baustelle A7")
    _, (two, s2), (three, s3), (four, s4) = replay([feed(a, b)], [feed(a, complete=False)], [feed()], [feed(a, full=False)])
    assert figures(s2) == (1, 0, 1, 0, 0, 0, "partial") and figures(s3) == (0, 0, 0, 0, 0, 0, "warn") and figures(s4) == (1, 0, 1, 0, 0, 0, "ok")
    assert two[9, "b"].aktiv and three[9, "b"].aktiv and four[9, "b"].aktiv


def test_guard_against_losing_a_large_share(replay):
    many = [item(f"g{i}", name=f"Baustelle Nr {i}", lat=48 + i * 0.05) for i in range(60)]
    _, (two, s2), (three, s3) = replay([feed(*many)], [feed(*many[:20])], [feed(*many[:55])])
    assert figures(s2) == (20, 0, 20, 0, 0, 0, "partial") and sum(r.aktiv for r in two.values()) == 60
    assert figures(s3) == (55, 0, 55, 0, 5, 0, "ok") and sum(r.aktiv for r in three.values()) == 55


def test_unusable_items_are_skipped(replay):
    [(rows, stats)] = replay([feed(item(None), item(" "), item("a", kategorie="?"), item("b", lat=None), item("c", name="x"), item("d", kategorie="bruecke"), item("e", name="Panne auf der A2"), item(" f "))])
    assert figures(stats) == (8, 1, 0, 7, 0, 0, "ok") and rows.keys() == {(9, "f")}


def test_several_runs_of_a_source_in_one_batch(spark, tmp_path):
    a, b = item("a"), item("b", name="Baustelle A7")
    schema = spark.createDataFrame([], SNAPSHOT).schema
    messages = [r + (n, True, None) for n, items in enumerate(([a, b], [a], [b | {"name": "Baustelle A8"}])) for r in rows_of(items)]
    spark.createDataFrame(messages, MESSAGE).coalesce(1).write.parquet(str(tmp_path / "in"))
    feeds.follow(spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), schema, today(), now()).awaitTermination()
    rows = {r.externe_id: r for r in feeds.snapshot(spark, str(tmp_path / "out"), schema).collect()}
    assert not rows["a"].aktiv and rows["b"].aktiv and rows["b"].name == "Baustelle A8"
    assert sorted((r.part, r.deactivated, r.reactivated) for r in spark.read.parquet(str(tmp_path / "out" / "runs")).collect()) == [(1, 0, 0), (2, 1, 0), (3, 1, 1)]


def test_duplicates_of_a_feed_become_one_row(replay, spark):
    part = {"name": "L536 Tunnelwartung", "kategorie": "sperrung", "lat": 48.123}
    items = [item("s1", lng=9.5001, **part), item("s2", lng=9.5002, gueltig_bis=datetime.date(2026, 9, 1), **part), item("s3", lng=9.5003, restbreite_m=3.0, **part), item("s4", **part | {"name": ""})]
    merged = ingest.group_duplicates(spark.createDataFrame(rows_of(items), ITEM)).orderBy("ord").collect()
    assert [r.members for r in merged] == [2, 1, 1] and merged[0].externe_id.startswith("dup#") and "@" in merged[1].externe_id and merged[2].externe_id == "s4"
    assert merged[0].gueltig_bis == datetime.date(2026, 9, 1) and merged[1].restbreite_m == 3.0
    [(rows, stats)] = replay([feed(*(r.asDict() for r in merged[:1]))])
    assert figures(stats) == (1, 1, 0, 0, 0, 0, "ok")


def test_rows_expire_after_their_grace(spark, tmp_path):
    """Each file of changes moves event time on; state and timers survive a restart between files."""
    day = lambda d, h=0: datetime.datetime(2026, 6, d, h)
    end = datetime.date(2026, 6, 3)  # grace ends with the 10th
    batches = [
        [(1, "a", 10, "insert", True, end, day(1)), (2, "a", 20, "insert", True, None, day(1)), (1, "b", 11, "insert", True, end, day(1)), (1, "c", 12, "insert", True, end, day(1))],
        [(1, "b", 11, "update", True, datetime.date(2026, 6, 30), day(5)), (1, "c", 12, "deactivate", False, end, day(5))],
        [(3, "z", 30, "insert", True, None, day(10, 23))],
        [(3, "z", 30, "update", True, None, day(11, 1))],
        [(3, "z", 30, "update", True, None, day(12))],
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.ROCKSDB)
    try:
        expired = []
        for rows in batches:
            spark.createDataFrame(rows, feeds.CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(feeds.CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = feeds.lives(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
            expired.append(sorted((r.source_id, r.externe_id, r.at) for r in spark.read.parquet(str(tmp_path / "out")).filter("action = 'expire'").collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert expired[2] == [] and expired[-1] == [(1, "a", day(11))]
    passed = spark.read.parquet(str(tmp_path / "out")).filter("action <> 'expire'").count()
    assert passed == sum(map(len, batches))
