"""What many rows, many groups and crowded places ask for, in small."""

import datetime
import heapq
import random
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridway.functions import text
from gridway.operators import corridor, findings, graph, ingest
from gridway.operators.grouped import each_batch
from gridway.plans import catalogue, import_queries
from oracle import SMALL, TABLES, expected, rows


def test_small_groups_are_handed_over_together(spark):
    df = spark.range(3000).selectExpr("id % 1000 AS k", "id AS v")
    calls = lambda rows, start, size: iter([pd.DataFrame({"groups": [len(start)], "rows": [int(size.sum())]})])
    found = each_batch(df, ["k"], ["v"], calls, "groups long, rows long").collect()
    assert sum(r.groups for r in found) == 1000 and sum(r.rows for r in found) == 3000 and len(found) < 20


def test_many_small_searches(spark):
    rng = random.Random(3)
    edges = [(t, rng.randrange(6), rng.randrange(6), float(rng.randrange(1, 9)), rng.choice([0, 1, None]), 0) for t in range(300) for _ in range(1 + t % 9)]
    trips = spark.createDataFrame([(t, 0, 5) for t in range(300)], "trip_id bigint, start bigint, goal bigint")
    found = {r.trip_id: r for r in graph.cheapest_paths(spark.createDataFrame(edges, "trip_id bigint, a bigint, b bigint, km double, blockers bigint, zones bigint"), trips).collect()}
    assert len(found) == 300 and not any(r.cut for r in found.values())
    for t in range(300):
        best = {0: 0.0}
        for _ in range(6):
            for _, a, b, km, n, _ in (e for e in edges if e[0] == t):
                if a in best:
                    best[b] = min(best.get(b, 1e18), best[a] + km + graph.BLOCKER_KM * (n or 0))
        assert found[t].cost == best.get(5) and (found[t].blockers is None) == (5 not in best)


def test_trips_of_searches_are_not_broadcast(spark):
    plan = catalogue.QUERIES["corridor_search"](spark, SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["import_rows", "stream_import"])
def test_more_than_9999_new_rows_of_a_source(spark, tmp_path, name):
    # Orders of one source; an odd sixth of them is unknown before, and all are in the stream.
    keys = spark.range(75_000 if name == "import_rows" else 20_000).selectExpr(f"id * {import_queries.SOURCES} + 1 AS o_orderkey")
    orders = keys.selectExpr("o_orderkey", "o_orderkey % 97 AS o_custkey", "'O' AS o_orderstatus", "1D AS o_totalprice", "timestamp_ntz'1996-01-01 00:00:00' AS o_orderdate", "'1' AS o_orderpriority")
    orders.coalesce(1).write.parquet(f"{tmp_path}/made")
    made = next((tmp_path / "made").glob("*.parquet"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY (SELECT * FROM '{made if t == 'orders' else f'{SMALL}/{t}.parquet'}') TO '{tmp_path}/{t}.parquet'")
    found = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert found.fach_id.str.len().max() == 15
    assert rows(found) == rows(expected(catalogue.ORACLES[name], str(tmp_path)))


def crowd(spark, n):
    """n findings on one route and category within a hundred metres."""
    return spark.range(n).selectExpr(
        "CAST(id AS INT) AS ord", "1 AS route_id", "'baustelle' AS kategorie", "'A' AS titel", "(id * 7) % 10 / 100D AS km", "CAST(1 + id % 3 AS INT) AS rank", "50 + (id * 7) % 10 * 0.0001D AS lat", "8D AS lng",
        "CASE WHEN id % 2 = 0 THEN concat('g', id) END AS geom", "concat('q', id % 4) AS quelle", "'import' AS herkunft",
    )


def within(seconds, df):
    begin, n = time.time(), df.count()
    assert time.time() - begin < seconds
    return n


def test_a_crowd_of_sources(spark):
    # Every severity occurs in every source, so that the severest alone stay.
    assert within(60, findings.dedupe_sources(crowd(spark, 40_000))) == 13_333


def test_a_crowd_in_groups(spark):
    grouped = findings.groups_within(crowd(spark, 80_000)).select("group").distinct()
    assert within(60, grouped) == 1


def test_a_crowd_of_places(spark):
    # Those with a geometry are nobody's twins; the others are within twenty-five metres of five places.
    assert 20_000 < within(60, findings.dedupe_places(crowd(spark, 40_000))) <= 20_010


def test_announced_works_of_a_crowded_place(spark):
    day = "date_add(DATE'2026-01-01', CAST(id % 90 AS INT))"
    rows = spark.range(80_000).selectExpr("id AS obstacle_id", "'A1' AS road", "50D AS lat", "8D AS lng", f"{day} AS gueltig_von", f"date_add({day}, 5) AS gueltig_bis")
    late = rows.selectExpr("obstacle_id + 1000000 AS obstacle_id", "road", "lat", "lng", "date_add(gueltig_von, 60) AS gueltig_von", "date_add(gueltig_bis, 60) AS gueltig_bis")
    # The last current row ends on day 94; announced ones begin on days 60 to 149.
    found = ingest.announced_only(late, rows)
    assert within(60, found) == late.filter("gueltig_von > date_add(DATE'2026-01-01', 94)").count()


def test_validities_decide_as_rows_do(spark):
    rng = random.Random(5)
    some_day = lambda: None if rng.random() < 0.2 else datetime.date(2026, 1, 1) + datetime.timedelta(days=rng.randrange(40))
    made = lambda n: [(k, rng.choice(["A1", "A2"]), 50 + rng.randrange(3) * 0.01, 8.0, some_day(), some_day()) for k in range(n)]
    future, current = made(200), made(25)
    schema = "obstacle_id long, road string, lat double, lng double, gueltig_von date, gueltig_bis date"
    met = lambda f, c: f[1:3] == c[1:3] and (f[4] is None or c[5] is None or f[4] <= c[5]) and (c[4] is None or f[5] is None or c[4] <= f[5])
    wanted = {f[0] for f in future if not any(met(f, c) for c in current)}
    found = ingest.announced_only(spark.createDataFrame(future, schema), spark.createDataFrame(current, schema)).collect()
    assert {r.obstacle_id for r in found} == wanted and wanted


def test_chains_are_numbered_once_for_their_lines(spark, monkeypatch):
    links = spark.createDataFrame([("r", k, k + 1 if k < 6 else None, 50.0 + k, 8.0) for k in range(1, 7)], "road string, code bigint, pos bigint, lat double, lng double")
    pairs = spark.createDataFrame([(1, "r", 2, 4), (2, "r", 5, 3)], "pair_id bigint, road string, a bigint, b bigint")
    calls, number = [], graph.numbered
    monkeypatch.setattr(graph, "numbered", lambda df: calls.append(1) or number(df))
    found = {r.pair_id: [p.lat for p in r.line] for r in graph.chain_lines(links, pairs).collect()}
    assert found == {1: [52.0, 53.0, 54.0], 2: [55.0, 54.0, 53.0]} and len(calls) == 1


def test_fronts_of_a_search_grow_by_cost(spark, monkeypatch):
    # A network in which four hops lead to every one of its nodes.
    rng = random.Random(8)
    edges = [(a, rng.randrange(3000), float(rng.randrange(5, 45)), 0, 0) for a in range(3000) for _ in range(10)]
    trips = [(k, rng.randrange(3000), rng.randrange(3000)) for k in range(6)]
    sizes, store = [], graph.stored

    def counted(df, name):
        out = store(df, name)
        if name == "labels":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", counted)
    found = graph.cheapest_chains(spark.createDataFrame(edges, "a bigint, b bigint, km double, blockers bigint, zones bigint"), spark.createDataFrame(trips, "trip_id bigint, start bigint, goal bigint")).collect()
    out = {}
    for a, b, km, *_ in edges:
        out.setdefault(a, []).append((b, km))
    for r in found:
        _, start, goal = trips[r.trip_id]
        best, todo = {start: 0.0}, [(0.0, start)]
        while todo:
            cost, at = heapq.heappop(todo)
            for b, km in out[at] if cost == best[at] else ():
                if cost + km < best.get(b, 1e18):
                    best[b] = cost + km
                    heapq.heappush(todo, (cost + km, b))
        assert r.cost == best.get(goal)
    assert max(sizes) < len(trips) * 500


def test_dear_roads_wait_and_old_labels_go(spark, monkeypatch):
    # A start of two thousand roads that are dearer than the whole way.
    edges = [(0, 1, 5.0), (1, 2, 5.0), (2, 3, 5.0)] + [(0, k, 1000.0) for k in range(100, 2100)] + [(100, 3, 1.0)]
    stores, store = [], graph.stored

    def held(df, name):
        out = store(df, name)
        if name == "labels":
            stores.append((out.count(), out.inputFiles()[0].rpartition("/")[0]))
        return out

    monkeypatch.setattr(graph, "stored", held)
    rows = spark.createDataFrame(edges, "a bigint, b bigint, km double").selectExpr("*", "0L AS blockers", "0L AS zones")
    trips = spark.createDataFrame([(1, 0, 3), (2, 100, 3), (3, 3, 0)], "trip_id bigint, start bigint, goal bigint")
    found = {r.trip_id: (r.cost, r.path) for r in graph.cheapest_chains(rows, trips).collect()}
    assert found == {1: (15.0, [0, 1, 2, 3]), 2: (1.0, [100, 3]), 3: (None, None)}
    assert len(stores) > 1 and max(n for n, _ in stores) < 100
    assert sum(spark.read.parquet(folder).count() for _, folder in stores) == 0


def test_points_on_routes_are_not_sorted(spark):
    routes = spark.createDataFrame([(1, i, 50.0, 8.0 + i * 0.001) for i in range(5)], "route_id int, i int, lat double, lng double")
    points = spark.createDataFrame([(k, 1, 50.0001 if k % 2 else 50.01, 8.0 + k * 0.001) for k in range(4)], "k int, route_id int, lat double, lng double")
    found = corridor.placed(points, routes, 20.0, ["k"], [])
    assert {r.k: r.km is not None for r in found.collect()} == {0: False, 1: True, 2: False, 3: True}
    assert "SortAggregate" not in found._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().sparkPlan().toString()


def test_notices_of_whole_texts(spark):
    # Thirty-two million characters, in which a notice stands once a text.
    prose = F.repeat(F.lit("Die Straßen zwischen den Städten sind heute frei, und alle fahren sie gern. "), 660)

    def said(n):
        rows = spark.range(n, numPartitions=4).select(F.concat(prose, F.lit("Fahrbahn halbseitig gesperrt, B 7, keine Umleitung."), prose, F.col("id").cast("string")).alias("t"))
        found = rows.select(text.notice_details(F.col("t")).alias("d"), text.road_refs(F.col("t")).alias("roads")).select("d.half_closed", "d.detour", "d.lanes", "d.supply", F.array_join("roads", ",").alias("roads"))
        return [tuple(r) for r in found.groupBy(*found.columns).count().collect()]

    assert said(4) == [(True, False, None, None, "B7", 4)]
    begin = time.time()
    assert said(320) == [(True, False, None, None, "B7", 320)]
    assert time.time() - begin < 10
