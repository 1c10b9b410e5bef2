import math

import pytest
from pyspark.sql import functions as F

from gridway.functions import geo
from gridway.operators import corridor


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_grid_join_equals_brute_force(spark):
    route = spark.createDataFrame([(0, i, 50 + 0.0007 * math.sin(i), 8 + 0.0011 * i) for i in range(60)], "route_id int, i int, lat double, lng double")
    points = spark.createDataFrame([(k, 49.9985 + 0.0002 * (k % 17), 8 + 0.0009 * k) for k in range(70)], "p int, lat double, lng double")
    for radius in (20.0, 60.0, 150.0):
        found = {(r.p, r.seg): r.dist_m for r in corridor.near(points, route, radius, ["p"]).collect()}
        dist, _ = geo.on_segment(*(F.col(c) for c in ("lat", "lng", "a_lat", "a_lng", "b_lat", "b_lng")))
        every = points.crossJoin(corridor.segments(route)).withColumn("d", dist).filter(F.col("d") <= radius)
        wanted = every.groupBy("p").agg(F.min(F.struct("d", "i")).alias("x")).select("p", "x.*").collect()
        assert found == {(r.p, r.i): r.d for r in wanted}


@pytest.mark.parametrize("a, b, want", [(0, 0, 0), (10, 350, 20), (350, 10, 20), (90, 270, 180)])
def test_angle_delta(spark, a, b, want):
    assert value(spark, geo.angle_delta(F.lit(float(a)), F.lit(float(b)))) == want


def test_halves_go_up(spark):
    assert value(spark, geo.half_up(F.lit(-2.5))) == -2
    assert value(spark, geo.half_up(F.lit(0.03), 50)) == 0.04


def test_swapped_coordinates(spark):
    lat, lng = geo.swapped_right(F.lit(8.6), F.lit(50.1))
    assert (value(spark, lat), value(spark, lng)) == (50.1, 8.6)


def test_first_vertex_inside_counts_not_the_nearest(spark):
    route = spark.createDataFrame([(0, 0, 50.0, 8.0), (0, 1, 50.0, 8.1)], "route_id int, i int, lat double, lng double")
    obstacle = spark.createDataFrame([(1, 50.01, 8.02)], "obstacle_id int, lat double, lng double")
    line = spark.createDataFrame([(1, 0, 50.01, 8.02), (1, 1, 50.00015, 8.03), (1, 2, 50.0, 8.05)], "obstacle_id int, j int, lat double, lng double")
    (hit,) = corridor.corridor_match(obstacle, line, route).collect()
    assert hit.vertex == 1 and 16 < hit.dist_m < 17


def test_point_at_km_clamps(spark):
    route = spark.createDataFrame([(0, 0, 50.0, 8.0), (0, 1, 50.0, 8.1)], "route_id int, i int, lat double, lng double")
    wanted = spark.createDataFrame([(0, -1.0), (0, 0.0), (0, 99.0)], "route_id int, km double")
    assert {r.km: r.lng for r in corridor.point_at_km(route, wanted).collect()} == {-1.0: 8.0, 0.0: 8.0, 99.0: 8.1}
