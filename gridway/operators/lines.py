"""Line obstacles against routes: direction, coincidence, crossing, and the part within the corridor.

Lines are rows (obstacle_id, j, lat, lng); pairs (obstacle_id, route_id) say which route each is held against. Distances
beyond the search radius count as infinite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridway.functions import geo
from gridway.operators import corridor


def pieces(lines: DataFrame) -> DataFrame:
    """(obstacle_id, j, a_lat, a_lng, b_lat, b_lng, km, course) of lines' segments that have a length."""
    along = Window.partitionBy("obstacle_id").orderBy("j")
    nxt = lambda c: F.lead(c).over(along)
    rows = lines.select("obstacle_id", "j", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), nxt("lat").alias("b_lat"), nxt("lng").alias("b_lng")).filter("b_lat IS NOT NULL")
    args = [F.col(c) for c in ("a_lat", "a_lng", "b_lat", "b_lng")]
    return rows.withColumns({"km": geo.haversine_km(*args), "course": geo.bearing(*args)}).filter("km > 0")


def paired(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows for each route of their obstacle. Lines are paired before they are cut up into points, as a join sorts what it is given."""
    return rows.join(pairs.select("obstacle_id", "route_id").distinct(), "obstacle_id")


def samples(lines: DataFrame, pairs: DataFrame, step_m: float = 12.0) -> DataFrame:
    """(obstacle_id, route_id, j, s, lat, lng, weight_km, course): points along each segment, about step_m apart, both ends included."""
    steps = F.greatest(F.lit(1), F.floor(F.col("km") * 1000 / step_m + 0.5).cast("int"))
    rows = paired(pieces(lines), pairs).withColumn("steps", steps).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    t = F.col("s") / F.col("steps")
    at = lambda c: F.col(f"a_{c}") + t * (F.col(f"b_{c}") - F.col(f"a_{c}"))
    return rows.select("obstacle_id", "route_id", "j", "s", at("lat").alias("lat"), at("lng").alias("lng"), (F.col("km") / (F.col("steps") + 1)).alias("weight_km"), "course")


def placed(points: DataFrame, routes: DataFrame, radius_m: float, keys: list[str], carried: list[str]) -> DataFrame:
    """points (keys, route_id, carried, lat, lng) with dist_m, km and the route's course there, null beyond the radius."""
    found = corridor.placed(points, routes, radius_m, keys, carried)
    # Kilometres are multiples of 20 metres: a route's courses are looked up for all of them, so that points are placed only once.
    marks = corridor.cumulative(routes).groupBy("route_id").agg((F.floor(F.max("cum_km") * 50) + 1).alias("n"))
    marks = marks.select("route_id", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("n")).select("route_id", (F.col("n") / F.lit(50.0)).alias("km"))
    courses = corridor.course_at_km(routes, marks).withColumnRenamed("course", "route_course")
    # Points beyond the radius have no course; numbers of their own keep them from meeting in one task.
    beyond = -1.0 - F.pmod(F.xxhash64(*keys), F.lit(1 << 20))
    return found.withColumn("__at", F.coalesce("km", beyond)).join(courses.withColumnRenamed("km", "__at"), ["route_id", "__at"], "left").drop("__at")


def relation(lines: DataFrame, pairs: DataFrame, routes: DataFrame, same_m: float = 8.0, reach_m: float = 60.0, opposite: float = 120.0, least_km: float = 0.1) -> DataFrame:
    """(obstacle_id, route_id, relation): parallel if it runs on the route, opposite if beside it the other way, else none."""
    mids = pieces(lines).select("obstacle_id", "j", ((F.col("a_lat") + F.col("b_lat")) / 2).alias("lat"), ((F.col("a_lng") + F.col("b_lng")) / 2).alias("lng"), F.col("km").alias("piece_km"), "course")
    at = placed(paired(mids, pairs), routes, reach_m, ["obstacle_id", "j"], ["piece_km", "course"])
    beside = F.col("dist_m").between(same_m, reach_m) & (F.col("dist_m") > same_m)
    delta = geo.angle_delta(F.col("course"), F.col("route_course"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("piece_km"))), F.lit(0.0))
    sums = at.groupBy("obstacle_id", "route_id").agg(total(F.col("dist_m") <= same_m).alias("on_km"), total(beside & (delta > opposite)).alias("opposite_km"), total(beside & (delta < 180 - opposite)).alias("parallel_km"))
    kind = F.when(F.col("on_km") >= least_km, "parallel").when((F.col("opposite_km") >= least_km) & (F.col("opposite_km") > F.col("parallel_km")), "opposite").otherwise("none")
    return sums.select("obstacle_id", "route_id", kind.alias("relation"), "on_km", "opposite_km", "parallel_km")


def alignment(lines: DataFrame, pairs: DataFrame, routes: DataFrame, near_m: float = 20.0, same_m: float = 8.0, far_m: float = 60.0, along: float = 40.0, across: float = 50.0) -> DataFrame:
    """Per pair the kilometres that run on the route, along it, across it, and far from it, and the verdicts drawn from them."""
    far = max(far_m, 3 * near_m)
    at = placed(samples(lines, pairs), routes, far, ["obstacle_id", "j", "s"], ["weight_km", "course"])
    folded = geo.folded_angle(F.col("course"), F.col("route_course"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("weight_km"))), F.lit(0.0))
    inside = F.col("dist_m") <= near_m
    sums = at.groupBy("obstacle_id", "route_id").agg(
        total((F.col("dist_m") <= same_m) & (F.col("route_course").isNull() | (folded <= along))).alias("coincident_km"),
        total(inside & (folded <= along)).alias("along_km"),
        total(inside & (folded >= across)).alias("across_km"),
        total(F.col("dist_m").isNull()).alias("far_km"),
    )
    # The lengths from which a verdict is drawn.
    crosses = (F.col("across_km") >= 0.03) & (F.col("across_km") > F.col("along_km")) & (F.col("along_km") < 0.05)
    off = (F.col("along_km") < 0.035) & (F.col("far_km") >= 0.12)
    return sums.withColumns({"crosses": crosses, "off_route": off})


def clip(lines: DataFrame, pairs: DataFrame, routes: DataFrame, corridor_m: float = 20.0, bridge_m: float = 60.0) -> DataFrame:
    """(obstacle_id, route_id, run, points, first_n, last_n): the runs of a densified line within max(3 corridors, 60 m) of the route.

    Gaps inside the line of at most bridge_m count as inside; runs need two points.
    """
    reach = max(3 * corridor_m, 60.0)
    per = Window.partitionBy("obstacle_id")
    length = pieces(lines).withColumn("line_m", F.sum("km").over(per) * 1000).withColumn("step", F.greatest(F.lit(15.0), geo.half_up(F.col("line_m") / 300)))
    n = F.greatest(F.lit(1), F.ceil(F.col("km") * 1000 / F.col("step")).cast("int"))
    along = per.orderBy("j")
    numbered = paired(length.withColumn("n", n).withColumns({"before": F.sum("n").over(along) - F.col("n"), "last": F.lead("j").over(along).isNull()}), pairs)
    # Each piece gives its points but the last, which is the next one's first; the line's last piece gives its end as well.
    dense = numbered.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - F.when(F.col("last"), 0).otherwise(1))))
    t = F.col("s") / F.col("n")
    at = lambda c: F.when(F.col("s") == F.col("n"), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}") + t * (F.col(f"b_{c}") - F.col(f"a_{c}")))
    points = dense.select("obstacle_id", "route_id", (F.col("before") + F.col("s")).cast("int").alias("k"), at("lat").alias("lat"), at("lng").alias("lng"), "step")
    flagged = corridor.placed(points, routes, reach, ["obstacle_id", "k"], ["step"]).select("obstacle_id", "route_id", "k", "step", F.col("dist_m").isNotNull().alias("inside"))
    # Points are sorted once, dealt anew after their lines were cut up; from there on whole islands are looked at.
    line = Window.partitionBy("obstacle_id", "route_id").orderBy("k")
    turn = lambda window: F.when(F.lag("inside").over(window) == F.col("inside"), 0).otherwise(1)
    turns = flagged.repartition("obstacle_id", "route_id").withColumn("turn", turn(line)).withColumn("island", F.sum("turn").over(line))
    islands = turns.groupBy("obstacle_id", "route_id", "island", "inside", "step").agg(F.count("*").alias("size"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))
    bridges = F.greatest(F.lit(1), F.ceil(F.lit(bridge_m) / F.col("step")))
    whole = Window.partitionBy("obstacle_id", "route_id")
    filled = islands.withColumn("last_island", F.max("island").over(whole)).withColumn("inside", F.col("inside") | ((F.col("size") <= bridges) & (F.col("island") > 1) & (F.col("island") < F.col("last_island"))))
    steps = whole.orderBy("island")
    runs = filled.withColumn("turn", turn(steps)).withColumn("run", F.sum("turn").over(steps)).filter("inside")
    out = runs.groupBy("obstacle_id", "route_id", "run").agg(F.sum("size").alias("points"), F.min("first_k").alias("first_n"), F.max("last_k").alias("last_n")).filter("points >= 2")
    number = F.row_number().over(whole.orderBy("first_n"))
    return out.select("obstacle_id", "route_id", number.alias("run"), "points", "first_n", "last_n")
