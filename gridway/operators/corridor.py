"""Routes, their segments, and what lies in their corridor.

A route is rows (route_id, i, lat, lng). Spatial joins are equi-joins on grid cells, so they never become a nested loop; the
exact distance decides afterwards. Points, of which there are many, stand in one cell; what they are held against, in every
cell that its padded box touches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridway.functions import geo

#: A degree of a great circle.
KM_PER_DEGREE = geo.EARTH_KM * math.pi / 180


def cumulative(routes: DataFrame) -> DataFrame:
    """routes with cum_km, the length from the start."""
    along = Window.partitionBy("route_id").orderBy("i")
    step = geo.haversine_km(F.lag("lat").over(along), F.lag("lng").over(along), F.col("lat"), F.col("lng"))
    return routes.withColumn("step_km", F.coalesce(step, F.lit(0.0))).withColumn("cum_km", F.sum("step_km").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("step_km")


def segments(routes: DataFrame) -> DataFrame:
    """(route_id, i, a_lat, a_lng, b_lat, b_lng, a_km, b_km) of each pair of neighbouring points."""
    along = Window.partitionBy("route_id").orderBy("i")
    nxt = lambda c: F.lead(c).over(along)
    rows = cumulative(routes)
    out = rows.select("route_id", "i", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), nxt("lat").alias("b_lat"), nxt("lng").alias("b_lng"), F.col("cum_km").alias("a_km"), nxt("cum_km").alias("b_km"))
    return out.filter("b_lat IS NOT NULL")


def cell_size(radius_m: float, max_lat: float = 56.0) -> float:
    """Degrees that span the radius in both directions up to the latitude."""
    return max(0.0005, radius_m / (geo.METRES_PER_DEGREE * math.cos(math.radians(max_lat))))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def box_cells(rows: DataFrame, west: Column, east: Column, south: Column, north: Column, size: float) -> DataFrame:
    """rows, once for each cell (cx, cy) of a box."""
    spans = rows.withColumn("cx", F.explode(F.sequence(cell(west, size), cell(east, size))))
    return spans.withColumn("cy", F.explode(F.sequence(cell(south, size), cell(north, size))))


def segment_cells(segs: DataFrame, size: float, pad: float) -> DataFrame:
    """segs, once for each cell that is within `pad` degrees of its box."""
    low, high = (lambda x: F.least(f"a_{x}", f"b_{x}") - pad), (lambda x: F.greatest(f"a_{x}", f"b_{x}") + pad)
    return box_cells(segs, low("lng"), high("lng"), low("lat"), high("lat"), size)


def in_cells(points: DataFrame, size: float) -> DataFrame:
    """points (lat, lng) with their cell."""
    return points.withColumns({"cx": cell(F.col("lng"), size), "cy": cell(F.col("lat"), size)})


def candidates(points: DataFrame, routes: DataFrame, radius_m: float, how: str = "inner") -> DataFrame:
    """points with the segments that may be within radius_m; of their own route only, if they have a route_id."""
    reach = cell_size(radius_m) if radius_m > 0 else 0.0
    size = 2 * reach
    own = ["route_id"] if "route_id" in points.columns else []
    return in_cells(points, size).join(segment_cells(segments(routes), size, reach), [*own, "cx", "cy"], how)


def near(points: DataFrame, routes: DataFrame, radius_m: float, keys: list[str]) -> DataFrame:
    """For each point (keys, lat, lng) and route within radius_m: dist_m, km, seg, the nearest segment, the first on ties.

    km is rounded to 20 metres. Points with a route_id are held against that route only.
    """
    by = [*keys, *(["route_id"] if "route_id" not in keys else [])]
    own = ["route_id"] if "route_id" in points.columns and "route_id" not in keys else []
    dist, t = geo.on_segment(*(F.col(c) for c in ("lat", "lng", "a_lat", "a_lng", "b_lat", "b_lng")))
    found = candidates(points.select(*keys, *own, "lat", "lng"), routes, radius_m).select(*by, "i", dist.alias("dist_m"), (F.col("a_km") + t * (F.col("b_km") - F.col("a_km"))).alias("km")).filter(F.col("dist_m") <= radius_m)
    best = found.groupBy(*by).agg(F.min(F.struct("dist_m", "i", "km")).alias("best"))
    return best.select(*by, F.col("best.dist_m").alias("dist_m"), geo.half_up(F.col("best.km"), 50).alias("km"), F.col("best.i").alias("seg"))


def nearest_of(segs: Column, lat: Column, lng: Column, radius_m: float) -> Column:
    """(dist_m, i, km) of the nearest of an array of segments within radius_m, the first on ties; geo.on_segment() with each step bound once."""
    east = F.cos(F.radians(lat)) * geo.METRES_PER_DEGREE
    x, y = (lambda c: (c - lng) * east), (lambda c: (c - lat) * geo.METRES_PER_DEGREE)
    ends = F.transform(segs, lambda s: F.struct(s["i"].alias("i"), s["a_km"].alias("a_km"), s["b_km"].alias("b_km"), x(s["a_lng"]).alias("ax"), y(s["a_lat"]).alias("ay"), x(s["b_lng"]).alias("bx"), y(s["b_lat"]).alias("by")))
    along = F.transform(ends, lambda e: F.struct(e.alias("e"), (e["bx"] - e["ax"]).alias("dx"), (e["by"] - e["ay"]).alias("dy")))
    long = F.transform(along, lambda s: F.struct(s["e"].alias("e"), s["dx"].alias("dx"), s["dy"].alias("dy"), (s["dx"] * s["dx"] + s["dy"] * s["dy"]).alias("length")))
    part = lambda s: F.when(s["length"] == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(s["e"]["ax"] * s["dx"] + s["e"]["ay"] * s["dy"]) / s["length"])))
    at = F.transform(long, lambda s: F.struct(s["e"].alias("e"), s["dx"].alias("dx"), s["dy"].alias("dy"), part(s).alias("t")))
    foot = F.transform(at, lambda s: F.struct(s["e"].alias("e"), s["t"].alias("t"), (s["e"]["ax"] + s["t"] * s["dx"]).alias("cx"), (s["e"]["ay"] + s["t"] * s["dy"]).alias("cy")))
    tried = F.transform(foot, lambda s: F.struct(F.sqrt(s["cx"] * s["cx"] + s["cy"] * s["cy"]).alias("dist_m"), s["e"]["i"].alias("i"), (s["e"]["a_km"] + s["t"] * (s["e"]["b_km"] - s["e"]["a_km"])).alias("km")))
    return F.array_min(F.filter(tried, lambda s: s["dist_m"] <= radius_m))


def placed(points: DataFrame, routes: DataFrame, radius_m: float, keys: list[str], carried: list[str]) -> DataFrame:
    """Each point (keys, carried, route_id, lat, lng) with dist_m and km on its route, both null beyond radius_m.

    A cell holds its segments as one row, so that a point stays one row as well: nothing is grouped or sorted by point.
    """
    by = [*keys, "route_id"]
    reach = cell_size(radius_m) if radius_m > 0 else 0.0
    segs = F.collect_list(F.struct("i", "a_lat", "a_lng", "b_lat", "b_lng", "a_km", "b_km")).alias("segs")
    cells = segment_cells(segments(routes), 2 * reach, reach).groupBy("route_id", "cx", "cy").agg(segs)
    met = in_cells(points.select(*by, *carried, "lat", "lng"), 2 * reach).join(cells, ["route_id", "cx", "cy"], "left")
    best = met.select(*by, *carried, nearest_of(F.col("segs"), F.col("lat"), F.col("lng"), radius_m).alias("best"))
    return best.select(*by, *carried, F.col("best.dist_m").alias("dist_m"), geo.half_up(F.col("best.km"), 50).alias("km"))


def corridor_match(obstacles: DataFrame, vertices: DataFrame, routes: DataFrame, radius_m: float = 20.0) -> DataFrame:
    """Obstacles within radius_m of a route: (obstacle_id, route_id, vertex, dist_m, km).

    An obstacle matches by its own point (vertex -1); if that is outside, by the first vertex (obstacle_id, j, lat, lng)
    of its line that is inside, which need not be the nearest.
    """
    own = obstacles.select("obstacle_id", F.lit(-1).alias("vertex"), "lat", "lng")
    every = own.unionByName(vertices.select("obstacle_id", F.col("j").cast("int").alias("vertex"), "lat", "lng"))
    found = near(every, routes, radius_m, ["obstacle_id", "vertex"])
    first = found.groupBy("obstacle_id", "route_id").agg(F.min(F.struct("vertex", "dist_m", "km")).alias("first"))
    return first.select("obstacle_id", "route_id", "first.*")


def boxes(routes: DataFrame, metres: float) -> DataFrame:
    """One padded box per route."""
    edge = routes.groupBy("route_id").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lng").alias("c"), F.max("lng").alias("d"))
    return edge.select("route_id", *(v.alias(k) for k, v in geo.padded_box(F.col("a"), F.col("b"), F.col("c"), F.col("d"), metres).items()))


def point_at_km(routes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (route_id, km, any other columns) with lat and lng on the route; before the start its first point, beyond the end its last."""
    segs = segments(routes)
    ends = segs.groupBy("route_id").agg(F.max("b_km").alias("total"), F.min("i").alias("first_i"), F.min_by(F.struct("a_lat", "a_lng"), "i").alias("head"), F.max_by(F.struct("b_lat", "b_lng"), "i").alias("tail"))
    # A whole kilometre is an equi-join key: each segment stands in every kilometre that it touches.
    slots = segs.withColumn("slot", F.explode(F.sequence(F.floor("a_km"), F.floor("b_km"))))
    place = wanted.join(ends, "route_id").withColumn("at", F.least(F.greatest("km", F.lit(0.0)), "total"))
    # A place is on the one segment that ends at it or beyond; the start is on the first.
    on = ((F.col("a_km") < F.col("at")) & (F.col("b_km") >= F.col("at"))) | ((F.col("at") <= 0) & (F.col("i") == F.col("first_i")))
    inner = place.withColumn("slot", F.floor("at")).join(slots, ["route_id", "slot"]).filter(on)
    t = F.when(F.col("b_km") == F.col("a_km"), 0.0).otherwise((F.col("at") - F.col("a_km")) / (F.col("b_km") - F.col("a_km")))
    pick = lambda head, tail, x: F.when(F.col("at") <= 0, F.col(head)).when(F.col("at") >= F.col("total"), F.col(tail)).otherwise(x)
    lat = pick("head.a_lat", "tail.b_lat", F.col("a_lat") + t * (F.col("b_lat") - F.col("a_lat")))
    lng = pick("head.a_lng", "tail.b_lng", F.col("a_lng") + t * (F.col("b_lng") - F.col("a_lng")))
    return inner.select(*wanted.columns, lat.alias("lat"), lng.alias("lng"))


def course_at_km(routes: DataFrame, wanted: DataFrame, window_km: float = 0.3) -> DataFrame:
    """wanted (route_id, km; distinct) with the route's local course; null where the route does not move."""
    sides = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    moved = wanted.select("route_id", F.col("km").alias("own_km"), sides).withColumn("km", F.col("own_km") + F.col("side") * window_km)
    at = point_at_km(routes, moved)
    one = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    both = at.groupBy("route_id", F.col("own_km").alias("km")).agg(one(-1, "lat").alias("back_lat"), one(-1, "lng").alias("back_lng"), one(1, "lat").alias("ahead_lat"), one(1, "lng").alias("ahead_lng"))
    args = [F.col(c) for c in ("back_lat", "back_lng", "ahead_lat", "ahead_lng")]
    return both.select("route_id", "km", F.when(geo.haversine_km(*args) >= 1e-4, geo.bearing(*args)).alias("course"))


def downsample(routes: DataFrame, most: int) -> DataFrame:
    """Routes of more than `most` points at evenly spaced points, both ends kept."""
    n = F.count("*").over(Window.partitionBy("route_id"))
    rows = routes.withColumn("n", n)
    k = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("k")
    picks = rows.filter(F.col("n") > most).select("route_id", "n").distinct().select("route_id", "n", k).select("route_id", F.floor(F.col("k") * (F.col("n") - 1) / F.lit(most - 1) + 0.5).cast("int").alias("i")).distinct()
    return rows.filter(F.col("n") <= most).select(*routes.columns).unionByName(rows.join(picks, ["route_id", "i"], "left_semi").select(*routes.columns))


def zone_violations(routes: DataFrame, zones: DataFrame, size: float = 0.1) -> DataFrame:
    """(route_id, zone_id, km_from_centre): the first zone, in order of ord, that each route enters, of any number of zones
    (zone_id, ord, lat, lng, radius_km). Points and zones meet in cells of `size` degrees."""
    lat, lng = F.col("z_lat"), F.col("z_lng")
    high = F.col("radius_km") / KM_PER_DEGREE
    wide = high / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.abs(lat) + high, F.lit(90.0)))))
    z = zones.select("zone_id", "ord", F.col("lat").alias("z_lat"), F.col("lng").alias("z_lng"), "radius_km")
    met = in_cells(routes.select("route_id", "lat", "lng"), size).join(box_cells(z, lng - wide, lng + wide, lat - high, lat + high, size), ["cx", "cy"])
    dist = met.groupBy("route_id", "zone_id", "ord", "radius_km").agg(F.min(geo.haversine_km(F.col("lat"), F.col("lng"), lat, lng)).alias("km"))
    return dist.filter("km < radius_km").groupBy("route_id").agg(F.min_by(F.struct("zone_id", "km"), "ord").alias("z")).select("route_id", "z.zone_id", F.col("z.km").alias("km_from_centre"))


def nodes_between(nodes: DataFrame, trips: DataFrame, slack_km: float = 60.0, most: int = 120, size: float = 0.5) -> DataFrame:
    """For each trip the `most` nodes whose detour over them is at most slack_km: (trip_id, node_id, detour_km, n).

    Such nodes lie in an ellipse around both ends; trips stand in all cells of its box, nodes in one. They are ranked by
    detours to a tenth of a kilometre, then by id. A trip that ends where it starts has none.
    """
    from_to = [F.col(c) for c in ("from_lat", "from_lng", "to_lat", "to_lng")]
    half = (geo.haversine_km(*from_to) + slack_km) / 2
    mid_lat, mid_lng = (F.col("from_lat") + F.col("to_lat")) / 2, (F.col("from_lng") + F.col("to_lng")) / 2
    high = half / KM_PER_DEGREE
    wide = high / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.abs(mid_lat) + high, F.lit(90.0)))))
    moving = trips.filter((F.col("from_lat") != F.col("to_lat")) | (F.col("from_lng") != F.col("to_lng")))
    pairs = in_cells(nodes.select("node_id", "lat", "lng"), size).join(box_cells(moving, mid_lng - wide, mid_lng + wide, mid_lat - high, mid_lat + high, size), ["cx", "cy"])
    to = lambda a, b: geo.haversine_km(F.col(f"{a}_lat"), F.col(f"{a}_lng"), F.col(f"{b}lat"), F.col(f"{b}lng"))
    detour = to("from", "") + to("to", "") - to("from", "to_")
    rank = F.row_number().over(Window.partitionBy("trip_id").orderBy(geo.half_up(F.col("detour_km"), 10), "node_id"))
    return pairs.withColumn("detour_km", detour).filter(F.col("detour_km") <= slack_km).withColumn("n", rank).filter(F.col("n") <= most).select("trip_id", "node_id", "detour_km", "n")


def in_polygon(points: DataFrame, rings: DataFrame, per_band: int = 16) -> DataFrame:
    """(point_id, polygon_id): the first polygon by ord that holds the point, by even-odd crossings.

    rings: (polygon_id, ord, a_lat, a_lng, b_lat, b_lng) edges. Points meet polygons on whole-degree cells of their boxes. Each polygon
    is cut into bands of latitude, as many as its edges fill with about `per_band` each, and a point meets the edges of its own band
    only: a long border costs a point no more than a short one.
    """
    boxed = rings.groupBy("polygon_id", "ord").agg(F.min("a_lat").alias("s"), F.max("a_lat").alias("n"), F.min("a_lng").alias("w"), F.max("a_lng").alias("e"), F.ceil(F.count("*") / per_band).alias("bands"))
    band = lambda c: F.floor((F.col(c) - F.col("s")) / (F.col("n") - F.col("s")) * F.col("bands"))
    tiles = boxed.filter("n > s").withColumn("cx", F.explode(F.sequence(F.floor("w"), F.floor("e")))).withColumn("cy", F.explode(F.sequence(F.floor("s"), F.floor("n"))))
    placed = points.withColumns({"cx": F.floor("lng"), "cy": F.floor("lat")}).join(tiles, ["cx", "cy"]).filter("lat BETWEEN s AND n AND lng BETWEEN w AND e").select("point_id", "lat", "lng", "polygon_id", "ord", band("lat").alias("band"))
    # Level edges cross no line of latitude.
    steep = rings.filter("a_lat <> b_lat").join(boxed.select("polygon_id", "s", "n", "bands"), "polygon_id").withColumns({"low": F.least("a_lat", "b_lat"), "high": F.greatest("a_lat", "b_lat")})
    banded = steep.withColumn("band", F.explode(F.sequence(band("low"), band("high")))).select("polygon_id", "band", "a_lat", "a_lng", "b_lat", "b_lng")
    edges = placed.join(banded, ["polygon_id", "band"])
    crosses = ((F.col("a_lat") > F.col("lat")) != (F.col("b_lat") > F.col("lat"))) & (F.col("lng") < (F.col("b_lng") - F.col("a_lng")) * (F.col("lat") - F.col("a_lat")) / F.nullif(F.col("b_lat") - F.col("a_lat"), F.lit(0.0)) + F.col("a_lng"))
    odd = edges.groupBy("point_id", "polygon_id", "ord").agg(F.count_if(crosses).alias("n")).filter("n % 2 = 1")
    return odd.groupBy("point_id").agg(F.min_by("polygon_id", "ord").alias("polygon_id"))


def detour_factor(routes: DataFrame) -> DataFrame:
    """(route_id, length_km, air_km, factor); factor is null below one kilometre of air line."""
    ends = cumulative(routes).groupBy("route_id").agg(F.max("cum_km").alias("length_km"), F.min_by(F.struct("lat", "lng"), "i").alias("a"), F.max_by(F.struct("lat", "lng"), "i").alias("b"))
    out = ends.withColumn("air_km", geo.haversine_km(*(F.col(c) for c in ("a.lat", "a.lng", "b.lat", "b.lng"))))
    return out.select("route_id", "length_km", "air_km", F.when(F.col("air_km") > 1, F.col("length_km") / F.col("air_km")).alias("factor"))


def loops(routes: DataFrame, close_m: float = 60.0, apart_km: float = 1.0, least: int = 3) -> DataFrame:
    """(route_id, first_i, samples): runs of at least `least` points in a row that come close to an earlier stretch of their route."""
    size = cell_size(close_m)
    at = cumulative(routes)
    left = in_cells(at, size)
    other = at.select("route_id", F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"), F.col("cum_km").alias("o_km"))
    right = box_cells(other, F.col("o_lng") - size, F.col("o_lng") + size, F.col("o_lat") - size, F.col("o_lat") + size, size)
    back = left.join(right, ["route_id", "cx", "cy"]).filter((F.col("cum_km") - F.col("o_km") >= apart_km) & (geo.haversine_km(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng")) * 1000 <= close_m)).select("route_id", "i").distinct()
    island = F.col("i") - F.row_number().over(Window.partitionBy("route_id").orderBy("i"))
    runs = back.withColumn("island", island).groupBy("route_id", "island").agg(F.min("i").alias("first_i"), F.count("*").alias("samples"))
    return runs.filter(F.col("samples") >= least).select("route_id", "first_i", "samples")


def detours(blocked: DataFrame, trips: DataFrame, km: float = 20.0, most: int = 3) -> DataFrame:
    """(trip_id, n, side, lat, lng, detour_km): points west and east of a trip's first `most` blocked ones (trip_id, ord, lat, lng)."""
    first = blocked.withColumn("n", F.row_number().over(Window.partitionBy("trip_id").orderBy("ord"))).filter(F.col("n") <= most)
    moving = trips.filter((F.col("from_lat") != F.col("to_lat")) | (F.col("from_lng") != F.col("to_lng")))
    rows = first.join(moving, "trip_id").withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    ends = [F.col(c) for c in ("from_lat", "from_lng", "to_lat", "to_lng")]
    lat, lng = geo.around(F.col("lat"), F.col("lng"), *ends, km, F.col("side"))
    at = rows.withColumns({"d_lat": lat, "d_lng": lng})
    detour = geo.haversine_km(*ends[:2], F.col("d_lat"), F.col("d_lng")) + geo.haversine_km(*ends[2:], F.col("d_lat"), F.col("d_lng")) - geo.haversine_km(*ends)
    return at.select("trip_id", "n", "side", F.col("d_lat").alias("lat"), F.col("d_lng").alias("lng"), geo.half_up(detour, 10).alias("detour_km"))


def slices(routes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slice_id, n, lat, lng): the stretch of a route between two kilometres (slice_id, route_id, from_km, to_km), ends included."""
    ends = wanted.select("slice_id", "route_id", F.greatest(F.lit(0.0), F.least("from_km", "to_km")).alias("low"), F.greatest("from_km", "to_km").alias("high"))
    met = segments(routes).filter("b_km > a_km").join(ends, "route_id").filter("b_km >= low AND a_km <= high")
    along = Window.partitionBy("slice_id").orderBy("i")
    part = lambda km: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(km) - F.col("a_km")) / (F.col("b_km") - F.col("a_km"))))
    at = lambda t: F.struct((F.col("a_lat") + t * (F.col("b_lat") - F.col("a_lat"))).alias("lat"), (F.col("a_lng") + t * (F.col("b_lng") - F.col("a_lng"))).alias("lng"))
    rows = met.withColumns({"k": F.row_number().over(along), "before": F.coalesce(F.max(F.col("b_km") >= F.col("high")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))}).filter(~F.col("before"))
    points = F.when(F.col("k") == 1, F.array(at(part("low")), at(part("high")))).otherwise(F.array(at(part("high"))))
    out = rows.select("slice_id", "k", F.posexplode(points).alias("e", "p"))
    return out.select("slice_id", F.row_number().over(Window.partitionBy("slice_id").orderBy("k", "e")).alias("n"), "p.lat", "p.lng")


def implausible(lines: DataFrame, most_km: float = 3.0) -> DataFrame:
    """(obstacle_id, jumps): whether a line (obstacle_id, j, lat, lng) has a straight piece that is too long to be true."""
    along = Window.partitionBy("obstacle_id").orderBy("j")
    step = geo.haversine_km(F.lag("lat").over(along), F.lag("lng").over(along), F.col("lat"), F.col("lng"))
    return lines.withColumn("step", step).groupBy("obstacle_id").agg(F.coalesce(F.max("step") > most_km, F.lit(False)).alias("jumps"))


def middles(lines: DataFrame) -> DataFrame:
    """(obstacle_id, lat, lng): the point in the middle of a line, by number."""
    whole = Window.partitionBy("obstacle_id")
    rows = lines.withColumns({"n": F.row_number().over(whole.orderBy("j")) - 1, "all": F.count("*").over(whole)})
    return rows.filter(F.col("n") == F.floor(F.col("all") / 2)).select("obstacle_id", "lat", "lng")


def route_keys(routes: DataFrame) -> DataFrame:
    """(route_id, key): a hash over a route's points, rounded to five decimals."""
    point = F.format_string("%.5f,%.5f", "lat", "lng")
    points = F.transform(F.array_sort(F.collect_list(F.struct("i", point.alias("p")))), lambda x: x["p"])
    return routes.groupBy("route_id").agg(F.sha1(F.array_join(points, ";").cast("binary")).alias("key"))


def snapped(lines: DataFrame, pairs: DataFrame, routes: DataFrame, radius_m: float = 60.0) -> DataFrame:
    """(obstacle_id, route_id, lat, lng): the route's point nearest to the line's point that is nearest to the route.

    Only line points within radius_m of their route count; pairs without one are left out.
    """
    at = placed(lines.select("obstacle_id", "j", "lat", "lng").join(pairs.select("obstacle_id", "route_id").distinct(), "obstacle_id"), routes, radius_m, ["obstacle_id", "j"], ["lat", "lng"])
    best = at.filter("dist_m IS NOT NULL").groupBy("obstacle_id", "route_id").agg(F.min_by(F.struct("lat", "lng", "km"), F.struct("dist_m", "j")).alias("p"))
    # The nearest route point is an end of a segment close by: the candidates are those around the place along the route.
    near_ends = segments(routes).select("route_id", "i", "a_lat", "a_lng", "b_lat", "b_lng", "a_km", "b_km").withColumn("slot", F.explode(F.sequence(F.floor("a_km") - 1, F.floor("b_km") + 1)))
    met = best.select("obstacle_id", "route_id", F.col("p.lat").alias("p_lat"), F.col("p.lng").alias("p_lng"), F.floor("p.km").alias("slot")).join(near_ends, ["route_id", "slot"])
    ends = met.withColumn("e", F.explode(F.array(F.struct("i", F.col("a_lat").alias("lat"), F.col("a_lng").alias("lng")), F.struct((F.col("i") + 1).alias("i"), F.col("b_lat").alias("lat"), F.col("b_lng").alias("lng")))))
    away = geo.haversine_km(F.col("p_lat"), F.col("p_lng"), F.col("e.lat"), F.col("e.lng"))
    return ends.groupBy("obstacle_id", "route_id").agg(F.min_by("e", F.struct(away, F.col("e.i"))).alias("e")).select("obstacle_id", "route_id", "e.lat", "e.lng")
