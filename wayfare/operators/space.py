"""Geometry of zones, neighbours, the graph of moves and its least-duration routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.columns import bin_fraction, centroid_miles, clip, low_bin, next_bin
from wayfare.plans.params import DEFAULT, Params
from wayfare.sources.lineage import settle


def polygon_centroid_area(vertices: DataFrame) -> DataFrame:
    """zone_id, centroid_x, centroid_y, area_sqft from vertices (zone_id, ring, seq, x, y) by the shoelace sums.

    Outer rings run one way and holes the other, so their terms cancel; rings are closed if they aren't.
    """
    ring = Window.partitionBy("zone_id", "ring").orderBy("seq")
    first = Window.partitionBy("zone_id", "ring").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = vertices.select("zone_id", "x", "y", F.coalesce(F.lead("x").over(ring), F.first("x").over(first)).alias("nx"), F.coalesce(F.lead("y").over(ring), F.first("y").over(first)).alias("ny"))
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    sums = rows.groupBy("zone_id").agg(F.sum(cross).alias("a"), F.sum((F.col("x") + F.col("nx")) * cross).alias("sx"), F.sum((F.col("y") + F.col("ny")) * cross).alias("sy"))
    return sums.select("zone_id", (F.col("sx") / (3 * F.col("a"))).alias("centroid_x"), (F.col("sy") / (3 * F.col("a"))).alias("centroid_y"), (F.abs("a") / 2).alias("area_sqft"))


def zone_pairs(zones: DataFrame) -> DataFrame:
    """Miles between all zones. Zones are a fixed city's few hundred; this is the only place that pairs them all."""
    at = zones.select("zone_id", "centroid_x", "centroid_y")
    pairs = at.toDF("origin", "x1", "y1").crossJoin(F.broadcast(at.toDF("destination", "x2", "y2")))
    return pairs.select("origin", "destination", centroid_miles(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("miles"))


def nearest_zones(zones: DataFrame, k: int) -> DataFrame:
    """zone_id, neighbour, miles, rank: the k nearest others; ties go to the smaller id."""
    order = Window.partitionBy("origin").orderBy("miles", "destination")
    ranked = zone_pairs(zones).filter("origin <> destination").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("origin").alias("zone_id"), F.col("destination").alias("neighbour"), "miles", "rank")


def zone_adjacency(vertices: DataFrame, params: Params = DEFAULT, cell_feet: float = 2000.0) -> DataFrame:
    """origin < destination of zones whose outlines come within adjacency_feet: segments meet in grid cells, not all pairs."""
    ring = Window.partitionBy("zone_id", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    segment = vertices.select("zone_id", "x", "y", F.coalesce(F.lead("x").over(ring), F.first("x").over(whole)).alias("nx"), F.coalesce(F.lead("y").over(ring), F.first("y").over(whole)).alias("ny"))
    reach = params.adjacency_feet
    cells = lambda a, b: F.sequence(F.floor((F.least(a, b) - reach) / cell_feet).cast("int"), F.floor((F.greatest(a, b) + reach) / cell_feet).cast("int"))
    grid = segment.withColumn("cx", F.explode(cells(F.col("x"), F.col("nx")))).withColumn("cy", F.explode(cells(F.col("y"), F.col("ny"))))
    other = grid.select(*(F.col(c).alias(f"{c}2") for c in ("zone_id", "x", "y", "nx", "ny")), "cx", "cy")
    met = grid.join(other, ["cx", "cy"]).filter("zone_id < zone_id2").drop("cx", "cy").distinct()
    c = F.col

    def to_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str):
        dx, dy = c(bx) - c(ax), c(by) - c(ay)
        length = dx * dx + dy * dy
        t = F.when(length > 0, clip(((c(px) - c(ax)) * dx + (c(py) - c(ay)) * dy) / length, 0.0, 1.0)).otherwise(0.0)
        ex, ey = c(px) - c(ax) - t * dx, c(py) - c(ay) - t * dy
        return F.sqrt(ex * ex + ey * ey)

    def side(ax: str, ay: str, bx: str, by: str, px: str, py: str):
        return F.signum((c(bx) - c(ax)) * (c(py) - c(ay)) - (c(by) - c(ay)) * (c(px) - c(ax)))

    crossing = (side("x", "y", "nx", "ny", "x2", "y2") * side("x", "y", "nx", "ny", "nx2", "ny2") < 0) & (side("x2", "y2", "nx2", "ny2", "x", "y") * side("x2", "y2", "nx2", "ny2", "nx", "ny") < 0)
    ends = F.least(to_segment("x", "y", "x2", "y2", "nx2", "ny2"), to_segment("nx", "ny", "x2", "y2", "nx2", "ny2"), to_segment("x2", "y2", "x", "y", "nx", "ny"), to_segment("nx2", "ny2", "x", "y", "nx", "ny"))
    near = met.withColumn("feet", F.when(crossing, 0.0).otherwise(ends)).groupBy("zone_id", "zone_id2").agg(F.min("feet").alias("feet"))
    return near.filter(F.col("feet") <= reach).select(F.col("zone_id").alias("origin"), F.col("zone_id2").alias("destination"), "feet")


def reposition_edges(adjacency: DataFrame, zones: DataFrame, pairs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Both directions of each adjacency: the pair's own averages if trips were seen, else its distance at a fixed speed."""
    both = adjacency.select("origin", "destination").union(adjacency.select("destination", "origin")).distinct()
    seen = pairs.select("origin", "destination", "trip_count", "avg_duration_min", "avg_distance_miles")
    rows = both.join(seen, ["origin", "destination"], "left").join(zone_pairs(zones), ["origin", "destination"])
    known, n = F.col("trip_count").isNotNull(), F.col("trip_count")
    return rows.select(
        "origin", "destination",
        F.when(known, F.greatest("avg_duration_min", F.lit(0.1))).otherwise(F.greatest(F.col("miles") / params.fallback_mph * 60.0, F.lit(0.1))).alias("duration_min"),
        F.when(known, F.greatest("avg_distance_miles", F.lit(0.01))).otherwise(F.greatest("miles", F.lit(0.01))).alias("distance_miles"),
        F.when(known, clip(n / (n + 10.0), 0.2, 0.99)).otherwise(0.2).alias("confidence"), F.when(known, "historical_od").otherwise("centroid_fallback").alias("edge_source"),
    )


def shortest_routes(edges: DataFrame) -> DataFrame:
    """origin, destination, minutes, miles, confidence (mean over edges), path: least duration between all pairs.

    Each round joins the best routes so far with each other, which doubles the edges a route may have; it ends when no
    route gets shorter. Ties go to fewer edges, then to the smaller path.
    """
    hop = edges.filter("origin <> destination").select("origin", "destination", F.col("duration_min").alias("minutes"), F.col("distance_miles").alias("miles"), F.col("confidence").alias("total"), F.array("origin", "destination").alias("path"))
    order = F.struct(F.round("minutes", 9), F.size("path"), F.col("path"))
    best = lambda df: df.groupBy("origin", "destination").agg(F.min_by(F.struct("minutes", "miles", "total", "path"), order).alias("b")).select("origin", "destination", "b.*")
    routes, mark = settle(best(hop)), None
    while True:
        a = routes.select("origin", F.col("destination").alias("via"), *(F.col(c).alias(f"{c}1") for c in ("minutes", "miles", "total", "path")))
        b = routes.select(F.col("origin").alias("via"), "destination", *(F.col(c).alias(f"{c}2") for c in ("minutes", "miles", "total", "path")))
        longer = a.join(b, "via").filter("origin <> destination").select("origin", "destination", *((F.col(f"{c}1") + F.col(f"{c}2")).alias(c) for c in ("minutes", "miles", "total")), F.concat("path1", F.slice("path2", 2, 1_000_000)).alias("path"))
        routes = settle(best(routes.select("origin", "destination", "minutes", "miles", "total", "path").union(longer)))
        found = tuple(routes.agg(F.count(F.lit(1)), F.sum(F.hash("origin", "destination", "path").cast("long"))).first())
        if found == mark:
            break
        mark = found
    return routes.select("origin", "destination", "minutes", "miles", (F.col("total") / (F.size("path") - 1)).alias("confidence"), "path")


def k_shortest_routes(edges: DataFrame, asked: DataFrame, k: int, routes: DataFrame | None = None) -> DataFrame:
    """The k least-duration simple paths for each pair asked (origin, destination), with their rank.

    Simple prefixes grow by one edge a round. A prefix stays while its minutes and the least rest of the way are within
    the k-th best complete path so far, so none of the k can be lost.
    """
    rest = (routes if routes is not None else shortest_routes(edges)).select(F.col("origin").alias("at"), "destination", F.col("minutes").alias("least"))
    step = edges.select(F.col("origin").alias("at"), F.col("destination").alias("next"), "duration_min", "distance_miles")
    front = settle(asked.select("origin", "destination").distinct().filter("origin <> destination").select("origin", "destination", F.col("origin").alias("at"), F.lit(0.0).alias("minutes"), F.lit(0.0).alias("miles"), F.array("origin").alias("path")))
    done = None
    while not front.isEmpty():
        grown = front.join(step, "at").filter(~F.array_contains("path", F.col("next")))
        grown = grown.select("origin", "destination", F.col("next").alias("at"), (F.col("minutes") + F.col("duration_min")).alias("minutes"), (F.col("miles") + F.col("distance_miles")).alias("miles"), F.concat("path", F.array("next")).alias("path"))
        grown = settle(grown)
        complete = grown.filter("at = destination").drop("at")
        complete = complete if done is None else done.unionByName(complete)
        order = Window.partitionBy("origin", "destination").orderBy(F.round("minutes", 9), "path")
        done = settle(complete.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"))
        bound = done.groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("n"), F.max("minutes").alias("bound")).filter(F.col("n") >= k).select("origin", "destination", "bound")
        open_ = grown.filter("at <> destination").join(rest, ["at", "destination"]).join(bound, ["origin", "destination"], "left")
        front = settle(open_.filter(F.col("bound").isNull() | (F.col("minutes") + F.col("least") <= F.col("bound") + 1e-9)).select("origin", "destination", "at", "minutes", "miles", "path"))
    if done is None:
        done = asked.sparkSession.createDataFrame([], "origin int, destination int, minutes double, miles double, path array<int>")
    order = Window.partitionBy("origin", "destination").orderBy(F.round("minutes", 9), "path")
    return done.withColumn("rank", F.row_number().over(order))


def route_at(asked: DataFrame, routes: DataFrame, zones: DataFrame, profiles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """asked (origin, destination, minute, ...) with route_minutes, route_miles, route_confidence at that minute.

    Minutes scale with the mean speed over the speed at the minute; the same zone costs nothing; without a path the
    straight line is driven at the speed of the minute, with little confidence.
    """
    rows = with_profile_at(asked, profiles, params)
    mean = F.broadcast(profiles.agg(F.avg("speed_mph").alias("_mean")))  # one row
    rows = rows.join(routes.select("origin", "destination", F.col("minutes").alias("_m"), F.col("miles").alias("_d"), F.col("confidence").alias("_c")), ["origin", "destination"], "left")
    rows = rows.join(zone_pairs(zones).withColumnRenamed("miles", "_straight"), ["origin", "destination"], "left").join(mean)
    same, found = F.col("origin") == F.col("destination"), F.col("_m").isNotNull()
    minutes = F.when(same, 0.0).when(found, F.greatest(F.col("_m") * F.col("_mean") / F.col("speed_at"), F.lit(0.1))).otherwise(F.greatest(F.col("_straight") / F.col("speed_at") * 60.0, F.lit(0.1)))
    miles = F.when(same, 0.0).when(found, F.col("_d")).otherwise(F.col("_straight"))
    confidence = F.when(same, 1.0).when(found, F.col("_c")).otherwise(0.15)
    return rows.select(*asked.columns, minutes.alias("route_minutes"), miles.alias("route_miles"), confidence.alias("route_confidence"))


def with_profile_at(rows: DataFrame, profiles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Adds speed_at and rpm_at, linear between the bins around `minute`. Profiles have one row per bin of a day."""
    low, high = F.broadcast(profiles.toDF("_lb", "_ls", "_lr")), F.broadcast(profiles.toDF("_hb", "_hs", "_hr"))
    minute = F.col("minute")
    t = bin_fraction(minute, params)
    joined = rows.join(low, low_bin(minute, params) == F.col("_lb"), "left").join(high, next_bin(minute, params) == F.col("_hb"), "left")
    speed = clip(F.coalesce((1 - t) * F.col("_ls") + t * F.col("_hs"), F.lit(params.fallback_mph)), *params.mph)
    rate = F.greatest(F.coalesce((1 - t) * F.col("_lr") + t * F.col("_hr"), F.lit(0.1)), F.lit(0.1))
    return joined.select(*(c for c in rows.columns if c not in ("speed_at", "rpm_at")), speed.alias("speed_at"), rate.alias("rpm_at"))
