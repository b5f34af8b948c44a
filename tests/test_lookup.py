"""The last source of the lookup, and default destinations, on hand-made models."""

import pytest
from pyspark.sql import functions as F

from wayfare.operators import lookup, space, studies
from wayfare.plans.model import TripModel

TRIPS = "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, PULocationID int, DOLocationID int, trip_distance double, fare_amount double, tip_amount double, source_month string"


@pytest.fixture(scope="module")
def far(spark):
    """Zones in a row; all trips are between the first two, so that pairs at the other end have neither rows nor seen neighbours."""
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1, 8)
    trips = [(at + timedelta(minutes=k), at + timedelta(minutes=k + 10 + k % 5), 1 + k % 2, 2 - k % 2, 2.0 + k % 3, 10.0 + k, 1.0, "2024-01") for k in range(60)]
    zones = spark.createDataFrame([(k, "A", f"zone {k}", 9000.0 * k, 0.0) for k in range(1, 13)], "zone_id int, borough string, zone_name string, centroid_x double, centroid_y double")
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 12)], "origin int, destination int")
    return TripModel(spark.createDataFrame(trips, TRIPS), zones, edges)


def test_the_last_source_is_gravity(spark, far):
    cells = spark.createDataFrame([(32, 10, 12), (32, 1, 2), (40, 1, 2), (32, 1, 12)], "time_bin int, origin int, destination int")
    rows = {(r.time_bin, r.origin, r.destination): r for r in lookup.estimate_od_bin(cells, far, direct=False).collect()}
    assert rows[32, 1, 2].source == "full_observed_sparse_eb" and rows[40, 1, 2].source == "global_od_time_adjusted"
    last = rows[32, 10, 12]
    assert last.source == "spatial_gravity_time_fallback"
    g, way = far.gravity.first(), far.routes.filter("origin = 10 and destination = 12").first()
    profile, mean = far.profiles.filter("time_bin = 32").first(), far.profiles.agg(F.avg("speed_mph")).first()[0]
    minutes = max(1.0, way.minutes * mean / profile.speed_mph)
    fare = 0.55 * max(2.5, g.intercept + g.distance * way.miles + g.duration * minutes) + 0.45 * profile.revenue_per_mile * way.miles
    assert last.revenue == pytest.approx(fare) and last.miles == pytest.approx(way.miles) and last.minutes >= minutes - 1e-9
    assert last.revenue_std == pytest.approx(max(1.0, 0.35 * fare)) and last.confidence == pytest.approx(min(max(0.08 + 0.17 * way.confidence, 0.05), 0.28))


def test_default_choices(spark):
    origins = spark.createDataFrame([(1,), (2,)], "origin int")
    pairs = spark.createDataFrame([(1, d, 30 - d) for d in range(3, 20)] + [(9, 1, 5)], "origin int, destination int, trip_count long")
    zones = spark.createDataFrame([(k,) for k in range(30, 0, -1)], "zone_id int")
    rows = lookup.default_choices(origins, pairs, zones).collect()
    first = {r.destination: r.share for r in rows if r.origin == 1}
    assert sorted(first) == list(range(3, 15)) and sum(first.values()) == pytest.approx(1) and first[3] == pytest.approx(27 / sum(30 - d for d in range(3, 15)))
    second = {r.destination: r.share for r in rows if r.origin == 2}
    assert sorted(second) == list(range(1, 13)) and set(second.values()) == {1 / 12}


def test_an_origin_without_rows_is_answered(spark, far):
    asked = spark.createDataFrame([(1, 1, 482.0), (2, 7, 482.0)], "query_id long, origin int, minute double")
    rows = lookup.od_options_or_default(asked, far, far.od.filter("origin <> 7")).collect()
    assert {r.is_default for r in rows if r.query_id == 1} == {False} and {r.is_default for r in rows if r.query_id == 2} == {True}
    assert sum(r.probability for r in rows if r.query_id == 2) == pytest.approx(1) and all(r.duration_min >= 1 for r in rows)


def test_a_pair_asked_often_is_estimated_once(spark, far):
    asked = spark.range(50).select("id", F.lit(1).alias("origin"), F.lit(2).alias("destination"), F.lit(487.5).alias("minute")).withColumnRenamed("id", "query_id")
    rows = lookup.estimate_od(asked, far).collect()
    assert len(rows) == 50 and len({(r.revenue, r.minutes, r.source) for r in rows}) == 1


def test_ranks_by_ranges(spark):
    values = [5.0, 1.0, 1.0, 3.0, 5.0, 5.0, -2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.value: r.rank for r in studies.average_ranks(df, "v").collect()}
    assert got == {-2.0: 1.0, 1.0: 2.5, 3.0: 4.0, 5.0: 6.0}


def test_outlines_that_touch_or_cross_or_lie_apart(spark):
    square = lambda z, x, y, h: [(z, 0, k, x + h * a, y + h * b) for k, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))]
    rows = square(1, 0.0, 0.0, 1000.0) + square(2, 2000.0, 0.0, 1000.0) + square(3, 500.0, 500.0, 700.0) + square(4, 0.0, 5000.0, 1000.0) + square(5, 2249.0, 5000.0, 1000.0)
    got = {(r.origin, r.destination): r.feet for r in space.zone_adjacency(spark.createDataFrame(rows, "zone_id int, ring int, seq int, x double, y double")).collect()}
    assert got[1, 2] == 0 and got[1, 3] == 0 and got[4, 5] == pytest.approx(249) and (1, 4) not in got
