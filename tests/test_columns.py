"""Column functions and operators on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from wayfare.functions import columns as c
from wayfare.operators import aggregate, space
from wayfare.sources.trips import read_trips, require_columns


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "minutes"), [("08:00", 480.0), ("23:53", 1433.0), ("0:05", 5.0), ("1445", 5.0), ("-10", 1430.0)])
def test_clock_minutes(spark, text, minutes):
    assert one(spark, c.clock_minutes(F.lit(text))) == minutes


@pytest.mark.parametrize("text", ["25:00", "08:60", "noon", "1:2:3"])
def test_clock_minutes_rejects(spark, text):
    with pytest.raises(Exception, match="not a clock time"):
        one(spark, c.clock_minutes(F.lit(text)))


def test_clock_text_carries_the_hour(spark):
    assert one(spark, c.clock_text(F.lit(479.7))) == "08:00"
    assert one(spark, c.clock_text(F.lit(1439.8))) == "00:00"


def test_bins_are_circular(spark):
    assert one(spark, c.next_bin(F.lit(1433.0))) == 0
    assert one(spark, c.circular_distance(F.lit(2), F.lit(94))) == 4


def test_weighted_means_skip_unusable_rows(spark):
    rows = spark.createDataFrame([(2.0, 1.0), (4.0, 3.0), (None, 5.0), (float("nan"), 1.0), (float("inf"), 1.0), (9.0, 0.0), (9.0, -1.0)], "v double, w double")
    assert rows.agg(c.weighted_mean(F.col("v"), F.col("w"), 7.0)).first()[0] == 3.5
    assert rows.filter("v = 9").agg(c.weighted_mean(F.col("v"), F.col("w"), 7.0)).first()[0] == 7.0
    assert math.isclose(rows.agg(c.geometric_weighted_mean(F.col("v"), F.col("w"), 7.0)).first()[0], (2 * 4**3) ** 0.25)


def test_pooled_std_of_one_is_zero(spark):
    assert one(spark, c.pooled_std(F.lit(3.0), F.lit(9.0), F.lit(1))) == 0.0
    assert one(spark, c.pooled_std(F.lit(4.0), F.lit(10.0), F.lit(2))) == 1.0


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="fare_amount"):
        require_columns(spark.range(1).withColumnRenamed("id", "PULocationID"))
    with pytest.raises(ValueError, match="no trip files"):
        read_trips(spark, {})


def test_read_trips_adds_a_tip_and_nulls_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tpep_pickup_datetime,tpep_dropoff_datetime,PULocationID,DOLocationID,trip_distance,fare_amount\n2025-01-01 08:00:00,2025-01-01 08:10:00,1,2,3.5,10\nnever,2025-01-01 08:10:00,x,2,3.5,10\n")
    rows = read_trips(spark, {"2025-01": str(tmp_path / "a.csv")}).orderBy("PULocationID").collect()
    assert [r.tip_amount for r in rows] == [0.0, 0.0]
    assert rows[0].tpep_pickup_datetime is None and rows[0].PULocationID is None and rows[1].PULocationID == 1


def test_square_with_a_hole(spark):
    ring = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(1, 1), (1, 2), (2, 2), (2, 1)]
    rows = [(1, 0, k, float(x), float(y)) for k, (x, y) in enumerate(ring)] + [(1, 1, k, float(x), float(y)) for k, (x, y) in enumerate(hole)]
    got = space.polygon_centroid_area(spark.createDataFrame(rows, "zone_id int, ring int, seq int, x double, y double")).first()
    assert math.isclose(got.area_sqft, 15.0) and math.isclose(got.centroid_x, (16 * 2 - 1.5) / 15)


def test_adjacency_within_a_distance(spark):
    square = lambda z, x: [(z, 0, k, x + dx, dy) for k, (dx, dy) in enumerate(((0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)))]
    rows = square(1, 0.0) + square(2, 1200.0) + square(3, 2500.0)
    got = space.zone_adjacency(spark.createDataFrame(rows, "zone_id int, ring int, seq int, x double, y double"))
    assert [(r.origin, r.destination, round(r.feet)) for r in got.collect()] == [(1, 2, 200)]


EDGES = [(1, 2, 2.0), (2, 3, 2.0), (1, 3, 5.0), (3, 1, 1.0), (2, 1, 9.0)]


def edge_frame(spark):
    return spark.createDataFrame([(o, d, m, m / 2, 0.5) for o, d, m in EDGES], "origin int, destination int, duration_min double, distance_miles double, confidence double")


def test_shortest_routes(spark):
    got = {(r.origin, r.destination): (r.minutes, r.path) for r in space.shortest_routes(edge_frame(spark)).collect()}
    assert got[1, 3] == (4.0, [1, 2, 3]) and got[2, 1] == (3.0, [2, 3, 1]) and got[3, 2] == (3.0, [3, 1, 2]) and len(got) == 6


def test_k_shortest_routes_are_simple_and_complete(spark):
    asked = spark.createDataFrame([(1, 3), (2, 1)], "origin int, destination int")
    got = [(r.origin, r["rank"], r.minutes, r.path) for r in space.k_shortest_routes(edge_frame(spark), asked, 3).orderBy("origin", "rank").collect()]
    assert got == [(1, 1, 4.0, [1, 2, 3]), (1, 2, 5.0, [1, 3]), (2, 1, 3.0, [2, 3, 1]), (2, 2, 9.0, [2, 1])]


def test_partials_merge(spark):
    rows = spark.createDataFrame([(0, 1, 2, 5), (0, 1, 2, 6), (1, 1, 2, 1)], "time_bin int, origin int, destination int, trip_count long")
    merged = aggregate.combine_aggregates([rows.limit(1), rows.subtract(rows.limit(1))], ["time_bin", "origin", "destination"])
    assert {(r.time_bin, r.trip_count) for r in merged.collect()} == {(0, 11), (1, 1)}
