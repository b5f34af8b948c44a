"""The one pass over the trips that the model makes, against plain sums over clean trips."""

import math

from conftest import SMALL
from pyspark.sql import functions as F

from wayfare import queries, queries_events
from wayfare.functions.columns import month_text
from wayfare.operators import aggregate, clean


def test_partials_stand_for_all_trips(spark):
    """The model reads what it needs of the trips in one pass and writes no trip."""
    m = queries.TripModel(queries.trip_view(spark, SMALL), queries.zone_view(spark, SMALL), None)
    parts = m.partials
    assert "clean" not in m.__dict__
    trips = m.clean
    for got, wanted in ((aggregate.partial_pickups(parts), aggregate.pickup_counts(trips)), (aggregate.partial_dropoffs(parts), aggregate.dropoff_counts(trips)), (aggregate.partial_days(parts), aggregate.service_days(trips))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    key = ("time_bin", "origin", "destination")
    left, right = ({tuple(r[c] for c in key): r for r in df.collect()} for df in (aggregate.partial_cells(parts), aggregate.od_time_aggregate(trips)))
    assert left.keys() == right.keys() and all(math.isclose(left[k][c], right[k][c], rel_tol=1e-9) for k in left for c in aggregate.SUMS)


def test_trips_by_date_and_microseconds_are_the_trips_of_the_datetimes(spark):
    zones = queries.zone_view(spark, SMALL)
    left, right = (sorted(map(tuple, clean.clean_trips(view(spark, SMALL), zones).collect())) for view in (queries.trip_view, queries.clocked_trips))
    assert left == right and len(left) > 1000


def test_orders_at_any_time_of_day(spark, tmp_path):
    """A trip starts its minutes after its order, also where that is another day; parts of a second stay."""
    for t in ("customer", "supplier", "lineitem", "nation", "region"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SMALL}/{t}.parquet")
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    late = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '1' SECOND") * (F.col("o_orderkey") * 977 % 86400 + 0.25)
    orders.withColumn("o_orderdate", late).write.parquet(f"{tmp_path}/orders.parquet")
    zones = queries.zone_view(spark, str(tmp_path))
    left, right = (sorted(map(tuple, clean.clean_trips(view(spark, str(tmp_path)), zones).collect())) for view in (queries.trip_view, queries.clocked_trips))
    assert left == right and len(left) > 1000


def test_clock_readings_have_no_zone(spark):
    """An hour over the night when clocks change is an hour, whatever the session's zone."""
    trip = "(timestamp_ntz '2021-03-14 01:30:00', timestamp_ntz '2021-03-14 03:30:00.5', 1, 2, 3.0D, 9.0D, 1.0D, 'm')"
    columns = "tpep_pickup_datetime, tpep_dropoff_datetime, PULocationID, DOLocationID, trip_distance, fare_amount, tip_amount, source_month"
    zones = spark.createDataFrame([(1,), (2,)], "zone_id int")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = clean.clean_trips(spark.sql(f"SELECT * FROM VALUES {trip} AS t({columns})"), zones).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (row.duration_min, row.time_bin, row.dropoff_bin) == (120 + 0.5 / 60, 6, 14)


def test_no_clock_is_read_for_each_line_item(spark):
    """The limits of a trip's line item are applied before it meets its order, and nothing after that reads a clock."""
    plan = queries.TripModel(queries.model(spark, SMALL).trips, queries.zone_view(spark, SMALL), None)
    rows = clean.clean_trips(plan.trips, plan.zones)
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    above = text[: text.index("(l_orderkey")]
    assert not any(f in text for f in ("unix_micros", "DAY TO SECOND")) and not any(f in above for f in ("hour(", "date_format("))
    joins = [line for line in text.splitlines() if "Join Inner" in line and "l_orderkey" in line]
    assert len(joins) == 1 and not any(part in joins[0] for part in (">=", "<=", "l_extendedprice", "duration"))


def test_kinds_of_events_are_told_after_the_window(spark):
    text = queries_events.event_view(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(" in text and "element_at(" not in text[text.index("Window [") :]
    window = text[text.index("Window [") :].splitlines()[0]
    assert window.index("o_custkey") < window.index("o_orderpriority")


def test_months_are_told_as_formatted(spark):
    days = spark.sql("SELECT explode(array(date'1992-01-31', date'2021-12-01', date'0999-03-04', date'9999-10-09', NULL)) AS d")
    assert all(r.a == r.b for r in days.select(month_text(F.col("d")).alias("a"), F.date_format("d", "yyyy-MM").alias("b")).collect())
