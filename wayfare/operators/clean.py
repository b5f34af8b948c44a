"""Cleaning of trip records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import DAY_MICROS, day_micros, micros_bin
from wayfare.plans.params import DEFAULT, Params

#: When a trip starts and how long it takes, as numbers: its date, microseconds since that midnight, microseconds of the trip.
CLOCK = ("pickup_date", "pickup_micros", "duration_micros")
KEYS = (*CLOCK, "PULocationID", "DOLocationID", "trip_distance", "fare_amount")


def on_clock(trips: DataFrame) -> DataFrame:
    """Trips with the columns of CLOCK in place of both datetimes; trips that have them stay as they are.

    Dates and clocks are read once for each trip: what follows, filters that move below joins too, is arithmetic.
    """
    if set(CLOCK) <= set(trips.columns):
        return trips
    start, end = F.col("tpep_pickup_datetime"), F.col("tpep_dropoff_datetime")
    took = F.date_diff(F.to_date(end), F.to_date(start)).cast("long") * DAY_MICROS + day_micros(end) - day_micros(start)
    rest = [c for c in trips.columns if c not in ("tpep_pickup_datetime", "tpep_dropoff_datetime")]
    return trips.select(*rest, F.to_date(start).alias("pickup_date"), day_micros(start).alias("pickup_micros"), took.alias("duration_micros"))


def clean_trips(trips: DataFrame, zones: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Trips inside all limits between known zones, with duration, revenue and both time bins.

    A row with a null key, an unknown zone, or a value outside its (inclusive) limits goes; a null or negative tip counts
    as none. Zones are few and joined by what Spark finds best.
    """
    known = zones.select("zone_id").distinct()
    present = reduce(Column.__and__, (F.col(c).isNotNull() for c in KEYS))  # apart, so that each moves to its side of a join; limits drop NaN
    rows = on_clock(trips).filter(present).withColumn("duration_min", F.col("duration_micros") / F.lit(60_000_000.0))
    rows = rows.filter(F.col("fare_amount").between(*params.fare) & F.col("trip_distance").between(*params.miles) & F.col("duration_min").between(*params.minutes))
    revenue = params.revenue_share * (F.col("fare_amount") + F.greatest(F.coalesce("tip_amount", F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("driver_revenue", revenue).filter("driver_revenue > 0")
    rows = rows.join(known.withColumnRenamed("zone_id", "PULocationID"), "PULocationID", "left_semi").join(known.withColumnRenamed("zone_id", "DOLocationID"), "DOLocationID", "left_semi")
    start = F.col("pickup_micros")
    return rows.select(
        "source_month", "pickup_date", micros_bin(start, params).alias("time_bin"), micros_bin(start + F.col("duration_micros"), params).alias("dropoff_bin"),
        F.col("PULocationID").alias("origin"), F.col("DOLocationID").alias("destination"), "driver_revenue", "duration_min", F.col("trip_distance").alias("distance_miles"),
    )
