"""Aggregates of clean trips. Sums and sums of squares are kept, so that partial results can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import clip, pooled_std, weighted_mean
from wayfare.plans.params import DEFAULT, Params

MEASURES = {"revenue": "driver_revenue", "duration": "duration_min", "distance": "distance_miles"}
SUMS = ["trip_count", *(f"{m}_{k}" for m in MEASURES for k in ("sum", "sumsq"))]


def _sums() -> list[Column]:
    sums = [s for m, c in MEASURES.items() for s in (F.sum(c).alias(f"{m}_sum"), F.sum(F.col(c) * F.col(c)).alias(f"{m}_sumsq"))]
    return [F.count(F.lit(1)).alias("trip_count"), *sums]


def od_time_aggregate(clean: DataFrame) -> DataFrame:
    """Count, sums and sums of squares for each time bin, origin and destination."""
    return clean.groupBy("time_bin", "origin", "destination").agg(*_sums())


#: What trip_partials groups by: cells of a bin and a pair, where and when trips end, and the days of a month's file.
CELL, ENDS, DAY = ("time_bin", "origin", "destination"), ("dropoff_bin", "dropoff_zone"), ("source_month", "pickup_date")


def trip_partials(clean: DataFrame) -> DataFrame:
    """One pass over the trips: sums of each cell, counts of each zone's ends by bin and of each day, told by `part`.

    All three are bounded by the city and the calendar, however many trips there are.
    """
    rows = clean.withColumn("dropoff_zone", F.col("destination"))
    keys = (*CELL, *ENDS, *DAY)
    grouped = rows.groupingSets([[F.col(c) for c in k] for k in (CELL, ENDS, DAY)], *keys)
    part = F.when(F.grouping("time_bin") == 0, "cell").when(F.grouping("dropoff_bin") == 0, "ends").otherwise("day")
    return grouped.agg(part.alias("part"), *_sums()).select("part", *keys, *SUMS)


def partial_cells(partials: DataFrame) -> DataFrame:
    """The rows of od_time_aggregate from trip_partials."""
    return partials.filter("part = 'cell'").select(*CELL, *SUMS)


def partial_pickups(partials: DataFrame) -> DataFrame:
    return partials.filter("part = 'cell'").groupBy("time_bin", F.col("origin").alias("zone_id")).agg(F.sum("trip_count").alias("pickup_count"))


def partial_dropoffs(partials: DataFrame) -> DataFrame:
    return partials.filter("part = 'ends'").select(F.col("dropoff_bin").alias("time_bin"), F.col("dropoff_zone").alias("zone_id"), F.col("trip_count").alias("dropoff_count"))


def partial_days(partials: DataFrame) -> DataFrame:
    return partials.filter("part = 'day'").agg(F.count(F.lit(1)).alias("service_days"))


def pickup_counts(clean: DataFrame) -> DataFrame:
    return clean.groupBy("time_bin", F.col("origin").alias("zone_id")).agg(F.count(F.lit(1)).alias("pickup_count"))


def dropoff_counts(clean: DataFrame) -> DataFrame:
    return clean.groupBy(F.col("dropoff_bin").alias("time_bin"), F.col("destination").alias("zone_id")).agg(F.count(F.lit(1)).alias("dropoff_count"))


def service_days(clean: DataFrame) -> DataFrame:
    """Distinct pickup dates of each month's file, summed over files: a date in two files counts twice."""
    return clean.select("source_month", "pickup_date").distinct().agg(F.count(F.lit(1)).alias("service_days"))


def combine_aggregates(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Merges saved partial aggregates: all other columns are summed by key."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in whole.columns if c not in keys))


def _averages(df: DataFrame, prefix: str) -> list:
    n = F.col("trip_count")
    means = [(F.col(f"{m}_sum") / n).alias(f"{prefix}avg_{c}") for m, c in MEASURES.items()]
    return means + [pooled_std(F.col(f"{m}_sum"), F.col(f"{m}_sumsq"), n).alias(f"{prefix}{m}_std") for m in MEASURES]


def observed_od(od: DataFrame) -> DataFrame:
    """Averages and pooled deviations of each observed cell."""
    return od.select("time_bin", "origin", "destination", "trip_count", *_averages(od, "observed_"))


def global_od(od: DataFrame) -> DataFrame:
    """The same for each pair over all bins."""
    pairs = od.groupBy("origin", "destination").agg(*(F.sum(c).alias(c) for c in SUMS))
    return pairs.select("origin", "destination", "trip_count", *_averages(pairs, ""))


def time_profiles(observed: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Speed and revenue per mile of each bin, weighted by trips; an empty bin has the mean over all trips."""
    miles, minutes, revenue = (F.col(f"observed_avg_{c}") for c in ("distance_miles", "duration_min", "driver_revenue"))
    moving = observed.filter((miles > 0) & (minutes > 0))
    rows = moving.select("time_bin", "trip_count", (60.0 * miles / minutes).alias("mph"), (revenue / F.greatest(miles, F.lit(0.1))).alias("rpm"))
    means = [weighted_mean(F.col("mph"), F.col("trip_count").cast("double")).alias("speed"), weighted_mean(F.col("rpm"), F.col("trip_count").cast("double")).alias("rate")]
    own, everywhere = rows.groupBy("time_bin").agg(*means), rows.agg(*(m.alias(f"all_{k}") for k, m in zip(("speed", "rate"), means, strict=True)))
    bins = observed.sparkSession.range(params.bins).select(F.col("id").cast("int").alias("time_bin"))
    joined = bins.join(own, "time_bin", "left").join(F.broadcast(everywhere))  # one row
    return joined.select("time_bin", clip(F.coalesce("speed", "all_speed", F.lit(params.fallback_mph)), *params.mph).alias("speed_mph"), F.greatest(F.coalesce("rate", "all_rate", F.lit(4.0)), F.lit(0.1)).alias("revenue_per_mile"))


def fit_gravity(pairs: DataFrame) -> DataFrame:
    """Weighted least squares of a pair's revenue on distance and duration: one row of coefficients and means.

    Rows weigh by their count in the fit and by its root in the means, as published. The equations are those of deviations
    from the weighted means: where duration nearly follows distance, sums of raw squares would lose half of the digits.
    Pairs on one line have no slopes: all coefficients are 0, as in an empty table.
    """
    w, x, z, y = F.col("trip_count").cast("double"), F.col("avg_distance_miles"), F.col("avg_duration_min"), F.col("avg_driver_revenue")
    centre = pairs.agg(*((F.sum(w * v) / F.sum(w)).alias(k) for k, v in {"_x": x, "_z": z, "_y": y}.items()))
    dx, dz, dy = x - F.col("_x"), z - F.col("_z"), y - F.col("_y")
    terms = {"xx": w * dx * dx, "xz": w * dx * dz, "zz": w * dz * dz, "xy": w * dx * dy, "zy": w * dz * dy}
    root = F.sqrt(w)
    means = {"mean_revenue": y, "mean_duration": z, "mean_distance": x}
    rows = pairs.join(F.broadcast(centre))  # one row
    sums = rows.agg(*(F.sum(v).alias(k) for k, v in terms.items()), *((F.sum(root * v) / F.sum(root)).alias(k) for k, v in means.items()), *(F.max(k).alias(k) for k in ("_x", "_z", "_y")))
    c = F.col
    det = F.nullif(c("xx") * c("zz") - c("xz") * c("xz"), F.lit(0.0))
    slopes = sums.select("*", ((c("xy") * c("zz") - c("xz") * c("zy")) / det).alias("_distance"), ((c("xx") * c("zy") - c("xz") * c("xy")) / det).alias("_duration"))
    solved = {"intercept": c("_y") - c("_distance") * c("_x") - c("_duration") * c("_z"), "distance": c("_distance"), "duration": c("_duration")}
    return slopes.select(*(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in solved.items()), *means)
