"""Calibration of structural trip durations (miles over the bin's speed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import airport_pair, borough_pair, clip, distance_band, weighted_mean
from wayfare.plans.params import DEFAULT, Params

GROUPS = ("distance_band", "borough_pair", "airport_pair", "time_bin")


def structural_minutes(miles: Column, mph: Column, params: Params = DEFAULT) -> Column:
    return F.greatest(F.lit(1.0), miles / F.greatest(F.coalesce(mph, F.lit(params.fallback_mph)), F.lit(params.mph[0])) * 60.0)


def shrunk_ratio(raw: Column, n: Column, overall: Column, params: Params = DEFAULT) -> Column:
    """A group's ratio, shrunk toward the overall one and relative to it."""
    reliability = n / (n + params.calibration_shrinkage)
    return clip((reliability * raw + (1 - reliability) * overall) / F.greatest(overall, F.lit(1e-9)), 0.75, 1.35)


def with_pair_names(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds borough_pair and airport_pair to rows with origin and destination."""
    names = zones.select("zone_id", "borough", "zone_name")
    both = df.join(names.toDF("origin", "_ob", "_on"), "origin", "left").join(names.toDF("destination", "_db", "_dn"), "destination", "left")
    unknown = lambda c: F.coalesce(c, F.lit("Unknown"))
    return both.select(*df.columns, borough_pair(unknown("_ob"), unknown("_db")).alias("borough_pair"), airport_pair(F.col("_on"), F.col("_dn")).alias("airport_pair"))


def duration_calibration(observed: DataFrame, zones: DataFrame, profiles: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """kind, key, factor, trips: the four kinds of groups with enough trips, and one row of kind `global` (clipped).

    All kinds come from one pass of grouping sets.
    """
    miles, minutes = F.col("observed_avg_distance_miles"), F.col("observed_avg_duration_min")
    rows = observed.filter((miles > 0) & (minutes > 0)).join(profiles.select("time_bin", "speed_mph"), "time_bin", "left")
    rows = rows.select("time_bin", "origin", "destination", "trip_count", distance_band(miles, params).alias("distance_band"), clip(minutes / structural_minutes(miles, F.col("speed_mph"), params), 0.35, 3.0).alias("ratio"))
    rows = with_pair_names(rows, zones)
    keys = [F.col(g) for g in GROUPS]
    mean = weighted_mean(F.col("ratio"), F.col("trip_count").cast("double"))
    grouped = rows.groupingSets([*([k] for k in keys), []], *keys).agg(mean.alias("raw"), F.sum("trip_count").alias("trips"), F.grouping_id(*keys).alias("level"))
    everywhere = grouped.filter(F.col("level") == 2 ** len(GROUPS) - 1).select(F.coalesce("raw", F.lit(1.0)).alias("overall"))
    kind, key = F.lit("global"), F.lit("")
    for k, g in enumerate(GROUPS):
        here = F.col("level") == 2 ** len(GROUPS) - 1 - 2 ** (len(GROUPS) - 1 - k)
        kind, key = F.when(here, g).otherwise(kind), F.when(here, F.col(g).cast("string")).otherwise(key)
    joined = grouped.withColumn("kind", kind).withColumn("key", key).join(F.broadcast(everywhere))  # one row
    is_global = F.col("kind") == "global"
    factor = F.when(is_global, clip(F.col("overall"), *params.calibration)).otherwise(shrunk_ratio(F.col("raw"), F.col("trips"), F.col("overall"), params))
    return joined.filter(is_global | (F.col("trips") >= params.calibration_count)).select("kind", "key", factor.alias("factor"), F.coalesce("trips", F.lit(0)).alias("trips"))


def with_calibrated_minutes(df: DataFrame, calibration: DataFrame, miles: Column, mph: Column, params: Params = DEFAULT, out: str = "calibrated_minutes") -> DataFrame:
    """Adds the calibrated duration and its multiplier; df has time_bin, borough_pair and airport_pair.

    A group without a factor counts as one.
    """
    rows = df.withColumn("distance_band", distance_band(miles, params))
    product = F.coalesce("_global", F.lit(1.0))
    base = calibration.filter("kind = 'global'").select(F.col("factor").alias("_global"))
    rows = rows.join(F.broadcast(base), how="left")  # one row
    for g in GROUPS:
        own = calibration.filter(F.col("kind") == g).select(F.col("key").alias(f"_k_{g}"), F.col("factor").alias(f"_f_{g}"))
        rows = rows.join(own, F.col(g).cast("string") == F.col(f"_k_{g}"), "left")
        product = product * F.coalesce(f"_f_{g}", F.lit(1.0))
    multiplier = clip(product, *params.calibration)
    rows = rows.withColumn("calibration_multiplier", multiplier).withColumn(out, F.greatest(F.lit(1.0), structural_minutes(miles, mph, params) * F.col("calibration_multiplier")))
    return rows.drop("_global", *(f"_{p}_{g}" for g in GROUPS for p in "kf"))
