"""Origin-destination-time estimation by hierarchical empirical Bayes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.columns import clip, row_mean, weighted_mean
from wayfare.operators.calibrate import with_calibrated_minutes, with_pair_names
from wayfare.operators.nodes import neighbour_bins
from wayfare.operators.space import zone_pairs
from wayfare.plans.params import DEFAULT, Params

MEASURES = ("driver_revenue", "duration_min", "distance_miles")


def od_support(observed: DataFrame, pairs: DataFrame, zones: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """time_bin, origin, destination, score: up to 20 destinations of each bin and origin; ties go to the smaller id.

    Scores add the cell's trips, a share of the origin's largest flows, and a bonus for the most popular destinations. The
    origin itself joins, with score 0, where there is room.
    """
    k = params.destinations
    spark = zones.sparkSession
    cells = zones.select(F.col("zone_id").alias("origin")).distinct().crossJoin(F.broadcast(spark.range(params.bins).select(F.col("id").cast("int").alias("time_bin"))))  # 96 rows
    flows = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("trip_count"), "destination"))).filter(F.col("rank") <= k)
    popular = pairs.groupBy("destination").agg(F.sum("trip_count").alias("n")).orderBy(F.desc("n"), "destination").limit(k)
    popular = popular.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "destination")) - 1).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy()))  # k rows
    scored = observed.select("time_bin", "origin", "destination", F.col("trip_count").cast("double").alias("score"))
    scored = scored.unionByName(cells.join(flows, "origin").select("time_bin", "origin", "destination", (params.global_discount * F.col("trip_count")).alias("score")))
    scored = scored.unionByName(cells.crossJoin(F.broadcast(popular)).select("time_bin", "origin", "destination", F.greatest(F.lit(0.1), 1 - F.col("rank") / F.greatest("of", F.lit(1))).alias("score")))
    scored = scored.unionByName(cells.select("time_bin", "origin", F.col("origin").alias("destination"), F.lit(0.0).alias("score")))
    summed = scored.groupBy("time_bin", "origin", "destination").agg(F.sum("score").alias("score"))
    order = Window.partitionBy("time_bin", "origin").orderBy(F.desc("score"), "destination")
    return summed.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def od_temporal_prior(observed: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Means of the same pair in the bins around, weighted by trips and nearness; temporal_weight is their sum."""
    spread = observed.withColumn("_n", F.explode(neighbour_bins(params)))
    weight = F.col("trip_count") * F.col("_n.weight")
    to = F.pmod(F.col("time_bin") + F.col("_n.offset"), F.lit(params.bins)).cast("int")
    means = [weighted_mean(F.col(f"observed_avg_{c}"), weight).alias(f"temporal_{c}") for c in MEASURES]
    deviations = [weighted_mean(F.col(f"observed_{m}_std"), weight).alias(f"temporal_{m}_std") for m in ("revenue", "duration", "distance")]
    return spread.groupBy(to.alias("time_bin"), "origin", "destination").agg(F.sum(weight).alias("temporal_weight"), *means, *deviations)


def od_spatial_prior(pairs: DataFrame, near: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Means over the origin's neighbours to the destination and the origin to the destination's neighbours."""
    n = near.select("zone_id", "neighbour", F.exp(-F.col("miles") / params.spatial_decay).alias("_near"))
    columns = [*(f"avg_{c}" for c in MEASURES), "revenue_std", "duration_std", "distance_std"]
    weight = (F.col("trip_count") * F.col("_near")).alias("_w")
    from_near = pairs.join(n, F.col("origin") == F.col("neighbour")).select(F.col("zone_id").alias("origin"), "destination", weight, *columns)
    to_near = pairs.join(n, F.col("destination") == F.col("neighbour")).select("origin", F.col("zone_id").alias("destination"), weight, *columns)
    means = [weighted_mean(F.col(c), F.col("_w")).alias(f"spatial_{c.removeprefix('avg_')}") for c in columns]
    return from_near.unionByName(to_near).groupBy("origin", "destination").agg(F.sum("_w").alias("spatial_total"), *means)


def od_estimates(observed: DataFrame, pairs: DataFrame, nodes: DataFrame, zones: DataFrame, temporal: DataFrame, spatial: DataFrame, profiles: DataFrame, gravity: DataFrame, calibration: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per supported cell with every prior, its weight, the blend, confidence, layer and probability."""
    c = F.col
    rows = od_support(observed, pairs, zones, params).drop("score").join(zone_pairs(zones), ["origin", "destination"])
    rows = rows.join(observed.withColumnRenamed("trip_count", "_n"), ["time_bin", "origin", "destination"], "left")
    rows = rows.join(pairs.withColumnRenamed("trip_count", "_pair_n"), ["origin", "destination"], "left")
    rows = rows.join(temporal.drop("temporal_revenue_std", "temporal_duration_std", "temporal_distance_std"), ["time_bin", "origin", "destination"], "left")
    rows = rows.join(spatial.drop("spatial_revenue_std", "spatial_duration_std", "spatial_distance_std"), ["origin", "destination"], "left")
    rows = rows.join(F.broadcast(profiles.select("time_bin", clip(c("speed_mph"), *params.mph).alias("_mph"))), "time_bin")  # one row per bin
    rows = rows.join(F.broadcast(gravity)).join(F.broadcast(profiles.agg(F.avg("speed_mph").alias("_all_mph"))))  # one row each
    rows = rows.join(nodes.select("time_bin", c("zone_id").alias("origin"), c("posterior").alias("_rate")), ["time_bin", "origin"], "left")
    # pairs without trips: what their flows add up to is the origin's total
    totals = pairs.groupBy("origin").agg(F.sum("trip_count").alias("_origin_n"))
    rows = rows.join(totals, "origin", "left")
    rows = with_calibrated_minutes(with_pair_names(rows, zones), calibration, c("miles"), c("_mph"), params, out="gravity_duration_min")
    count, pair_n = F.coalesce("_n", F.lit(0)).cast("double"), F.coalesce("_pair_n", F.lit(0)).cast("double")
    seen = c("_pair_n").isNotNull()
    rows = rows.withColumn("gravity_driver_revenue", F.greatest(F.lit(0.0), c("intercept") + c("distance") * c("miles") + c("duration") * c("gravity_duration_min"))).withColumn("gravity_distance_miles", c("miles"))
    rows = rows.withColumns({
        "observed_trip_count": count, "pair_trip_count": pair_n,
        "global_driver_revenue": F.when(seen, c("avg_driver_revenue")).otherwise(c("mean_revenue")),
        "global_duration_min": F.when(seen, c("avg_duration_min") * c("_all_mph") / c("_mph")).otherwise(c("gravity_duration_min")),
        "global_distance_miles": F.when(seen, c("avg_distance_miles")).otherwise(c("miles")),
        "temporal_total": F.coalesce("temporal_weight", F.lit(0.0)), "spatial_total": F.coalesce("spatial_total", F.lit(0.0)),
        "global_weight": F.least(pair_n * params.global_discount, F.lit(25.0)), "gravity_weight": F.lit(params.gravity_weight),
    })
    rows = rows.withColumns({
        "temporal_weight": F.least("temporal_total", F.lit(20.0)), "spatial_weight": F.least("spatial_total", F.lit(20.0)),
        **{f"temporal_{m}": F.coalesce(f"temporal_{m}", f"global_{m}") for m in MEASURES}, **{f"spatial_{m}": F.coalesce(f"spatial_{m}", f"global_{m}") for m in MEASURES},
    })
    sources = [("observed_avg_", "observed_trip_count"), ("temporal_", "temporal_weight"), ("spatial_", "spatial_weight"), ("global_", "global_weight"), ("gravity_", "gravity_weight")]
    blend = {m: row_mean([(c(f"{p}{m}"), c(w)) for p, w in sources], c(f"gravity_{m}"), geometric=m == "duration_min") for m in MEASURES}
    effective = c("observed_trip_count") + 0.5 * c("temporal_total") + 0.25 * c("spatial_weight") + 0.2 * c("pair_trip_count")
    floors = {"revenue": (1.0, 0.35, "gravity_driver_revenue"), "duration": (2.0, 0.30, "gravity_duration_min"), "distance": (0.25, 0.25, "gravity_distance_miles")}
    deviation = lambda m: F.when(c("observed_trip_count") >= 2, c(f"observed_{m}_std")).when(seen, c(f"{m}_std")).otherwise(F.greatest(F.lit(floors[m][0]), floors[m][1] * c(floors[m][2])))
    layer = (
        F.when(c("observed_trip_count") >= 20, "observed_dense_eb").when(c("observed_trip_count") > 0, "observed_sparse_eb").when(c("temporal_total") > 0, "temporal_eb")
        .when(c("spatial_weight") > 0, "spatial_eb").when(c("pair_trip_count") > 0, "global_od_eb").otherwise("gravity_prior")
    )
    flow = F.when(c("_origin_n") > 0, c("pair_trip_count") / c("_origin_n")).otherwise(0.0)
    cell = Window.partitionBy("time_bin", "origin")
    rows = rows.withColumn("_prior", 0.8 * flow + 0.2 * F.exp(-c("miles") / 8.0))
    rows = rows.withColumn("_prior", F.when(F.sum("_prior").over(cell) > 0, c("_prior") / F.sum("_prior").over(cell)).otherwise(1 / F.count(F.lit(1)).over(cell)))
    rows = rows.withColumn("_top", c("observed_trip_count") + params.dirichlet * c("_prior"))
    probability = F.when(F.sum("_top").over(cell) > 0, c("_top") / F.sum("_top").over(cell)).otherwise(1 / F.count(F.lit(1)).over(cell))
    return rows.select(
        "time_bin", "origin", "destination", "observed_trip_count",
        blend["driver_revenue"].alias("driver_revenue"), F.greatest(F.lit(1.0), blend["duration_min"], 0.85 * c("gravity_duration_min")).alias("duration_min"), F.greatest(F.lit(0.01), blend["distance_miles"]).alias("distance_miles"),
        *(deviation(m).alias(f"{m}_dev") for m in floors), clip(effective / (effective + params.od_prior), params.min_confidence, 0.995).alias("confidence"), layer.alias("imputation_layer"),
        effective.alias("effective_sample_size"), "temporal_weight", "spatial_weight", "global_weight", "gravity_weight",
        *(f"{p}{m}" for p, _ in sources for m in MEASURES), "calibration_multiplier", "distance_band", "borough_pair", c("_prior").alias("destination_prior"),
        probability.alias("destination_probability"), (probability * F.greatest(F.coalesce("_rate", F.lit(0.0)), F.lit(0.0))).alias("trips_per_bin_day"),
    )
