"""Batches of questions about any zone, pair and minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.columns import bin_fraction, clip, low_bin, next_bin, pickup_probability
from wayfare.operators.calibrate import structural_minutes, with_calibrated_minutes, with_pair_names
from wayfare.operators.space import route_at, with_profile_at
from wayfare.plans.params import DEFAULT, Params

#: What a zone without any row answers.
NODE_DEFAULTS = {"posterior": 0.0, "expected_wait": 75.0, "competitors": 0.0, "competition_ratio": 10.0, "supply": 0.0, "node_confidence": 0.05, "expected_driver_revenue": 0.0, "expected_duration_min": 15.0, "expected_distance_miles": 2.0}
ESTIMATES = ("revenue", "minutes", "miles", "revenue_std", "minutes_std", "miles_std", "confidence", "observed_trip_count")


def two_bins(questions: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Each question (with `minute`) twice: for the bin before and after, with time_bin, bin_weight and is_low."""
    t = bin_fraction(F.col("minute"), params)
    both = F.array(F.struct(low_bin(F.col("minute"), params).alias("time_bin"), (1 - t).alias("bin_weight"), F.lit(True).alias("is_low")), F.struct(next_bin(F.col("minute"), params).alias("time_bin"), t.alias("bin_weight"), F.lit(False).alias("is_low")))
    return questions.select("*", F.inline(both))


def node_at(questions: DataFrame, nodes: DataFrame, scenario: str = "medium", params: Params = DEFAULT, competitors: bool = False) -> DataFrame:
    """questions (zone_id, minute, ...) with the node's metrics, linear between bins; the scenario picks wait and competitors."""
    by_scenario = ["expected_wait", *(["competitors"] if competitors else [])]
    metrics = [c for c in NODE_DEFAULTS if c not in ("expected_wait", "competitors")]
    own = nodes.select("zone_id", "time_bin", *metrics, *(F.col(f"{c}_{scenario}").alias(c) for c in by_scenario))
    names = [*metrics, *by_scenario]
    low = own.toDF("zone_id", "_lb", *(f"_l_{c}" for c in names))
    high = own.toDF("zone_id", "_hb", *(f"_h_{c}" for c in names))
    rows = questions.withColumn("_lb", low_bin(F.col("minute"), params)).withColumn("_hb", next_bin(F.col("minute"), params))
    rows = rows.join(low, ["zone_id", "_lb"], "left").join(high, ["zone_id", "_hb"], "left")
    t = bin_fraction(F.col("minute"), params)
    blend = lambda c: (1 - t) * F.coalesce(f"_l_{c}", f"_h_{c}") + t * F.coalesce(f"_h_{c}", f"_l_{c}")
    out = rows.select(*questions.columns, *(F.coalesce(blend(c), F.lit(NODE_DEFAULTS[c])).alias(c) for c in names), F.col("_l_expected_wait").isNull().alias("_a"), F.col("_h_expected_wait").isNull().alias("_b"))
    probability = F.when(F.col("_a") & F.col("_b"), 0.0).otherwise(pickup_probability(F.col("expected_wait"), params.bin_minutes))
    return out.withColumn("pickup_probability", probability).drop("_a", "_b")


def estimate_od_bin(cells: DataFrame, model, params: Params = DEFAULT, direct: bool = True) -> DataFrame:
    """cells (time_bin, origin, destination, ...) with an estimate of each; the first source that has one answers.

    All sources are read once and joined; one ladder of conditions picks. `model` is a TripModel; without `direct` the
    stored estimates are left out, so that the later sources can be examined.
    """
    c = F.col
    key, pair = ["time_bin", "origin", "destination"], ["origin", "destination"]
    rows = cells.withColumn("minute", (c("time_bin") * params.bin_minutes).cast("double"))
    if direct:
        names = {"driver_revenue": "revenue", "duration_min": "minutes", "distance_miles": "miles", "revenue_dev": "revenue_std", "duration_dev": "minutes_std", "distance_dev": "miles_std", "confidence": "confidence", "observed_trip_count": "observed_trip_count", "imputation_layer": "source"}
        rows = rows.join(model.od.select(*key, *(c(a).alias(f"_d_{b}") for a, b in names.items())), key, "left")
    rows = rows.join(model.observed.select(*key, c("trip_count").alias("_o_n"), *(c(f"observed_{a}").alias(f"_o_{b}") for a, b in (("avg_driver_revenue", "revenue"), ("avg_duration_min", "minutes"), ("avg_distance_miles", "miles"), ("revenue_std", "revenue_std"), ("duration_std", "minutes_std"), ("distance_std", "miles_std")))), key, "left")
    short = (("avg_driver_revenue", "revenue"), ("avg_duration_min", "minutes"), ("avg_distance_miles", "miles"), ("revenue_std", "revenue_std"), ("duration_std", "minutes_std"), ("distance_std", "miles_std"))
    rows = rows.join(model.pairs.select(*pair, c("trip_count").alias("_g_n"), *(c(a).alias(f"_g_{b}") for a, b in short)), pair, "left")
    prior = (("driver_revenue", "revenue"), ("duration_min", "minutes"), ("distance_miles", "miles"), ("revenue_std", "revenue_std"), ("duration_std", "minutes_std"), ("distance_std", "miles_std"))
    rows = rows.join(model.temporal.select(*key, c("temporal_weight").alias("_t_w"), *(c(f"temporal_{a}").alias(f"_t_{b}") for a, b in prior)), key, "left")
    rows = rows.join(model.spatial.select(*pair, c("spatial_total").alias("_s_w"), *(c(f"spatial_{a}").alias(f"_s_{b}") for a, b in prior)), pair, "left")
    rows = route_at(with_profile_at(rows, model.profiles, params), model.routes, model.zones, model.profiles, params)
    rows = rows.join(F.broadcast(model.gravity)).join(F.broadcast(model.profiles.agg(F.avg("speed_mph").alias("_mph"), F.avg("revenue_per_mile").alias("_rpm"))))  # one row each
    sr, rr = c("_mph") / c("speed_at"), c("rpm_at") / F.greatest(F.lit(0.1), c("_rpm"))

    n = c("_o_n").cast("double")
    r = n / (n + params.od_prior)
    toward = lambda m, scale: r * c(f"_o_{m}") + (1 - r) * F.when(c("_g_n").isNotNull(), c(f"_g_{m}") * scale).otherwise(c(f"_o_{m}"))
    one = F.lit(1.0)
    at_least = lambda low, x: F.greatest(F.lit(low), x)
    observed = (toward("revenue", rr), toward("minutes", sr), toward("miles", one), at_least(0.5, toward("revenue_std", one)), at_least(1.0, toward("minutes_std", sr)), at_least(0.1, toward("miles_std", one)), clip(r, params.min_confidence, 0.995), n, F.when(n >= 20, "full_observed_dense_eb").otherwise("full_observed_sparse_eb"))
    w = c("_t_w")
    by_time = (c("_t_revenue") * rr, c("_t_minutes") * sr, c("_t_miles"), at_least(0.5, c("_t_revenue_std")), at_least(1.0, c("_t_minutes_std") * sr), at_least(0.1, c("_t_miles_std")), clip(0.15 + 0.70 * w / (w + 30.0), params.min_confidence, 0.88), F.lit(0.0), F.lit("temporal_same_od_eb"))
    g = c("_g_n").cast("double")
    by_pair = (at_least(0.0, c("_g_revenue") * rr), at_least(1.0, c("_g_minutes") * sr), at_least(0.01, c("_g_miles")), at_least(0.5, c("_g_revenue_std")), at_least(1.0, c("_g_minutes_std") * sr), at_least(0.1, c("_g_miles_std")), clip(0.20 + 0.70 * g / (g + 50.0), params.min_confidence, 0.90), F.lit(0.0), F.lit("global_od_time_adjusted"))
    way, drive = at_least(0.01, c("route_miles")), at_least(1.0, c("route_minutes"))
    gravity = at_least(2.5, c("intercept") + c("distance") * way + c("duration") * drive)
    s = F.least(c("_s_w"), F.lit(100.0))
    by_space = (at_least(2.5, 0.55 * c("_s_revenue") * rr + 0.45 * gravity), at_least(1.0, 0.55 * c("_s_minutes") * sr + 0.45 * drive), at_least(0.01, 0.55 * c("_s_miles") + 0.45 * way), at_least(1.0, c("_s_revenue_std")), at_least(2.0, c("_s_minutes_std") * sr), at_least(0.25, c("_s_miles_std")), clip(0.12 + 0.35 * s / (s + 30.0), params.min_confidence, 0.48), F.lit(0.0), F.lit("spatial_neighbor_gravity_eb"))
    fare = 0.55 * gravity + 0.45 * c("rpm_at") * way
    by_gravity = (fare, drive, way, at_least(1.0, 0.35 * fare), at_least(2.0, 0.30 * drive), at_least(0.25, 0.25 * way), clip(0.08 + 0.17 * c("route_confidence"), params.min_confidence, 0.28), F.lit(0.0), F.lit("spatial_gravity_time_fallback"))
    # fixed values above: the ladder's published weights and slopes
    tiers: list[tuple[Column, tuple]] = [(n.isNotNull(), observed), (w > 0, by_time), (g.isNotNull(), by_pair), (c("_s_w") > 0, by_space)]
    if direct:
        tiers.insert(0, (c("_d_revenue").isNotNull(), tuple(c(f"_d_{x}") for x in (*ESTIMATES, "source"))))

    def pick(k: int) -> Column:
        ladder = F.when(tiers[0][0], tiers[0][1][k])
        for condition, values in tiers[1:]:
            ladder = ladder.when(condition, values[k])
        return ladder.otherwise(by_gravity[k])

    chosen = rows.select(*cells.columns, "speed_at", *(pick(k).alias(name) for k, name in enumerate((*ESTIMATES, "source"))))
    return guard(chosen, model.zones, model.calibration, params).select(*cells.columns, *ESTIMATES, "source", "floor_minutes")


def guard(rows: DataFrame, zones: DataFrame, calibration: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """No trip faster than the limit or than most of its calibrated time; adds floor_minutes."""
    way = F.greatest(F.lit(0.01), F.col("miles"))
    rows = with_calibrated_minutes(with_pair_names(rows, zones), calibration, way, F.col("speed_at"), params)
    floor = 0.85 * structural_minutes(way, F.col("speed_at"), params) * F.col("calibration_multiplier")
    return rows.withColumn("floor_minutes", floor).withColumns({"minutes": F.greatest(F.lit(1.0), way / params.mph[1] * 60.0, F.col("floor_minutes"), F.col("minutes")), "revenue": F.greatest(F.lit(0.0), F.col("revenue")), "confidence": clip(F.col("confidence"), params.min_confidence, 0.995)})


def estimate_od(questions: DataFrame, model, params: Params = DEFAULT, direct: bool = True) -> DataFrame:
    """questions (query_id, origin, destination, minute) with estimates at the minute; an unknown zone is an error.

    Both bins around the minute are estimated and mixed; the source is that of the nearer one. A cell (bin and pair) is
    estimated once, whatever the number of questions about it.
    """
    known = model.zones.select("zone_id").distinct()
    checked = questions.join(known.select(F.col("zone_id").alias("origin"), F.lit(True).alias("_o")), "origin", "left").join(known.select(F.col("zone_id").alias("destination"), F.lit(True).alias("_d")), "destination", "left")
    fail = F.raise_error(F.concat(F.lit("unknown zone pair: "), F.col("origin").cast("string"), F.lit("->"), F.col("destination").cast("string"))).cast("int")
    checked = checked.withColumn("origin", F.when(F.col("_o") & F.col("_d"), F.col("origin")).otherwise(fail)).select("query_id", "origin", "destination", F.col("minute").alias("asked"))
    sided = two_bins(checked.withColumnRenamed("asked", "minute"), params).drop("minute")
    cell = ["time_bin", "origin", "destination"]
    rows = sided.join(estimate_od_bin(sided.select(*cell).distinct(), model, params, direct), cell)
    mixed = [F.sum(F.col("bin_weight") * F.col(e)).alias(e) for e in ESTIMATES]
    source = F.max_by("source", F.struct(F.when(F.col("is_low"), F.col("bin_weight") > 0.5).otherwise(F.col("bin_weight") >= 0.5), F.col("bin_weight")))
    return rows.groupBy("query_id", "origin", "destination").agg(*mixed, source.alias("source")).withColumn("is_directly_observed", F.col("observed_trip_count") > 0)


def normalise(od: DataFrame) -> DataFrame:
    """Probabilities without negatives that add up to one in each cell."""
    p = F.greatest("destination_probability", F.lit(0.0))
    total = F.sum(p).over(Window.partitionBy("time_bin", "origin"))
    return od.withColumn("destination_probability", F.when(total > 0, p / total).otherwise(1 / F.count(F.lit(1)).over(Window.partitionBy("time_bin", "origin"))))


def od_options(questions: DataFrame, od: DataFrame) -> DataFrame:
    """questions (query_id, origin, minute) to query_id, destination, probability and mean metrics at the minute."""
    metrics = ("driver_revenue", "duration_min", "distance_miles", "revenue_dev", "duration_dev", "distance_dev", "confidence")
    rows = two_bins(questions).join(od.select("time_bin", "origin", "destination", "destination_probability", *metrics), ["time_bin", "origin"])
    p = F.col("bin_weight") * F.col("destination_probability")
    sums = rows.groupBy("query_id", "origin", "destination").agg(F.sum(p).alias("_p"), *(F.sum(p * F.col(m)).alias(m) for m in metrics))
    total = F.sum(F.greatest("_p", F.lit(0.0))).over(Window.partitionBy("query_id"))
    return sums.select("query_id", "origin", "destination", (F.greatest("_p", F.lit(0.0)) / F.greatest(total, F.lit(1e-12))).alias("probability"), *((F.col(m) / F.greatest("_p", F.lit(1e-12))).alias(m) for m in metrics))


def default_choices(origins: DataFrame, pairs: DataFrame, zones: DataFrame, most: int = 12) -> DataFrame:
    """origin, destination, share for each origin asked: its largest flows, else the first zones alike."""
    order = Window.partitionBy("origin").orderBy(F.desc("trip_count"), "destination")
    largest = pairs.join(origins, "origin", "left_semi").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)
    share = F.col("trip_count") / F.sum("trip_count").over(Window.partitionBy("origin"))
    seen = largest.select("origin", "destination", share.alias("share"))
    first = zones.select("zone_id").distinct().orderBy("zone_id").limit(most)
    alike = first.select(F.col("zone_id").alias("destination"), (1.0 / F.count(F.lit(1)).over(Window.partitionBy())).alias("share"))  # a dozen zones
    return seen.unionByName(origins.join(seen, "origin", "left_anti").crossJoin(F.broadcast(alike)).select("origin", "destination", "share"))


def od_options_or_default(questions: DataFrame, model, od: DataFrame | None = None, pairs: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """od_options, and where an origin has no stored row around the minute the default choices, estimated through all sources.

    Adds is_default. od and pairs stand in for the model's own stored estimates and flows. Each (origin, destination) of a
    default is estimated once a bin, whatever the number of questions.
    """
    metrics = {"revenue": "driver_revenue", "minutes": "duration_min", "miles": "distance_miles", "revenue_std": "revenue_dev", "minutes_std": "duration_dev", "miles_std": "distance_dev", "confidence": "confidence"}
    od, pairs = model.od if od is None else od, model.pairs if pairs is None else pairs
    stored = od_options(questions, od).withColumn("is_default", F.lit(False))
    sided = two_bins(questions, params)
    without = questions.join(sided.join(od.select("time_bin", "origin").distinct(), ["time_bin", "origin"], "left_semi").select("query_id").distinct(), "query_id", "left_anti")
    choices = default_choices(without.select("origin").distinct(), pairs, model.zones)
    asked = two_bins(without, params)
    cells = asked.select("time_bin", "origin").distinct().join(choices, "origin")
    known = estimate_od_bin(cells, model, params).select("time_bin", "origin", "destination", "share", *metrics)
    rows = asked.join(known, ["time_bin", "origin"])
    mixed = [F.sum(F.col("bin_weight") * F.col(a)).alias(b) for a, b in metrics.items()]
    answered = rows.groupBy("query_id", "origin", "destination").agg(F.first("share").alias("probability"), *mixed).withColumn("is_default", F.lit(True))
    return stored.unionByName(answered.select(stored.columns))
