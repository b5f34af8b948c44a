"""Metrics of zones and time bins: demand posterior, latent supply, waits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.columns import clip, pickup_probability, row_mean, weighted_mean
from wayfare.plans.params import DEFAULT, Params


def node_grid(pickups: DataFrame, dropoffs: DataFrame, days: DataFrame, zones: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Every bin of every zone, with counts (0 where none) and counts per service day."""
    bins = zones.sparkSession.range(params.bins).select(F.col("id").cast("int").alias("time_bin"))
    grid = zones.select("zone_id").distinct().crossJoin(F.broadcast(bins))  # 96 rows
    full = grid.join(pickups, ["time_bin", "zone_id"], "left").join(dropoffs, ["time_bin", "zone_id"], "left").na.fill(0, ["pickup_count", "dropoff_count"])
    exposure = F.greatest(F.col("service_days").cast("double"), F.lit(1.0))
    full = full.join(F.broadcast(days))  # one row
    return full.select("time_bin", "zone_id", "pickup_count", "dropoff_count", "service_days", (F.col("pickup_count") / exposure).alias("raw_pickups"), (F.col("dropoff_count") / exposure).alias("raw_dropoffs"))


def marginal_rates(grid: DataFrame) -> DataFrame:
    """Adds the zone's, the bin's and the grand mean rate."""
    rate = F.avg("raw_pickups")
    return grid.join(grid.groupBy("zone_id").agg(rate.alias("zone_rate")), "zone_id").join(grid.groupBy("time_bin").agg(rate.alias("bin_rate")), "time_bin").join(F.broadcast(grid.agg(rate.alias("grand_rate"))))


def neighbour_bins(params: Params = DEFAULT):
    """Array of (offset, weight) of the circular bins around one."""
    n = params.temporal_bins
    return F.array(*(F.struct(F.lit(s * d).alias("offset"), F.lit(math.exp(-d / params.temporal_decay)).alias("weight")) for d in range(1, n + 1) for s in (-1, 1)))


def temporal_prior(grid: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """time_bin, zone_id, temporal_prior: weighted mean of the bins around."""
    spread = grid.select("time_bin", "zone_id", "raw_pickups", F.explode(neighbour_bins(params)).alias("n"))
    to = F.pmod(F.col("time_bin") + F.col("n.offset"), F.lit(params.bins)).cast("int")
    return spread.groupBy(to.alias("time_bin"), "zone_id").agg(weighted_mean(F.col("raw_pickups"), F.col("n.weight")).alias("temporal_prior"))


def spatial_prior(grid: DataFrame, near: DataFrame, value: str, params: Params = DEFAULT) -> DataFrame:
    """time_bin, zone_id, spatial_prior: weighted mean of the nearest zones in the same bin. near: zone_id, neighbour, miles."""
    joined = near.join(grid.select("time_bin", F.col("zone_id").alias("neighbour"), value), "neighbour")
    return joined.groupBy("time_bin", "zone_id").agg(weighted_mean(F.col(value), F.exp(-F.col("miles") / params.spatial_decay)).alias("spatial_prior"))


def node_posterior(grid: DataFrame, near: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Adds both priors, the posterior rate, its confidence and its layer."""
    rows = marginal_rates(grid).join(temporal_prior(grid, params), ["time_bin", "zone_id"], "left").join(spatial_prior(grid, near, "raw_pickups", params), ["time_bin", "zone_id"], "left")
    rows = rows.withColumn("temporal_prior", F.coalesce("temporal_prior", "zone_rate")).withColumn("spatial_prior", F.coalesce("spatial_prior", "grand_rate"))
    parts = zip(("temporal_prior", "spatial_prior", "zone_rate", "bin_rate", "grand_rate"), (4.0, 2.0, 3.0, 2.0, 1.0), strict=True)
    prior = row_mean([(F.col(c), F.lit(w)) for c, w in parts], F.col("grand_rate"))
    n = F.col("pickup_count")
    r = n / (n + params.node_prior)
    layer = F.when(n >= 20, "observed_dense_eb").when(n > 0, "observed_sparse_eb").when(F.col("temporal_prior") > 0, "temporal_spatial_eb").otherwise("global_prior")
    return rows.select("time_bin", "zone_id", "pickup_count", "dropoff_count", "service_days", "raw_pickups", "raw_dropoffs", "temporal_prior", "spatial_prior", F.greatest(r * F.col("raw_pickups") + (1 - r) * prior, F.lit(1e-8)).alias("posterior"), clip(r, params.min_confidence, 0.995).alias("node_confidence"), layer.alias("node_layer"))


def latent_stock(nodes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """time_bin, zone_id, stock: the daily recurrence of vacant cars, run until a synthetic day repeats.

    A zone's day is one array of a row; zones don't depend on each other.
    """
    n = params.bins
    day = nodes.groupBy("zone_id").agg(F.sort_array(F.collect_list(F.struct("time_bin", F.col("posterior").alias("p"), F.col("raw_dropoffs").alias("d")))).alias("day"))
    keep, pull, drain, floor = params.stock_persistence, params.demand_attraction, params.pickup_depletion, params.supply_floor
    history = F.lit(floor)
    for lag in range(1, params.stock_history_bins + 1):
        at = F.element_at("day", -lag)
        history = history + keep ** (lag - 1) * (at["d"] + pull * at["p"])

    def step(acc, k):
        now, before = F.get(F.col("day"), F.pmod(k, F.lit(n))), F.get(F.col("day"), F.pmod(k - 1, F.lit(n)))
        stock = F.greatest(F.lit(floor), keep * acc["stock"] + before["d"] + pull * before["p"] - drain * now["p"])
        last = k >= (params.stock_days - 1) * n
        return F.struct(stock.alias("stock"), F.when(last, F.concat(acc["out"], F.array(stock))).otherwise(acc["out"]).alias("out"))

    start = F.struct(history.cast("double").alias("stock"), F.array().cast("array<double>").alias("out"))
    cycle = F.aggregate(F.sequence(F.lit(0), F.lit(params.stock_days * n - 1)), start, step, lambda acc: acc["out"])
    return day.select("zone_id", F.posexplode(cycle).alias("time_bin", "stock"))


def diffuse_supply(stock: DataFrame, near: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """time_bin, zone_id, supply: most of the own stock and some of the neighbours' mean."""
    around = spatial_prior(stock, near, "stock", params)
    share = params.supply_diffusion
    return stock.join(around, ["time_bin", "zone_id"], "left").select("time_bin", "zone_id", ((1 - share) * F.col("stock") + share * F.coalesce("spatial_prior", "stock")).alias("supply"))


def node_metrics(posterior: DataFrame, supply: DataFrame, zones: DataFrame, params: Params = DEFAULT, scenario: str = "medium") -> DataFrame:
    """Adds supply, queue pressure (competition_ratio), waits and competitors of each scenario; `scenario` is active."""
    if scenario not in params.competition:
        raise ValueError(f"unknown competition scenario: {scenario}")
    half = posterior.filter("posterior > 0").agg(F.coalesce(F.percentile("posterior", F.lit(0.5)), F.lit(1.0)).alias("_half"))
    floor = F.greatest(F.lit(0.05), 0.05 * F.col("_half"))
    rows = posterior.join(supply, ["time_bin", "zone_id"]).join(F.broadcast(half))  # one row
    rows = rows.withColumn("competition_ratio", (F.col("supply") + params.supply_floor) / (F.col("posterior") + floor)).drop("_half")
    middle = rows.filter("competition_ratio > 0").agg(F.coalesce(F.percentile("competition_ratio", F.lit(0.5)), F.lit(1.0)).alias("_middle"))
    airport = zones.select("zone_id", F.lower(F.coalesce("zone_name", F.lit(""))).contains("airport").alias("_airport"))
    rows = rows.join(airport, "zone_id", "left").join(F.broadcast(middle))  # one row
    queue = F.when(F.col("_airport"), params.airport_queue).otherwise(1.0)
    for s, m in params.competition.items():
        rows = rows.withColumn(f"expected_wait_{s}", clip(params.reference_wait / F.col("_middle") * F.col("competition_ratio") * m * queue, *params.wait))
    arrivals = F.greatest("posterior", F.lit(1e-8)) / params.bin_minutes
    for s in params.competition:
        rows = rows.withColumn(f"competitors_{s}", F.greatest(F.col(f"expected_wait_{s}") * arrivals - 1, F.lit(0.0)))
    rows = rows.withColumn("expected_wait", F.col(f"expected_wait_{scenario}")).withColumn("competition_scenario", F.lit(scenario))
    return rows.withColumn("pickup_probability", pickup_probability(F.col("expected_wait"), params.bin_minutes)).drop("_middle", "_airport")


def attach_trip_expectations(nodes: DataFrame, od: DataFrame) -> DataFrame:
    """Adds the expected revenue, minutes and miles of a trip from each cell; 0, 15 and 2 where there are no rows."""
    p = F.col("destination_probability")
    sums = od.groupBy("time_bin", F.col("origin").alias("zone_id")).agg(*(F.sum(p * F.col(c)).alias(f"expected_{c}") for c in ("driver_revenue", "duration_min", "distance_miles")))
    return nodes.join(sums, ["time_bin", "zone_id"], "left").na.fill({"expected_driver_revenue": 0.0, "expected_duration_min": 15.0, "expected_distance_miles": 2.0})


def pickup_scale(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.greatest(F.percentile("posterior", F.lit(0.95)), F.lit(1.0)).alias("pickup_scale"))


def bin_leaders(nodes: DataFrame, metrics: list[tuple[str, bool]], k: int) -> DataFrame:
    """time_bin, zone_id of the first k zones by any of the metrics (name, whether less is better)."""
    rows = nodes
    for c, ascending in metrics:
        order = Window.partitionBy("time_bin").orderBy(F.col(c).asc() if ascending else F.col(c).desc(), "zone_id")
        rows = rows.withColumn(f"_r_{c}", F.row_number().over(order))
    return rows.filter(F.least(*(F.col(f"_r_{c}") for c, _ in metrics)) <= k).select("time_bin", "zone_id").distinct()
