"""Candidates of where to move, and what-if changes of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.columns import low_bin
from wayfare.operators.lookup import node_at, normalise, od_options
from wayfare.operators.nodes import bin_leaders
from wayfare.operators.space import nearest_zones, route_at
from wayfare.plans.params import DEFAULT, Params

#: In the order in which they fill the selection.
METRICS = ("demand", "net_trip", "net_rate", "competition_advantage", "proximity", "destination_probability")

#: Digits to which metrics are compared, so that sums in another order make no other ranks.
NEAR = 9


def trip_scores(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Adds net_trip, net_rate, demand and competition_advantage to node metrics."""
    net = F.col("expected_driver_revenue") - params.cost_per_mile * F.col("expected_distance_miles")
    cycle = F.greatest(F.lit(1.0), F.col("expected_wait") + F.col("expected_duration_min"))
    return df.withColumns({"net_trip": net, "net_rate": net / cycle, "demand": F.col("posterior"), "competition_advantage": 1.0 / F.greatest(F.lit(1e-6), F.col("competition_ratio"))})


def leaders(nodes: DataFrame, params: Params = DEFAULT, scenario: str = "medium") -> DataFrame:
    """time_bin, zone_id of the leading zones of each bin by five scores; equal to NEAR digits is equal."""
    own = trip_scores(nodes.withColumn("expected_wait", F.col(f"expected_wait_{scenario}")), params)
    scores = ("demand", "net_trip", "net_rate", "competition_advantage", "node_confidence")
    own = own.withColumns({m: F.round(m, NEAR) for m in scores})
    return bin_leaders(own, [(m, False) for m in scores], max(8, params.candidate_zones))


def candidate_pool(states: DataFrame, model, params: Params = DEFAULT) -> DataFrame:
    """state_id, origin, minute, destination: near zones, leaders of the bin, likely destinations, largest flows."""
    n = max(8, params.candidate_zones)
    s = states.select("state_id", F.col("zone_id").alias("origin"), "minute")
    near = s.join(nearest_zones(model.zones, params.candidate_near).select(F.col("zone_id").alias("origin"), F.col("neighbour").alias("destination")), "origin")
    lead = s.withColumn("time_bin", low_bin(F.col("minute"), params)).join(leaders(model.nodes, params).withColumnRenamed("zone_id", "destination"), "time_bin")
    likely = od_options(s.withColumnRenamed("state_id", "query_id"), model.od)
    likely = likely.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("probability"), "destination"))).filter(F.col("k") <= n)
    likely = s.join(likely.select(F.col("query_id").alias("state_id"), "destination"), "state_id")
    flows = model.pairs.withColumn("k", F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("trip_count"), "destination"))).filter(F.col("k") <= n)
    large = s.join(flows.select("origin", "destination"), "origin")
    columns = ("state_id", "origin", "minute", "destination")
    whole = near.select(*columns).unionByName(lead.select(*columns)).unionByName(likely.select(*columns)).unionByName(large.select(*columns))
    return whole.filter("origin <> destination").distinct()


def candidate_details(states: DataFrame, model, params: Params = DEFAULT, scenario: str = "medium") -> DataFrame:
    """Each state's reachable candidates with routes, metrics on arrival, ranks and whether they are selected.

    The leaders of each metric are taken in the metrics' order, then the best by rank sum, until there are enough; equal
    values go to the smaller zone.
    """
    routed = route_at(candidate_pool(states, model, params), model.routes, model.zones, model.profiles, params)
    routed = routed.filter((F.col("route_minutes") <= params.reposition_minutes) & (F.col("route_miles") <= params.reposition_miles))
    asked = routed.select("state_id", F.col("destination").alias("zone_id"), (F.col("minute") + F.col("route_minutes")).alias("minute"))
    arrived = trip_scores(node_at(asked, model.nodes, scenario, params), params).drop("minute").withColumnRenamed("zone_id", "destination")
    likely = od_options(states.select(F.col("state_id").alias("query_id"), F.col("zone_id").alias("origin"), "minute"), model.od).select(F.col("query_id").alias("state_id"), "destination", F.col("probability").alias("destination_probability"))
    rows = routed.join(arrived, ["state_id", "destination"]).join(likely, ["state_id", "destination"], "left").na.fill(0.0, ["destination_probability"]).withColumn("proximity", 1.0 / F.greatest(F.lit(1.0), F.col("route_minutes")))
    total = F.lit(0)
    first = F.lit(None).cast("int")
    for k, m in enumerate(METRICS):
        falling = F.round(m, NEAR).desc()
        rows = rows.withColumn(f"rank_{m}", F.rank().over(Window.partitionBy("state_id").orderBy(falling))).withColumn(f"_k_{m}", F.row_number().over(Window.partitionBy("state_id").orderBy(falling, "destination")))
        total = total + F.col(f"rank_{m}")
        first = F.coalesce(first, F.when(F.col(f"_k_{m}") <= params.candidate_quota, k * params.candidate_quota + F.col(f"_k_{m}")))
    rows = rows.withColumn("rank_sum", total).withColumn("_first", first)
    order = Window.partitionBy("state_id").orderBy(F.col("_first").asc_nulls_last(), "rank_sum", F.round("route_minutes", NEAR), "destination")
    ranked = rows.withColumn("selected_rank", F.row_number().over(order)).withColumn("selected", F.col("selected_rank") <= params.candidate_zones)
    return ranked.drop("_first", *(f"_k_{m}" for m in METRICS))


# ---------------------------------------------------------------- what if


def with_competition(nodes: DataFrame, scenario: str, params: Params = DEFAULT) -> DataFrame:
    """The scenario's wait and competitors become the active ones."""
    if scenario not in params.competition:
        raise ValueError(f"unknown competition scenario: {scenario}")
    return nodes.withColumn("expected_wait", F.col(f"expected_wait_{scenario}")).withColumn("competition_scenario", F.lit(scenario))


def with_min_confidence(od: DataFrame, threshold: float) -> DataFrame:
    """Drops destinations below the threshold, keeps the best one where all would go, and renormalises."""
    cell = Window.partitionBy("time_bin", "origin")
    best = F.row_number().over(cell.orderBy(F.desc("confidence"), "destination"))
    rows = od.withColumn("_b", best).withColumn("_m", F.max("confidence").over(cell))
    kept = rows.filter((F.col("confidence") >= threshold) | ((F.col("_b") == 1) & (F.col("_m") < threshold)))
    return normalise(kept.drop("_b", "_m"))


def with_revenue_multiplier(df: DataFrame, zone: int, multiplier: float, zone_column: str = "origin", columns: tuple[str, ...] = ("driver_revenue", "revenue_dev")) -> DataFrame:
    """Revenue columns of one origin, scaled."""
    return df.withColumns({c: F.when(F.col(zone_column) == zone, F.col(c) * multiplier).otherwise(F.col(c)) for c in columns})
