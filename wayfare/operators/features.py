"""Numeric features of states and of actions in them, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.operators.lookup import node_at
from wayfare.operators.space import route_at
from wayfare.plans.params import DEFAULT, Params

# fixed values: what the features are measured in
REVENUE, TRIP_MINUTES, TRIP_MILES, MOVE_COST, COMPETITORS = 100.0, 90.0, 30.0, 20.0, 10.0

STATE = ("sin_clock", "cos_clock", "remaining_share", "demand", "wait", "revenue", "minutes", "miles", "crowding", "competitors", "confidence")
ACTION = ("is_wait", "route_minutes", "route_miles", "route_cost", "target_demand", "target_wait", "target_net", "target_minutes", "target_confidence", "route_confidence")


def _scaled(nodes: DataFrame, scale: Column, params: Params) -> dict[str, Column]:
    return {
        "demand": F.col("posterior") / F.greatest(F.lit(1.0), scale), "wait": F.col("expected_wait") / params.wait[1], "revenue": F.col("expected_driver_revenue") / REVENUE,
        "minutes": F.col("expected_duration_min") / TRIP_MINUTES, "miles": F.col("expected_distance_miles") / TRIP_MILES, "confidence": F.col("node_confidence"),
    }


def state_features(states: DataFrame, nodes: DataFrame, scale: DataFrame, params: Params = DEFAULT, scenario: str = "medium") -> DataFrame:
    """states (state_id, zone_id, minute, remaining) with the eleven columns of STATE. scale: one row, pickup_scale."""
    at = node_at(states, nodes, scenario, params, competitors=True).join(F.broadcast(scale))  # one row
    angle = 2 * math.pi * F.pmod("minute", F.lit(1440.0)) / 1440.0
    own = _scaled(at, F.col("pickup_scale"), params)
    crowding = F.col("competition_ratio") / (1 + F.col("competition_ratio"))
    named = {"sin_clock": F.sin(angle), "cos_clock": F.cos(angle), "remaining_share": F.greatest(F.lit(0.0), F.col("remaining")) / params.horizon_minutes, **own, "crowding": crowding, "competitors": F.col("competitors") / (COMPETITORS + F.col("competitors"))}
    return at.select(*states.columns, *(named[c].alias(c) for c in STATE))


def state_action_features(states: DataFrame, actions: DataFrame, model, scale: DataFrame, params: Params = DEFAULT, scenario: str = "medium") -> DataFrame:
    """One row per row of actions (state_id, action; null waits): the state's features and the ten columns of ACTION.

    A move is measured at its target when it arrives there, waiting at the zone itself now.
    """
    base = state_features(states, model.nodes, scale, params, scenario)
    asked = actions.join(states.select("state_id", F.col("zone_id").alias("origin"), "minute"), "state_id").withColumn("destination", F.coalesce("action", "origin"))
    routed = route_at(asked, model.routes, model.zones, model.profiles, params)
    arrival = routed.withColumn("zone_id", F.col("destination")).withColumn("minute", F.col("minute") + F.when(F.col("action").isNull(), 0.0).otherwise(F.col("route_minutes")))
    there = node_at(arrival, model.nodes, scenario, params).join(F.broadcast(scale))  # one row
    own, waits = _scaled(there, F.col("pickup_scale"), params), F.col("action").isNull()
    moving = lambda c: F.when(waits, 0.0).otherwise(c)
    named = {
        "is_wait": waits.cast("double"), "route_minutes": moving(F.col("route_minutes") / params.reposition_minutes), "route_miles": moving(F.col("route_miles") / params.reposition_miles), "route_cost": moving(params.cost_per_mile * F.col("route_miles") / MOVE_COST),
        "target_demand": own["demand"], "target_wait": own["wait"], "target_net": (F.col("expected_driver_revenue") - params.cost_per_mile * F.col("expected_distance_miles")) / REVENUE, "target_minutes": own["minutes"], "target_confidence": own["confidence"],
        "route_confidence": moving(F.col("route_confidence")),
    }
    return there.select("state_id", "action", *(named[c].alias(c) for c in ACTION)).join(base, "state_id")
