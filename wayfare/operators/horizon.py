"""Expected value of a finite horizon: one backward induction solves every coalition of allowed targets at once.

A move or trip that ends within the same step counts from the next one on, so no step reads its own unfinished values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.columns import conditional_wait, pickup_probability
from wayfare.operators.lookup import node_at, od_options
from wayfare.operators.space import route_at
from wayfare.plans.params import DEFAULT, Params
from wayfare.sources.lineage import discard, settle


def _steps(zones: DataFrame, start: float, params: Params) -> DataFrame:
    """step, zone_id, minute; a horizon has a couple of dozen steps."""
    steps = zones.sparkSession.range(params.steps).select(F.col("id").cast("int").alias("step"))
    return zones.select("zone_id").distinct().crossJoin(F.broadcast(steps)).withColumn("minute", F.lit(start) + F.col("step") * F.lit(float(params.step_minutes)))


def wait_transitions(model, start: float, params: Params = DEFAULT, scenario: str = "medium") -> DataFrame:
    """step, zone_id, pickup, destination, probability, end_pos, reward."""
    at = node_at(_steps(model.zones, start, params), model.nodes, scenario, params)
    step = float(params.step_minutes)
    at = at.select("step", "zone_id", "minute", pickup_probability(F.col("expected_wait"), step).alias("pickup"), conditional_wait(F.col("expected_wait"), step).alias("wait"))
    asked = at.select((F.col("step").cast("long") * 100000 + F.col("zone_id")).alias("query_id"), F.col("zone_id").alias("origin"), (F.col("minute") + F.col("wait")).alias("minute"))
    options = od_options(asked, model.od).withColumn("step", F.floor(F.col("query_id") / 100000).cast("int")).withColumnRenamed("origin", "zone_id")
    rows = at.join(options, ["step", "zone_id"])
    end = F.col("step") + (F.col("wait") + F.col("duration_min")) / step
    return rows.select("step", "zone_id", "pickup", "destination", "probability", end.alias("end_pos"), (F.col("driver_revenue") - params.cost_per_mile * F.col("distance_miles")).alias("reward"))


def move_transitions(model, start: float, targets: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """step, zone_id, target, end_pos, cost for the given targets (step, zone_id, target), within the limits of a move."""
    asked = targets.select("step", F.col("zone_id").alias("origin"), F.col("target").alias("destination"), (F.lit(start) + F.col("step") * F.lit(float(params.step_minutes))).alias("minute")).filter("origin <> destination")
    rows = route_at(asked, model.routes, model.zones, model.profiles, params).filter((F.col("route_minutes") <= params.reposition_minutes) & (F.col("route_miles") <= params.reposition_miles))
    return rows.select("step", F.col("origin").alias("zone_id"), F.col("destination").alias("target"), (F.col("step") + F.col("route_minutes") / params.step_minutes).alias("end_pos"), (params.cost_per_mile * F.col("route_miles")).alias("cost"))


def _clamped(step: Column, end: Column, last: int) -> tuple[Column, Column, Column]:
    """Lower and upper step around an end, and the upper one's weight."""
    low = F.least(F.greatest(F.floor(end).cast("int"), step + 1), F.lit(last))
    high = F.least(F.greatest(F.ceil(end).cast("int"), low), F.lit(last))
    return low, high, F.when(low == high, 0.0).otherwise(end - F.floor(end))


def finite_horizon_values(waits: DataFrame, moves: DataFrame, masks: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """mask, step, zone_id, value, target (null: wait) for each row of masks.

    masks: mask, allowed (array of target zones; null allows all). A row for each mask and zone carries the values of all
    later steps, so a step looks each end of its transitions up once; transitions are small against masks x zones. A
    step's rows are written before the next.
    """
    last = params.steps
    zones = waits.select("zone_id").union(moves.select("zone_id")).distinct()
    masks = masks.select("mask", "allowed")
    state = settle(masks.crossJoin(F.broadcast(zones)).select("mask", "allowed", "zone_id", F.array(F.lit(0.0)).alias("values"), F.array(F.lit(None).cast("int")).alias("targets")))

    def ahead(rows: DataFrame, at: str) -> DataFrame:
        """Transitions that end within the horizon, with `future` for each mask: a mix of the values between which they end."""
        low, high, share = _clamped(F.col("step"), F.col("end_pos"), last)
        ended = rows.filter(F.col("end_pos") <= last + 1e-12).withColumns({"_lo": last - low + 1, "_hi": last - high + 1, "_t": share}).withColumnRenamed("zone_id", "_from")
        later = ended.join(state.select("mask", "allowed", F.col("zone_id").alias(at), "values"), at)
        return later.withColumn("future", (1 - F.col("_t")) * F.element_at("values", F.col("_lo")) + F.col("_t") * F.element_at("values", F.col("_hi")))

    for step in range(last - 1, -1, -1):
        own = F.col("step") == step
        worth = F.col("probability") * (F.col("reward") + F.col("future"))
        trips = ahead(waits.filter(own), "destination").select("mask", F.col("_from").alias("zone_id"), worth.alias("worth"), F.lit(None).cast("double").alias("gain"), F.lit(None).cast("int").alias("less"))
        moved = ahead(moves.filter(own), "target").filter("allowed is null or array_contains(allowed, target)")
        moved = moved.select("mask", F.col("_from").alias("zone_id"), F.lit(None).cast("double").alias("worth"), (F.col("future") - F.col("cost")).alias("gain"), (-F.col("target")).cast("int").alias("less"))
        found = trips.unionByName(moved).groupBy("mask", "zone_id").agg(F.sum("worth").alias("picked"), F.max(F.when(F.col("gain").isNotNull(), F.struct(F.round("gain", 9).alias("near"), "less", "gain"))).alias("m"))  # of nearly equal moves the smaller target
        chance = waits.filter(own).groupBy("zone_id").agg(F.max("pickup").alias("pickup"))
        p = F.coalesce("pickup", F.lit(0.0))
        stay = (1 - p) * F.element_at("values", -1) + p * F.coalesce("picked", F.lit(0.0))
        rows = state.join(found, ["mask", "zone_id"], "left").join(chance, "zone_id", "left").withColumn("stay", stay)
        better = F.coalesce(F.col("m.gain") > F.col("stay") + 1e-12, F.lit(False))
        value, target = F.when(better, F.col("m.gain")).otherwise(F.col("stay")), F.when(better, -F.col("m.less"))
        before, state = state, settle(rows.select("mask", "allowed", "zone_id", F.array_append("values", value).alias("values"), F.array_append("targets", target).alias("targets")))
        discard(before)
    each = state.select("mask", "zone_id", F.posexplode(F.arrays_zip("values", "targets")).alias("k", "at"))
    return each.select("mask", (last - F.col("k")).cast("int").alias("step"), "zone_id", F.col("at.values").alias("value"), F.col("at.targets").alias("target"))


def optimal_actions(values: DataFrame) -> DataFrame:
    return values.filter("target is not null").select("mask", "step", "zone_id", "target")


def start_value(values: DataFrame, zone: int) -> DataFrame:
    return values.filter((F.col("step") == 0) & (F.col("zone_id") == zone)).select("mask", F.col("value").alias("coalition_value"))
