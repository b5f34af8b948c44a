"""Policies as set operations: a table of states in, one action per state out. Null means to wait."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.candidates import trip_scores
from wayfare.operators.lookup import node_at
from wayfare.plans.params import DEFAULT, Params

#: Gain that a move needs over staying.
TOLERANCE = 1e-12


def feasible(details: DataFrame, states: DataFrame) -> DataFrame:
    """Selected candidates whose route is shorter than the time left."""
    return details.filter("selected").join(states.select("state_id", "remaining"), "state_id").filter("route_minutes < remaining")


def _demand(m: Params) -> Column:
    return F.col("posterior") / F.greatest(F.lit(1e-6), F.col("competition_ratio"))


def _income(m: Params) -> Column:
    return F.col("net_trip")


def _greedy(m: Params) -> Column:
    return (F.col("net_trip") - m.cost_per_mile * F.col("route_miles")) / F.greatest(F.lit(1.0), F.col("route_minutes") + F.col("expected_wait") + F.col("expected_duration_min"))


def _legacy(m: Params) -> Column:
    return F.col("expected_driver_revenue") + 0.3 * F.col("posterior") - 0.5 * F.col("route_minutes") - 0.15 * F.col("route_miles")


SCORES: dict[str, tuple[Callable[[Params], Column], float]] = {"highest_demand": (_demand, TOLERANCE), "highest_income": (_income, TOLERANCE), "greedy_net_earnings": (_greedy, TOLERANCE), "legacy_utility": (_legacy, 0.0)}


def wait_only(states: DataFrame) -> DataFrame:
    return states.select("state_id", F.lit(None).cast("int").alias("action"))


def best_moves(states: DataFrame, details: DataFrame, model, policy: str, params: Params = DEFAULT) -> DataFrame:
    """state_id, action, score: the best candidate by the policy's score if it beats staying.

    Candidates are looked at in the order of their selection, and one must beat the best so far by the tolerance: a fold
    over a state's few candidates.
    """
    score, tolerance = SCORES[policy]
    here = trip_scores(node_at(states.select("state_id", "zone_id", "minute"), model.nodes, params=params), params).withColumns({"route_minutes": F.lit(0.0), "route_miles": F.lit(0.0)})
    stay = here.select("state_id", score(params).alias("stay"))
    moves = feasible(details, states).select("state_id", F.struct("selected_rank", score(params).alias("score"), F.col("destination").alias("zone")).alias("move")).groupBy("state_id").agg(F.sort_array(F.collect_list("move")).alias("moves"))
    start = F.struct(F.col("stay").alias("score"), F.lit(None).cast("int").alias("zone"))
    better = lambda acc, m: F.when(m["score"] > acc["score"] + tolerance, F.struct(m["score"].alias("score"), m["zone"].cast("int").alias("zone"))).otherwise(acc)
    chosen = F.aggregate(F.coalesce("moves", F.array().cast("array<struct<selected_rank:int,score:double,zone:int>>")), start, better)
    return stay.join(moves, "state_id", "left").withColumn("c", chosen).select("state_id", F.col("c.zone").alias("action"), F.col("c.score").alias("score"))


def state_key(states: DataFrame, params: Params = DEFAULT) -> DataFrame:
    return states.withColumn("time_bin", F.floor(F.pmod("minute", F.lit(1440.0)) / params.bin_minutes).cast("int")).withColumn("remaining_bucket", F.floor(F.col("remaining") / params.step_minutes).cast("int"))


def apply_q_table(states: DataFrame, q_table: DataFrame, allowed: DataFrame, fallback: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """state_id, action, from_table: the best seen action; waiting first among equals, then by text; else the fallback's.

    q_table: zone_id, time_bin, remaining_bucket, action (text, WAIT or a zone), q. allowed: state_id, action (text).
    """
    seen = state_key(states, params).join(q_table, ["zone_id", "time_bin", "remaining_bucket"]).join(allowed.union(states.select("state_id", F.lit("WAIT"))).distinct(), ["state_id", "action"], "left_semi")
    order = Window.partitionBy("state_id").orderBy(F.desc("q"), (F.col("action") != "WAIT"), "action")
    best = seen.withColumn("k", F.row_number().over(order)).filter("k = 1").select("state_id", F.col("action").try_cast("int").alias("known"), F.lit(True).alias("from_table"))
    joined = states.select("state_id").join(best, "state_id", "left").join(fallback.select("state_id", F.col("action").alias("other")), "state_id", "left")
    return joined.select("state_id", F.when(F.col("from_table"), F.col("known")).otherwise(F.col("other")).alias("action"), F.coalesce("from_table", F.lit(False)).alias("from_table"))


def q_table_coverage(decisions: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    hits = F.count_if("from_table")
    return decisions.agg(n.alias("decisions"), hits.alias("hits"), (n - hits).alias("fallbacks"), (hits / F.greatest(n, F.lit(1))).alias("hit_rate"), ((n - hits) / F.greatest(n, F.lit(1))).alias("fallback_rate"))


def apply_value_policy(states: DataFrame, optimal: DataFrame, allowed: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """state_id, action of the value model at the state's step; waiting where that isn't allowed. allowed: state_id, action."""
    at = states.withColumn("step", F.floor((params.horizon_minutes - F.col("remaining")) / params.step_minutes).cast("int"))
    found = at.join(optimal.select("step", "zone_id", F.col("target").alias("action")), ["step", "zone_id"]).join(allowed, ["state_id", "action"], "left_semi").select("state_id", F.col("action").alias("found"))
    return states.select("state_id").join(found, "state_id", "left").select("state_id", F.col("found").alias("action"))


def action_agreement(actions: DataFrame) -> DataFrame:
    """policy_a, policy_b, agreement, type_agreement over states; actions: policy, state_id, action."""
    a, b = actions.toDF("policy_a", "state_id", "a"), actions.toDF("policy_b", "state_id", "b")
    both = a.join(b, "state_id")
    return both.groupBy("policy_a", "policy_b").agg(F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")).alias("agreement"), F.avg((F.col("a").isNull() == F.col("b").isNull()).cast("double")).alias("type_agreement"))


def action_summary(actions: DataFrame) -> DataFrame:
    wait = F.coalesce(F.col("action").cast("string"), F.lit("WAIT"))
    return actions.groupBy("policy").agg(F.count(F.lit(1)).alias("states"), F.avg(F.col("action").isNull().cast("double")).alias("wait_rate"), F.countDistinct(wait).alias("distinct_actions"))


def state_grid(zones: DataFrame, start: float, offsets: list[float], params: Params = DEFAULT) -> DataFrame:
    """state_id, zone_id, minute, remaining: every zone at some minutes of the horizon (a handful of offsets)."""
    at = zones.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(offsets)], "k int, elapsed double")
    grid = zones.select("zone_id").distinct().crossJoin(F.broadcast(at))
    return grid.select((F.col("zone_id").cast("long") * 1000 + F.col("k")).alias("state_id"), "zone_id", (start + F.col("elapsed")).alias("minute"), (params.horizon_minutes - F.col("elapsed")).alias("remaining"))
