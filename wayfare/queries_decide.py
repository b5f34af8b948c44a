"""Registered queries of candidates, policies, horizon values, coalitions, episodes and studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import candidates, episodes, nodes, policies, shapley, space, studies
from wayfare.operators.players import Changed
from wayfare.plans.params import DEFAULT, Params
from wayfare.queries import model, query, rounded, trip_view
from wayfare.sources.lineage import settle

START = 480.0
KINDS = ("click", "error", "purchase", "signup", "view")


#: Few zones are near enough to be candidates for that alone, so that leaders, likely destinations and flows matter.
BOARD = Params(candidate_near=6)
_boards: dict[tuple[str, str], Changed] = {}
_details: dict[tuple[str, str], DataFrame] = {}


def board(spark: SparkSession, sf_dir: str) -> Changed:
    """The model with empty streets and a tariff by zone, so that moving can pay: decisions are made on it.

    Moves take the straight way at the fixed speed, as if no trip had been seen; revenue is scaled by the origin's tariff.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _boards:
        m = model(spark, sf_dir)
        routes = settle(space.shortest_routes(space.reposition_edges(m.adjacency, m.zones, m.pairs.limit(0))))
        tariff = 0.5 + F.pmod(F.col("origin") * 7, F.lit(5)) / 2.0
        od = settle(m.od.withColumns({c: F.col(c) * tariff for c in ("driver_revenue", "revenue_dev")}))
        _boards[key] = Changed(m, od=od, routes=routes, nodes=settle(nodes.attach_trip_expectations(m.bare_nodes, od)))
    return _boards[key]


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.state_grid(model(spark, sf_dir).zones, START, [15.0 * k for k in range(8)])


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _details:
        _details[key] = settle(candidates.candidate_details(_states(spark, sf_dir), board(spark, sf_dir), BOARD))
    return _details[key]


@query
def candidate_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_candidates(spark, sf_dir).select("state_id", "origin", "destination", "route_minutes", "route_miles", *candidates.METRICS, "rank_sum", "selected_rank", "selected"), 3)


@query
def policy_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action of each scoring policy in every state of the grid."""
    m, states, details = board(spark, sf_dir), _states(spark, sf_dir), _candidates(spark, sf_dir)
    each = [policies.best_moves(states, details, m, p, BOARD).select(F.lit(p).alias("policy"), "state_id", "action") for p in policies.SCORES]
    each.append(policies.wait_only(states).select(F.lit("wait_only").alias("policy"), "state_id", "action"))
    return reduce(DataFrame.unionByName, each)


@query
def policy_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policies.action_agreement(policy_actions(spark, sf_dir)))


@query
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policies.action_summary(policy_actions(spark, sf_dir)))


@query
def min_confidence_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates.with_min_confidence(model(spark, sf_dir).od, 0.6)
    return rounded(rows.select("time_bin", "origin", "destination", "confidence", "destination_probability"), 4)


@query
def revenue_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean revenue of each origin when one origin's rises by a twentieth."""
    rows = candidates.with_revenue_multiplier(model(spark, sf_dir).od, 8, 1.05)
    return rounded(rows.groupBy("origin").agg(F.sum(F.col("destination_probability") * F.col("driver_revenue")).alias("revenue"), F.avg("revenue_dev").alias("revenue_dev")), 3)


@query
def competition_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir).nodes
    each = [candidates.with_competition(m, s).groupBy("competition_scenario").agg(F.avg("expected_wait").alias("mean_wait"), F.max("expected_wait").alias("longest_wait")) for s in DEFAULT.competition]
    return rounded(reduce(DataFrame.unionByName, each))


def coalition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mask, value over the event types as players: the sum of each user's largest total among the mask's types."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    masks = spark.range(1 << len(KINDS)).select(F.col("id").alias("mask"))  # a handful of players
    bit = reduce(lambda c, k: c.when(F.col("event_type") == k[1], 1 << k[0]), enumerate(KINDS), F.when(F.lit(False), 0)).cast("long")
    totals = events.withColumn("bit", bit).filter("bit is not null").groupBy("user_id", "bit").agg(F.sum("value").alias("total"))
    inside = totals.join(F.broadcast(masks), F.col("mask").bitwiseAND(F.col("bit")) != 0)
    worth = inside.groupBy("mask", "user_id").agg(F.max("total").alias("best")).groupBy("mask").agg(F.sum("best").alias("value"))
    return settle(masks.join(worth, "mask", "left").na.fill(0.0, ["value"]))


def _players() -> list[int]:
    return list(range(1, len(KINDS) + 1))


@query
def shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shapley.exact_shapley(coalition_table(spark, sf_dir), _players()), 4)


@query
def shapley_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shapley.sampled_shapley(coalition_table(spark, sf_dir), _players(), 512, 7), 3)


@query
def pair_synergy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shapley.pair_synergy(coalition_table(spark, sf_dir), _players()), 4)


@query
def axiom_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = coalition_table(spark, sf_dir)
    found = shapley.exact_shapley(values, _players())
    return shapley.axiom_checks(values, found, _players(), 1e-4).select("axiom", "status")


@query
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = coalition_table(spark, sf_dir)
    rows = shapley.ablation(values, shapley.exact_shapley(values, _players()), _players())
    return rounded(shapley.ablation_summary(rows), 3)


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.col("event_type").alias("algorithm"), F.col("user_id").alias("scenario_id")).agg(F.sum("value").alias("net_earnings"), F.count(F.lit(1)).alias("completed_trips"))


@query
def episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(episodes.episode_summary(_episodes(spark, sf_dir)))


@query
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(episodes.paired_comparison(_episodes(spark, sf_dir), "view"))


@query
def summary_with_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(episodes.summary_with_pairs(_episodes(spark, sf_dir), "view").select("algorithm", "rank", "mean", "mean_gain", "win_rate"))


@query
def representative_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(episodes.representative_episode(_episodes(spark, sf_dir)))


@query
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("hour", F.hour("ts"))
    return rounded(episodes.event_summary(events, ("event_type", "hour"), ("value",)), 4)


@query
def trip_count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(studies.trip_count_distribution(_episodes(spark, sf_dir)))


@query
def interval_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(studies.interval_bars(episodes.episode_summary(_episodes(spark, sf_dir))))


@query
def smoothed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling mean of daily event values by type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))
    return rounded(studies.smoothed_history(daily, "day", "value", 7, ["event_type"]), 4)


@query
def bin_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    return rounded(studies.bin_snapshot(m.nodes, m.zones, 32))


@query
def holdout_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of all observed cells rebuilt without their own value, by measure."""
    held = studies.holdout_reconstruct(model(spark, sf_dir).od.filter("observed_trip_count > 0"))
    pairs = {"revenue": ("observed_avg_driver_revenue", "held_revenue"), "minutes": ("observed_avg_duration_min", "held_minutes"), "miles": ("observed_avg_distance_miles", "held_miles")}
    held = held.withColumns({c: F.round(c, 6) for p in pairs.values() for c in p})  # equal up to the order of sums
    return rounded(reduce(DataFrame.unionByName, (studies.error_metrics(held, *p).withColumn("measure", F.lit(k)) for k, p in pairs.items())), 4)


@query
def holdout_tail_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = studies.holdout_reconstruct(model(spark, sf_dir).od.filter("observed_trip_count > 0"))
    held = held.withColumns({"truth": F.round("observed_avg_duration_min", 6), "held_minutes": F.round("held_minutes", 6)})
    return rounded(studies.tail_metrics(held, "truth", "held_minutes"), 4)


@query
def holdout_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of well observed cells, rebuilt."""
    cells = studies.holdout_cells(model(spark, sf_dir).od, 2000, 7)
    return rounded(studies.holdout_reconstruct(cells).select("time_bin", "origin", "destination", "observed_trip_count", "held_revenue", "held_minutes", "held_miles"), 3)


@query
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    return rounded(studies.coverage_summary(studies.coverage_check(studies.coverage_queries(m.zones, 5000, 7), m)))


@query
def baseline_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far zones' ranks by demand, income and wait agree at one bin."""
    m = model(spark, sf_dir).nodes.filter("time_bin = 32")
    each = [m.select(F.lit(k).alias("kind"), "zone_id", F.round(F.col(c), 6).alias("value")) for k, c in (("demand", "posterior"), ("income", "expected_driver_revenue"), ("wait", "expected_wait"))]
    return rounded(studies.rank_agreement(reduce(DataFrame.unionByName, each)))


@query
def competition_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the mean chance of a pickup per borough from low to high competition."""
    m = model(spark, sf_dir)
    rows = m.nodes.join(m.zones.select("zone_id", F.col("borough").alias("algorithm")), "zone_id")
    each = [rows.groupBy("algorithm").agg(F.avg(1 - F.exp(-15 / F.col(f"expected_wait_{s}"))).alias("mean")).withColumn("scenario", F.lit(s)) for s in DEFAULT.competition]
    return rounded(studies.competition_trend(reduce(DataFrame.unionByName, each)))


@query
def one_step_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw for each line item's trip: a wait, or a move to its destination, by keyed random numbers."""
    m = model(spark, sf_dir)
    trips = trip_view(spark, sf_dir)
    key = F.xxhash64(*trips.columns)
    key_ = F.col("query_id")
    rows = trips.select(key.alias("query_id"), F.col("PULocationID").alias("zone_id"), F.col("DOLocationID").alias("to")).dropDuplicates(["query_id"])
    rows = settle(rows)  # read three times
    rows = rows.select("query_id", (key_ % 300).alias("scenario_id"), "zone_id", F.lit(START).alias("minute"), F.lit(60.0).alias("remaining"), F.when(key_ % 3 == 0, F.col("to")).alias("action"))
    return rounded(episodes.one_step(rows, m, 7))


