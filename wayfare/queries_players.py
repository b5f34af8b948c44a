"""Registered queries of the game between zones: who plays, what coalitions are worth, checks and sensitivity."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import candidates, features, nodes, players, policies, shapley, studies
from wayfare.plans.params import DEFAULT
from wayfare.queries import _questions, model, query, rounded
from wayfare.queries_decide import BOARD, START, _candidates, _states, board
from wayfare.queries_sql import ORACLES
from wayfare.sources.lineage import settle, shared_dir
from wayfare.sources.trips import write_observed_od

START_ZONE, POOL, PLAYERS, TIES = 8, 8, 5, 6
_known: dict[tuple, object] = {}


def _once(name: str):
    """One result per session and folder: later queries read what earlier ones settled."""

    def wrap(f):
        def get(spark: SparkSession, sf_dir: str):
            key = (name, spark.sparkContext.applicationId, sf_dir)
            if key not in _known:
                _known[key] = f(spark, sf_dir)
            return _known[key]

        return get

    return wrap


@query
def observed_od_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed cells, written as a partitioned table and read back."""
    folder = f"{shared_dir(spark)}/observed-{uuid.uuid4().hex}"  # one for each call: earlier results stay readable
    observed = model(spark, sf_dir).observed
    write_observed_od(observed, folder)
    back = spark.read.parquet(f"{folder}/observed_od")
    return rounded(back.select(*(F.col(c).cast(observed.schema[c].dataType) for c in observed.columns)))


ORACLES["observed_od_table"] = ORACLES["od_time_profile"]


@query
def start_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected candidates of every state, with names."""
    rows = players.start_candidates(_candidates(spark, sf_dir), model(spark, sf_dir).zones)
    return rounded(rows.select("state_id", "selected_rank", "destination", "zone_name", "borough", "route_minutes", "route_miles", "rank_sum"))


@_once("coverage")
def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(players.reachable_coverage(board(spark, sf_dir), START_ZONE, START, PLAYERS, BOARD))


@query
def reachable_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coverage(spark, sf_dir)


@_once("players")
def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The players: a pool by coverage, then a third each by gain alone, coverage and synergy."""
    coverage = _coverage(spark, sf_dir)
    pool = [r.zone_id for r in coverage.filter(F.col("zone_id") != START_ZONE).orderBy(F.desc("coverage"), "zone_id").limit(POOL).collect()]
    masks = shapley.coalition_masks(spark, pool).filter("size <= 2")
    values = settle(players.game_values(board(spark, sf_dir), START, START_ZONE, masks, pool, [players.Variant("as it is")]).drop("variant"))
    values = values.withColumn("value", F.round("value", TIES))
    return settle(shapley.select_players(players.player_scores(values, coverage, pool), PLAYERS))


@query
def selected_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir)


def _players(spark: SparkSession, sf_dir: str) -> list[int]:
    return [r.player for r in _selected(spark, sf_dir).orderBy("rank").collect()]


@_once("game")
def _game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant, mask, value for all coalitions, in the model as it is, without unsure rows, and with one zone earning more."""
    who = _players(spark, sf_dir)
    rises = [players.Variant(f"income {k + 1}", zone=who[0], factor=1 + x) for k, x in enumerate(players.INCOME_STEPS)]
    variants = [players.Variant("as it is"), players.Variant("sure", least_confidence=players.LOW_CONFIDENCE), *rises]
    return settle(players.game_values(board(spark, sf_dir), START, START_ZONE, shapley.coalition_masks(spark, who), who, variants))


def _values(spark: SparkSession, sf_dir: str, variant: str = "as it is") -> DataFrame:
    return _game(spark, sf_dir).filter(F.col("variant") == variant).select("mask", F.round("value", TIES).alias("value"))


@query
def horizon_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-hour value of the start zone for all coalitions, in every variant of the model."""
    return rounded(_game(spark, sf_dir))


@query
def zone_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shapley.exact_shapley(_values(spark, sf_dir), _players(spark, sf_dir))
    return rounded(shapley.shapley_report(found, model(spark, sf_dir).zones))


@query
def zone_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shapley.exact_shapley(_values(spark, sf_dir), _players(spark, sf_dir))
    return rounded(players.zone_diagnostics(found, board(spark, sf_dir), START))


@query
def coalition_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(players.coalition_export(_values(spark, sf_dir), shapley.coalition_masks(spark, _players(spark, sf_dir))))


@query
def strategy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the zones' game: axioms, dominance, confidence, income, diminishing returns."""
    who, values = _players(spark, sf_dir), _values(spark, sf_dir)
    found = shapley.exact_shapley(values, who)
    axioms = shapley.axiom_checks(values, found, who, 1e-4).withColumn("is_hard", F.lit(True))
    full = _game(spark, sf_dir).filter((F.col("mask") == (1 << len(who)) - 1) & (F.col("variant") != "sure"))
    fulls = full.select(F.when(F.col("variant") == "as it is", 0).otherwise(F.substring("variant", 8, 2).cast("int")).alias("step"), F.round("value", TIES).alias("value"))
    more = [
        players.check_dominance(values, found, who), players.check_confidence(values, _values(spark, sf_dir, "sure"), who),
        players.check_income(values, _values(spark, sf_dir, "income 1"), who, who[0]), players.check_diminishing(fulls),
    ]
    return rounded(reduce(DataFrame.unionByName, [axioms, *more]), 4)


@query
def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return players.axiom_summary(strategy_checks(spark, sf_dir))


@_once("baselines")
def _baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values over four baselines: no zone always allowed, or the best zone outside by one of three scores."""
    who, m = _players(spark, sf_dir), board(spark, sf_dir)
    at = spark.range(1).select(F.lit(0).cast("long").alias("state_id"), F.lit(START_ZONE).alias("zone_id"), F.lit(START).alias("minute"))
    details = candidates.candidate_details(at, m, BOARD).filter("selected")
    scored = details.select(F.col("destination").alias("zone_id"), *(F.round(policies.SCORES[p][0](DEFAULT), TIES).alias(n) for n, p in (("demand", "highest_demand"), ("income", "highest_income"), ("greedy", "greedy_net_earnings"))))
    outside = studies.external_baselines(scored, _selected(spark, sf_dir).select(F.col("player").alias("zone_id"))).first()
    base = {"wait_only": [], **{n: [outside[n]] for n in ("demand", "income", "greedy") if outside[n] is not None}}
    masks = [shapley.coalition_masks(spark, who, zones).select((F.col("mask") + k * (1 << len(who))).alias("mask"), "allowed") for k, zones in enumerate(base.values())]
    targets = sorted({*who, *(z for zones in base.values() for z in zones)})
    values = settle(players.game_values(m, START, START_ZONE, reduce(DataFrame.unionByName, masks), targets, [players.Variant("as it is")]).select("mask", F.round("value", TIES).alias("value")))
    return settle(players.baseline_shapley(values, who, list(base)))


@query
def baseline_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_baselines(spark, sf_dir))


@query
def baseline_shapley_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _baselines(spark, sf_dir).select(F.col("baseline").alias("kind"), F.col("player").alias("zone_id"), F.round("shapley_value", TIES).alias("value"))
    return rounded(studies.rank_agreement(rows))


@query
def competition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode summaries by third of the day, as if each third were a level of competition."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    level = F.element_at(F.array(*(F.lit(s) for s in DEFAULT.competition)), F.floor(F.hour("ts") / 8).cast("int") + 1)
    rows = events.groupBy(F.col("event_type").alias("algorithm"), F.col("user_id").alias("scenario_id"), level.alias("competition_scenario")).agg(F.sum("value").alias("net_earnings"), F.count(F.lit(1)).alias("completed_trips"))
    found = players.competition_table(rows, model(spark, sf_dir).nodes, START_ZONE, START)
    return rounded(found.select("competition_scenario", "algorithm", "episodes", "mean", "lower", "upper", "start_wait", "start_competitors"))


@query
def state_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of one state for each order: its origin at its minute, the time left by its minute."""
    m = model(spark, sf_dir)
    states = _questions(spark, sf_dir).select(F.col("query_id").alias("state_id"), F.col("origin").alias("zone_id"), "minute", F.pmod("minute", F.lit(120.0)).alias("remaining"))
    return rounded(features.state_features(states, m.nodes, nodes.pickup_scale(m.posterior)).drop("minute", "remaining"))


@query
def state_action_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every selected candidate and of waiting, in every state of the grid."""
    m, states = board(spark, sf_dir), _states(spark, sf_dir)
    moves = _candidates(spark, sf_dir).filter("selected").select("state_id", F.col("destination").alias("action"))
    actions = moves.unionByName(states.select("state_id", F.lit(None).cast("int").alias("action")))
    return rounded(features.state_action_features(states, actions, m, nodes.pickup_scale(m.posterior)).drop("minute", "remaining"))
