"""Which zones play, what coalitions of them are worth under changes of the model, and checks over these values.

A change of the model (a variant) is a copy of its zones: zone ids of variant k are shifted by k * SHIFT, so one backward
induction solves all variants and all coalitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators import candidates, episodes, horizon, lookup, policies, shapley, studies
from wayfare.plans.params import DEFAULT, Params
from wayfare.sources.lineage import settle

SHIFT = 1_000_000
# fixed values: the checks' published settings
LOW_CONFIDENCE, LARGEST_DROP, LEAST_JACCARD, LEAST_CORRELATION, TOP = 0.35, 20.0, 0.5, 0.5, 5
INCOME_STEPS = (0.05, 0.10, 0.15)
COVERAGE_MINUTES, COVERAGE_ROUNDS, LIKELY = (0.0, 30.0, 60.0, 90.0), 3, 4


def start_candidates(details: DataFrame, zones: DataFrame) -> DataFrame:
    """The selected candidates of each state, best first, with names."""
    named = zones.select(F.col("zone_id").alias("destination"), "zone_name", "borough")
    return details.filter("selected").join(F.broadcast(named), "destination", "left")  # a city's few hundred zones


def reachable_coverage(model, start_zone: int, start: float, n: int, params: Params = DEFAULT) -> DataFrame:
    """zone_id, coverage, discovery: how often each zone is met in three rounds of steps out from the start zone.

    A step leads to a state's selected candidates and to its likeliest destinations, at four minutes of the horizon. The
    zones met most go on to the next round.
    """
    wide = Params(**{**params.__dict__, "candidate_zones": max(8, n)})
    states = policies.state_grid(model.zones, start, list(COVERAGE_MINUTES), params)
    moves = candidates.candidate_details(states, model, wide).filter("selected").select("origin", "destination", F.lit("dynamic").alias("source"))
    likely = lookup.od_options(states.select(F.col("state_id").alias("query_id"), F.col("zone_id").alias("origin"), "minute"), model.od)
    likely = likely.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("probability"), "destination"))).filter(F.col("k") <= LIKELY)
    steps = settle(moves.union(likely.select("origin", "destination", F.lit("passenger_reachable"))).groupBy("origin", "destination", "source").agg(F.count(F.lit(1)).alias("n")))
    met, frontier = None, model.zones.filter(F.col("zone_id") == start_zone).select(F.col("zone_id").alias("origin"))
    for depth in range(COVERAGE_ROUNDS):
        reached = steps.join(F.broadcast(frontier), "origin")  # some dozen zones
        label = F.when(F.col("source") == "dynamic", F.lit(f"dynamic_depth_{depth}")).otherwise(F.col("source"))
        here = reached.groupBy(F.col("destination").alias("zone_id"), label.alias("source")).agg(F.sum("n").alias("n"))
        met = settle(met.union(here) if met else here)
        total = met.groupBy("zone_id").agg(F.sum("n").alias("coverage"))
        last = reached.select(F.col("destination").alias("zone_id")).distinct().join(total, "zone_id")
        frontier = settle(last.orderBy(F.desc("coverage"), "zone_id").limit(max(12, 2 * n)).select(F.col("zone_id").alias("origin")))
    return met.groupBy("zone_id").agg(F.sum("n").alias("coverage"), F.array_join(F.sort_array(F.collect_set("source")), "|").alias("discovery"))


@dataclass(frozen=True)
class Variant:
    """A change of the model: a least confidence of its rows, or one origin's revenue scaled."""

    name: str
    least_confidence: float = 0.0
    zone: int = -1
    factor: float = 1.0

    def od(self, od: DataFrame) -> DataFrame:
        if self.least_confidence:
            od = candidates.with_min_confidence(od, self.least_confidence)
        return candidates.with_revenue_multiplier(od, self.zone, self.factor) if self.factor != 1.0 else od


class Changed:
    """A model of which some tables are others."""

    def __init__(self, model, **tables: DataFrame):
        self._model, self._tables = model, tables

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return self._tables[name] if name in self._tables else getattr(self._model, name)


def game_values(model, start: float, start_zone: int, masks: DataFrame, targets: list[int], variants: list[Variant], params: Params = DEFAULT) -> DataFrame:
    """variant, mask, value of the start zone at the first step. masks: mask, allowed (target zones)."""
    spark = masks.sparkSession
    steps = spark.range(params.steps).select(F.col("id").cast("int").alias("step"))
    wanted = model.zones.select("zone_id").distinct().crossJoin(F.broadcast(steps)).withColumn("target", F.explode(F.array(*(F.lit(z) for z in targets))))  # a city's zones x steps x players
    moves = settle(horizon.move_transitions(model, start, wanted, params))
    shifted = lambda df, k, *names: df.withColumns({c: (F.col(c) + k * SHIFT).cast("int") for c in names})
    waits = [shifted(horizon.wait_transitions(Changed(model, od=v.od(model.od)), start, params), k, "zone_id", "destination") for k, v in enumerate(variants)]
    every = [shifted(moves, k, "zone_id", "target") for k in range(len(variants))]
    allowed = F.flatten(F.transform("allowed", lambda z: F.array(*((z + k * SHIFT).cast("int") for k in range(len(variants))))))
    solved = horizon.finite_horizon_values(settle(reduce(DataFrame.unionByName, waits)), settle(reduce(DataFrame.unionByName, every)), settle(masks.select("mask", allowed.alias("allowed"))), params)
    at = solved.filter((F.col("step") == 0) & (F.pmod("zone_id", F.lit(SHIFT)) == start_zone))
    names = F.array(*(F.lit(v.name) for v in variants))
    return at.select(F.get(names, F.floor(F.col("zone_id") / SHIFT).cast("int")).alias("variant"), "mask", "value")


def player_scores(values: DataFrame, coverage: DataFrame, pool: list[int]) -> DataFrame:
    """player, gain, coverage, synergy of a pool from the values of its singles and pairs."""
    gain = shapley.singleton_gain(values, pool).withColumnRenamed("singleton_gain", "gain")
    pairs = shapley.pair_synergy(values, pool).select("player", "synergy")
    return gain.join(coverage.select(F.col("zone_id").alias("player"), "coverage"), "player").join(pairs, "player", "left").na.fill(0.0, ["synergy"])


def coalition_export(values: DataFrame, masks: DataFrame, base: list[int] | None = None) -> DataFrame:
    """coalition_mask, coalition_size, coalition_zone_ids, coalition_value, base_allowed_zone_ids; zones joined by |."""
    rows = values.join(masks, "mask")
    zones = F.array_join(F.transform("zones", lambda z: z.cast("string")), "|")
    return rows.select(F.col("mask").alias("coalition_mask"), F.col("size").alias("coalition_size"), zones.alias("coalition_zone_ids"), F.col("value").alias("coalition_value"), F.lit("|".join(map(str, base or []))).alias("base_allowed_zone_ids"))


def zone_diagnostics(found: DataFrame, model, start: float, params: Params = DEFAULT) -> DataFrame:
    """found (player, shapley_value, ...) with the zone's state at the start and how well its trips are known."""
    asked = found.withColumn("zone_id", F.col("player")).withColumn("minute", F.lit(start))
    at = lookup.node_at(asked, model.nodes, params=params, competitors=True)
    known = model.od.groupBy(F.col("origin").alias("zone_id")).agg(F.count(F.lit(1)).alias("od_rows"), F.sum("observed_trip_count").cast("double").alias("observed_trips"), F.avg("confidence").alias("mean_od_confidence"))
    rows = at.join(known, "zone_id", "left").join(model.zones.select("zone_id", "zone_name"), "zone_id", "left").na.fill(0.0, ["observed_trips", "mean_od_confidence"]).na.fill(0, ["od_rows"])
    state = {"expected_wait": "start_expected_wait", "posterior": "start_pickup_rate", "competition_ratio": "start_competition_ratio", "competitors": "start_competitors", "node_confidence": "start_confidence"}
    return rows.select(*found.columns, "zone_name", *(F.col(a).alias(b) for a, b in state.items()), "od_rows", "observed_trips", "mean_od_confidence")


# ---------------------------------------------------------------- checks


def _result(axiom: str, status: Column, detail: Column, hard: bool) -> list[Column]:
    return [F.lit(axiom).alias("axiom"), status.alias("status"), detail.cast("double").alias("detail"), F.lit(hard).alias("is_hard")]


def check_dominance(values: DataFrame, found: DataFrame, players: list[int]) -> DataFrame:
    """Whether players that gain alone are those of high value: rank correlation; none where one of both is constant."""
    both = shapley.singleton_gain(values, players).join(found, "player")
    rho = studies.spearman(both, "singleton_gain", "shapley_value")
    undefined = F.col("spearman").isNull() | F.isnan("spearman")
    return rho.select(*_result("dominance", F.when(undefined, "N/A").when(F.col("spearman") >= LEAST_CORRELATION, "PASS").otherwise("WARN"), F.col("spearman"), False))


def _full(values: DataFrame, n: int, name: str) -> DataFrame:
    return values.filter(F.col("mask") == (1 << n) - 1).select(F.col("value").alias(name))


def check_confidence(values: DataFrame, filtered: DataFrame, players: list[int]) -> DataFrame:
    """Whether the value and the best players hold without rows of low confidence: percent lost, Jaccard of the top."""
    n = len(players)

    def top(v: DataFrame, name: str) -> DataFrame:
        ranked = shapley.singleton_gain(v, players).withColumn("k", F.row_number().over(Window.orderBy(F.desc("singleton_gain"), "player")))  # a handful of players
        return ranked.filter(F.col("k") <= TOP).agg(F.collect_set("player").alias(name))

    rows = _full(values, n, "whole").join(_full(filtered, n, "left")).join(top(values, "a")).join(top(filtered, "b"))  # one row each
    lost = 100 * (F.col("whole") - F.col("left")) / F.greatest(F.abs("whole"), F.lit(1e-9))
    jaccard = F.size(F.array_intersect("a", "b")) / F.greatest(F.size(F.array_union("a", "b")), F.lit(1))
    return rows.select(*_result("confidence", F.when((lost <= LARGEST_DROP) & (jaccard >= LEAST_JACCARD), "PASS").otherwise("WARN"), lost, False))


def check_income(values: DataFrame, raised: DataFrame, players: list[int], zone: int, tolerance: float = 1e-7) -> DataFrame:
    """Whether no value falls when a zone earns more: of all players together, and of the zone alone."""
    n = len(players)
    alone = lambda v, name: shapley.singleton_gain(v, players).filter(F.col("player") == zone).select(F.col("singleton_gain").alias(name))
    rows = _full(values, n, "before").join(_full(raised, n, "after")).join(alone(values, "alone_before")).join(alone(raised, "alone_after"))  # one row each
    change = F.col("after") - F.col("before")
    passed = (change >= -tolerance) & (F.col("alone_after") >= F.col("alone_before") - tolerance)
    return rows.select(*_result("income", F.when(passed, "PASS").otherwise("FAIL"), change, True))


def check_diminishing(fulls: DataFrame) -> DataFrame:
    """Whether each further rise of a zone's revenue adds no more than the one before. fulls: step (from 0), value."""
    order = Window.orderBy("step")  # a handful of steps
    grown = fulls.withColumn("gain", F.col("value") - F.lag("value").over(order))
    grown = grown.withColumn("more", F.col("gain") > F.lag("gain").over(order) + 1e-6)
    agg = grown.agg(F.coalesce(F.bool_or("more"), F.lit(False)).alias("rises"), F.max_by("gain", "step").alias("last"))
    return agg.select(*_result("diminishing_returns", F.when(F.col("rises"), "INFO").otherwise("PASS"), F.col("last"), False))


def axiom_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("is_hard", "status").agg(F.count(F.lit(1)).alias("checks"))


# ---------------------------------------------------------------- sensitivity


def baseline_shapley(values: DataFrame, players: list[int], names: list[str]) -> DataFrame:
    """baseline, player, shapley_value, rank; values: mask with the baseline's number above the players' bits."""
    n = len(players)
    own = lambda k: values.filter(F.floor(F.col("mask") / (1 << n)) == k).select((F.col("mask") - k * (1 << n)).alias("mask"), "value")
    each = [shapley.exact_shapley(own(k), players).withColumn("baseline", F.lit(name)) for k, name in enumerate(names)]
    return reduce(DataFrame.unionByName, each).withColumn("rank", F.rank().over(Window.partitionBy("baseline").orderBy(F.desc("shapley_value"))))


def competition_table(rows: DataFrame, nodes: DataFrame, start_zone: int, start: float, params: Params = DEFAULT) -> DataFrame:
    """Episode summaries of each scenario with the start zone's wait and competitors. rows: episodes with competition_scenario."""
    spark, out = rows.sparkSession, []
    for s in params.competition:
        asked = spark.range(1).select(F.lit(start_zone).alias("zone_id"), F.lit(start).alias("minute"))
        at = lookup.node_at(asked, nodes, s, params, competitors=True).select(F.col("expected_wait").alias("start_wait"), F.col("competitors").alias("start_competitors"))
        own = episodes.episode_summary(rows.filter(F.col("competition_scenario") == s)).withColumn("competition_scenario", F.lit(s))
        out.append(own.join(F.broadcast(at)))  # one row
    return reduce(DataFrame.unionByName, out)
