"""A game between given zones on the board: values of the horizon, actions and Shapley values; SQL of candidates, policies and the game."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators import horizon, players, policies, shapley, studies
from wayfare.plans.params import DEFAULT
from wayfare.queries import query, rounded
from wayfare.queries_decide import START, _states, board
from wayfare.queries_players import START_ZONE, TIES, _once
from wayfare.queries_sql import _CHAIN, ORACLES, _select
from wayfare.sources.lineage import settle

#: The zones beside the start zone on the grid, and one that all coalitions may go to in the second half of the masks.
TARGETS, ALWAYS = (3, 7, 9, 13), 12


@_once("board_horizon")
def _horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coalitions of TARGETS, without and with ALWAYS (masks from 16 on), in one backward induction."""
    b = board(spark, sf_dir)
    steps = spark.range(DEFAULT.steps).select(F.col("id").cast("int").alias("step"))
    wanted = b.zones.select("zone_id").distinct().crossJoin(F.broadcast(steps)).withColumn("target", F.explode(F.array(*(F.lit(z) for z in (*TARGETS, ALWAYS)))))  # a city's zones x steps x players
    masks = shapley.coalition_masks(spark, list(TARGETS), []).select("mask", "allowed").union(shapley.coalition_masks(spark, list(TARGETS), [ALWAYS]).select(F.col("mask") + 16, "allowed"))
    return settle(horizon.finite_horizon_values(settle(horizon.wait_transitions(b, START)), settle(horizon.move_transitions(b, START, wanted)), masks))


@query
def board_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of every zone at every step under every coalition, and where to move."""
    return rounded(_horizon(spark, sf_dir), 3)


@query
def board_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each coalition's best action is to move to each target, by step."""
    return horizon.optimal_actions(_horizon(spark, sf_dir)).groupBy("mask", "step", "target").agg(F.count(F.lit(1)).alias("zones"))


@_once("board_coalitions")
def _coalitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(horizon.start_value(_horizon(spark, sf_dir), START_ZONE).select("mask", F.round("coalition_value", TIES).alias("value")))


@query
def board_coalitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask, size, zones and value of every coalition from the start zone."""
    rows = players.coalition_export(_coalitions(spark, sf_dir).filter("mask < 16"), shapley.coalition_masks(spark, list(TARGETS)))
    return rounded(rows, 3)


@query
def board_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of the targets with what each gains alone and with its best partner."""
    values = _coalitions(spark, sf_dir).filter("mask < 16")
    report = shapley.shapley_report(shapley.exact_shapley(values, list(TARGETS)), board(spark, sf_dir).zones)
    alone = shapley.singleton_gain(values, list(TARGETS))
    return rounded(report.join(alone, "player").join(shapley.pair_synergy(values, list(TARGETS)), "player"), 3)


@query
def board_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How Shapley values without and with an always allowed zone agree: rank correlation and shared top players."""
    found = players.baseline_shapley(_coalitions(spark, sf_dir), list(TARGETS), ["wait_only", "with_zone"])
    return rounded(studies.rank_agreement(found.select(F.col("baseline").alias("kind"), F.col("player").alias("zone_id"), F.round("shapley_value", 4).alias("value")), 2), 4)


@query
def board_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the value model does in every state of the grid; waiting where the way is longer than the time left."""
    states = _states(spark, sf_dir)
    best = horizon.optimal_actions(_horizon(spark, sf_dir).filter("mask = 15"))
    routes = board(spark, sf_dir).routes.select(F.col("origin").alias("zone_id"), F.col("destination").alias("action"), "minutes")
    allowed = states.select("state_id", "zone_id", "remaining").join(routes, "zone_id").filter("minutes < remaining").select("state_id", "action")
    return policies.apply_value_policy(states, best, allowed)


#: The board: empty streets, tariffs by zone.
_BOARD = f"""{_CHAIN}, board_hops AS (
  SELECT 1 AS k, origin, destination, greatest(z.miles/15*60, 0.1) AS minutes, greatest(z.miles, 0.01) AS miles FROM adjacent a JOIN miles z USING (origin, destination)
  UNION ALL SELECT k + 1, origin, destination, min(minutes), min(miles) FROM (SELECT h.k, h.origin, a.destination, h.minutes + greatest(z.miles/15*60, 0.1) AS minutes, h.miles + greatest(z.miles, 0.01) AS miles FROM board_hops h JOIN adjacent a ON a.origin = h.destination JOIN miles z ON z.origin = a.origin AND z.destination = a.destination WHERE h.k < 9 AND a.destination <> h.origin) GROUP BY ALL),
board_routes AS MATERIALIZED (SELECT origin, destination, min(minutes) AS minutes, min(miles) AS miles FROM board_hops GROUP BY ALL),
board_od AS MATERIALIZED (SELECT time_bin, origin, destination, p, revenue*(0.5 + (origin*7 % 5)/2.0::DOUBLE) AS revenue, minutes, dist FROM od),
board_nodes AS MATERIALIZED (SELECT n.time_bin, n.zone_id, posterior, ratio, node_confidence, wait_medium AS wait, e.revenue, e.minutes, e.dist FROM nodes n JOIN (SELECT time_bin, origin, sum(p*revenue) AS revenue, sum(p*minutes) AS minutes, sum(p*dist) AS dist FROM board_od GROUP BY ALL) e ON e.time_bin = n.time_bin AND e.origin = n.zone_id),
board_speed AS MATERIALIZED (SELECT q.minute, all_mph/least(greatest((1-t)*a.mph + t*b.mph, 5), 35) AS slow FROM (SELECT {START} + 5*range::DOUBLE AS minute, floor(({START} + 5*range)/15)::INT AS low, ({START} + 5*range)/15.0::DOUBLE - floor(({START} + 5*range)/15) AS t FROM range(24)) q JOIN profiles a ON a.time_bin = low JOIN profiles b ON b.time_bin = (low + 1) % 96 CROSS JOIN mean_mph),
states AS (SELECT (zone_id*1000 + k)::BIGINT AS state_id, zone_id, {START} + 15*k::DOUBLE AS minute, (({START}/15)::INT + k)::INT AS time_bin, 120 - 15*k::DOUBLE AS remaining FROM zones, range(8) r(k))"""

_NET, _RATE, _FREE = "(revenue - 0.35*dist)", "(revenue - 0.35*dist)/greatest(1, wait + minutes)", "1/greatest(1e-6, ratio)"
_SIX = ("demand", "net_trip", "net_rate", "competition_advantage", "proximity", "destination_probability")

_POOL = f"""{_BOARD},
led AS (SELECT time_bin, zone_id FROM (SELECT time_bin, zone_id, {', '.join(f'row_number() OVER (PARTITION BY time_bin ORDER BY round({x}, 9) DESC, zone_id) AS k{i}' for i, x in enumerate(('posterior', _NET, _RATE, _FREE, 'node_confidence')))} FROM board_nodes) WHERE least(k0, k1, k2, k3, k4) <= 12),
likely AS (SELECT time_bin, origin, destination, row_number() OVER (PARTITION BY time_bin, origin ORDER BY p DESC, destination) AS k FROM board_od),
pool AS (
  SELECT state_id, zone_id AS origin, minute, remaining, s.time_bin, neighbour AS destination FROM states s JOIN near_all n USING (zone_id) WHERE rank <= 6
  UNION SELECT state_id, s.zone_id, minute, remaining, s.time_bin, l.zone_id FROM states s JOIN led l ON l.time_bin = s.time_bin
  UNION SELECT state_id, zone_id, minute, remaining, s.time_bin, destination FROM states s JOIN likely l ON l.time_bin = s.time_bin AND l.origin = s.zone_id WHERE k <= 12
  UNION SELECT state_id, zone_id, minute, remaining, time_bin, destination FROM states s JOIN flows f ON f.origin = s.zone_id WHERE rank <= 12),
routed AS (
  SELECT p.*, greatest(r.minutes*slow, 0.1) AS route_minutes, r.miles AS route_miles FROM pool p JOIN board_routes r ON r.origin = p.origin AND r.destination = p.destination JOIN board_speed v ON v.minute = p.minute
  WHERE p.origin <> p.destination AND greatest(r.minutes*slow, 0.1) <= 45 AND r.miles <= 25),
timed_arrival AS (SELECT *, (floor((minute + route_minutes)/15)::INT) % 96 AS low, (minute + route_minutes)/15 - floor((minute + route_minutes)/15) AS t FROM routed),
arrived AS (
  SELECT s.state_id, s.origin, s.destination, remaining, route_minutes, route_miles, {', '.join(f'(1-t)*a.{c} + t*b.{c} AS {c}' for c in ('posterior', 'ratio', 'wait', 'revenue', 'minutes', 'dist'))}, coalesce(o.p, 0) AS destination_probability, 1/greatest(1, route_minutes) AS proximity
  FROM timed_arrival s JOIN board_nodes a ON a.time_bin = low AND a.zone_id = s.destination JOIN board_nodes b ON b.time_bin = (low + 1) % 96 AND b.zone_id = s.destination LEFT JOIN board_od o ON o.time_bin = s.time_bin AND o.origin = s.origin AND o.destination = s.destination),
scores AS (SELECT *, posterior AS demand, {_NET} AS net_trip, {_RATE} AS net_rate, {_FREE} AS competition_advantage FROM arrived),
metric_ranks AS (SELECT *, {', '.join(f'rank() OVER (PARTITION BY state_id ORDER BY round({m}, 9) DESC) AS r{i}, row_number() OVER (PARTITION BY state_id ORDER BY round({m}, 9) DESC, destination) AS k{i}' for i, m in enumerate(_SIX))} FROM scores),
placed AS (SELECT *, {' + '.join(f'r{i}' for i in range(6))} AS rank_sum, coalesce({', '.join(f'CASE WHEN k{i} <= 4 THEN {4*i} + k{i} END' for i in range(6))}) AS first_k FROM metric_ranks),
details AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY first_k NULLS LAST, rank_sum, round(route_minutes, 9), destination)::INT AS selected_rank FROM placed)"""

_SCORES = {
    "highest_demand": ("posterior/greatest(1e-6, ratio)", "posterior/greatest(1e-6, ratio)", 1e-12), "highest_income": (_NET, _NET, 1e-12),
    "greedy_net_earnings": (f"({_NET} - 0.35*route_miles)/greatest(1, route_minutes + wait + minutes)", f"{_NET}/greatest(1, wait + minutes)", 1e-12),
    "legacy_utility": ("revenue + 0.3*posterior - 0.5*route_minutes - 0.15*route_miles", "revenue + 0.3*posterior", 0),
}

_ACTIONS = f"""{_POOL},
actions AS MATERIALIZED (
  SELECT 'wait_only' AS policy, state_id, NULL::INT AS action FROM states UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{name}', s.state_id, CASE WHEN best.score > {stay} + {tolerance} THEN best.zone END FROM states s JOIN board_nodes n ON n.time_bin = s.time_bin AND n.zone_id = s.zone_id LEFT JOIN "
    f"(SELECT state_id, first(destination ORDER BY round({move}, 9) DESC, selected_rank) AS zone, max({move}) AS score FROM details WHERE selected_rank <= 12 AND route_minutes < remaining GROUP BY state_id) best ON best.state_id = s.state_id"
    for name, (move, stay, tolerance) in _SCORES.items()
) + ")"

#: Waits and moves of the game, then the induction: a row carries the values of all later steps, the last one first.
_GAME = f"""{_BOARD},
stood AS (
  SELECT z.zone_id, s.k::INT AS step, {START} + 5*s.k AS minute, (1-t)*a.wait + t*b.wait AS wait
  FROM zones z, (SELECT range AS k, floor(({START} + 5*range)/15)::INT AS low, ({START} + 5*range)/15.0::DOUBLE - floor(({START} + 5*range)/15) AS t FROM range(24)) s JOIN board_nodes a ON a.time_bin = low AND a.zone_id = z.zone_id JOIN board_nodes b ON b.time_bin = (low + 1) % 96 AND b.zone_id = z.zone_id),
waited AS (SELECT *, 1 - exp(-5/wait) AS pickup, least(greatest(wait - 5*exp(-5/wait)/(1 - exp(-5/wait)), 0), 5) AS c FROM stood),
left_at AS (SELECT *, (floor((minute + c)/15)::INT) % 96 AS low, (minute + c)/15 - floor((minute + c)/15) AS t FROM waited),
trips AS (
  SELECT zone_id, step, pickup, c, destination, sum(w*p) AS p, sum(w*p*revenue)/sum(w*p) AS revenue, sum(w*p*minutes)/sum(w*p) AS minutes, sum(w*p*dist)/sum(w*p) AS dist
  FROM (SELECT l.zone_id, step, pickup, c, o.destination, CASE WHEN side = 0 THEN 1 - t ELSE t END AS w, o.p, o.revenue, o.minutes, o.dist FROM left_at l, (VALUES (0), (1)) v(side) JOIN board_od o ON o.origin = l.zone_id AND o.time_bin = (l.low + side) % 96) GROUP BY ALL),
waits AS MATERIALIZED (SELECT zone_id, step, pickup, destination, p/sum(p) OVER (PARTITION BY zone_id, step) AS p, revenue - 0.35*dist AS reward, step + (c + minutes)/5 AS ends FROM trips),
moves AS MATERIALIZED (
  SELECT origin AS zone_id, k::INT AS step, destination AS target, k + greatest(minutes*slow, 0.1)/5 AS ends, 0.35*miles AS cost
  FROM board_routes JOIN (SELECT range AS k FROM range(24)) ON true JOIN board_speed v ON v.minute = {START} + 5*k WHERE destination IN {(*TARGETS, ALWAYS)} AND origin <> destination AND greatest(minutes*slow, 0.1) <= 45 AND miles <= 25),
tied AS (SELECT * FROM (SELECT zone_id, step, pickup, destination, NULL::INT AS target, p, reward, ends FROM waits UNION ALL SELECT zone_id, step, NULL, target, target, NULL, -cost, ends FROM moves) WHERE ends <= 24 + 1e-12),
ended AS MATERIALIZED (SELECT *, 25 - least(greatest(floor(ends)::INT, step + 1), 24) AS a, 25 - least(greatest(ceil(ends)::INT, least(greatest(floor(ends)::INT, step + 1), 24)), 24) AS b, ends - floor(ends) AS f FROM tied),
chances AS MATERIALIZED (SELECT DISTINCT zone_id, step, pickup FROM waits),
solved AS (
  SELECT mask::INT AS mask, zone_id, 24 AS step, [0.0::DOUBLE] AS v, NULL::INT AS target FROM range(32) m(mask), zones
  UNION ALL
  SELECT mask, zone_id, step, list_append(v, CASE WHEN gain > stay + 1e-12 THEN gain ELSE stay END), CASE WHEN gain > stay + 1e-12 THEN chosen END FROM (
    SELECT s.mask, s.zone_id, s.step - 1 AS step, s.v, (1 - h.pickup)*s.v[-1] + h.pickup*coalesce(sum(e.p*(e.reward + (CASE WHEN e.a = e.b THEN d.v[e.a] ELSE (1-e.f)*d.v[e.a] + e.f*d.v[e.b] END))) FILTER (e.target IS NULL), 0) AS stay,
      max(e.reward + (CASE WHEN e.a = e.b THEN d.v[e.a] ELSE (1-e.f)*d.v[e.a] + e.f*d.v[e.b] END)) FILTER (e.target IS NOT NULL) AS gain, first(e.target ORDER BY round(e.reward + (CASE WHEN e.a = e.b THEN d.v[e.a] ELSE (1-e.f)*d.v[e.a] + e.f*d.v[e.b] END), 9) DESC, e.target) FILTER (e.target IS NOT NULL) AS chosen
    FROM solved s JOIN chances h ON h.zone_id = s.zone_id AND h.step = s.step - 1 LEFT JOIN (ended e JOIN solved d ON d.zone_id = e.destination) ON e.zone_id = s.zone_id AND e.step = s.step - 1 AND d.mask = s.mask
      AND (e.target IS NULL OR (e.target = {ALWAYS} AND s.mask >= 16) OR (list_position({list(TARGETS)}, e.target) > 0 AND (s.mask >> (list_position({list(TARGETS)}, e.target) - 1)::INT) & 1 = 1))
    GROUP BY s.mask, s.zone_id, s.step, s.v, h.pickup)),
coalitions AS MATERIALIZED (SELECT mask, round(v[-1], {TIES}) AS value FROM solved WHERE step = 0 AND zone_id = {START_ZONE}),
who AS (SELECT unnest({list(TARGETS)})::INT AS player, unnest([1, 2, 4, 8])::INT AS bit),
marginal AS (SELECT player, a.mask // 16 AS game, a.mask % 16 AS mask, bit_count(a.mask % 16) AS size, b.value - a.value AS marginal FROM coalitions a JOIN who ON (a.mask & bit) = 0 JOIN coalitions b ON b.mask = a.mask | bit),
values_of AS (SELECT game, player, sum(marginal*[6, 2, 2, 6][size + 1]/24.0::DOUBLE) AS value FROM marginal GROUP BY ALL),
partners AS (SELECT m.player, q.player AS partner, m.marginal - a.marginal AS synergy, row_number() OVER (PARTITION BY m.player ORDER BY m.marginal - a.marginal DESC, q.player) AS k FROM marginal m JOIN who q ON q.bit = m.mask JOIN marginal a ON a.player = m.player AND a.mask = 0 AND a.game = 0 WHERE m.game = 0),
ranks_of AS (SELECT game, player, round(value, 4) AS value, rank() OVER (PARTITION BY game ORDER BY round(value, 4)) + (count(*) OVER (PARTITION BY game, round(value, 4)) - 1)/2.0 AS r, row_number() OVER (PARTITION BY game ORDER BY round(value, 4) DESC, player) AS k FROM values_of)"""


def _on(chain: str, *args, **kwargs) -> str:
    return chain + _select(*args, **kwargs).removeprefix(_CHAIN)


ORACLES |= {
    "candidate_details": _on(_POOL, "state_id, origin, destination, rank_sum::INT AS rank_sum, selected_rank, selected_rank <= 12 AS selected", "details", "route_minutes; route_miles; " + "; ".join(_SIX), digits=3),
    "start_candidates": _on(_POOL, "state_id, selected_rank, destination, z.zone_name, z.borough, rank_sum::INT AS rank_sum", "details d JOIN zones z ON z.zone_id = d.destination WHERE selected_rank <= 12", "route_minutes; route_miles"),
    "policy_actions": f"{_ACTIONS} SELECT * FROM actions",
    "policy_agreement": _on(_ACTIONS, "a.policy AS policy_a, b.policy AS policy_b", "actions a JOIN actions b ON a.state_id = b.state_id GROUP BY a.policy, b.policy", "avg((a.action IS NOT DISTINCT FROM b.action)::INT) agreement; avg(((a.action IS NULL) = (b.action IS NULL))::INT) type_agreement"),
    "policy_summary": _on(_ACTIONS, "policy, count(*) AS states, count(DISTINCT coalesce(action::VARCHAR, 'WAIT')) AS distinct_actions", "actions GROUP BY policy", "avg((action IS NULL)::INT) wait_rate"),
    "board_values": _on(_GAME, "mask::BIGINT AS mask, step, zone_id, target", "solved", "v[-1] value", 3),
    "board_actions": f"{_GAME} SELECT mask::BIGINT AS mask, step, target, count(*) AS zones FROM solved WHERE target IS NOT NULL GROUP BY ALL",
    "board_coalitions": _on(_GAME, f"mask::BIGINT AS coalition_mask, bit_count(mask)::INT AS coalition_size, array_to_string(list_filter({list(TARGETS)}, lambda z, i: (mask >> (i - 1)::INT) & 1 = 1), '|') AS coalition_zone_ids, '' AS base_allowed_zone_ids", "coalitions WHERE mask < 16", "value coalition_value", 3),
    "board_shapley": _on(_GAME, "v.player, row_number() OVER (ORDER BY value DESC, v.player)::INT AS rank, zone_name, borough, partner", "values_of v JOIN zones z ON z.zone_id = v.player JOIN marginal m ON m.player = v.player AND m.game = 0 AND m.mask = 0 JOIN partners p ON p.player = v.player AND p.k = 1 WHERE v.game = 0", "value shapley_value; value lower; value upper; marginal singleton_gain; synergy", 3),
    "board_baselines": _on(_GAME, "'wait_only' AS kind_a, 'with_zone' AS kind_b", "ranks_of a JOIN ranks_of b ON a.player = b.player WHERE a.game = 0 AND b.game = 1", "corr(a.r,b.r) spearman; sum((a.k<=2AND(b.k<=2))::INT)/sum((a.k<=2OR(b.k<=2))::INT)::DOUBLE jaccard".replace("AND(", " AND (").replace("OR(", " OR ("), 4),
    "board_policy": f"""{_GAME} SELECT s.state_id, CASE WHEN r.minutes < s.remaining THEN v.target END AS action FROM states s JOIN solved v ON v.mask = 15 AND v.zone_id = s.zone_id AND v.step = floor((120 - s.remaining)/5)::INT LEFT JOIN board_routes r ON r.origin = s.zone_id AND r.destination = v.target""",
    "competition_table": _on(
        f"""{_CHAIN}, thirds AS (SELECT ['low', 'medium', 'high'][hour(ts)::INT//8 + 1] AS competition_scenario, event_type AS algorithm, user_id, sum(value) AS x FROM events GROUP BY ALL),
level AS (SELECT s AS competition_scenario, w AS start_wait, greatest(w*posterior/15 - 1, 0) AS start_competitors FROM full_nodes, (VALUES ('low'), ('medium'), ('high')) v(s) CROSS JOIN LATERAL (SELECT CASE s WHEN 'low' THEN wait_low WHEN 'medium' THEN wait_medium ELSE wait_high END AS w) WHERE zone_id = {START_ZONE} AND time_bin = {int(START) // 15})""",
        "competition_scenario, algorithm, episodes",
        "(SELECT competition_scenario, algorithm, count(*) AS episodes, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std FROM thirds GROUP BY ALL) JOIN level USING (competition_scenario)",
        "mean; mean-1.96*std/sqrt(episodes) lower; mean+1.96*std/sqrt(episodes) upper; start_wait; start_competitors"),
}
