"""Coalitions, horizon values, draws, episodes and studies on hand-made rows."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from wayfare.operators import candidates, episodes, horizon, shapley, studies
from wayfare.plans.params import Params


def table(spark, worth, n):
    return spark.createDataFrame([(m, float(worth([k for k in range(n) if m >> k & 1]))) for m in range(1 << n)], "mask long, value double")


GAMES = {
    "additive": (lambda s: sum((1, 2, 4)[k] for k in s), [1.0, 2.0, 4.0]),
    "unanimity": (lambda s: 6.0 if len(s) == 3 else 0.0, [2.0, 2.0, 2.0]),
    "dummy": (lambda s: 5.0 * (0 in s) + 0.0 * (1 in s) + 1.0 * (2 in s), [5.0, 0.0, 1.0]),
}


@pytest.mark.parametrize("game", GAMES)
def test_exact_shapley(spark, game):
    worth, want = GAMES[game]
    values = table(spark, worth, 3)
    found = shapley.exact_shapley(values, [10, 20, 30])
    assert [r.shapley_value for r in found.orderBy("player").collect()] == pytest.approx(want)
    assert {r.status for r in shapley.axiom_checks(values, found, [10, 20, 30]).collect()} == {"PASS"}
    summary = shapley.shapley_summary(values, found, 3).first()
    assert summary.gap == pytest.approx(0) and summary.coalitions == 8


def test_sampled_shapley_of_an_additive_game_has_no_error(spark):
    rows = shapley.sampled_shapley(table(spark, GAMES["additive"][0], 3), [10, 20, 30], 64, 1).orderBy("player").collect()
    assert [r.shapley_value for r in rows] == pytest.approx([1.0, 2.0, 4.0]) and all(r.standard_error < 1e-9 for r in rows)


def test_masks(spark):
    rows = {r.mask: (r.size, r.zones, r.allowed) for r in shapley.coalition_masks(spark, [7, 9], [4]).collect()}
    assert rows == {0: (0, [], [4]), 1: (1, [7], [7, 4]), 2: (1, [9], [9, 4]), 3: (2, [7, 9], [7, 9, 4])}


def solve(waits, moves, allowed, zones, steps):
    """Backward induction in plain Python, with ends in the same step read from the next."""
    value = [[0.0] * len(zones) for _ in range(steps + 1)]
    index = {z: k for k, z in enumerate(zones)}

    def ahead(step, end, zone):
        low = min(max(math.floor(end), step + 1), steps)
        high = min(max(math.ceil(end), low), steps)
        share = 0.0 if low == high else end - math.floor(end)
        return (1 - share) * value[low][index[zone]] + share * value[high][index[zone]]

    for step in range(steps - 1, -1, -1):
        for z in zones:
            own = [w for w in waits if w[0] == step and w[1] == z]
            p = own[0][2] if own else 0.0
            best = (1 - p) * value[step + 1][index[z]] + p * sum(pr * (reward + ahead(step, end, d)) for _, _, _, d, pr, end, reward in own if end <= steps + 1e-12)
            for s, o, target, end, cost in moves:
                if s == step and o == z and (allowed is None or target in allowed) and end <= steps + 1e-12:
                    best = max(best, ahead(step, end, target) - cost)
            value[step][index[z]] = best
    return {(s, z): value[s][index[z]] for s in range(steps + 1) for z in zones}


def test_horizon_values_match_plain_induction(spark):
    params = Params(horizon_minutes=20)
    zones, steps = [1, 2, 3], params.steps
    waits = [(s, z, 0.2 * z, d, 0.5, s + e, 3.0 * z + d) for s, z in itertools.product(range(steps), zones) for d, e in ((1, 0.4), (3, 1.7))]
    moves = [(s, z, t, s + 0.3 * abs(t - z) + 0.2, 0.5 * abs(t - z)) for s, z, t in itertools.product(range(steps), zones, (2, 3)) if z != t]
    masks = spark.createDataFrame([(0, []), (1, [2]), (2, [3]), (3, [2, 3]), (9, None)], "mask long, allowed array<int>")
    got = horizon.finite_horizon_values(spark.createDataFrame(waits, "step int, zone_id int, pickup double, destination int, probability double, end_pos double, reward double"), spark.createDataFrame(moves, "step int, zone_id int, target int, end_pos double, cost double"), masks, params)
    by = {(r.mask, r.step, r.zone_id): r.value for r in got.collect()}
    for mask, allowed in ((0, []), (1, [2]), (2, [3]), (3, [2, 3]), (9, None)):
        for (step, zone), v in solve(waits, moves, allowed, zones, steps).items():
            assert by[mask, step, zone] == pytest.approx(v, abs=1e-9)


def test_min_confidence_keeps_the_best_where_all_would_go(spark):
    rows = spark.createDataFrame([(0, 1, 2, 0.9, 0.5), (0, 1, 3, 0.1, 0.5), (0, 2, 2, 0.2, 0.7), (0, 2, 3, 0.2, 0.3)], "time_bin int, origin int, destination int, confidence double, destination_probability double")
    got = sorted((r.origin, r.destination, r.destination_probability) for r in candidates.with_min_confidence(rows, 0.5).collect())
    assert got == [(1, 2, 1.0), (2, 2, 1.0)]


def test_keyed_draws_repeat_and_spread(spark):
    rows = spark.range(4000).select(episodes.keyed_uniform(F.lit(1), "id").alias("u"), episodes.keyed_normal(F.lit(1), "id").alias("z"))
    first, again = rows.collect(), rows.repartition(7).orderBy("u").collect()
    assert sorted(r.u for r in first) == [r.u for r in again] and all(0 < r.u < 1 for r in first)
    assert abs(sum(r.u for r in first) / 4000 - 0.5) < 0.03 and abs(sum(r.z for r in first) / 4000) < 0.08


def test_destination_by_inverse_sum(spark):
    rows = [(q, d, p, u) for q, u in ((1, 0.1), (2, 0.65), (3, 0.9999)) for d, p in ((5, 0.6), (6, 0.3), (7, 0.0999))]
    got = {r.query_id: r.destination for r in episodes.draw_destination(spark.createDataFrame(rows, "query_id long, destination int, probability double, u double")).collect()}
    assert got == {1: 5, 2: 6, 3: 7}


def test_episode_minutes_add_up(spark):
    events = [("a", 1, 0, "WAIT_FOR_PICKUP", 0.0, 4.0, 0.0, 0.0, 0.0, "WAIT"), ("a", 1, 1, "OCCUPIED_TRIP", 4.0, 30.0, 20.0, 3.0, 8.0, "WAIT"), ("a", 1, 2, "EMPTY_REPOSITION", 30.0, 40.0, 0.0, 1.0, 2.0, "7"), ("a", 1, 3, "UNFINISHED_TRIP", 40.0, 110.0, 99.0, 9.0, 9.0, "WAIT")]
    rows = spark.createDataFrame(events, "algorithm string, scenario_id long, event_index int, event_type string, start_elapsed_min double, end_elapsed_min double, revenue double, operating_cost double, distance_miles double, selected_action string")
    got = episodes.episodes_from_events(rows).first()
    assert (got.gross_revenue, got.operating_cost, got.completed_trips, got.net_earnings) == (20.0, 4.0, 1, 16.0)
    assert (got.waiting_minutes, got.occupied_minutes, got.empty_minutes, got.unfinished_minutes, got.unused_minutes) == (4.0, 26.0, 10.0, 70.0, 10.0)
    assert got.first_action == "WAIT" and got.unfinished_trip and (got.occupied_miles, got.empty_miles) == (8.0, 2.0)


def test_rank_correlation_shares_ranks_of_ties(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 4.0)], "a double, b double")
    assert studies.spearman(rows, "a", "b").first().spearman == pytest.approx(0.9486832980505138)
