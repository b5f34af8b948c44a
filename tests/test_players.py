"""The game's operators on hand-made values, and candidates of dense states."""

import itertools
import math

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from wayfare.operators import candidates, features, nodes, players, policies, shapley, studies
from wayfare.queries import model

WHO = [10, 20, 30]


def table(spark, worth):
    return spark.createDataFrame([(m, float(worth([k for k in range(3) if m >> k & 1]))) for m in range(8)], "mask long, value double")


def additive(*weights):
    return lambda s: 100.0 + sum(weights[k] for k in s)


def one(df):
    return df.first()


def test_dominance_follows_the_ranks(spark):
    values = table(spark, additive(1, 2, 4))
    found = shapley.exact_shapley(values, WHO)
    assert one(players.check_dominance(values, found, WHO)).status == "PASS"
    upside_down = found.withColumn("shapley_value", -F.col("shapley_value"))
    row = one(players.check_dominance(values, upside_down, WHO))
    assert row.status == "WARN" and row.detail == pytest.approx(-1)
    flat = table(spark, additive(2, 2, 2))
    assert one(players.check_dominance(flat, shapley.exact_shapley(flat, WHO), WHO)).status == "N/A"


@pytest.mark.parametrize(("left", "status", "lost"), [(additive(1, 2, 4), "PASS", 0.0), (lambda s: 0.5 * additive(1, 2, 4)(s), "WARN", 50.0)])
def test_confidence_compares_the_whole_values(spark, left, status, lost):
    row = one(players.check_confidence(table(spark, additive(1, 2, 4)), table(spark, left), WHO))
    assert (row.status, row.detail) == (status, pytest.approx(lost))


@pytest.mark.parametrize(("after", "status"), [(additive(1, 2, 5), "PASS"), (additive(1, 2, 3), "FAIL"), (lambda s: additive(9, 2, 4)(s) - (3 if s == [2] else 0), "FAIL")])
def test_income_must_not_lower_values(spark, after, status):
    row = one(players.check_income(table(spark, additive(1, 2, 4)), table(spark, after), WHO, 30))
    assert row.status == status and row.is_hard


@pytest.mark.parametrize(("values", "status"), [([10, 14, 17, 19], "PASS"), ([10, 11, 13, 16], "INFO"), ([10, 10, 10, 10], "PASS")])
def test_diminishing_returns(spark, values, status):
    row = one(players.check_diminishing(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "step int, value double")))
    assert (row.status, row.detail) == (status, values[3] - values[2])


def test_summary_counts_by_status(spark):
    rows = spark.createDataFrame([("a", "PASS", True), ("b", "PASS", True), ("c", "WARN", False)], "axiom string, status string, is_hard boolean")
    assert {(r.is_hard, r.status, r.checks) for r in players.axiom_summary(rows).collect()} == {(True, "PASS", 2), (False, "WARN", 1)}


def test_coalitions_are_exported_with_their_zones(spark):
    rows = players.coalition_export(table(spark, additive(1, 2, 4)), shapley.coalition_masks(spark, WHO), [7]).collect()
    by = {r.coalition_mask: (r.coalition_size, r.coalition_zone_ids, r.coalition_value, r.base_allowed_zone_ids) for r in rows}
    assert len(by) == 8 and by[0] == (0, "", 100.0, "7") and by[5] == (2, "10|30", 105.0, "7")


def test_baselines_are_told_apart_by_mask(spark):
    rows = table(spark, additive(1, 2, 4)).union(table(spark, additive(5, 2, 2)).withColumn("mask", F.col("mask") + 8))
    got = {(r.baseline, r.player): (r.shapley_value, r["rank"]) for r in players.baseline_shapley(rows, WHO, ["none", "other"]).collect()}
    assert got["none", 30] == (pytest.approx(4), 1) and got["other", 10] == (pytest.approx(5), 1) and got["other", 20][1] == got["other", 30][1] == 2


def test_players_by_thirds_then_rank_sum(spark):
    rows = [(1, 9.0, 1, 0.0), (2, 1.0, 9, 0.0), (3, 0.0, 0, 9.0), (4, 8.0, 8, 8.0), (5, 2.0, 2, 2.0)]
    got = shapley.select_players(spark.createDataFrame(rows, "player int, gain double, coverage long, synergy double"), 4).orderBy("rank").collect()
    assert [(r.player, r.reasons) for r in got] == [(1, "gain"), (2, "coverage"), (3, "synergy"), (4, "rank_sum")]


def test_external_baselines_leave_players_out(spark):
    scored = spark.createDataFrame([(1, 9.0, 9.0, 9.0), (2, 5.0, 1.0, 2.0), (3, 5.0, 2.0, 1.0)], "zone_id int, demand double, income double, greedy double")
    assert tuple(one(studies.external_baselines(scored, spark.createDataFrame([(1,)], "zone_id int")))) == (2, 3, 2)


def test_coverage_counts_steps_as_a_plain_walk(spark):
    m, start, n = model(spark, SMALL), 480.0, 4
    states = policies.state_grid(m.zones, start, list(players.COVERAGE_MINUTES))
    wide = players.Params(candidate_zones=8)
    from wayfare.operators import lookup

    steps = [(r.origin, r.destination, "dynamic") for r in candidates.candidate_details(states, m, wide).filter("selected").collect()]
    options = lookup.od_options(states.select(F.col("state_id").alias("query_id"), F.col("zone_id").alias("origin"), "minute"), m.od).collect()
    for q in {r.query_id for r in options}:
        best = sorted((r for r in options if r.query_id == q), key=lambda r: (-r.probability, r.destination))[:4]
        steps += [(r.origin, r.destination, "passenger_reachable") for r in best]
    met, frontier, found = {}, {3}, {}
    for depth in range(3):
        reached = [s for s in steps if s[0] in frontier]
        for _, z, source in reached:
            met[z] = met.get(z, 0) + 1
            found.setdefault(z, set()).add(f"dynamic_depth_{depth}" if source == "dynamic" else source)
        frontier = set(sorted({z for _, z, _ in reached}, key=lambda z: (-met[z], z))[:12])
    got = {r.zone_id: (r.coverage, r.discovery) for r in players.reachable_coverage(m, 3, start, n).collect()}
    assert got == {z: (c, "|".join(sorted(found[z]))) for z, c in met.items()}


def test_variants_are_solved_apart(spark):
    """A zone that earns more in one variant is worth more there, and the model as it is gives the same alone or among others."""
    m, masks = model(spark, SMALL), spark.createDataFrame([(0, [])], "mask long, allowed array<int>")
    params = players.Params(horizon_minutes=60)
    both = {r.variant: r.value for r in players.game_values(m, 480.0, 3, masks, [3], [players.Variant("a"), players.Variant("b", zone=3, factor=2.0)], params).collect()}
    alone = one(players.game_values(m, 480.0, 3, masks, [3], [players.Variant("a")], params)).value
    assert both["a"] == pytest.approx(alone) and both["b"] >= both["a"] and (both["a"] == 0 or both["b"] > both["a"])


def test_features_of_waiting_and_moving(spark):
    m = model(spark, SMALL)
    states = spark.createDataFrame([(1, 3, 480.0, 60.0)], "state_id long, zone_id int, minute double, remaining double")
    scale = nodes.pickup_scale(m.posterior)
    state = one(features.state_features(states, m.nodes, scale))
    assert state.sin_clock == pytest.approx(math.sin(2 * math.pi / 3)) and state.remaining_share == 0.5 and 0 <= state.crowding < 1
    rows = {r.action: r for r in features.state_action_features(states, spark.createDataFrame([(1, None), (1, 5)], "state_id long, action int"), m, scale).collect()}
    assert (rows[None].is_wait, rows[None].route_minutes, rows[None].route_confidence, rows[None].target_demand) == (1.0, 0.0, 0.0, pytest.approx(state.demand))
    assert rows[5].is_wait == 0.0 and rows[5].route_minutes > 0 and rows[5].wait == state.wait


def test_competition_table_has_each_scenario(spark):
    rows = spark.createDataFrame([(s, "x", k, float(k), 1) for s in ("low", "high") for k in range(3)], "competition_scenario string, algorithm string, scenario_id long, net_earnings double, completed_trips int")
    got = {r.competition_scenario: r for r in players.competition_table(rows, model(spark, SMALL).nodes, 3, 480.0).collect()}
    assert set(got) == {"low", "high"} and got["low"].start_wait <= got["high"].start_wait and got["low"].mean == 1.0


def test_invalid_answers_stop_the_coverage_summary(spark):
    rows = spark.createDataFrame([(1, True), (2, None)], "query_id long, is_valid boolean").withColumns({"source": F.lit("s"), "confidence": F.lit(0.5), "is_directly_observed": F.lit(True)})
    assert one(studies.coverage_summary(rows.filter("is_valid"))).coverage == 1.0
    with pytest.raises(Exception, match="invalid answer to question 2"):
        studies.coverage_summary(rows).collect()



def test_all_subsets_have_a_mask(spark):
    masks = {tuple(r.zones) for r in shapley.coalition_masks(spark, WHO).collect()}
    assert masks == {c for n in range(4) for c in itertools.combinations(WHO, n)}
