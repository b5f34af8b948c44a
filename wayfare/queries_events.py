"""Registered queries of typed events, their episodes and time accounts, report tables, table policies and readers, and their SQL.

Events are derived from orders and line items: a customer's orders of one priority are an episode, their items its events.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.operators import clean, episodes, policies, shapley, studies
from wayfare.plans.params import DEFAULT
from wayfare.queries import line_view, model, query, rounded, trip_view, zone_view
from wayfare.queries_board import _SCORES, _on
from wayfare.queries_board import _ACTIONS as _ACTIONS_SQL
from wayfare.queries_decide import BOARD, START, _candidates, _players, _states, board, coalition_table
from wayfare.queries_sql import _CHAIN, _EVENTS, ORACLES, _select
from wayfare.sources.lineage import shared_dir
from wayfare.sources.trips import read_trips, read_zones, write_table

TYPES = ("WAIT_NO_PICKUP", "WAIT_FOR_PICKUP", "OCCUPIED_TRIP", "OCCUPIED_TRIP", "EMPTY_REPOSITION", "OCCUPIED_TRIP", "WAIT_NO_PICKUP")


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the window by customer first, so that rows are sorted by a number, not by one of five texts."""
    rows = line_view(spark, sf_dir)
    kind = F.element_at(F.array(*(F.lit(t) for t in TYPES)), ((F.col("l_partkey") + F.col("l_linenumber")) % len(TYPES)).cast("int") + 1)
    from_zone = (F.col("s_nationkey") + 1).cast("int")
    to_zone = F.when(F.col("kind") == "OCCUPIED_TRIP", F.col("c_nationkey") + 1).when(F.col("kind") == "EMPTY_REPOSITION", (F.col("s_nationkey") + F.col("l_linenumber")) % 25 + 1).otherwise(F.col("s_nationkey") + 1).cast("int")
    own = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = rows.withColumn("minutes", ((F.col("l_partkey") * 13) % 30 + 1).cast("double"))
    rows = rows.withColumn("event_index", (F.row_number().over(own) - 1).cast("long")).withColumn("end", F.sum("minutes").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("end") - F.col("minutes")).filter(F.col("start") < DEFAULT.horizon_minutes)
    rows = rows.withColumn("kind", kind)  # not before: it would be dealt and sorted with the rows
    late = F.col("end") > DEFAULT.horizon_minutes
    event = F.when(late & (F.col("kind") == "OCCUPIED_TRIP"), "UNFINISHED_TRIP").when(late & (F.col("kind") == "EMPTY_REPOSITION"), "TERMINAL_UNUSED").otherwise(F.col("kind"))
    miles = F.when(F.col("kind").isin("OCCUPIED_TRIP", "EMPTY_REPOSITION"), F.col("l_quantity") * 0.4).otherwise(0.0).cast("double")
    action = F.when(F.col("kind").startswith("WAIT"), "WAIT").when(F.col("kind") == "EMPTY_REPOSITION", to_zone.cast("string"))
    return rows.select(
        F.col("o_orderpriority").alias("algorithm"), F.col("o_custkey").alias("scenario_id"), "event_index", event.alias("event_type"), from_zone.alias("from_zone"), to_zone.alias("to_zone"), F.col("start").alias("start_elapsed_min"), F.least("end", F.lit(float(DEFAULT.horizon_minutes))).alias("end_elapsed_min"),
        F.when(F.col("kind") == "OCCUPIED_TRIP", F.col("l_extendedprice") / 1000.0).otherwise(0.0).cast("double").alias("revenue"), (DEFAULT.cost_per_mile * miles).alias("operating_cost"), miles.alias("distance_miles"), action.alias("selected_action"),
    )


@query
def event_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes and clock readings of every event."""
    return rounded(episodes.event_durations(event_view(spark, sf_dir), START).select("algorithm", "scenario_id", "event_index", "event_type", "minutes", "start_clock", "end_clock"))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.episodes_from_events(event_view(spark, sf_dir))


@query
def event_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earnings, decisions, miles and the closed time account of every episode."""
    return rounded(_told(spark, sf_dir), 4)


@query
def event_episode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked means of the algorithms, with how often they move and begin by waiting."""
    told = _told(spark, sf_dir)
    return rounded(episodes.episode_summary(told, ("unused_minutes", "unfinished_trip")).join(episodes.move_share(told), "algorithm"), 3)


@query
def event_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episode of each algorithm that is nearest to its means, an open time account counting against it."""
    told = _told(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("net_earnings", "time_accounting_error")})
    return rounded(episodes.representative_episode(told).select("algorithm", "scenario_id", "completed_trips", "net_earnings", "time_accounting_error"), 4)


@query
def paired_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain of each algorithm over the first one in the same scenarios, against a stated gain of one."""
    told = _told(spark, sf_dir)
    return rounded(episodes.paired_calibration(told, "5-LOW", "1-URGENT", 1.0), 3)


@query
def trajectory_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves between zones with both centroids, numbered along the episode."""
    rows = studies.trajectory_moves(event_view(spark, sf_dir), zone_view(spark, sf_dir))
    return rounded(rows.select("algorithm", "scenario_id", "event_index", "from_x", "from_y", "to_x", "to_y", "move", "label"), 1)


@query
def timeline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(studies.timeline_segments(event_view(spark, sf_dir)))


@query
def minute_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean minutes of five parts of an episode, and their running total."""
    return rounded(studies.minute_breakdown(_told(spark, sf_dir)), 4)


@query
def ablation_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean drops with one deviation on either side, of the best and of random players removed."""
    values = coalition_table(spark, sf_dir)
    rows = shapley.ablation(values, shapley.exact_shapley(values, _players()), _players())
    return rounded(studies.ablation_bands(shapley.ablation_summary(rows)).select("kind", "removed", "lower", "upper"), 3)


@query
def player_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All zones, those that play with their value."""
    found = shapley.exact_shapley(coalition_table(spark, sf_dir), _players())
    return rounded(studies.player_map_table(zone_view(spark, sf_dir), found).select("zone_id", "zone_name", "centroid_x", "centroid_y", "shapley_value"), 4)


# ---------------------------------------------------------------- table policies


def _q_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What actions earned on average in the events, by zone, time of day and time left."""
    rows = event_view(spark, sf_dir).select(F.col("from_zone").alias("zone_id"), (START + F.col("start_elapsed_min")).alias("minute"), (DEFAULT.horizon_minutes - F.col("start_elapsed_min")).alias("remaining"), F.coalesce("selected_action", F.lit("WAIT")).alias("action"), (F.col("revenue") - F.col("operating_cost")).alias("net"))
    return policies.state_key(rows).groupBy("zone_id", "time_bin", "remaining_bucket", "action").agg(F.round(F.avg("net"), 6).alias("q"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, details = _states(spark, sf_dir), _candidates(spark, sf_dir)
    allowed = policies.feasible(details, states).select("state_id", F.col("destination").cast("string").alias("action"))
    fallback = policies.best_moves(states, details, board(spark, sf_dir), "greedy_net_earnings", BOARD)
    return policies.apply_q_table(states, _q_table(spark, sf_dir), allowed, fallback)


@query
def q_table_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action of the table learnt from events in every state, the greedy policy's where the table has none."""
    return _decisions(spark, sf_dir)


@query
def q_table_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(policies.q_table_coverage(_decisions(spark, sf_dir)))


# ---------------------------------------------------------------- readers


def _months(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """All trips written as two files: odd months as Parquet without tips, even ones as CSV with values that can't be read."""
    folder = f"{shared_dir(spark)}/months-{uuid.uuid4().hex}"
    trips = trip_view(spark, sf_dir)
    odd = F.substring("source_month", 6, 2).cast("int") % 2 == 1
    write_table(trips.filter(odd).drop("tip_amount", "source_month"), f"{folder}/odd")
    a, b = F.col("PULocationID"), F.col("DOLocationID")
    text = trips.filter(~odd).drop("source_month").withColumns({
        "tpep_pickup_datetime": F.when((a + b) % 17 == 3, "never").otherwise(F.col("tpep_pickup_datetime").cast("string")), "fare_amount": F.when((a + 3 * b) % 11 == 4, "n/a").otherwise(F.col("fare_amount").cast("string")),
        "DOLocationID": F.when((a * 5 + b) % 13 == 2, 264).otherwise(b),
    })
    write_table(text, f"{folder}/even.csv", kind="csv")
    return {"1 odd": f"{folder}/odd", "2 even": f"{folder}/even.csv"}


@query
def months_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers and cleaning keep and drop of two files of different kinds."""
    trips, zones = read_trips(spark, _months(spark, sf_dir)), zone_view(spark, sf_dir)
    known = [F.col("DOLocationID").isin([r.zone_id for r in zones.select("zone_id").collect()])]  # a city's few zones
    read = trips.groupBy("source_month").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("tpep_pickup_datetime").isNull()).alias("without_pickup"), F.count_if(F.col("fare_amount").isNull()).alias("without_fare"), F.count_if(~known[0]).alias("unknown_zones"), F.sum("tip_amount").alias("tips"))
    kept = clean.clean_trips(trips, zones).groupBy("source_month").agg(F.count(F.lit(1)).alias("kept"), F.sum("driver_revenue").alias("revenue"), F.sum("time_bin").alias("bins"))
    return rounded(read.join(kept, "source_month"), 2)


@query
def zones_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone names from a written lookup that lacks some zones and has others too many."""
    zones = zone_view(spark, sf_dir)
    path = f"{shared_dir(spark)}/lookup-{uuid.uuid4().hex}.csv"
    id_ = F.when(F.col("zone_id") % 6 == 0, F.lit("none")).otherwise(F.col("zone_id").cast("string"))
    write_table(zones.select(id_.alias("LocationID"), F.col("borough").alias("Borough"), F.col("zone_name").alias("Zone"), F.lit("Yellow Zone").alias("service_zone")), path, kind="csv")
    return rounded(read_zones(spark, path, zones.select("zone_id", "centroid_x", "centroid_y")), 1)


# ---------------------------------------------------------------- SQL

_TOLD = f"""
WITH numbered AS (
  SELECT o_orderpriority AS algorithm, o_custkey AS scenario_id, row_number() OVER w - 1 AS event_index, {list(TYPES)}[((l_partkey + l_linenumber) % 7)::INT + 1] AS kind, s_nationkey AS s, c_nationkey AS c, l_linenumber AS line, l_quantity AS quantity, l_extendedprice AS price,
    sum((l_partkey*13) % 30 + 1) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE AS stop, ((l_partkey*13) % 30 + 1)::DOUBLE AS took
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WINDOW w AS (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)),
told AS (
  SELECT algorithm, scenario_id, event_index, CASE WHEN stop > 120 AND kind = 'OCCUPIED_TRIP' THEN 'UNFINISHED_TRIP' WHEN stop > 120 AND kind = 'EMPTY_REPOSITION' THEN 'TERMINAL_UNUSED' ELSE kind END AS event_type,
    (s + 1)::INT AS from_zone, (CASE kind WHEN 'OCCUPIED_TRIP' THEN c + 1 WHEN 'EMPTY_REPOSITION' THEN (s + line) % 25 + 1 ELSE s + 1 END)::INT AS to_zone, stop - took AS a, least(stop, 120) AS b,
    CASE WHEN kind = 'OCCUPIED_TRIP' THEN price/1000.0::DOUBLE ELSE 0 END AS revenue, CASE WHEN kind IN ('OCCUPIED_TRIP', 'EMPTY_REPOSITION') THEN quantity*0.4::DOUBLE ELSE 0 END AS miles,
    CASE WHEN kind LIKE 'WAIT%' THEN 'WAIT' WHEN kind = 'EMPTY_REPOSITION' THEN ((s + line) % 25 + 1)::INT::VARCHAR END AS selected_action
  FROM numbered WHERE stop - took < 120),
parts AS (
  SELECT algorithm, scenario_id, sum(CASE WHEN event_type <> 'UNFINISHED_TRIP' THEN revenue ELSE 0 END) AS gross, sum(CASE WHEN event_type <> 'UNFINISHED_TRIP' THEN 0.35::DOUBLE*miles ELSE 0 END) AS cost, count(*) FILTER (event_type = 'OCCUPIED_TRIP') AS trips,
    coalesce(sum(b - a) FILTER (event_type LIKE 'WAIT%'), 0) AS waiting, coalesce(sum(b - a) FILTER (event_type = 'EMPTY_REPOSITION'), 0) AS empty, coalesce(sum(b - a) FILTER (event_type = 'OCCUPIED_TRIP'), 0) AS occupied,
    coalesce(sum(b - a) FILTER (event_type = 'UNFINISHED_TRIP'), 0) AS unfinished, coalesce(sum(b - a) FILTER (event_type LIKE 'TERMINAL%'), 0) AS terminal, sum(b - a) AS accounted,
    coalesce(sum(miles) FILTER (event_type = 'EMPTY_REPOSITION'), 0) AS empty_miles, coalesce(sum(miles) FILTER (event_type = 'OCCUPIED_TRIP'), 0) AS occupied_miles, count(*) FILTER (selected_action = 'WAIT') AS wait_decisions,
    count(*) FILTER (event_type IN ('EMPTY_REPOSITION', 'TERMINAL_UNUSED') AND selected_action <> 'WAIT') AS reposition_decisions, count(*) FILTER (event_type = 'UNFINISHED_TRIP') > 0 AS unfinished_trip, first(selected_action ORDER BY event_index) AS first_action
  FROM told GROUP BY ALL),
accounts AS (SELECT * REPLACE (greatest(accounted, 120) AS accounted), terminal + greatest(0, 120 - accounted) AS unused, greatest(accounted, 120) - 120 AS error, gross - cost AS net FROM parts),
means AS (
  SELECT algorithm, count(*) AS episodes, avg(net) AS mean, stddev_samp(net) AS std, quantile_cont(net, 0.5) AS median, quantile_cont(net, 0.1) AS worst, avg(trips) AS trips, avg(unused) AS unused, avg(unfinished_trip::INT) AS cut,
    avg(CASE WHEN wait_decisions + reposition_decisions > 0 THEN reposition_decisions/(wait_decisions + reposition_decisions)::DOUBLE ELSE 0 END) AS moved, avg((first_action = 'WAIT')::INT) AS begins FROM accounts GROUP BY ALL),
near AS (SELECT *, abs(round(net, 6) - avg(round(net, 6)) OVER w)/greatest(1, stddev_samp(round(net, 6)) OVER w) + abs(trips - avg(trips) OVER w)/greatest(1, stddev_samp(trips) OVER w) + 5*abs(round(error, 6)) AS score FROM accounts WINDOW w AS (PARTITION BY algorithm)),
gains AS (SELECT x.net - y.net AS d FROM accounts x JOIN accounts y ON x.scenario_id = y.scenario_id WHERE x.algorithm = '5-LOW' AND y.algorithm = '1-URGENT')
"""


def _of(columns: str, source: str, doubles: str = "", digits: int = 5) -> str:
    return _TOLD + _select(columns, source, doubles, digits).removeprefix(_CHAIN)


_CLOCK = "printf('%02d:%02d', (floor((480 + {0})/60)::INT) % 24, ((480 + {0}) % 60)::INT)"
_PARTS = ("occupied", "empty", "waiting", "unfinished", "unused")
_GREEDY_MOVE, _GREEDY_STAY, _ = _SCORES["greedy_net_earnings"]
_DECIDED = f"""{_ACTIONS_SQL}, {_TOLD.strip().removeprefix('WITH ').replace('numbered AS', 'numbered_events AS').replace('FROM numbered ', 'FROM numbered_events ').replace('near AS', 'near_means AS').replace('parts AS', 'event_parts AS').replace('FROM parts', 'FROM event_parts')},
learnt AS (SELECT from_zone AS zone_id, floor((480 + a)/15)::INT AS time_bin, floor((120 - a)/5)::INT AS bucket, coalesce(selected_action, 'WAIT') AS action, round(avg(revenue - 0.35::DOUBLE*miles), 6) AS q FROM told GROUP BY ALL),
known AS (
  SELECT state_id, first(l.action ORDER BY q DESC, l.action <> 'WAIT', l.action) AS action FROM states s JOIN learnt l ON l.zone_id = s.zone_id AND l.time_bin = s.time_bin AND l.bucket = floor(s.remaining/5)::INT
  WHERE l.action = 'WAIT' OR EXISTS (FROM details d WHERE d.state_id = s.state_id AND selected_rank <= 12 AND route_minutes < remaining AND d.destination::VARCHAR = l.action) GROUP BY state_id),
decided AS (SELECT a.state_id, CASE WHEN k.state_id IS NOT NULL THEN TRY_CAST(k.action AS INT) ELSE a.action END AS action, k.state_id IS NOT NULL AS from_table FROM actions a LEFT JOIN known k ON k.state_id = a.state_id WHERE policy = 'greedy_net_earnings')"""

_READ = f"""{_CHAIN}, files AS (
  SELECT CASE WHEN substr(source_month, 6, 2)::INT % 2 = 1 THEN '1 odd' ELSE '2 even' END AS source_month, pickup, dropoff, origin, destination, miles, fare, tip FROM timed),
seen AS (
  SELECT source_month, CASE WHEN source_month = '2 even' AND (origin + destination) % 17 = 3 THEN NULL ELSE pickup END AS pickup, dropoff, origin, CASE WHEN source_month = '2 even' AND (origin*5 + destination) % 13 = 2 THEN 264 ELSE destination END AS destination, miles,
    CASE WHEN source_month = '2 even' AND (origin + 3*destination) % 11 = 4 THEN NULL ELSE fare END AS fare, CASE WHEN source_month = '2 even' THEN tip ELSE 0 END AS tip FROM files),
kept AS (SELECT *, epoch_us(dropoff - pickup)/6e7 AS took FROM seen WHERE pickup IS NOT NULL AND fare BETWEEN 2.5 AND 500 AND miles BETWEEN 0.01 AND 100 AND destination <> 264)"""

ORACLES |= {
    "event_durations": _of(f"algorithm, scenario_id, event_index, event_type, {_CLOCK.format('a')} AS start_clock, {_CLOCK.format('b')} AS end_clock", "told", "b-a minutes"),
    "event_episodes": _of("algorithm, scenario_id, trips AS completed_trips, wait_decisions, reposition_decisions, unfinished_trip, first_action", "accounts", "gross gross_revenue; cost operating_cost; waiting waiting_minutes; empty empty_minutes; occupied occupied_minutes; unfinished unfinished_minutes; unused unused_minutes; empty_miles; occupied_miles; accounted accounted_minutes; error time_accounting_error; net net_earnings", 4),
    "event_episode_summary": _of("algorithm, episodes, row_number() OVER (ORDER BY mean DESC, algorithm)::INT AS rank", "means", "mean; std; median; worst worst_10_percent; trips mean_completed_trips; unused mean_unused_minutes; cut mean_unfinished_trip; mean-1.96*std/sqrt(episodes) lower; mean+1.96*std/sqrt(episodes) upper; moved reposition_decision_share; begins first_action_wait_rate", 3),
    "event_representatives": _of("algorithm, scenario_id, trips AS completed_trips", "(SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY score, scenario_id) AS k FROM near) WHERE k = 1", "net net_earnings; error time_accounting_error", 4),
    "paired_calibration": _of("'5-LOW' AS algorithm, count(*) AS pairs", "gains", "avg(d) mean_gain; avg(d)-1.96*stddev_samp(d)/sqrt(count(*)) lower_gain; avg(d)+1.96*stddev_samp(d)/sqrt(count(*)) upper_gain; avg((d>1e-9)::INT) win_rate; 1.0::DOUBLE expected_gain; avg(d)-1 gap", 3),
    "trajectory_moves": _of(
        "algorithm, scenario_id, event_index, move::INT AS move, CASE WHEN event_type = 'EMPTY_REPOSITION' THEN 'E' ELSE 'P' END || move AS label",
        "(SELECT *, row_number() OVER (PARTITION BY algorithm, scenario_id ORDER BY event_index) AS move FROM told WHERE from_zone <> to_zone)", "((from_zone-1)%5)*9000.0::DOUBLE from_x; floor((from_zone-1)/5)*9000 from_y; ((to_zone-1)%5)*9000.0::DOUBLE to_x; floor((to_zone-1)/5)*9000 to_y", 1),
    "timeline_segments": _of("algorithm, scenario_id, event_index, CASE WHEN event_type LIKE 'WAIT%' THEN 'waiting' WHEN event_type = 'OCCUPIED_TRIP' THEN 'occupied' WHEN event_type = 'EMPTY_REPOSITION' THEN 'empty' WHEN event_type = 'UNFINISHED_TRIP' THEN 'unfinished' ELSE 'unused' END AS label", "told", "a start; b-a length"),
    "minute_breakdown": _of(
        "algorithm, part", "(" + " UNION ALL ".join(f"SELECT algorithm, '{p}_minutes' AS part, avg({p}) AS mean, {' + '.join(f'avg({q})' for q in _PARTS[: k + 1])} AS total FROM accounts GROUP BY algorithm" for k, p in enumerate(_PARTS)) + ")", "mean; total", 4),
    "ablation_bands": _EVENTS + _select("kind, removed::INT AS removed", "(SELECT kind, removed, avg(full_value - value) AS m, coalesce(stddev_samp(full_value - value), 0) AS s FROM taken t JOIN coalitions c ON c.mask = 31 - t.gone CROSS JOIN (SELECT value AS full_value FROM coalitions WHERE mask = 31) GROUP BY ALL)", "m-s lower; m+s upper", 3).removeprefix(_CHAIN),
    "player_map": _EVENTS + _select("CAST(n_nationkey + 1 AS INT) AS zone_id, CASE WHEN n_nationkey IN (0, 12) THEN n_name || ' Airport' ELSE n_name END AS zone_name", "nation LEFT JOIN shapley ON player = n_nationkey + 1", "(n_nationkey%5)*9000.0::DOUBLE centroid_x; floor(n_nationkey/5)*9000.0::DOUBLE centroid_y; shapley_value", 4).removeprefix(_CHAIN),
    "q_table_actions": f"{_DECIDED} SELECT * FROM decided",
    "q_table_coverage": _on(_DECIDED, "count(*) AS decisions, count(*) FILTER (from_table) AS hits, count(*) FILTER (NOT from_table) AS fallbacks", "decided", "avg(from_table::INT) hit_rate; avg((NOT(from_table))::INT) fallback_rate"),
    "months_read_back": _on(
        _READ, "s.source_month, rows, without_pickup, without_fare, unknown_zones, kept, bins",
        "(SELECT source_month, count(*) AS rows, count(*) FILTER (pickup IS NULL) AS without_pickup, count(*) FILTER (fare IS NULL) AS without_fare, count(*) FILTER (destination = 264) AS unknown_zones, sum(tip) AS tips FROM seen GROUP BY ALL) s"
        " JOIN (SELECT source_month, count(*) AS kept, sum(fare + greatest(tip, 0)) AS revenue, sum(hour(pickup)*4 + minute(pickup)//15)::BIGINT AS bins FROM kept WHERE took BETWEEN 1 AND 240 GROUP BY ALL) k ON k.source_month = s.source_month", "tips; revenue", 2),
    "zones_read_back": "SELECT CAST(n_nationkey + 1 AS INT) AS zone_id, (n_nationkey % 5)*9000.0::DOUBLE AS centroid_x, floor(n_nationkey/5)*9000.0::DOUBLE AS centroid_y, CASE WHEN (n_nationkey + 1) % 6 = 0 THEN 'Unknown' ELSE r_name END AS borough, CASE WHEN (n_nationkey + 1) % 6 = 0 THEN 'Unknown' WHEN n_nationkey IN (0, 12) THEN n_name || ' Airport' ELSE n_name END AS zone_name, CASE WHEN (n_nationkey + 1) % 6 = 0 THEN 'Unknown' ELSE 'Yellow Zone' END AS service_zone FROM nation JOIN region ON n_regionkey = r_regionkey",
}
