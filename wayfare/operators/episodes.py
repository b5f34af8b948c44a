"""Keyed draws, episodes from events, summaries and paired comparisons of policies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions.columns import bin_fraction, clock_text, low_bin
from wayfare.operators.lookup import node_at
from wayfare.operators.space import route_at
from wayfare.plans.params import DEFAULT, Params
from wayfare.sources.lineage import settle

# ---------------------------------------------------------------- draws


def keyed_digits(*keys: Column | str) -> Column:
    """32 hexadecimal digits fixed by the keys, the same in any engine that has MD5."""
    return F.md5(F.concat_ws(":", *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)).cast("binary"))


def _bits(digits: Column) -> Column:
    """The number of the first 13 digits, below 2 ** 52."""
    return F.conv(F.substring(digits, 1, 13), 16, 10).cast("long")


def scenario_bank(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("scenario_id"), _bits(keyed_digits(F.lit(seed), F.col("id"))).alias("base_seed"))


def keyed_uniform(*keys: Column | str) -> Column:
    """A number in (0, 1) fixed by the keys, so policies share their random numbers."""
    return (_bits(keyed_digits(*keys)).cast("double") + 0.5) / float(1 << 52)


def keyed_normal(*keys: Column) -> Column:
    u, v = keyed_uniform(F.lit("radius"), *keys), keyed_uniform(F.lit("angle"), *keys)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def draw_wait(mean: Column, u: Column) -> Column:
    return -mean * F.ln(u)


def draw_destination(options: DataFrame) -> DataFrame:
    """One destination per query_id, by its `u`: options in falling probability, the last if u is beyond the sum."""
    order = Window.partitionBy("query_id").orderBy(F.desc("probability"), "destination")
    rows = options.withColumn("_sum", F.sum("probability").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    hit = rows.filter((F.col("_sum") >= F.col("u")) | (F.col("_k") == F.col("_n")))
    return hit.withColumn("_h", F.row_number().over(order)).filter("_h = 1").drop("_sum", "_k", "_n", "_h")


#: What od_options answers for a destination besides its probability.
OPTION_METRICS = ("driver_revenue", "duration_min", "distance_miles", "revenue_dev", "duration_dev", "distance_dev", "confidence")


def option_cells(od: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """low, origin, options: the destinations of a bin and the next one as one array, by destination. A row for each bin and zone."""
    p = ("destination_probability", *OPTION_METRICS)
    side = lambda name, bin_: od.select(bin_.cast("int").alias("low"), "origin", "destination", *(F.col(c).cast("double").alias(f"{name}_{c}") for c in p))
    both = side("l", F.col("time_bin")).join(side("h", F.pmod(F.col("time_bin") - 1, F.lit(params.bins))), ["low", "origin", "destination"], "full").na.fill(0.0)
    option = F.struct("destination", *(f"{n}_{c}" for n in "lh" for c in p))
    return both.groupBy("low", "origin").agg(F.sort_array(F.collect_list(option)).alias("options"))


def draw_at(questions: DataFrame, cells: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """questions (origin, minute, u, ...) with the destination drawn by u and its mean metrics at the minute.

    The same as od_options and draw_destination one after the other, but a question stays one row: its options are an
    array of option_cells, which is mixed, sorted and summed in place. Origins without options drop out.
    """
    rows = questions.withColumn("low", low_bin(F.col("minute"), params)).join(cells, ["low", "origin"])
    t = bin_fraction(F.col("minute"), params)
    rows = rows.withColumn("_t", t).withColumn("_p", F.transform("options", lambda o: F.greatest((1 - F.col("_t")) * o["l_destination_probability"] + F.col("_t") * o["h_destination_probability"], F.lit(0.0))))
    rows = rows.withColumn("_all", F.greatest(F.aggregate("_p", F.lit(0.0), lambda a, x: a + x), F.lit(1e-12)))
    falling = F.array_sort(F.transform("_p", lambda x, k: F.struct((-x / F.col("_all")).alias("less"), k.alias("k"))))  # options are sorted by destination
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"), F.lit(False).alias("hit"))
    step = lambda a, x: F.when(a["hit"], a).otherwise(F.struct((a["sum"] - x["less"]).alias("sum"), x["k"].alias("k"), (a["sum"] - x["less"] >= F.col("u")).alias("hit")))
    rows = rows.withColumn("_k", F.aggregate(falling, start, step, lambda a: a["k"]))
    rows = rows.withColumn("_o", F.get(F.col("options"), F.col("_k")))
    low, high = ((w * F.col("_o")[f"{n}_destination_probability"]) for n, w in (("l", 1 - F.col("_t")), ("h", F.col("_t"))))
    metrics = [((low * F.col("_o")[f"l_{m}"] + high * F.col("_o")[f"h_{m}"]) / F.greatest(low + high, F.lit(1e-12))).alias(m) for m in OPTION_METRICS]
    return rows.select(*questions.columns, F.col("_o")["destination"].alias("destination"), *metrics)


def trip_metrics(mean: Column, std: Column, z: Column, floor: float) -> Column:
    return F.greatest(mean + z * std, F.lit(floor))


def one_step(actions: DataFrame, model, seed: int, params: Params = DEFAULT, scenario: str = "medium") -> DataFrame:
    """Where each (query_id, scenario_id, zone_id, minute, remaining, action) leads: next_zone, next_minute, reward, done.

    Waiting without a pickup within a step moves the clock on; a trip beyond the horizon ends it without reward, as does
    a move longer than the time left.
    """
    step = float(params.step_minutes)
    key = lambda name: (F.lit(seed), F.col("scenario_id"), F.col("query_id"), F.lit(name))
    waiting = node_at(actions.filter("action is null"), model.nodes, scenario, params).select("query_id", "scenario_id", "zone_id", "minute", "remaining", "expected_wait")
    waiting = waiting.withColumn("wait", draw_wait(F.col("expected_wait"), keyed_uniform(*key("wait"))))
    none = waiting.filter(F.col("wait") > F.least(F.lit(step), F.col("remaining")))
    none = none.select("query_id", F.col("zone_id").alias("next_zone"), (F.col("minute") + F.least(F.lit(step), F.col("remaining"))).alias("next_minute"), F.lit(0.0).alias("reward"), (F.col("remaining") <= step).alias("done"))
    picked = waiting.filter(F.col("wait") <= F.least(F.lit(step), F.col("remaining"))).withColumn("at", F.col("minute") + F.col("wait"))
    asked = picked.select("query_id", "scenario_id", F.col("minute").alias("asked"), "remaining", "wait", F.col("zone_id").alias("origin"), F.col("at").alias("minute"), keyed_uniform(*key("destination")).alias("u"))
    drawn = draw_at(asked, settle(option_cells(model.od, params)), params).withColumnRenamed("minute", "at").withColumnRenamed("asked", "minute")
    trip = drawn.withColumns({
        "minutes": trip_metrics(F.col("duration_min"), F.col("duration_dev"), keyed_normal(*key("minutes")), 1.0),
        "miles": trip_metrics(F.col("distance_miles"), F.col("distance_dev"), keyed_normal(*key("miles")), 0.01),
        "fare": trip_metrics(F.col("driver_revenue"), F.col("revenue_dev"), keyed_normal(*key("fare")), 0.0),
    })
    fits = F.col("wait") + F.col("minutes") <= F.col("remaining")
    trip = trip.select("query_id", F.col("destination").alias("next_zone"), F.when(fits, F.col("at") + F.col("minutes")).otherwise(F.col("minute") + F.col("remaining")).alias("next_minute"), F.when(fits, F.col("fare") - params.cost_per_mile * F.col("miles")).otherwise(0.0).alias("reward"), (~fits | (F.col("wait") + F.col("minutes") >= F.col("remaining"))).alias("done"))
    moving = actions.filter("action is not null").select("query_id", F.col("zone_id").alias("origin"), F.col("action").alias("destination"), "minute", "remaining")
    moving = route_at(moving, model.routes, model.zones, model.profiles, params)
    fits = F.col("route_minutes") <= F.col("remaining")
    moving = moving.select("query_id", F.when(fits, F.col("destination")).otherwise(F.col("origin")).alias("next_zone"), (F.col("minute") + F.least("route_minutes", "remaining")).alias("next_minute"), F.when(fits, -params.cost_per_mile * F.col("route_miles")).otherwise(0.0).alias("reward"), (F.col("route_minutes") >= F.col("remaining")).alias("done"))
    return none.unionByName(trip).unionByName(moving)


# ---------------------------------------------------------------- episodes

#: Event types and the minutes they count for.
MINUTES = {"waiting_minutes": ("WAIT_NO_PICKUP", "WAIT_FOR_PICKUP"), "empty_minutes": ("EMPTY_REPOSITION",), "occupied_minutes": ("OCCUPIED_TRIP",), "unfinished_minutes": ("UNFINISHED_TRIP",), "unused_minutes": ("TERMINAL_UNUSED", "TERMINAL_OR_INVALID_ROUTE_WAIT")}


def event_durations(events: DataFrame, start: float) -> DataFrame:
    """Adds minutes and both clock readings to events."""
    return events.withColumn("minutes", F.col("end_elapsed_min") - F.col("start_elapsed_min")).withColumn("start_clock", clock_text(start + F.col("start_elapsed_min"))).withColumn("end_clock", clock_text(start + F.col("end_elapsed_min")))


def episodes_from_events(events: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row per algorithm and scenario; what the parts leave of the horizon counts as unused."""
    minutes = F.col("end_elapsed_min") - F.col("start_elapsed_min")
    of = lambda *kinds: F.col("event_type").isin(*kinds)
    finished = F.when(of("OCCUPIED_TRIP"), 1)
    sums = [F.coalesce(F.sum(F.when(of(*kinds), minutes)), F.lit(0.0)).alias(name) for name, kinds in MINUTES.items()]
    rows = events.groupBy("algorithm", "scenario_id").agg(
        F.sum(F.when(of("UNFINISHED_TRIP"), 0.0).otherwise(F.col("revenue"))).alias("gross_revenue"), F.sum(F.when(of("UNFINISHED_TRIP"), 0.0).otherwise(F.col("operating_cost"))).alias("operating_cost"), F.count(finished).alias("completed_trips"), *sums,
        F.coalesce(F.sum(F.when(of("EMPTY_REPOSITION"), F.col("distance_miles"))), F.lit(0.0)).alias("empty_miles"), F.coalesce(F.sum(F.when(of("OCCUPIED_TRIP"), F.col("distance_miles"))), F.lit(0.0)).alias("occupied_miles"),
        F.count(F.when(F.col("selected_action") == "WAIT", 1)).alias("wait_decisions"), F.count(F.when(of("EMPTY_REPOSITION", "TERMINAL_UNUSED") & (F.col("selected_action") != "WAIT"), 1)).alias("reposition_decisions"),
        (F.count(F.when(of("UNFINISHED_TRIP"), 1)) > 0).alias("unfinished_trip"), F.min_by("selected_action", "event_index").alias("first_action"),
    )
    parts = F.col("waiting_minutes") + F.col("empty_minutes") + F.col("occupied_minutes") + F.col("unfinished_minutes") + F.col("unused_minutes")
    rows = rows.withColumn("unused_minutes", F.col("unused_minutes") + F.greatest(F.lit(0.0), params.horizon_minutes - parts))
    return rows.withColumn("accounted_minutes", parts).withColumn("time_accounting_error", F.col("accounted_minutes") - params.horizon_minutes).withColumn("net_earnings", F.col("gross_revenue") - F.col("operating_cost"))


def episode_summary(episodes: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Ranked by mean earnings: mean, deviation, 95 % interval, median, 10 % quantile of each algorithm, and other means."""
    x, n = "net_earnings", F.count(F.lit(1))
    rows = episodes.groupBy("algorithm").agg(
        n.alias("episodes"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.1)).alias("worst_10_percent"),
        F.avg("completed_trips").alias("mean_completed_trips"), *(F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in also),
    )
    half = 1.96 * F.col("std") / F.sqrt(F.col("episodes"))
    ranked = rows.withColumn("lower", F.col("mean") - half).withColumn("upper", F.col("mean") + half)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "algorithm")))  # one row per algorithm


def move_share(episodes: DataFrame) -> DataFrame:
    decisions = F.col("wait_decisions") + F.col("reposition_decisions")
    share = F.when(decisions > 0, F.col("reposition_decisions") / decisions).otherwise(0.0)
    return episodes.groupBy("algorithm").agg(F.avg(share).alias("reposition_decision_share"), F.avg((F.col("first_action") == "WAIT").cast("double")).alias("first_action_wait_rate"))


def paired_differences(episodes: DataFrame, baseline: str) -> DataFrame:
    base = episodes.filter(F.col("algorithm") == baseline).select("scenario_id", F.col("net_earnings").alias("baseline_earnings"))
    return episodes.filter(F.col("algorithm") != baseline).join(base, "scenario_id").select("scenario_id", "algorithm", "net_earnings", "baseline_earnings", (F.col("net_earnings") - F.col("baseline_earnings")).alias("difference"))


def paired_comparison(episodes: DataFrame, baseline: str) -> DataFrame:
    d, n = F.col("difference"), F.count(F.lit(1))
    share = lambda c: F.avg(c.cast("double"))
    rows = paired_differences(episodes, baseline).groupBy("algorithm").agg(n.alias("pairs"), F.avg(d).alias("mean_gain"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std_gain"), F.percentile(d, F.lit(0.5)).alias("median_gain"), share(d > 1e-9).alias("win_rate"), share(F.abs(d) <= 1e-9).alias("tie_rate"), share(d < -1e-9).alias("loss_rate"))
    half = 1.96 * F.col("std_gain") / F.sqrt(F.col("pairs"))
    return rows.withColumn("lower_gain", F.col("mean_gain") - half).withColumn("upper_gain", F.col("mean_gain") + half).withColumn("baseline", F.lit(baseline))


def summary_with_pairs(episodes: DataFrame, baseline: str) -> DataFrame:
    return episode_summary(episodes).join(paired_comparison(episodes, baseline), "algorithm", "left")


def paired_calibration(episodes: DataFrame, algorithm: str, baseline: str, expected_gain: float) -> DataFrame:
    """The simulated paired gain of an algorithm against the gain that the value model expects."""
    rows = paired_comparison(episodes, baseline).filter(F.col("algorithm") == algorithm)
    return rows.select("algorithm", "pairs", "mean_gain", "lower_gain", "upper_gain", "win_rate", F.lit(expected_gain).alias("expected_gain"), (F.col("mean_gain") - expected_gain).alias("gap"))


def representative_episode(episodes: DataFrame) -> DataFrame:
    """Of each algorithm the episode nearest to its mean earnings and trips; the smaller scenario of equals."""
    own = Window.partitionBy("algorithm")
    off = lambda c: F.abs(F.col(c) - F.avg(c).over(own)) / F.greatest(F.lit(1.0), F.coalesce(F.stddev_samp(c).over(own), F.lit(0.0)))
    error = 5.0 * F.abs("time_accounting_error") if "time_accounting_error" in episodes.columns else F.lit(0.0)
    scored = episodes.withColumn("score", off("net_earnings") + off("completed_trips") + error)
    return scored.withColumn("_k", F.row_number().over(own.orderBy("score", "scenario_id"))).filter("_k = 1").drop("_k")


def event_summary(events: DataFrame, by: tuple[str, ...] = ("algorithm", "event_type"), sums: tuple[str, ...] = ("minutes", "revenue", "distance_miles")) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), *(F.sum(c).alias(f"total_{c}") for c in sums))
