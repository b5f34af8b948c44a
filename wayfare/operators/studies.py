"""Validation studies, sensitivity studies and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.columns import row_mean
from wayfare.operators.episodes import keyed_digits, keyed_uniform
from wayfare.operators.lookup import ESTIMATES, estimate_od
from wayfare.plans.params import DEFAULT, Params
from wayfare.sources.lineage import settle


def average_rank(column: Column, by: list[str] | None = None) -> Column:
    """Ranks in which equal values share their mean rank; minimum ranks alone would bias rank correlations."""
    own = Window.partitionBy(*(by or []))
    return F.rank().over(own.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*(by or []), column)) - 1) / 2.0


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """value, rank over all rows: values are counted, dealt by range, and ranks run on from one range to the next.

    No task sees more than its range of distinct values; what is added up over all are the ranges' totals.
    """
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("_n")).filter("value is not null")
    ranged = settle(counted.repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    offsets = ranged.groupBy("_part").agg(F.sum("_n").alias("_total")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.withColumn("_upto", inside).join(F.broadcast(offsets), "_part").select("value", (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation of two columns, over all rows or in each group (groups are ranked in one task each)."""
    if by:
        ranked = df.select(*by, average_rank(F.col(a), by).alias("_a"), average_rank(F.col(b), by).alias("_b"))
    else:
        rows = settle(df.select(F.col(a).alias("_x"), F.col(b).alias("_y")))  # the same doubles wherever they are read
        ranked = rows.join(average_ranks(rows, "_x").toDF("_x", "_a"), "_x").join(average_ranks(rows, "_y").toDF("_y", "_b"), "_y")
    both = F.stddev_pop("_a") * F.stddev_pop("_b")  # none where one of both is constant
    return ranked.groupBy(*(by or [])).agg(F.try_divide(F.covar_pop("_a", "_b"), both).alias("spearman"))


def error_metrics(df: DataFrame, truth: str, estimate: str, by: list[str] | None = None) -> DataFrame:
    """n, MAE, RMSE, bias, MAPE (over nonzero truth, percent) and rank correlation."""
    e = F.col(estimate) - F.col(truth)
    plain = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), (100 * F.avg(F.when(F.col(truth) != 0, F.abs(e / F.col(truth))))).alias("mape"))
    ranks = spearman(df, truth, estimate, by)
    return plain.join(ranks, by) if by else plain.join(F.broadcast(ranks))  # one row


def holdout_cells(od: DataFrame, n: int, seed: int, least: int = 20) -> DataFrame:
    """A seeded sample of well observed cells; where none has enough trips, of the top quarter of the observed ones."""
    seen = od.filter("observed_trip_count > 0")
    enough, quarter = seen.agg(F.count_if(F.col("observed_trip_count") >= least), F.percentile("observed_trip_count", F.lit(0.75))).first()
    threshold = float(least) if enough else float(quarter or 0.0)
    return seen.filter(F.col("observed_trip_count") >= threshold).orderBy(keyed_digits(F.lit(seed), F.col("time_bin"), F.col("origin"), F.col("destination")), "time_bin", "origin", "destination").limit(n)


def holdout_reconstruct(cells: DataFrame) -> DataFrame:
    """Cells with estimates blended from the four priors alone. The priors are as built, so pairs' own totals still hold the cell."""
    sources = (("temporal_", "temporal_weight"), ("spatial_", "spatial_weight"), ("global_", "global_weight"), ("gravity_", "gravity_weight"))
    pick = lambda m, g=False: row_mean([(F.col(f"{p}{m}"), F.col(w)) for p, w in sources], F.col(f"gravity_{m}"), geometric=g)
    return cells.withColumn("held_revenue", pick("driver_revenue")).withColumn("held_minutes", F.greatest(pick("duration_min", True), 0.85 * F.col("gravity_duration_min"))).withColumn("held_miles", pick("distance_miles"))


def tail_metrics(df: DataFrame, truth: str, estimate: str) -> DataFrame:
    """Error metrics by quartile of the truth; edges belong to the lower quartile."""
    edges = df.agg(*(F.percentile(truth, F.lit(q)).alias(f"_q{k}") for k, q in enumerate((0.25, 0.5, 0.75))))
    rows = df.join(F.broadcast(edges))  # one row
    quartile = F.when(F.col(truth) <= F.col("_q0"), "Q1").when(F.col(truth) <= F.col("_q1"), "Q2").when(F.col(truth) <= F.col("_q2"), "Q3").otherwise("Q4")
    return error_metrics(rows.withColumn("quartile", quartile), truth, estimate, ["quartile"])


def coverage_queries(zones: DataFrame, n: int, seed: int) -> DataFrame:
    """Seeded random questions over all zones and minutes."""
    ids = zones.select("zone_id").distinct().withColumn("k", F.row_number().over(Window.orderBy("zone_id")) - 1)  # a city's few hundred zones
    many = ids.count()
    draw = lambda name: keyed_uniform(F.lit(seed), F.col("id"), F.lit(name))
    asked = zones.sparkSession.range(n).select(F.col("id").alias("query_id"), F.floor(draw("o") * many).cast("int").alias("ko"), F.floor(draw("d") * many).cast("int").alias("kd"), F.floor(draw("m") * 1440).cast("double").alias("minute"))
    return asked.join(ids.toDF("origin", "ko"), "ko").join(ids.toDF("destination", "kd"), "kd").select("query_id", "origin", "destination", "minute")


def coverage_check(questions: DataFrame, model, params: Params = DEFAULT) -> DataFrame:
    answers = estimate_od(questions, model, params)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    valid = F.lit(True)
    for c in ESTIMATES:
        valid = valid & finite(c)
    valid = valid & (F.col("revenue") >= 0) & (F.col("minutes") > 0) & (F.col("miles") > 0) & (F.col("confidence") > 0) & (F.col("confidence") <= 1)
    return answers.withColumn("is_valid", valid)


def coverage_summary(checked: DataFrame) -> DataFrame:
    """One row of counts and shares. Fails when it is computed if any answer is invalid."""
    by_source = checked.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "source", F.col("n").cast("string")))), "|").alias("sources"))
    plain = checked.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.when(F.col("is_valid"), True).otherwise(F.raise_error(F.concat(F.lit("invalid answer to question "), F.col("query_id").cast("string"))).cast("boolean"))).alias("valid"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("is_directly_observed").cast("double")).alias("observed_share"))
    return plain.withColumn("coverage", F.col("valid") / F.greatest("questions", F.lit(1))).join(F.broadcast(by_source))  # one row


def rank_agreement(values: DataFrame, top: int = 5) -> DataFrame:
    """kind_a, kind_b, spearman of values, jaccard of the top zones, for all pairs of kinds. values: kind, zone_id, value."""
    ranked = values.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("value"), "zone_id")))
    tops = ranked.filter(F.col("k") <= top).groupBy("kind").agg(F.collect_set("zone_id").alias("top"))
    both = values.toDF("kind_a", "zone_id", "a").join(values.toDF("kind_b", "zone_id", "b"), "zone_id").filter("kind_a < kind_b")
    rho = spearman(both, "a", "b", ["kind_a", "kind_b"])
    sets = tops.toDF("kind_a", "ta").join(F.broadcast(tops.toDF("kind_b", "tb"))).filter("kind_a < kind_b")  # one row per kind
    jaccard = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    return rho.join(sets.select("kind_a", "kind_b", jaccard.alias("jaccard")), ["kind_a", "kind_b"])


def external_baselines(scored: DataFrame, players: DataFrame) -> DataFrame:
    """The best zone that is no player by each score. scored: zone_id, demand, income, greedy."""
    others = scored.join(players.select("zone_id"), "zone_id", "left_anti")
    best = lambda c: F.max_by("zone_id", F.struct(F.col(c), -F.col("zone_id"))).alias(c)
    return others.agg(best("demand"), best("income"), best("greedy"))


def competition_trend(table: DataFrame) -> DataFrame:
    """Changes from low over medium to high of each algorithm's mean, and whether they never rise. table: algorithm, scenario, mean."""
    order = F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("scenario"))
    stepped = table.withColumn("_o", order).withColumn("step", F.col("mean") - F.lag("mean").over(Window.partitionBy("algorithm").orderBy("_o")))
    return stepped.groupBy("algorithm").agg(F.max(F.when(F.col("scenario") == "medium", F.col("step"))).alias("low_to_medium"), F.max(F.when(F.col("scenario") == "high", F.col("step"))).alias("medium_to_high"), F.coalesce(F.bool_and(F.col("step") <= 1e-9), F.lit(True)).alias("non_increasing"))


# ---------------------------------------------------------------- report tables


def smoothed_history(history: DataFrame, order: str, value: str, window: int, by: list[str] | None = None) -> DataFrame:
    """Adds the mean of the last `window` rows, fewer at the start."""
    return history.withColumn("smoothed", F.avg(value).over(Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(1 - window, 0)))


def bin_snapshot(nodes: DataFrame, zones: DataFrame, time_bin: int) -> DataFrame:
    return nodes.filter(F.col("time_bin") == time_bin).join(zones.select("zone_id", "zone_name", "borough"), "zone_id", "left").select("zone_id", "zone_name", "borough", "posterior", "supply", "expected_wait")


def trip_count_distribution(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("algorithm").agg(*(F.percentile("completed_trips", F.lit(q)).alias(n) for n, q in (("low", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1.0))))


def player_map_table(zones: DataFrame, found: DataFrame) -> DataFrame:
    return zones.join(found.select(F.col("player").alias("zone_id"), "shapley_value"), "zone_id", "left")


def ablation_bands(summary: DataFrame) -> DataFrame:
    return summary.withColumn("lower", F.col("mean_drop") - F.col("std_drop")).withColumn("upper", F.col("mean_drop") + F.col("std_drop"))


def trajectory_moves(events: DataFrame, zones: DataFrame) -> DataFrame:
    """Moves between zones with both centroids, a running number and E (empty) or P (passenger)."""
    at = zones.select("zone_id", "centroid_x", "centroid_y")
    rows = events.filter("from_zone <> to_zone").join(at.toDF("from_zone", "from_x", "from_y"), "from_zone", "left").join(at.toDF("to_zone", "to_x", "to_y"), "to_zone", "left")
    order = Window.partitionBy("algorithm", "scenario_id").orderBy("event_index")
    return rows.withColumn("move", F.row_number().over(order)).withColumn("label", F.concat(F.when(F.col("event_type") == "EMPTY_REPOSITION", "E").otherwise("P"), F.col("move").cast("string")))


def timeline_segments(events: DataFrame) -> DataFrame:
    label = F.when(F.col("event_type").startswith("WAIT"), "waiting").when(F.col("event_type") == "OCCUPIED_TRIP", "occupied").when(F.col("event_type") == "EMPTY_REPOSITION", "empty").when(F.col("event_type") == "UNFINISHED_TRIP", "unfinished").otherwise("unused")
    return events.select("algorithm", "scenario_id", "event_index", F.col("start_elapsed_min").alias("start"), F.greatest(F.lit(0.0), F.col("end_elapsed_min") - F.col("start_elapsed_min")).alias("length"), label.alias("label"))


def interval_bars(summary: DataFrame) -> DataFrame:
    return summary.select("algorithm", "mean", (F.col("mean") - F.col("lower")).alias("below"), (F.col("upper") - F.col("mean")).alias("above")).orderBy(F.desc("mean"), "algorithm")


def minute_breakdown(episodes: DataFrame) -> DataFrame:
    """algorithm, part, mean and running total of the five parts of an episode."""
    parts = ("occupied_minutes", "empty_minutes", "waiting_minutes", "unfinished_minutes", "unused_minutes")
    means = episodes.groupBy("algorithm").agg(*(F.avg(p).alias(p) for p in parts))
    long = means.select("algorithm", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("part"), F.col(p).alias("mean")) for k, p in enumerate(parts)))))
    return long.withColumn("total", F.sum("mean").over(Window.partitionBy("algorithm").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))).drop("k")
