"""Coalitions as bit masks, Shapley values, and checks of their axioms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.operators.episodes import keyed_digits


def coalition_masks(spark: SparkSession, players: list[int], base: list[int] | None = None) -> DataFrame:
    """mask, size, zones (players of the mask), allowed (with the always allowed): one row per subset."""
    zone = F.array(*(F.lit(z) for z in players))
    inside = F.filter(zone, lambda z, k: F.col("mask").bitwiseAND(F.element_at(F.array(*(F.lit(1 << i).cast("long") for i in range(len(players)))), k + 1)) != 0)
    rows = spark.range(1 << len(players)).select(F.col("id").alias("mask"))
    rows = rows.select("mask", F.bit_count("mask").alias("size"), inside.alias("zones"))
    return rows.withColumn("allowed", F.array_distinct(F.concat("zones", F.array(*(F.lit(z) for z in base or [])).cast("array<int>"))))


def marginals(values: DataFrame, players: list[int]) -> DataFrame:
    """player, mask (without it), size, marginal: coalition values (mask, value) joined with themselves, one bit more."""
    spark = values.sparkSession
    bits = spark.createDataFrame([(z, 1 << k) for k, z in enumerate(players)], "player int, bit long")
    without = values.join(F.broadcast(bits)).filter(F.col("mask").bitwiseAND(F.col("bit")) == 0)  # a handful of players
    added = without.withColumn("more", F.col("mask").bitwiseOR(F.col("bit"))).withColumnRenamed("value", "less")
    return added.join(values.select(F.col("mask").alias("more"), "value"), "more").select("player", "mask", F.bit_count("mask").alias("size"), (F.col("value") - F.col("less")).alias("marginal"))


def exact_shapley(values: DataFrame, players: list[int]) -> DataFrame:
    n = len(players)
    weights = F.array(*(F.lit(math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n)) for s in range(n)))
    return marginals(values, players).groupBy("player").agg(F.sum(F.element_at(weights, F.col("size") + 1) * F.col("marginal")).alias("shapley_value"))


def sampled_shapley(values: DataFrame, players: list[int], permutations: int, seed: int) -> DataFrame:
    """player, shapley_value, standard_error over permutations drawn by hash, each with its reverse."""
    spark = values.sparkSession
    who = spark.createDataFrame([(z, 1 << k) for k, z in enumerate(players)], "player int, bit long")
    drawn = spark.range((permutations + 1) // 2).select(F.col("id").alias("p")).join(F.broadcast(who)).withColumn("u", keyed_digits(F.lit(seed), F.col("p"), F.col("player")))
    forward, back = Window.partitionBy("p").orderBy("u", "player"), Window.partitionBy("p").orderBy(F.desc("u"), F.desc("player"))
    before = lambda w: F.sum("bit").over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = drawn.select("player", "bit", before(forward).alias("with")).union(drawn.select("player", "bit", before(back).alias("with")))
    joined = steps.withColumn("without", F.col("with") - F.col("bit")).join(values.select(F.col("mask").alias("with"), F.col("value").alias("high")), "with").join(values.select(F.col("mask").alias("without"), F.col("value").alias("low")), "without")
    gain = F.col("high") - F.col("low")
    return joined.groupBy("player").agg(F.avg(gain).alias("shapley_value"), (F.coalesce(F.stddev_samp(gain), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("standard_error"))


def shapley_report(found: DataFrame, zones: DataFrame) -> DataFrame:
    error = F.col("standard_error") if "standard_error" in found.columns else F.lit(0.0)
    order = Window.orderBy(F.desc("shapley_value"), "player")  # a handful of players
    rows = found.withColumn("rank", F.row_number().over(order)).withColumn("lower", F.col("shapley_value") - 1.96 * error).withColumn("upper", F.col("shapley_value") + 1.96 * error)
    return rows.join(zones.select(F.col("zone_id").alias("player"), "zone_name", "borough"), "player", "left")


def shapley_summary(values: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Baseline, full value, gain, sum of values, gap."""
    ends = values.agg(F.max(F.when(F.col("mask") == 0, F.col("value"))).alias("baseline"), F.max(F.when(F.col("mask") == (1 << n) - 1, F.col("value"))).alias("full_value"), F.count(F.lit(1)).alias("coalitions"))
    total = found.agg(F.sum("shapley_value").alias("total"))
    return ends.join(F.broadcast(total)).withColumn("gain", F.col("full_value") - F.col("baseline")).withColumn("gap", F.abs(F.col("gain") - F.col("total")))


def singleton_gain(values: DataFrame, players: list[int]) -> DataFrame:
    return marginals(values, players).filter("mask = 0").select("player", F.col("marginal").alias("singleton_gain"))


def pair_synergy(values: DataFrame, players: list[int]) -> DataFrame:
    """player, partner, synergy: what a pair is worth beyond both alone, with the best partner (the smaller id of equals)."""
    m = marginals(values, players)
    alone = singleton_gain(values, players)
    bits = values.sparkSession.createDataFrame([(z, 1 << k) for k, z in enumerate(players)], "partner int, mask long")
    pairs = m.join(F.broadcast(bits), "mask").join(alone, "player").select("player", "partner", (F.col("marginal") - F.col("singleton_gain")).alias("synergy"))
    return pairs.withColumn("k", F.row_number().over(Window.partitionBy("player").orderBy(F.desc("synergy"), "partner"))).filter("k = 1").drop("k")


def select_players(scores: DataFrame, n: int) -> DataFrame:
    """player, rank, reasons: a third each by gain, coverage and synergy, filled by rank sum. scores: player, gain, coverage, synergy."""
    third = max(1, n // 3)
    metrics = ("gain", "coverage", "synergy")
    rows, total, first = scores, F.lit(0), F.lit(None).cast("int")
    for k, m in enumerate(metrics):
        rows = rows.withColumn(f"_k_{m}", F.row_number().over(Window.orderBy(F.desc(m), "player"))).withColumn(f"_r_{m}", F.rank().over(Window.orderBy(F.desc(m))))
        total = total + F.col(f"_r_{m}")
        first = F.coalesce(first, F.when(F.col(f"_k_{m}") <= third, k * third + F.col(f"_k_{m}")))
    rows = rows.withColumn("_first", first).withColumn("rank_sum", total)
    reasons = F.concat_ws("|", *(F.when(F.col(f"_k_{m}") <= third, m) for m in metrics))
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("_first").asc_nulls_last(), "rank_sum", "player"))).filter(F.col("rank") <= n)
    return ranked.select("player", "rank", F.when(reasons == "", "rank_sum").otherwise(reasons).alias("reasons"))


# ---------------------------------------------------------------- axioms


def _status(passed: Column) -> Column:
    return F.when(passed, "PASS").otherwise("FAIL")


def axiom_checks(values: DataFrame, found: DataFrame, players: list[int], tolerance: float = 1e-7) -> DataFrame:
    """axiom, status, detail of efficiency, monotonicity, dummy and symmetry."""
    n = len(players)
    m = marginals(values, players)
    s = shapley_summary(values, found, n).select(F.lit("efficiency").alias("axiom"), _status(F.col("gap") <= tolerance).alias("status"), F.col("gap").alias("detail"))
    least = m.agg(F.min("marginal").alias("least")).select(F.lit("monotonicity").alias("axiom"), _status(F.col("least") >= -tolerance).alias("status"), F.col("least").alias("detail"))
    idle = m.groupBy("player").agg(F.max(F.abs("marginal")).alias("most")).filter(F.col("most") <= tolerance).join(found, "player")
    worst = idle.agg(F.coalesce(F.max(F.abs("shapley_value")), F.lit(0.0)).alias("w"))
    dummy = worst.select(F.lit("dummy").alias("axiom"), _status(F.col("w") <= tolerance).alias("status"), F.col("w").alias("detail"))
    bits = values.sparkSession.createDataFrame([(z, 1 << k) for k, z in enumerate(players)], "player int, bit long")
    own, other = m.join(F.broadcast(bits), "player"), m.join(F.broadcast(bits), "player").toDF("player2", "mask", "size2", "marginal2", "bit2")
    both = own.join(other, "mask").filter((F.col("player") < F.col("player2")) & (F.col("mask").bitwiseAND(F.col("bit2")) == 0))
    equal = both.groupBy("player", "player2").agg(F.max(F.abs(F.col("marginal") - F.col("marginal2"))).alias("apart")).filter(F.col("apart") <= tolerance)
    valued = equal.join(found.select("player", F.col("shapley_value").alias("a")), "player").join(found.select(F.col("player").alias("player2"), F.col("shapley_value").alias("b")), "player2")
    worst = valued.agg(F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("w"))
    symmetry = worst.select(F.lit("symmetry").alias("axiom"), _status(F.col("w") <= tolerance).alias("status"), F.col("w").alias("detail"))
    return s.union(least).union(dummy).union(symmetry)


def ablation(values: DataFrame, found: DataFrame, players: list[int], repeats: int = 20, seed: int = 7) -> DataFrame:
    """kind, removed, repeat, drop, drop_percent: the top k players removed together, and as many random ones."""
    n, spark = len(players), values.sparkSession
    bits = spark.createDataFrame([(z, 1 << k) for k, z in enumerate(players)], "player int, bit long")
    ranked = found.join(F.broadcast(bits), "player")
    upto = Window.orderBy(F.desc("shapley_value"), "player").rowsBetween(Window.unboundedPreceding, 0)
    top = ranked.select(F.lit("top").alias("kind"), F.row_number().over(Window.orderBy(F.desc("shapley_value"), "player")).alias("removed"), F.lit(0).cast("long").alias("repeat"), F.sum("bit").over(upto).alias("gone"))
    drawn = spark.range(repeats).select(F.col("id").alias("repeat")).join(F.broadcast(bits)).withColumn("u", keyed_digits(F.lit(seed), F.col("repeat"), F.col("player")))
    w = Window.partitionBy("repeat").orderBy("u", "player")
    random = drawn.select(F.lit("random").alias("kind"), F.row_number().over(w).alias("removed"), "repeat", F.sum("bit").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("gone"))
    full = values.filter(F.col("mask") == (1 << n) - 1).select(F.col("value").alias("full"))
    left = top.union(random).withColumn("mask", F.lit((1 << n) - 1).cast("long").bitwiseXOR(F.col("gone"))).join(values, "mask").join(F.broadcast(full))  # one row
    return left.select("kind", "removed", "repeat", (F.col("full") - F.col("value")).alias("drop"), (100 * (F.col("full") - F.col("value")) / F.nullif(F.col("full"), F.lit(0.0))).alias("drop_percent"))


def ablation_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "removed").agg(F.avg("drop").alias("mean_drop"), F.coalesce(F.stddev_samp("drop"), F.lit(0.0)).alias("std_drop"), F.count(F.lit(1)).alias("n"))
