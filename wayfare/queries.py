"""Registered queries of the trip operators over the star-schema tables, and their SQL.

Trips are derived from line items, orders, customers and suppliers (nations are zones); episodes and events from the
events table. Doubles are rounded to five places, a hair off the halves, so that sums in another order agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import columns as col
from wayfare.operators import aggregate, calibrate, nodes, od, space
from wayfare.operators import lookup as look
from wayfare.plans.model import TripModel
from wayfare.queries_sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_models: dict[tuple[str, str], TripModel] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*(F.round(F.col(c) + 1.3e-9, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _orders_and_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders with their customer's nation, line items with their supplier's."""
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    orders = read("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(read("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = read("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").join(read("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return orders, lines


def line_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order's and both nations' columns.

    Orders meet their customers and line items their suppliers first, so that the many rows are dealt once, by order.
    """
    orders, lines = _orders_and_lines(spark, sf_dir)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _trip_numbers() -> tuple[Column, Column, list[Column]]:
    """Of a line item: minutes after its order's date, minutes of the trip, and miles, fare and tip."""
    start = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 131 + F.col("l_suppkey") * 17) % 1440
    minutes = 2.0 + F.col("l_quantity") * 1.2 + ((F.col("l_partkey") * 13) % 30)
    fare = F.col("l_extendedprice") / 1000.0
    return start, minutes, [(F.col("l_quantity") * 0.4).cast("double").alias("trip_distance"), fare.cast("double").alias("fare_amount"), (fare * F.col("l_discount")).cast("double").alias("tip_amount")]


def clocked_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips of trip_view by date and microseconds, as cleaning takes them.

    What depends on an order or a line item alone is computed, and filtered, before they meet; after that all is arithmetic.
    """
    orders, lines = _orders_and_lines(spark, sf_dir)
    day = F.col("o_orderdate").cast("timestamp_ntz")
    start, minutes, numbers = _trip_numbers()
    micros = F.floor((minutes * 60).cast("double") * 1_000_000 + 0.5)  # as trip_view rounds them
    orders = orders.select("o_orderkey", (F.col("c_nationkey") + 1).cast("int").alias("DOLocationID"), col.month_text(F.to_date(day)).alias("source_month"), F.to_date(day).alias("day"), F.when(day == F.to_date(day), F.lit(0)).otherwise(col.day_micros(day)).alias("into_day"))
    raw = ("l_quantity", "l_extendedprice", "l_discount")  # few distinct values, which compress; filters on what is made of them move below the join
    lines = lines.select("l_orderkey", (F.col("s_nationkey") + 1).cast("int").alias("PULocationID"), (start * 60_000_000).alias("after"), micros.alias("duration_micros"), *raw)
    since = F.col("into_day") + F.col("after")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.date_add("day", F.floor(since / col.DAY_MICROS).cast("int")).alias("pickup_date"), F.pmod(since, F.lit(col.DAY_MICROS)).alias("pickup_micros"), "duration_micros",
        "PULocationID", "DOLocationID", *numbers, "source_month",
    )


def trip_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_view(spark, sf_dir)
    start, minutes, numbers = _trip_numbers()
    day = F.col("o_orderdate").cast("timestamp_ntz")
    second = F.expr("INTERVAL '1' SECOND")  # times doubles it rounds to microseconds, without decimals in between
    later = lambda t, m: t + second * (m * 60).cast("double")
    pickup = later(day, start)
    return rows.select(
        pickup.alias("tpep_pickup_datetime"), later(pickup, minutes).alias("tpep_dropoff_datetime"), (F.col("s_nationkey") + 1).cast("int").alias("PULocationID"), (F.col("c_nationkey") + 1).cast("int").alias("DOLocationID"),
        *numbers, F.date_format("o_orderdate", "yyyy-MM").alias("source_month"),
    )


def zone_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    zone = (F.col("n_nationkey") + 1).cast("int")
    name = F.when(zone.isin(1, 13), F.concat("n_name", F.lit(" Airport"))).otherwise(F.col("n_name"))
    return rows.select(zone.alias("zone_id"), F.col("r_name").alias("borough"), name.alias("zone_name"), ((F.col("n_nationkey") % 5) * 9000.0).cast("double").alias("centroid_x"), (F.floor(F.col("n_nationkey") / 5) * 9000.0).cast("double").alias("centroid_y"))


def vertex_view(zones: DataFrame) -> DataFrame:
    """Outlines as vertices (zone_id, ring, seq, x, y) in feet: a square around each centroid, every other one with a square hole."""
    k = F.col("zone_id") - 1

    def square(ring: int, x: Column, y: Column, half: Column, right: tuple[int, ...], up: tuple[int, ...]) -> Column:
        return F.array(*(F.struct(F.lit(ring).alias("ring"), F.lit(s).alias("seq"), (x + half * a).cast("double").alias("x"), (y + half * b).cast("double").alias("y")) for s, (a, b) in enumerate(zip(right, up, strict=True))))

    x, y = F.col("centroid_x"), F.col("centroid_y")
    outer = square(0, x, y, 4390 + 5 * (k % 4), (-1, 1, 1, -1), (-1, -1, 1, 1))
    hole = square(1, x + 800 + 100 * (k % 5), y - 500, 600 + 100 * (k % 3), (-1, -1, 1, 1), (-1, 1, 1, -1))
    return zones.select("zone_id", F.inline(F.when(k % 2 == 1, F.concat(outer, hole)).otherwise(outer)))


def model(spark: SparkSession, sf_dir: str) -> TripModel:
    """One model per session and folder: later queries read the tables that earlier ones settled."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        zones = zone_view(spark, sf_dir)
        _models[key] = TripModel(clocked_trips(spark, sf_dir), zones, space.zone_adjacency(vertex_view(zones)))
    return _models[key]


@query
def od_time_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).observed)


@query
def clean_trips_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir).clean
    return rounded(m.groupBy("source_month").agg(F.count(F.lit(1)).alias("trips"), F.countDistinct("pickup_date").alias("days"), F.sum("driver_revenue").alias("revenue"), F.avg("duration_min").alias("minutes"), F.max("distance_miles").alias("longest")))


@query
def pickup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.pickup_counts(model(spark, sf_dir).clean)


@query
def dropoff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.dropoff_counts(model(spark, sf_dir).clean)


@query
def service_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.service_days(model(spark, sf_dir).clean)


@query
def combined_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial aggregates of two halves of the months, merged."""
    m = model(spark, sf_dir).clean
    halves = [aggregate.od_time_aggregate(m.filter(F.substring("source_month", 6, 2).cast("int") % 2 == k)) for k in (0, 1)]
    return rounded(aggregate.combine_aggregates(halves, ["time_bin", "origin", "destination"]).select("time_bin", "origin", "destination", "trip_count", "revenue_sum", "duration_sum", "distance_sum"))


@query
def global_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).pairs)


@query
def time_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).profiles)


@query
def gravity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).gravity)


@query
def duration_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).calibration)


@query
def calibrated_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated duration of every pair at the start of every bin."""
    m = model(spark, sf_dir)
    rows = calibrate.with_pair_names(space.zone_pairs(m.zones), m.zones).join(m.profiles, how="cross")
    rows = calibrate.with_calibrated_minutes(rows, m.calibration, F.col("miles"), F.col("speed_mph"))
    return rounded(rows.select("time_bin", "origin", "destination", "miles", "distance_band", "borough_pair", "airport_pair", "calibration_multiplier", "calibrated_minutes"))


@query
def nearest_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).near)


@query
def reposition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).edges)


@query
def shortest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).routes.select("origin", "destination", "minutes"))


@query
def node_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).posterior)


@query
def latent_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).stock)


@query
def node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("time_bin", "zone_id", "supply", "competition_ratio", "expected_wait_low", "expected_wait_medium", "expected_wait_high", "competitors_medium", "pickup_probability")
    return rounded(model(spark, sf_dir).bare_nodes.select(*wanted))


@query
def pickup_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nodes.pickup_scale(model(spark, sf_dir).posterior))


@query
def od_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    return rounded(od.od_support(m.observed, m.pairs, m.zones))


@query
def od_temporal_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = od.od_temporal_prior(model(spark, sf_dir).observed)
    return rounded(rows.select("time_bin", "origin", "destination", "temporal_weight", "temporal_driver_revenue", "temporal_duration_min", "temporal_distance_miles"))


@query
def od_spatial_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark, sf_dir)
    rows = od.od_spatial_prior(m.pairs, m.near)
    return rounded(rows.select("origin", "destination", "spatial_total", "spatial_driver_revenue", "spatial_duration_min", "spatial_distance_miles"))


@query
def od_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("time_bin", "origin", "destination", "observed_trip_count", "driver_revenue", "duration_min", "distance_miles", "revenue_dev", "confidence", "imputation_layer", "effective_sample_size", "calibration_multiplier", "destination_probability", "trips_per_bin_day")
    return rounded(model(spark, sf_dir).od.select(*wanted), 3)  # the fitted gravity differs by 1e-10 between orders of adding


@query
def node_trip_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).nodes.select("time_bin", "zone_id", *(f"expected_{c}" for c in od.MEASURES)), 3)


@query
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir).summary())


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question of each order: between its customer's nation and the next, at a minute of its key."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("query_id"), (F.col("c_nationkey") + 1).cast("int").alias("origin"), ((F.col("c_nationkey") + F.col("o_orderkey")) % 25 + 1).cast("int").alias("destination"), ((F.col("o_orderkey") * 37) % 1440).cast("double").alias("minute"))


@query
def od_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any pair at any minute, stored estimates first."""
    return rounded(look.estimate_od(_questions(spark, sf_dir), model(spark, sf_dir)), 3)


@query
def od_lookup_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell from the sources behind the stored estimates."""
    m = model(spark, sf_dir)
    cells = space.zone_pairs(m.zones).select("origin", "destination").join(m.profiles.select("time_bin"), how="cross")
    return rounded(look.estimate_od_bin(cells, m, direct=False), 3)


@query
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _questions(spark, sf_dir).select("query_id", F.col("origin").alias("zone_id"), "minute")
    return rounded(look.node_at(asked, model(spark, sf_dir).nodes, "high"))


@query
def od_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations from every zone at 96 minutes between bins."""
    m = model(spark, sf_dir)
    asked = m.nodes.select((F.col("time_bin") * 1000 + F.col("zone_id")).cast("long").alias("query_id"), F.col("zone_id").alias("origin"), (F.col("time_bin") * 15 + 7.0).alias("minute"))
    return rounded(look.od_options(asked, m.od).select("query_id", "origin", "destination", "probability", "driver_revenue", "duration_min", "distance_miles", "confidence"), 3)


@query
def profile_at_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _questions(spark, sf_dir).select("query_id", "minute")
    rows = space.with_profile_at(asked, model(spark, sf_dir).profiles)
    rows = rows.withColumn("clock", col.clock_text(F.col("minute"))).withColumn("wait_within_step", col.conditional_wait(F.col("speed_at"), 5.0)).withColumn("pickup_within_step", col.pickup_probability(F.col("speed_at"), 5.0))
    return rounded(rows.withColumn("minute_again", col.clock_minutes(F.col("clock"))))


@query
def bin_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = [("posterior", False), ("expected_driver_revenue", False), ("expected_wait", True), ("pickup_probability", False), ("competition_ratio", True)]
    settled = rounded(model(spark, sf_dir).nodes)  # near ties fall to the smaller id
    return nodes.bin_leaders(settled, metrics, 12)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}


