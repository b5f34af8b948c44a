"""The trip model: named tables built from cleaned trips and zones, each computed once and kept on shared storage."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators import aggregate, calibrate, clean, nodes, od, space
from wayfare.plans.params import DEFAULT, Params
from wayfare.sources.lineage import settle


class TripModel:
    def __init__(self, trips: DataFrame, zones: DataFrame, adjacency: DataFrame, params: Params = DEFAULT):
        self.trips, self.zones, self.adjacency, self.params = trips, zones, adjacency, params

    @cached_property
    def clean(self) -> DataFrame:
        return settle(clean.clean_trips(self.trips, self.zones, self.params))

    @cached_property
    def partials(self) -> DataFrame:
        """All that the model keeps of the trips, in one pass that writes no trip; `clean` is settled only for who asks for trips."""
        trips = self.__dict__.get("clean")
        return settle(aggregate.trip_partials(clean.clean_trips(self.trips, self.zones, self.params) if trips is None else trips))

    @cached_property
    def cells(self) -> DataFrame:
        return aggregate.partial_cells(self.partials)

    @cached_property
    def observed(self) -> DataFrame:
        return aggregate.observed_od(self.cells)

    @cached_property
    def pairs(self) -> DataFrame:
        return settle(aggregate.global_od(self.cells))

    @cached_property
    def profiles(self) -> DataFrame:
        return settle(aggregate.time_profiles(self.observed, self.params))

    @cached_property
    def gravity(self) -> DataFrame:
        return settle(aggregate.fit_gravity(self.pairs))

    @cached_property
    def calibration(self) -> DataFrame:
        return settle(calibrate.duration_calibration(self.observed, self.zones, self.profiles, self.params))

    @cached_property
    def near(self) -> DataFrame:
        return settle(space.nearest_zones(self.zones, self.params.neighbours))

    @cached_property
    def grid(self) -> DataFrame:
        return settle(nodes.node_grid(aggregate.partial_pickups(self.partials), aggregate.partial_dropoffs(self.partials), aggregate.partial_days(self.partials), self.zones, self.params))

    @cached_property
    def posterior(self) -> DataFrame:
        return settle(nodes.node_posterior(self.grid, self.near, self.params))

    @cached_property
    def stock(self) -> DataFrame:
        return settle(nodes.latent_stock(self.posterior, self.params))

    @cached_property
    def bare_nodes(self) -> DataFrame:
        return settle(nodes.node_metrics(self.posterior, nodes.diffuse_supply(self.stock, self.near, self.params), self.zones, self.params))

    @cached_property
    def temporal(self) -> DataFrame:
        return settle(od.od_temporal_prior(self.observed, self.params))

    @cached_property
    def spatial(self) -> DataFrame:
        return settle(od.od_spatial_prior(self.pairs, self.near, self.params))

    @cached_property
    def od(self) -> DataFrame:
        return settle(od.od_estimates(self.observed, self.pairs, self.posterior, self.zones, self.temporal, self.spatial, self.profiles, self.gravity, self.calibration, self.params))

    @cached_property
    def nodes(self) -> DataFrame:
        return settle(nodes.attach_trip_expectations(self.bare_nodes, self.od))

    @cached_property
    def edges(self) -> DataFrame:
        return settle(space.reposition_edges(self.adjacency, self.zones, self.pairs, self.params))

    @cached_property
    def routes(self) -> DataFrame:
        return settle(space.shortest_routes(self.edges))

    def summary(self) -> DataFrame:
        """One row of counts, mean confidence and waits."""
        od_ = self.od.agg(F.count(F.lit(1)).alias("od_rows"), F.count_if(F.col("observed_trip_count") > 0).alias("observed_cells"), F.count_if(F.col("observed_trip_count") == 0).alias("imputed_cells"), F.avg("confidence").alias("mean_od_confidence"))
        node = self.nodes.agg(F.count(F.lit(1)).alias("node_rows"), F.avg("node_confidence").alias("mean_node_confidence"), F.avg("expected_wait").alias("mean_wait"), F.percentile("expected_wait", F.lit(0.5)).alias("median_wait"), F.max("service_days").alias("service_days"))
        edge = self.edges.agg(F.count(F.lit(1)).alias("directed_edges"))
        return od_.join(F.broadcast(node)).join(F.broadcast(edge))  # one row each
