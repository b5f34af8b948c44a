"""Constants of the trip model."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # fixed values: the model's published settings
    bin_minutes: int = 15
    step_minutes: int = 5
    horizon_minutes: int = 120
    fare: tuple[float, float] = (2.5, 500.0)
    miles: tuple[float, float] = (0.01, 100.0)
    minutes: tuple[float, float] = (1.0, 240.0)
    revenue_share: float = 1.0
    cost_per_mile: float = 0.35
    reference_wait: float = 12.0
    wait: tuple[float, float] = (1.0, 75.0)
    stock_persistence: float = 0.72
    stock_history_bins: int = 8
    demand_attraction: float = 0.45
    pickup_depletion: float = 0.72
    supply_diffusion: float = 0.22
    supply_floor: float = 0.35
    stock_days: int = 30
    competition: dict[str, float] = field(default_factory=lambda: {"low": 0.70, "medium": 1.00, "high": 1.35})
    airport_queue: float = 1.25
    fallback_mph: float = 15.0
    mph: tuple[float, float] = (5.0, 35.0)
    reposition_minutes: float = 45.0
    reposition_miles: float = 25.0
    adjacency_feet: float = 250.0
    destinations: int = 20
    dirichlet: float = 8.0
    od_prior: float = 10.0
    node_prior: float = 12.0
    temporal_bins: int = 4
    temporal_decay: float = 1.5
    neighbours: int = 4
    spatial_decay: float = 2.0
    global_discount: float = 0.35
    gravity_weight: float = 2.0
    min_confidence: float = 0.05
    candidate_zones: int = 12
    candidate_quota: int = 4
    candidate_near: int = 24
    distance_bands: tuple[float, ...] = (0.0, 1.0, 2.0, 4.0, 7.0, 12.0, 20.0, 100.0)
    calibration_count: int = 50
    calibration_shrinkage: float = 150.0
    calibration: tuple[float, float] = (0.70, 1.80)

    @property
    def bins(self) -> int:
        return 24 * 60 // self.bin_minutes

    @property
    def steps(self) -> int:
        return self.horizon_minutes // self.step_minutes


DEFAULT = Params()
