"""Parameters of the operators, with their production defaults, and a preset for coarse series."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnomalyConfig:
    bin_seconds: int = 180
    baseline_seconds: int = 3600
    min_history: int = 10
    radius_km: float = 1.0
    wide_radius_km: float = 1.5
    min_neighbors: int = 3
    min_excess: float = 5.0
    min_z: float = 3.0
    sigma_floor: float = 1.5
    #: A value that is older at the time of a report is stale.
    max_age_seconds: int = 180


@dataclass(frozen=True)
class EventConfig:
    bin_seconds: int = 180
    eps_km: float = 0.75
    centroid_km: float = 1.0
    member_km: float = 0.75
    max_gap_bins: int = 1
    support_score: float = 0.35
    support_excess: float = 3.0
    movement_km: float = 0.1


@dataclass(frozen=True)
class WindConfig:
    max_offset_seconds: int = 900
    preferred_km: float = 15.0
    max_km: float = 30.0
    min_stations: int = 3
    max_stations: int = 8
    power: float = 2.0
    epsilon_km: float = 0.1


@dataclass(frozen=True)
class TraceConfig:
    particles: int = 200
    dt_seconds: int = 60
    minutes: int = 60
    cell_m: float = 250.0
    buffer_m: float = 10_000.0
    block_seconds: int = 600
    seed: int = 42


#: Six-hour bins and wider circles, for series with a few observations a day.
COARSE = AnomalyConfig(bin_seconds=21_600, baseline_seconds=432_000, radius_km=3.0, wide_radius_km=4.5, max_age_seconds=10_800)
