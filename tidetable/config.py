"""Domain constants."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Thresholds of the transit pipeline; pass another instance to change them."""

    time_zone: str = "America/Toronto"
    early_below_s: float = -60.0
    late_above_s: float = 300.0
    outlier_s: float = 3600.0
    vehicle_stale_s: float = 120.0
    earth_radius_m: float = 6_371_000.0
    bunched_below: float = 0.5
    gapped_above: float = 1.5
    headway_min_s: float = 120.0
    headway_max_s: float = 1800.0
    headway_actual_max_s: float = 7200.0
    transfer_walk_m: float = 150.0
    transfer_wait_s: float = 1800.0
    transfer_min_walk_s: float = 30.0
    walk_speed_mps: float = 1.2
    transfer_min_rows: int = 10
    footpath_m: float = 250.0
    footpath_speed_mps: float = 1.25
    footpath_extra_s: int = 30
    stride_minutes: int = 10
    lead_edges_min: tuple[float, ...] = (0.0, 5.0, 10.0, 20.0, 40.0)
    final_lead_max_min: float = 2.0
    rain_icons: tuple[int, ...] = (12, 13, 14, 28)
    snow_icons: tuple[int, ...] = (16, 17, 18, 25, 26, 27)
    freezing_icons: tuple[int, ...] = (7, 8, 19)
    planner_slack_s: int = 45
    planner_access_m: float = 600.0
    planner_rounds: int = 4
    planner_missed_penalty_s: float = 900.0
    planner_live_s: int = 2700
    freshness_minutes: dict[str, float] = field(default_factory=lambda: {"realtime": 5.0, "alerts": 15.0, "static": 48 * 60.0, "weather": 6 * 60.0})


DEFAULT = Settings()
