"""Parameters of the pipeline, as one frozen value that operators take."""

from __future__ import annotations

from dataclasses import dataclass, field

ENTITY = ["run_id", "participant_id"]


@dataclass(frozen=True)
class Params:
    zone: str = "America/New_York"
    width_s: int = 60
    expected: dict = field(default_factory=lambda: {"hr": 60, "eda": 240, "acc": 1920})
    hr_range: tuple[float, float] = (30.0, 220.0)
    eda_range: tuple[float, float] = (0.0, 100.0)
    acc_scale: float = 1 / 64
    still_below: float = 0.05
    trailing_s: float = 10.0
    refresh: int = 10
    max_history: int = 5760
    warmup: int = 1440
    hr_epsilon: float = 1.0
    eda_epsilon: float = 0.02
    min_coverage: float = 0.5
    sufficient_coverage: float = 0.8
    z_full: float = 3.0
    weight_hr: float = 0.5
    weight_eda: float = 0.5
    activity_full: float = 0.25
    confound_level: float = 0.35
    night_start: int = 22
    night_end: int = 8
    still_ratio: float = 0.9
    compatible_z: float = 0.5
    bridge: int = 5
    min_rest: int = 30
    min_overnight: float = 0.7
    target_rest: int = 480
    recent: int = 20

    @property
    def baseline_id(self) -> str:
        return f"baseline-median-mad-1.4826-w{self.warmup}-r{self.refresh}"


@dataclass(frozen=True)
class Rules:
    """One version of the trigger rules."""

    version: str = "rules-2"
    load: float = 0.70
    window: int = 20
    at_least: int = 15
    recovery: float = 0.50
    overnight: float = 0.60
    pressure: float = 0.10
    cooldown_minutes: int = 60
    reset: float = 0.55


RULES_1 = Rules(version="rules-1", pressure=0.70)
