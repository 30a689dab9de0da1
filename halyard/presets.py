"""Parameters of recognition, with three presets."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Fixed values of the decision rules.
INSTANT_DISTANCE = 10
QUALITY_GATE_DISTANCE = 12
CONFIRM_RUN = 2
BLUR_COUNTED_RUN = 2
BLUR_CLEARING_RUN = 3
BLUR_IMPROVEMENT = 4
BLUR_GATE_FRACTION = 0.5
RECTANGLE_HOLD_FRAMES = 2
NEAR_MISS_SPAN = 8
AMBIENT_WEIGHT = 0.15
FAILURES_KEPT = 50
NEAR_MISSES_KEPT = 20
IDLE_INTERVAL_MS = 120
TRACKING_INTERVAL_MS = 80


@dataclass(frozen=True)
class Preset:
    threshold: int = 14
    margin: int = 4
    delay_ms: int = 150
    sharpness: float = 100.0
    glare_level: int = 250
    glare_percent: float = 20.0
    min_brightness: float = 50.0
    max_brightness: float = 220.0
    continuous: bool = False
    boost_near_threshold: bool = True
    #: Every second frame is skipped while no candidate is tracked.
    throttle: bool = False
    #: "worker" or "inline": which of the two frame paths is followed.
    path: str = "worker"

    def __post_init__(self) -> None:
        if self.threshold < QUALITY_GATE_DISTANCE:
            raise ValueError("the quality gate must not lie above the similarity threshold")

    def with_(self, **changes) -> Preset:
        return replace(self, **changes)


HOOK = Preset()
APP = Preset(threshold=18, margin=5, delay_ms=180, sharpness=85.0, continuous=True)
AUDIT = Preset(threshold=18, margin=5, boost_near_threshold=False)
PRESETS = {"hook": HOOK, "app": APP, "audit": AUDIT}
