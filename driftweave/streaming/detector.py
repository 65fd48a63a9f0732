"""A detector of abrupt change in a stream of numbers: two-sided cumulative sums on robust increments.

It fires only if an arm is high, rises faster than usual for this stream, and accelerates, several steps in a row.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field
from statistics import median


@dataclass
class Settings:
    k_lambda: float = 4.5
    k_slope: float = 3.5
    ema_alpha: float = 0.05
    delta: float = 0.01
    slope_window: int = 10
    accel_window: int = 8
    confirm_steps: int = 3
    var_window: int = 50
    adapt_window: int = 150
    clip_sigma: float = 2.5
    min_samples: int = 50
    accel_floor: float = 0.12


def mad_sigma(values) -> float:
    """1.4826 times the upper median of distances to the median; 1 with under four values."""
    if len(values) < 4:
        return 1.0
    center = median(values)
    spread = sorted(abs(v - center) for v in values)
    return max(1.4826 * spread[len(spread) // 2], 1e-6)


def slope(values) -> float:
    """Least-squares slope over places; 0 with under two values."""
    n = len(values)
    if n < 2:
        return 0.0
    mid = (n - 1) / 2.0
    # the places' deviations add up to zero, so the values' mean drops out
    return sum((i - mid) * v for i, v in enumerate(values)) * 12.0 / (n * (n * n - 1.0))


def moments(values) -> tuple[float, float]:
    """Mean and sample deviation."""
    n = len(values)
    mean = math.fsum(values) / n
    return mean, math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (n - 1)) if n > 1 else 0.0


@dataclass
class Arm:
    """One of the two cumulative sums. `sign` is 1 for rises and -1 for falls."""

    sign: float
    settings: Settings
    value: float = 0.0
    path: deque = field(default_factory=deque)
    recent: deque = field(default_factory=deque)
    slopes: deque = field(default_factory=deque)
    slope: float = 0.0

    def __post_init__(self) -> None:
        self.path = deque(maxlen=self.settings.slope_window)
        self.recent = deque(maxlen=self.settings.accel_window)
        self.slopes = deque(maxlen=self.settings.adapt_window)

    def add(self, z: float) -> None:
        self.value = max(0.0, self.value + self.sign * z - self.settings.delta)
        self.path.append(self.value)
        self.slope = slope(self.path)
        self.slopes.append(self.slope)
        self.recent.append(self.slope)

    def reading(self) -> tuple[float, float, float]:
        """Score of the slope, its limit, and the acceleration."""
        n, k = len(self.slopes), self.settings.k_slope
        mean, spread = moments(self.slopes)
        score = self.slope if n < 5 else (self.slope - mean) / (spread + 1e-9)
        return score, 2.0 * k if n < 10 else mean + k * spread, abs(slope(self.recent))

    def clear(self) -> None:
        """Forgets the sum and its path; what slopes are usual stays known."""
        self.value = 0.0
        self.path.clear()
        self.recent.clear()


class ChangeDetector:
    """Feed numbers to `update`; call `reset` after acting on a fire."""

    def __init__(self, **settings):
        self.settings = Settings(**settings)
        self.full_reset()

    def full_reset(self) -> None:
        """Starts from scratch."""
        self.n = 0
        self.mean: float | None = None
        self.values: deque = deque(maxlen=self.settings.var_window)
        self.heights: deque = deque(maxlen=self.settings.adapt_window)
        self.up, self.low = Arm(1.0, self.settings), Arm(-1.0, self.settings)
        self.level = self.limit = 0.0
        self._quiet()

    def _quiet(self) -> None:
        self.confirmed, self.fired, self.score, self.acceleration, self.direction = 0, False, 0.0, 0.0, "none"

    def reset(self) -> None:
        """Lowers both arms; the mean, the spread and what is usual stay."""
        self.up.clear()
        self.low.clear()
        self._quiet()

    def _level(self) -> float:
        k = self.settings.k_lambda
        return 3.0 * k if len(self.heights) < 20 else k * max(1.5, moments(self.heights)[1])

    def update(self, x: float) -> bool:
        s = self.settings
        self.n += 1
        before = x if self.mean is None else self.mean  # the mean without x, so that a jump cannot hide itself
        self.mean = s.ema_alpha * x + (1.0 - s.ema_alpha) * before
        self.values.append(x)
        z = (x - before) / mad_sigma(self.values)
        z = min(max(z, -s.clip_sigma), s.clip_sigma)
        for arm in (self.up, self.low):
            arm.add(z)
        self.heights.append(max(self.up.value, self.low.value))
        self.level = self._level()
        arm, self.direction = (self.up, "up") if self.up.slope >= self.low.slope else (self.low, "down")
        self.score, self.limit, self.acceleration = arm.reading()
        met = self.n >= s.min_samples and arm.value > self.level and self.score > self.limit and self.acceleration > s.accel_floor
        self.confirmed = self.confirmed + 1 if met else 0
        self.fired = self.confirmed >= s.confirm_steps
        return self.fired

    def snapshot(self) -> dict:
        return {
            "n_samples": self.n, "ema_mean": self.mean if self.mean is not None else 0.0, "U_t": self.up.value, "L_t": self.low.value, "abruptness_score": self.score, "acceleration": self.acceleration,
            "confirm_count": self.confirmed, "direction": self.direction, "lambda_current": self.level, "slope_thresh_current": self.limit, "drift_detected": self.fired,
        }


SNAPSHOT = "n_samples long, ema_mean double, U_t double, L_t double, abruptness_score double, acceleration double, confirm_count int, direction string, lambda_current double, slope_thresh_current double, drift_detected boolean"
