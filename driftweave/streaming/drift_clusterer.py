"""The clusterer with a change detector on its surprise, which speeds up forgetting after a confirmed change."""

from __future__ import annotations

import numpy as np

from .clusterer import StreamClusterer
from .detector import ChangeDetector

#: A fire at least this strong marks a boundary between regimes.
STRONG = 2.3


class DriftAwareClusterer(StreamClusterer):
    """Differs from the plain one also without any change: balls live as long as one point does, and none returns to the pool.

    After a fire, the numbers of balls for a macro and of points for a try at new balls are lowered for a while; as
    splitting macros and forming balls keep their own numbers, this only lets macros appear and vanish within a step.
    """

    def __init__(
        self,
        cusum_k_lambda: float = 3.5304030498554377,
        cusum_k_slope: float = 2.509685764176742,
        cusum_ema_alpha: float = 0.11986779639677939,
        cusum_delta: float = 0.016777202486114567,
        cusum_confirm: int = 2,
        cusum_min_samples: int = 39,
        relax_steps: int = 238,
        n_micro_relax: int = 1,
        N_fast: int = 4,
        fast_window_fraction: float = 0.21498970223954925,
        detect: bool = True,
        **settings,
    ):
        super().__init__(**settings)
        self.detector = ChangeDetector(k_lambda=cusum_k_lambda, k_slope=cusum_k_slope, ema_alpha=cusum_ema_alpha, delta=cusum_delta, confirm_steps=cusum_confirm, min_samples=cusum_min_samples)
        self.relax_steps, self.n_micro_relax, self.N_fast, self.fraction, self.detect = relax_steps, n_micro_relax, max(2, min(N_fast, self.N - 1)), fast_window_fraction, detect
        self.relaxed = self.cooldown = 0
        self.boundary: int | None = None
        self.last_surprise = 0.0
        self._events: list[dict] = []

    @property
    def in_relax(self) -> bool:
        return self.relaxed > 0

    def update(self, x) -> None:
        x = np.asarray(x, float)
        self.t += 1
        cutoff = self.t - self.W
        n_micro, n_pool = (self.n_micro_relax, self.N_fast) if self.relaxed > 0 else (self.n_micro, self.N)
        self.relaxed = max(0, self.relaxed - 1)
        if self.cooldown > 0:
            self.cooldown -= 1
        else:
            self.boundary = None
        self.expire(cutoff)
        self.drop_macros(self.n_micro)
        self.place(x, cutoff)
        if len(self.pool) >= n_pool:
            self.form_balls()
        self.attach()
        self.form_macros(n_micro)
        self.split_macros()
        self.drop_macros(n_micro)
        self.last_surprise = self.surprise(x)
        if self.macros and self.detect and self.detector.update(self.last_surprise):
            self._fire()

    def _fire(self) -> None:
        d = self.detector
        self._events.append({"t": self.t, "direction": d.direction, "score": d.score, "acceleration": d.acceleration, "n_mcs": len(self.balls), "n_macros": len(self.macros)})
        self.relaxed = self.relax_steps
        if self.cooldown == 0 and d.score >= STRONG:
            self.boundary, self.cooldown = self.t, self.relax_steps
        d.reset()

    def expire(self, cutoff: int) -> None:
        """Balls mostly from before the boundary keep a short window only; balls without points go."""
        fast = self.t - int(self.W * self.fraction)
        kept = []
        for ball in self.balls:
            if not len(ball):
                continue
            old = self.boundary is not None and sum(t < self.boundary for t in ball.times) > 0.5 * len(ball)
            if ball.expire(fast if old else cutoff):
                kept.append(ball)
        self.balls = kept

    def backdate(self, share: float = 0.5) -> None:
        """Ages balls without a point from the last quarter window by a share of the window."""
        for ball in self.balls:
            if ball.times and ball.times[-1] < self.t - self.W // 4:
                ball.times = [t - int(self.W * share) for t in ball.times]

    def events(self) -> list[dict]:
        out, self._events = self._events, []
        return out
