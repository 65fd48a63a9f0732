"""A two-tier clusterer over the last W points of a stream: balls of near points, and groups of balls.

Balls form where a pool of unplaced points is dense; groups are components of the mutual-neighbour graph of ball centres.
All steps are plain numpy over one stream's state, the same for batch and streaming runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


#: How near points are found: by all distances, whatever kind of tree is named, or among points of equal hashes only.
BACKENDS = ("exact", "auto", "kd", "ball", "lsh")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def neighbor_lists(d: np.ndarray, k: int) -> np.ndarray:
    """For each point the k nearest others, ties to the lower index; `d` is the matrix of distances."""
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def _member(lists: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n), bool)
    out[np.arange(n)[:, None], lists] = True
    return out


def tight_groups(x: np.ndarray, k: int, alpha: float = 1.0) -> np.ndarray:
    """Component numbers in order of first appearance; -1 for outliers, which a lone point is too."""
    n = len(x)
    labels = np.full(n, -1, np.int64)
    if n < 2:
        return labels
    d = distances(x, x)
    near = _member(neighbor_lists(d, min(k, n - 1)), n)
    tight = near & near.T
    count = tight.sum(axis=1)
    if not count.any():
        return labels
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(count > 0, (d * tight).sum(axis=1) / count / count**2, np.inf)
    finite = score[np.isfinite(score)]
    good = (count > 0) & (score <= finite.mean() + alpha * finite.std())
    linked = tight & good[:, None] & good[None, :]
    label = 0
    for i in range(n):
        if good[i] and labels[i] < 0:
            todo = [i]
            labels[i] = label
            while todo:
                j = todo.pop()
                new = np.flatnonzero(linked[j] & (labels < 0))
                labels[new] = label
                todo += new.tolist()
            label += 1
    return labels


def _blocks(x: np.ndarray, others: int) -> Iterator[slice]:
    """Slices of x whose distances to so many others take some 32 MB."""
    rows = max(1, (1 << 22) // max(1, others * (x.shape[1] if x.ndim > 1 else 1)))
    return (slice(at, min(len(x), at + rows)) for at in range(0, len(x), rows))


def shared_radius_of(x: np.ndarray, k: int = 5, r_max: float = 0.5, tk: int = 5, mk: int = 4) -> float:
    """The greatest distance from a point to a neighbour that it shares with a neighbour, over pairs that share `tk`; r_max with under `mk` pairs."""
    n = len(x)
    if n < 2:
        return r_max
    k = min(k, n - 1)
    lists, dist = np.empty((n, k), np.int64), np.empty((n, k))
    for own in _blocks(x, n):
        d = distances(x[own], x)
        d[np.arange(len(d)), np.arange(own.start, own.stop)] = np.inf
        lists[own] = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist[own] = np.take_along_axis(d, lists[own], axis=1)
    pairs, longest = 0, 0.0
    for own in _blocks(lists, k * k):
        shared = (lists[own][:, None, :, None] == lists[lists[own]][:, :, None, :]).any(axis=3)  # of a point, with a neighbour
        many = shared.sum(axis=2) >= tk
        pairs += int(many.sum())
        longest = max(longest, float(np.where(shared & many[:, :, None], dist[own][:, None, :], 0.0).max(initial=0.0)))
    return float(np.clip(longest, 1e-4, r_max)) if pairs >= mk else r_max


def hashed_near(x: np.ndarray, tables: int, hashes: int, seed: int = 42) -> np.ndarray:
    """Which points share a bucket of signed random projections in some table."""
    normal = np.random.RandomState(seed).randn(tables, hashes, x.shape[1])
    bits = np.einsum("nd,thd->tnh", x, normal) > 0
    return (bits[:, :, None, :] == bits[:, None, :, :]).all(axis=3).any(axis=0)


def cover(x: np.ndarray, radius: float, least: int, allowed: np.ndarray | None = None) -> list[np.ndarray]:
    """In order, each unclaimed point claims all unclaimed points within the radius, if there are enough."""
    free = np.ones(len(x), bool)
    out = []
    for rows in _blocks(x, len(x)):
        asking = rows.start + np.flatnonzero(free[rows])  # what is claimed by now claims nothing
        near = distances(x[asking], x) <= radius
        if allowed is not None:
            near &= allowed[asking]
        for i, held in zip(asking, near):
            if free[i]:
                own = np.flatnonzero(held & free)
                if len(own) >= least:
                    out.append(own)
                    free[own] = False
    return out


@dataclass(eq=False)
class Ball:
    id: int
    radius: float
    times: list = field(default_factory=list)
    held: np.ndarray | None = None  # room for points, of which the first len(times) rows are used
    center: np.ndarray | None = None
    macro: int = -1
    version: int = 0  # of the centre

    def __len__(self) -> int:
        return len(self.times)

    @property
    def points(self) -> np.ndarray:
        return self.held[: len(self.times)]

    def add(self, t: int, x: np.ndarray) -> None:
        n = len(self.times)
        if self.held is None or n == len(self.held):
            room = np.empty((max(16, 2 * n), len(x)))
            if n:
                room[:n] = self.held
            self.held = room
        self.held[n] = x
        self.times.append(t)
        self._center()

    def fill(self, times: list, points: np.ndarray) -> None:
        self.times, self.held = times, points
        self._center()

    def expire(self, cutoff: int) -> bool:
        """Drops points not newer than the cutoff; whether any is left."""
        if self.times and min(self.times) <= cutoff:
            keep = [i for i, t in enumerate(self.times) if t > cutoff]
            kept = self.held[keep]
            self.times = [self.times[i] for i in keep]
            self.held = kept
            if keep:
                self._center()
        return bool(self.times)

    def _center(self) -> None:
        self.center = np.add.reduce(self.points, axis=0) / len(self.times)
        self.version += 1

    def contains(self, x: np.ndarray) -> bool:
        return bool(np.sqrt(((x - self.center) ** 2).sum()) <= self.radius)


class StreamClusterer:
    def __init__(self, W: int = 500, N: int = 5, r_max: float = 0.15, k: int = 4, n_micro: int = 2, snn_k: int = 5, alpha: float = 1.6, tk: int = 3, mk: int = 2, backend: str = "exact", n_hashes: int = 10, n_tables: int = 3):
        self.W, self.N, self.r_max, self.k, self.n_micro, self.snn_k, self.alpha, self.tk, self.mk = W, N, r_max, k, n_micro, snn_k, alpha, tk, mk
        if backend not in BACKENDS:
            raise ValueError(f"unknown backend {backend!r}: one of {', '.join(BACKENDS)}")
        self.backend, self.n_hashes, self.n_tables = backend, n_hashes, n_tables
        self.t = 0
        self.pool: list[tuple[int, np.ndarray]] = []
        self.balls: list[Ball] = []
        self.macros: dict[int, list[Ball]] = {}
        self.next_macro = self.next_ball = 0
        self.pool_version, self.tried = 0, -1
        self.known: dict[tuple, np.ndarray] = {}  # groups of balls whose centres have not moved since
        self.used: dict[tuple, np.ndarray] = {}

    # one point -------------------------------------------------------------------------------------------------------

    def update(self, x) -> None:
        x = np.asarray(x, float)
        self.t += 1
        cutoff = self.t - self.W
        self.expire(cutoff)
        self.drop_macros(self.n_micro)
        self.place(x, cutoff)
        if len(self.pool) >= self.N:
            self.form_balls()
        self.attach()
        self.form_macros(self.n_micro)
        self.split_macros()
        self.drop_macros(self.n_micro)

    def expire(self, cutoff: int) -> None:
        """Old points go; balls with under N points dissolve into the pool."""
        kept = []
        for ball in self.balls:
            ball.expire(cutoff)
            if len(ball) >= self.N:
                kept.append(ball)
            else:
                if ball.times:
                    self.pool += zip(ball.times, ball.points)
                    self.pool_version += 1
                ball.macro = -1
        self.balls = kept

    def nearest(self, x: np.ndarray) -> tuple[Ball | None, float]:
        if not self.balls:
            return None, np.inf
        d = np.sqrt(((np.array([b.center for b in self.balls]) - x) ** 2).sum(axis=1))
        i = int(d.argmin())
        return self.balls[i], float(d[i])

    def place(self, x: np.ndarray, cutoff: int) -> None:
        """Into the nearest ball if that holds the point, else into the pool, which loses old points only then."""
        ball, d = self.nearest(x)
        if ball is not None and d <= ball.radius:
            ball.add(self.t, x)
        else:
            self.pool = [p for p in [*self.pool, (self.t, x)] if p[0] > cutoff]
            self.pool_version += 1

    def form_balls(self) -> None:
        if len(self.pool) < self.N or self.tried == self.pool_version:
            return  # the same pool gave no more balls the last time
        x = np.array([p for _, p in self.pool])
        radius = shared_radius_of(x, min(self.snn_k, len(x) - 1), self.r_max, self.tk, self.mk)
        allowed = hashed_near(x, self.n_tables, self.n_hashes) if self.backend == "lsh" and len(x) >= 4 else None
        taken = np.zeros(len(x), bool)
        for own in cover(x, radius, self.N, allowed):
            ball = Ball(self.next_ball, radius)
            self.next_ball += 1
            ball.fill([self.pool[i][0] for i in own], x[own])
            self.balls.append(ball)
            taken[own] = True
        if taken.any():
            self.pool = [p for p, used in zip(self.pool, taken) if not used]
            self.pool_version += 1
        else:
            self.tried = self.pool_version

    def attach(self) -> None:
        """Free balls join the macro of the nearest assigned ball within twice its radius."""
        held = [b for b in self.balls if b.macro >= 0]
        free = [b for b in self.balls if b.macro < 0]
        if not self.macros or not held or not free:
            return
        d = distances(np.array([b.center for b in free]), np.array([b.center for b in held]))
        for ball, row in zip(free, d):
            i = int(row.argmin())
            if row[i] <= 2 * held[i].radius:
                ball.macro = held[i].macro
                self.macros.setdefault(ball.macro, []).append(ball)

    def _groups(self, balls: list[Ball]) -> list[list[Ball]]:
        key = tuple((b.id, b.version) for b in balls)
        labels = self.known.get(key)
        if labels is None:
            labels = tight_groups(np.array([b.center for b in balls]), self.k, self.alpha)
        self.used[key] = labels
        return [[b for b, v in zip(balls, labels) if v == g] for g in range(labels.max(initial=-1) + 1)]

    def _found(self, balls: list[Ball]) -> int:
        macro = self.next_macro
        self.next_macro += 1
        return macro

    def form_macros(self, n_micro: int) -> None:
        free = [b for b in self.balls if b.macro == -1]
        if len(free) < n_micro or not free:
            return
        for group in self._groups(free):
            if len(group) >= n_micro:
                macro = self._found(group)
                self.macros[macro] = group
                for b in group:
                    b.macro = macro

    def split_macros(self) -> None:
        """Each macro keeps its largest component; others of enough balls become macros, the rest is free again."""
        self.known, self.used = {**self.known, **self.used}, {}
        alive = set(map(id, self.balls))
        gone: list[int] = []
        new: dict[int, list[Ball]] = {}
        for macro, listed in list(self.macros.items()):
            balls = [b for b in listed if id(b) in alive and b.macro == macro]
            groups = self._groups(balls) if len(balls) >= self.n_micro else []
            best = max(groups, key=len, default=[])
            if len(best) < self.n_micro:
                gone.append(macro)
                continue
            for b in balls:
                b.macro = -1
            for b in best:
                b.macro = macro
            self.macros[macro] = best
            for group in groups:
                if group is not best and len(group) >= self.n_micro:
                    new[self._found(group)] = group
        for macro in gone:
            for b in self.macros.pop(macro):
                if b.macro == macro:
                    b.macro = -1
        for macro, group in new.items():
            self.macros[macro] = group
            for b in group:
                b.macro = macro
        self.known = self.used

    def drop_macros(self, n_micro: int) -> None:
        alive = set(map(id, self.balls))
        for macro, listed in list(self.macros.items()):
            live = [b for b in listed if id(b) in alive and b.macro == macro]
            if len(live) < n_micro:
                for b in live:
                    b.macro = -1
                del self.macros[macro]
            else:
                self.macros[macro] = live

    # reading ---------------------------------------------------------------------------------------------------------

    def fit(self, xs) -> "StreamClusterer":
        for x in xs:
            self.update(x)
        return self

    def labels(self, xs) -> np.ndarray:
        """Macro of the nearest ball if that holds the point and has one, else -1."""
        xs = np.asarray(xs, float)
        out = np.full(len(xs), -1, np.int64)
        if self.balls and len(xs):
            d = distances(xs, np.array([b.center for b in self.balls]))
            at = d.argmin(axis=1)
            radius, macro = np.array([b.radius for b in self.balls]), np.array([b.macro for b in self.balls])
            held = d[np.arange(len(xs)), at] <= radius[at]
            out[held] = np.maximum(macro[at[held]], -1)
        return out

    def surprise(self, x) -> float:
        """Distance to the nearest centre in radii; 0 without balls."""
        ball, d = self.nearest(np.asarray(x, float))
        return 0.0 if ball is None else d / max(ball.radius, 1e-6)

    def pending_ratio(self, window: int) -> float:
        return len(self.pool) / max(1, window)

    def events(self) -> list[dict]:
        """Drift events since the last call; this clusterer has none."""
        return []
