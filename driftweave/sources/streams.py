"""Labelled two-dimensional streams with drifts, as a Spark data source for batch and streaming reads.

    spark.read.format("drift_stream").option("dataset", "AbruptShift").option("seed", 42).option("n", 5000).load()

Options: dataset (names joined by commas, or `all`, or `full`), seed (numbers joined by commas), n, and table (`points` or
`drifts`). Each pair of dataset and seed is one partition: its numbers follow from one generator, drawn in a fixed order.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

POINTS = "stream string, seed int, idx long, x array<double>, y int"
DRIFTS = "stream string, seed int, drift_ord int, drift_idx long"
SEEDS, QUICK_SEEDS = (42, 314, 2718, 9001, 20250), (42, 314)
Points = Iterator[tuple[np.ndarray, int]]


def quarters(n: int) -> list[int]:
    return [n // 4 * i for i in (1, 2, 3)]


def _turns(n: int) -> Callable[[int], bool]:
    """Whether a regime begins at an index: at all multiples of a quarter but 0."""
    return lambda i: i > 0 and i % (n // 4) == 0


def _regimes(parts: list[tuple[int, list, float]]) -> Callable[[np.random.RandomState, int], Points]:
    """A stream of clusters that are replaced at given indices: (first index, centres, spread)."""

    def points(rs: np.random.RandomState, n: int) -> Points:
        starts = [int(f * n) if isinstance(f, float) else f for f, _, _ in parts]
        for i in range(n):
            at = max(k for k, s in enumerate(starts) if s <= i)
            _, centers, spread = parts[at]
            k = rs.randint(len(centers))
            yield rs.normal(centers[k], spread), k

    return points


def abrupt_shift(rs: np.random.RandomState, n: int) -> Points:
    # fixed values: the centres of four regimes
    centers = np.array([[[0.2, 0.2], [0.8, 0.2], [0.5, 0.8]], [[0.8, 0.8], [0.2, 0.8], [0.5, 0.2]], [[0.1, 0.5], [0.9, 0.5], [0.5, 0.1]], [[0.3, 0.7], [0.7, 0.3], [0.5, 0.5]]])
    yield from _regimes([(q, centers[r], 0.055) for r, q in enumerate([0, *quarters(n)])])(rs, n)


def abrupt_split(rs: np.random.RandomState, n: int) -> Points:
    yield from _regimes([(0, [[0.25, 0.5], [0.75, 0.5]], 0.07), (n // 2, [[0.25, 0.5], [0.65, 0.3], [0.85, 0.7]], 0.06)])(rs, n)


def abrupt_merge(rs: np.random.RandomState, n: int) -> Points:
    yield from _regimes([(0, [[0.2, 0.5], [0.8, 0.5], [0.5, 0.15]], 0.055), (n // 2, [[0.5, 0.5], [0.5, 0.15]], 0.09)])(rs, n)


def gradual_rbf(rs: np.random.RandomState, n: int) -> Points:
    """Centres on slow waves, with an offset that changes its sign at each turn; the first regime has none."""
    base = np.array([[0.20, 0.25], [0.75, 0.25], [0.45, 0.75]])
    offset = np.array([[0.04, 0.02], [-0.03, 0.05], [0.02, -0.04]])
    size = np.array([[0.02, 0.015], [0.015, 0.02], [0.018, 0.016]])
    turn, sign = _turns(n), 0.0
    for i in range(n):
        if turn(i):
            sign = -1.0 if sign >= 0 else 1.0
        a = 2.0 * np.pi * (i / max(n, 1))
        wave = np.array([[np.sin(a), np.cos(a)], [np.cos(a), np.sin(a)], [np.sin(a + 1.2), np.cos(a + 0.6)]])
        k = rs.randint(3)
        yield rs.normal((base + sign * offset + size * wave)[k], 0.05), k


def birth_death(rs: np.random.RandomState, n: int) -> Points:
    """Three of seven centres are active; at a turn one goes and another comes, and 120 noisy points follow."""
    centers = rs.uniform(0.12, 0.88, (7, 2))
    active, weights, calm, turn = [0, 1, 2], rs.dirichlet(np.ones(3)), 0, _turns(n)
    for i in range(n):
        if turn(i):
            active.remove(int(rs.choice(active)))
            new = int(rs.randint(7))
            while new in active:
                new = int(rs.randint(7))
            active.append(new)
            weights, calm = rs.dirichlet(np.ones(3)), i + 120
        k = active[int(rs.choice(3, p=weights))]
        if i < calm and rs.rand() < 0.18:
            yield rs.uniform(0, 1, 2), k
        else:
            yield rs.normal(centers[k], 0.085 if i < calm else 0.05), k


def reappearing_modes(rs: np.random.RandomState, n: int) -> Points:
    centers = np.array([[0.18, 0.22], [0.42, 0.74], [0.72, 0.20], [0.80, 0.76]])
    pairs, at, turn = [(0, 1), (2, 3), (0, 3), (1, 2)], 0, _turns(n)
    for i in range(n):
        at += turn(i)
        k = pairs[at % 4][int(rs.rand() >= 0.55)]
        yield rs.normal(centers[k], 0.052), k


def variable_density(rs: np.random.RandomState, n: int) -> Points:
    """Long clusters that turn, swap their spreads and move a little."""
    centers, spreads, angle, turn = np.array([[0.18, 0.18], [0.82, 0.24], [0.50, 0.78]]), [0.03, 0.06, 0.09], 0.0, _turns(n)
    for i in range(n):
        if turn(i):
            angle += np.pi / 5.0
            spreads = [spreads[-1], *spreads[:-1]]
            centers = np.clip(centers + rs.normal(0, 0.04, (3, 2)), 0.06, 0.94)
        k = rs.randint(3)
        axes = _rotation(angle)
        yield rs.multivariate_normal(centers[k], axes @ np.diag([spreads[k] ** 2, (1.6 * spreads[k]) ** 2]) @ axes.T), k


def _rotation(angle: float) -> np.ndarray:
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[c, -s], [s, c]])


def rotating_moons(rs: np.random.RandomState, n: int) -> Points:
    angle, turn = 0.0, _turns(n)
    for i in range(n):
        if turn(i):
            angle += np.pi / 3.0
        k = rs.randint(2)
        t = rs.uniform(0, np.pi)
        upper = np.array([np.cos(t), np.sin(t)]) * 0.3 + 0.5
        lower = np.array([1 - np.cos(t), 0.5 - np.sin(t)]) * 0.3 + 0.35
        yield _rotation(angle) @ ((lower if k else upper) - 0.5) + 0.5 + rs.normal(0, 0.025, 2), k


def speed_variant(rs: np.random.RandomState, n: int) -> Points:
    """Centres on a slow random walk, which jump at each third."""
    centers, jumps = np.array([[0.25, 0.25], [0.75, 0.25], [0.5, 0.75]]), (n // 3, 2 * n // 3)
    for i in range(n):
        centers = np.clip(centers + rs.normal(0, 0.0003, (3, 2)), 0.05, 0.95)
        if i in jumps:
            centers = np.clip(centers + rs.choice([-1, 1], (3, 2)) * rs.uniform(0.08, 0.15, (3, 2)), 0.05, 0.95)
        k = rs.randint(3)
        yield rs.normal(centers[k], 0.05), k


def dimension_shift(rs: np.random.RandomState, n: int) -> Points:
    """Centres move along another direction at each drift."""
    centers, steps = np.array([[0.3, 0.3], [0.7, 0.3], [0.5, 0.75]]), iter([(0.0, 1.0), (0.707, 0.707), (-0.707, 0.707)])
    for i in range(n):
        if i in (n // 4, n // 2, 3 * n // 4):
            centers = np.clip(centers + 0.18 * np.array(next(steps)), 0.05, 0.95)
        k = rs.randint(3)
        yield rs.normal(centers[k], 0.055), k


#: Name, points, and where the drifts are.
DATASETS: dict[str, tuple[Callable[[np.random.RandomState, int], Points], Callable[[int], list[int]]]] = {
    "AbruptShift": (abrupt_shift, quarters),
    "AbruptSplit": (abrupt_split, lambda n: [n // 2]),
    "AbruptMerge": (abrupt_merge, lambda n: [n // 2]),
    "GradualRBF": (gradual_rbf, quarters),
    "BirthDeath": (birth_death, quarters),
    "ReappearingModes": (reappearing_modes, quarters),
    "VariableDensity": (variable_density, quarters),
    "RotatingMoons": (rotating_moons, quarters),
    "SpeedVariant": (speed_variant, lambda n: [n // 3, 2 * n // 3]),
    "DimensionShift": (dimension_shift, lambda n: [n // 4, n // 2, 3 * n // 4]),
}
#: The usual benchmark's datasets, and those of the comparison.
ALL = [k for k in DATASETS if k not in ("AbruptShift", "DimensionShift")]
FULL = [k for k in DATASETS if k != "DimensionShift"]


def generate(name: str, seed: int, n: int = 5000) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """x (n x 2), y, and the indices of the drifts."""
    points, drifts = DATASETS[name]
    rows = list(points(np.random.RandomState(seed), n))
    return np.array([x for x, _ in rows]).reshape(len(rows), -1), np.array([y for _, y in rows], int), drifts(n)


def scalar_stream(seed: int = 42) -> list[tuple[int, str, float]]:
    """step, segment, x: 1,400 numbers with three abrupt changes, a gradual one and a heavy tail."""
    rnd = random.Random(seed)
    g = rnd.gauss

    def tail() -> float:
        u, v, w = g(0, 1), g(0, 1), g(0, 1)
        return u / math.sqrt((v**2 + w**2 + g(0, 1) ** 2) / 3) * 0.7

    kinds = [(300, "stable", lambda i: g(0, 1)), (500, "ABRUPT up", lambda i: g(6, 1)), (700, "ABRUPT down", lambda i: g(-3, 1)), (1000, "gradual", lambda i: g(-3 + (i - 700) * 0.015, 1)), (1100, "heavy-tail", lambda i: tail()), (1400, "ABRUPT final", lambda i: g(5, 1))]
    out = []
    for i in range(1, 1401):
        segment, draw = next((s, f) for last, s, f in kinds if i <= last)
        out.append((i, segment, draw(i)))
    return out


class _Run(InputPartition):
    def __init__(self, name: str, seed: int):
        super().__init__((name, seed))
        self.name, self.seed = name, seed


def _options(options: dict) -> tuple[list[str], list[int], int, str]:
    names = options.get("dataset", "all")
    chosen = {"all": ALL, "full": FULL}.get(names) or [x.strip() for x in names.split(",")]
    if unknown := [x for x in chosen if x not in DATASETS]:
        raise ValueError(f"unknown datasets: {', '.join(unknown)}")
    return chosen, [int(x) for x in options.get("seed", "42").split(",")], int(options.get("n", 5000)), options.get("table", "points")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.names, self.seeds, self.n, self.table = _options(options)

    def partitions(self) -> list[InputPartition]:
        return [_Run(name, seed) for name in self.names for seed in self.seeds]

    def read(self, partition: _Run) -> Iterator[tuple]:
        points, drifts = DATASETS[partition.name]
        if self.table == "drifts":
            yield from ((partition.name, partition.seed, k, i) for k, i in enumerate(drifts(self.n)))
        else:
            for i, (x, y) in enumerate(points(np.random.RandomState(partition.seed), self.n)):
                yield partition.name, partition.seed, i, [float(v) for v in x], int(y)


class _StreamReader(SimpleDataSourceStreamReader):
    """Gives each stream's next `rows_per_batch` points (1,000 by default) in every batch."""

    def __init__(self, options: dict):
        self.names, self.seeds, self.n, _ = _options(options)
        self.step = int(options.get("rows_per_batch", 1000))

    def initialOffset(self) -> dict:
        return {"idx": 0}

    def _rows(self, start: int, end: int) -> Iterator[tuple]:
        for name in self.names:
            for seed in self.seeds:
                for i, (x, y) in enumerate(DATASETS[name][0](np.random.RandomState(seed), self.n)):
                    if i >= end:
                        break
                    if i >= start:
                        yield name, seed, i, [float(v) for v in x], int(y)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(self.n, start["idx"] + self.step)
        return iter(list(self._rows(start["idx"], end))), {"idx": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self._rows(start["idx"], end["idx"])))

    def commit(self, end: dict) -> None:
        pass


class DriftStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "drift_stream"

    def schema(self) -> str:
        return DRIFTS if self.options.get("table") == "drifts" else POINTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DriftStream)
