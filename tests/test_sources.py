"""The ten streams against a second generator: the Mersenne Twister of the standard library, with draws written out by hand."""

import math
import random

import numpy as np
import pytest

from driftweave.sources import streams


class Draws:
    """The legacy generator's numbers from 32-bit words: masked rejection, 53-bit doubles, polar normals, inverted exponentials."""

    def __init__(self, seed):
        state = [seed & 0xFFFFFFFF]
        for i in range(1, 624):
            state.append((1812433253 * (state[-1] ^ state[-1] >> 30) + i) & 0xFFFFFFFF)
        self.source = random.Random()
        self.source.setstate((3, (*state, 624), None))
        self.spare = None

    def integer(self, n):
        mask = (1 << (n - 1).bit_length()) - 1
        if n == 1:
            return 0
        while (v := self.source.getrandbits(32) & mask) >= n:
            pass
        return v

    def uniform(self, a=0.0, b=1.0):
        return a + (b - a) * self.source.random()

    def gauss(self):
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        while True:
            x, y = 2 * self.source.random() - 1, 2 * self.source.random() - 1
            r = x * x + y * y
            if 0 < r < 1:
                f = math.sqrt(-2 * math.log(r) / r)
                self.spare = f * x
                return f * y

    def normal(self, center, spread):
        return [c + spread * self.gauss() for c in center]

    def weights(self, n):
        draws = [-math.log(1.0 - self.source.random()) for _ in range(n)]
        return [d / sum(draws) for d in draws]

    def pick(self, weights):
        u, total = self.source.random(), 0.0
        for i, w in enumerate(weights):
            total += w / sum(weights)
            if u < total:
                return i
        return len(weights) - 1


def clip(points, lo, hi):
    return [[min(hi, max(lo, v)) for v in p] for p in points]


def turned(p, a):
    return [math.cos(a) * p[0] - math.sin(a) * p[1], math.sin(a) * p[0] + math.cos(a) * p[1]]


def regimes(*parts):
    """(first index as a function of n, centres, spread)"""

    def stream(d, n):
        for i in range(n):
            _, centers, spread = [p for p in parts if p[0](n) <= i][-1]
            k = d.integer(len(centers))
            yield d.normal(centers[k], spread), k

    return stream


def gradual(d, n):
    base, off, size = [(0.20, 0.25), (0.75, 0.25), (0.45, 0.75)], [(0.04, 0.02), (-0.03, 0.05), (0.02, -0.04)], [(0.02, 0.015), (0.015, 0.02), (0.018, 0.016)]
    for i in range(n):
        part = i // (n // 4)
        sign = 0 if part == 0 else -1 if part % 2 else 1
        a = 2 * math.pi * i / n
        wave = [(math.sin(a), math.cos(a)), (math.cos(a), math.sin(a)), (math.sin(a + 1.2), math.cos(a + 0.6))]
        k = d.integer(3)
        yield d.normal([base[k][c] + sign * off[k][c] + size[k][c] * wave[k][c] for c in (0, 1)], 0.05), k


def births(d, n):
    centers = [[d.uniform(0.12, 0.88) for _ in (0, 1)] for _ in range(7)]
    active, weights, since = [0, 1, 2], d.weights(3), None
    for i in range(n):
        if i and i % (n // 4) == 0:
            active.pop(d.integer(3))
            while (new := d.integer(7)) in active:
                pass
            active.append(new)
            weights, since = d.weights(3), i
        k = active[d.pick(weights)]
        fresh = since is not None and i < since + 120
        if fresh and d.uniform() < 0.18:
            yield [d.uniform(), d.uniform()], k
        else:
            yield d.normal(centers[k], 0.085 if fresh else 0.05), k


def modes(d, n):
    centers, pairs = [(0.18, 0.22), (0.42, 0.74), (0.72, 0.20), (0.80, 0.76)], [(0, 1), (2, 3), (0, 3), (1, 2)]
    for i in range(n):
        k = pairs[i // (n // 4) % 4][0 if d.uniform() < 0.55 else 1]
        yield d.normal(centers[k], 0.052), k


def densities(d, n):
    centers, spreads, angle = [[0.18, 0.18], [0.82, 0.24], [0.50, 0.78]], [0.03, 0.06, 0.09], 0.0
    for i in range(n):
        if i and i % (n // 4) == 0:
            angle += math.pi / 5
            spreads = spreads[-1:] + spreads[:-1]
            centers = clip([[v + 0.04 * d.gauss() for v in c] for c in centers], 0.06, 0.94)
        k = d.integer(3)
        turn = np.array([turned((1, 0), angle), turned((0, 1), angle)]).T
        cov = turn @ np.diag([spreads[k] ** 2, (1.6 * spreads[k]) ** 2]) @ turn.T
        z = [d.gauss(), d.gauss()]
        _, s, v = np.linalg.svd(cov)
        yield [centers[k][c] + sum(z[j] * math.sqrt(s[j]) * v[j][c] for j in (0, 1)) for c in (0, 1)], k


def moons(d, n):
    for i in range(n):
        k, t = d.integer(2), d.uniform(0, math.pi)
        p = (0.3 * math.cos(t) + 0.5, 0.3 * math.sin(t) + 0.5) if k == 0 else (0.3 * (1 - math.cos(t)) + 0.35, 0.3 * (0.5 - math.sin(t)) + 0.35)
        q = turned((p[0] - 0.5, p[1] - 0.5), math.pi / 3 * (i // (n // 4)))
        yield [v + 0.5 + 0.025 * d.gauss() for v in q], k


def speeds(d, n):
    centers = [[0.25, 0.25], [0.75, 0.25], [0.5, 0.75]]
    for i in range(n):
        centers = clip([[v + 0.0003 * d.gauss() for v in c] for c in centers], 0.05, 0.95)
        if i in (n // 3, 2 * n // 3):
            signs = [[(-1, 1)[d.integer(2)] for _ in c] for c in centers]
            sizes = [[d.uniform(0.08, 0.15) for _ in c] for c in centers]
            centers = clip([[v + s * z for v, s, z in zip(*row)] for row in zip(centers, signs, sizes)], 0.05, 0.95)
        k = d.integer(3)
        yield d.normal(centers[k], 0.05), k


def dimensions(d, n):
    centers = [[0.3, 0.3], [0.7, 0.3], [0.5, 0.75]]
    steps = {n // 4: (0.0, 1.0), n // 2: (0.707, 0.707), 3 * n // 4: (-0.707, 0.707)}
    for i in range(n):
        if i in steps:
            centers = clip([[v + 0.18 * s for v, s in zip(c, steps[i])] for c in centers], 0.05, 0.95)
        k = d.integer(3)
        yield d.normal(centers[k], 0.055), k


SECOND = {
    "AbruptShift": regimes(
        (lambda n: 0, [(0.2, 0.2), (0.8, 0.2), (0.5, 0.8)], 0.055), (lambda n: n // 4, [(0.8, 0.8), (0.2, 0.8), (0.5, 0.2)], 0.055),
        (lambda n: n // 4 * 2, [(0.1, 0.5), (0.9, 0.5), (0.5, 0.1)], 0.055), (lambda n: n // 4 * 3, [(0.3, 0.7), (0.7, 0.3), (0.5, 0.5)], 0.055),
    ),
    "AbruptSplit": regimes((lambda n: 0, [(0.25, 0.5), (0.75, 0.5)], 0.07), (lambda n: n // 2, [(0.25, 0.5), (0.65, 0.3), (0.85, 0.7)], 0.06)),
    "AbruptMerge": regimes((lambda n: 0, [(0.2, 0.5), (0.8, 0.5), (0.5, 0.15)], 0.055), (lambda n: n // 2, [(0.5, 0.5), (0.5, 0.15)], 0.09)),
    "GradualRBF": gradual, "BirthDeath": births, "ReappearingModes": modes, "VariableDensity": densities, "RotatingMoons": moons, "SpeedVariant": speeds, "DimensionShift": dimensions,
}


@pytest.mark.parametrize("seed", [42, 20250])
@pytest.mark.parametrize("name", streams.DATASETS)
def test_stream_is_that_of_a_second_generator(name, seed):
    x, y, _ = streams.generate(name, seed, 2000)
    want = list(SECOND[name](Draws(seed), 2000))
    assert y.tolist() == [k for _, k in want]
    assert np.allclose(x, [p for p, _ in want], rtol=0, atol=1e-12)


@pytest.mark.parametrize("n", [2000, 5000])
def test_drifts_are_where_the_streams_change(n):
    quarters = [n // 4, n // 2, 3 * n // 4]
    want = {"AbruptSplit": [n // 2], "AbruptMerge": [n // 2], "SpeedVariant": [n // 3, 2 * n // 3]}
    for name in streams.DATASETS:
        assert streams.generate(name, 1, n)[2] == want.get(name, quarters)


def test_scalar_stream_draws():
    g = random.Random(42)
    rows = streams.scalar_stream(42)
    for i, segment, x in rows:
        center = {"stable": 0.0, "ABRUPT up": 6.0, "ABRUPT down": -3.0, "gradual": -3 + (i - 700) * 0.015, "ABRUPT final": 5.0}.get(segment)
        if center is None:
            u, v, w = g.gauss(0, 1), g.gauss(0, 1), g.gauss(0, 1)
            assert x == pytest.approx(0.7 * u / math.sqrt((v * v + w * w + g.gauss(0, 1) ** 2) / 3))
        else:
            assert x == g.gauss(center, 1)
    assert [sum(s == k for _, s, _ in rows) for k in ("stable", "ABRUPT up", "ABRUPT down", "gradual", "heavy-tail", "ABRUPT final")] == [300, 200, 200, 300, 100, 300]
