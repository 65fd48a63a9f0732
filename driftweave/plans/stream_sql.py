"""SQL for DuckDB that draws the synthetic streams from a Mersenne Twister of its own: an independent form to compare with.

`words` has the generator's 32-bit numbers in order. A look-up table tells for every place the next one at which a draw
succeeds: a pair of doubles inside the unit circle (normals), or a number below a bound after masking. A recursive query
then walks from draw to draw, as streams use numbers in an order that depends on what they drew before.
"""

from __future__ import annotations

import math

import numpy as np


def _draws(seed: int, words: int) -> str:
    """CTEs up to `a`, one row of lists by place: v (word), d (double), pp (next pair of normals), g0, g1 (these), p3 (next number below 3 of two bits)."""
    y = "((s[j] & 2147483648) | (s[j + 1] & 2147483647))"
    following = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"""
    seeded AS (SELECT 0 AS i, {seed}::BIGINT AS v UNION ALL SELECT i + 1, (1812433253 * xor(v, v >> 30) + i + 1) & 4294967295 FROM seeded WHERE i < 623),
    twisted AS (
        SELECT 0 AS k, list(v ORDER BY i) AS s, []::BIGINT[] AS new FROM seeded
        UNION ALL SELECT k + 1, list_concat(s[228:], new2), new2 FROM (SELECT k, s, list_transform(range(1, 228), lambda j: xor(s[j + 397], xor({y} >> 1, ({y} & 1) * 2567483615))) AS new2 FROM twisted WHERE k < {words // 227 + 1})
    ),
    raw AS (SELECT (k - 1) * 227 + unnest(range(0, 227)) AS p, unnest(new) AS v FROM twisted WHERE k > 0),
    t1 AS (SELECT p, xor(v, v >> 11) AS v FROM raw), t2 AS (SELECT p, xor(v, (v << 7) & 2636928640) AS v FROM t1), t3 AS (SELECT p, xor(v, (v << 15) & 4022730752) AS v FROM t2),
    words AS (SELECT p, xor(v, v >> 18) AS v FROM t3),
    doubles AS (SELECT p, v, ((v >> 5) * 67108864 + (lead(v) OVER (ORDER BY p) >> 6))::DOUBLE / 9007199254740992.0::DOUBLE AS d FROM words),
    pairs AS (SELECT p, v, d, 2.0::DOUBLE * d - 1.0 AS x, 2.0::DOUBLE * lead(d, 2) OVER (ORDER BY p) - 1.0 AS y FROM doubles),
    circle AS (SELECT *, CASE WHEN x * x + y * y < 1 AND x * x + y * y <> 0 THEN sqrt(-2.0::DOUBLE * ln(x * x + y * y) / (x * x + y * y)) END AS f FROM pairs),
    places AS (SELECT p, v, d, f * y AS g0, f * x AS g1, min(CASE WHEN f IS NOT NULL THEN p END) OVER (PARTITION BY p % 4 ORDER BY p {following}) AS pp, min(CASE WHEN v & 3 < 3 THEN p END) OVER (ORDER BY p {following}) AS p3 FROM circle),
    a AS (SELECT {', '.join(f'list({c} ORDER BY p) AS {c[:2]}' for c in ('v', 'd', 'pp::INT', 'p3::INT', 'g0', 'g1'))} FROM places)"""


def _walk(first: str, label: str) -> str:
    """CTE `w`: for each point i the place q of its label's number and s of its normals; a point's draws begin at p."""
    return f"""w AS (
        SELECT -1::BIGINT AS i, 0::BIGINT AS q, {first}::BIGINT - 4 AS s
        UNION ALL SELECT i, q, a.pp[q + 2] FROM (SELECT w.i + 1 AS i, {label} AS q FROM (SELECT i, s + 4 AS p FROM w) w, a WHERE w.i < {{n}} - 1) w, a
    )"""


def _centers(rows: list[tuple[int, int, float, float]]) -> str:
    """CTE `c` of (regime, k, cx, cy)."""
    return "c AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {k}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for r, k, x, y in rows) + ") AS c(r, k, cx, cy))"


def _points(name: str, seed: int, n: int, ctes: list[str], body: str, words: int) -> str:
    """`body` has i, k, x and y of each point."""
    return f"WITH RECURSIVE {_draws(seed, words)}, {', '.join(c.replace('{n}', str(n)) for c in ctes)} SELECT '{name}' AS stream, {seed}::INT AS seed, i AS idx, round(x, 9) AS x0, round(y, 9) AS x1, k::INT AS y FROM ({body})"


_LABEL3, _LABEL2 = "a.p3[w.p + 1]", "w.p"


def _clusters(regime: str, spread: str, centers: list[tuple[int, int, float, float]], two: str = "false") -> tuple[list[str], str]:
    """Points around centres by regime (an expression of i); `two` tells where there are two clusters, which need no rejection."""
    ctes = [_walk("0", f"CASE WHEN {two.replace('i ', 'w.i + 1 ')} THEN {_LABEL2} ELSE {_LABEL3} END"), _centers(centers)]
    return ctes, f"SELECT i, m.k, cx + ({spread}) * a.g0[s + 1] AS x, cy + ({spread}) * a.g1[s + 1] AS y FROM (SELECT i, s, {regime} AS r, CASE WHEN {two} THEN a.v[q + 1] & 1 ELSE a.v[q + 1] & 3 END AS k FROM w, a WHERE i >= 0) m JOIN c ON c.r = m.r AND c.k = m.k, a"


def stream(name: str, seed: int = 42, n: int = 5000) -> str:
    """stream, seed, idx, x0, x1, y of a stream, coordinates rounded to nine decimals."""
    quarter = f"(i // {n // 4})"
    flat = lambda parts: [(r, k, x, y) for r, own in enumerate(parts) for k, (x, y) in enumerate(own)]
    few, many = 9 * n + 2000, 25 * n + 2000
    if name == "AbruptShift":
        parts = [[(0.2, 0.2), (0.8, 0.2), (0.5, 0.8)], [(0.8, 0.8), (0.2, 0.8), (0.5, 0.2)], [(0.1, 0.5), (0.9, 0.5), (0.5, 0.1)], [(0.3, 0.7), (0.7, 0.3), (0.5, 0.5)]]
        return _points(name, seed, n, *_clusters(quarter, "0.055", flat(parts)), few)
    if name == "AbruptSplit":
        ctes, body = _clusters(f"(i // {n // 2})", f"CASE WHEN i < {n // 2} THEN 0.07::DOUBLE ELSE 0.06::DOUBLE END", flat([[(0.25, 0.5), (0.75, 0.5)], [(0.25, 0.5), (0.65, 0.3), (0.85, 0.7)]]), f"i < {n // 2}")
        return _points(name, seed, n, ctes, body, few)
    if name == "AbruptMerge":
        ctes, body = _clusters(f"(i // {n // 2})", f"CASE WHEN i < {n // 2} THEN 0.055::DOUBLE ELSE 0.09::DOUBLE END", flat([[(0.2, 0.5), (0.8, 0.5), (0.5, 0.15)], [(0.5, 0.5), (0.5, 0.15)]]), f"i >= {n // 2}")
        return _points(name, seed, n, ctes, body, few)
    if name == "DimensionShift":
        parts, own = [], [(0.3, 0.3), (0.7, 0.3), (0.5, 0.75)]
        for dx, dy in ((0.0, 0.0), (0.0, 1.0), (0.707, 0.707), (-0.707, 0.707)):
            own = [tuple(min(0.95, max(0.05, v + 0.18 * d)) for v, d in zip(c, (dx, dy))) for c in own]
            parts.append(own)
        regime = f"((i >= {n // 4})::INT + (i >= {n // 2})::INT + (i >= {3 * n // 4})::INT)"
        return _points(name, seed, n, *_clusters(regime, "0.055", flat(parts)), few)
    if name == "GradualRBF":
        rows = "(0, 0.20, 0.25, 0.04, 0.02, 0.02, 0.015), (1, 0.75, 0.25, -0.03, 0.05, 0.015, 0.02), (2, 0.45, 0.75, 0.02, -0.04, 0.018, 0.016)"
        table = f"c AS (SELECT k, bx::DOUBLE AS bx, by_::DOUBLE AS by_, ox::DOUBLE AS ox, oy::DOUBLE AS oy, sx::DOUBLE AS sx, sy::DOUBLE AS sy FROM (VALUES {rows}) AS c(k, bx, by_, ox, oy, sx, sy))"
        angle, turn = f"(2 * pi() * i / {n})", f"CASE WHEN {quarter} = 0 THEN 0 WHEN {quarter} % 2 = 1 THEN -1 ELSE 1 END"
        body = f"""SELECT i, k, bx + sign * ox + sx * CASE k WHEN 0 THEN sin(z) WHEN 1 THEN cos(z) ELSE sin(z + 1.2) END + 0.05::DOUBLE * a.g0[s + 1] AS x, by_ + sign * oy + sy * CASE k WHEN 0 THEN cos(z) WHEN 1 THEN sin(z) ELSE cos(z + 0.6) END + 0.05::DOUBLE * a.g1[s + 1] AS y
            FROM (SELECT i, s, a.v[q + 1] & 3 AS k, {angle} AS z, {turn} AS sign FROM w, a WHERE i >= 0) JOIN c USING (k), a"""
        return _points(name, seed, n, [_walk("0", _LABEL3), table], body, few)
    if name == "ReappearingModes":
        pairs, own = [(0, 1), (2, 3), (0, 3), (1, 2)], [(0.18, 0.22), (0.42, 0.74), (0.72, 0.20), (0.80, 0.76)]
        table = "c AS (SELECT * FROM (VALUES " + ", ".join(f"({r}, {side}, {k}, {own[k][0]!r}::DOUBLE, {own[k][1]!r}::DOUBLE)" for r, pair in enumerate(pairs) for side, k in enumerate(pair)) + ") AS c(r, side, k, cx, cy))"
        body = f"SELECT i, k, cx + 0.052::DOUBLE * a.g0[s + 1] AS x, cy + 0.052::DOUBLE * a.g1[s + 1] AS y FROM (SELECT i, s, {quarter} % 4 AS r, (a.d[q] >= 0.55)::INT AS side FROM w, a WHERE i >= 0) JOIN c USING (r, side), a"
        return _points(name, seed, n, [_walk("0", "w.p + 1"), table], body, few)  # a double has two words; the second one's place is q
    if name == "RotatingMoons":
        body = f"""SELECT i, k, cos(z) * px - sin(z) * py + 0.5 + 0.025::DOUBLE * a.g0[s + 1] AS x, sin(z) * px + cos(z) * py + 0.5 + 0.025::DOUBLE * a.g1[s + 1] AS y
            FROM (SELECT i, s, k, z, CASE k WHEN 0 THEN 0.3::DOUBLE * cos(t) ELSE 0.3::DOUBLE * (1 - cos(t)) + 0.35 - 0.5 END AS px, CASE k WHEN 0 THEN 0.3::DOUBLE * sin(t) ELSE 0.3::DOUBLE * (0.5 - sin(t)) + 0.35 - 0.5 END AS py
                FROM (SELECT i, s, a.v[q - 1] & 1 AS k, pi() * a.d[q] AS t, pi() / 3 * {quarter} AS z FROM w, a WHERE i >= 0)), a"""
        return _points(name, seed, n, [_walk("0", "w.p + 2")], body, few)  # a word for the label and two for the angle
    if name == "VariableDensity":
        # a number's spread and axes by regime; the axes' signs are those of the library's decomposition
        rows, spreads = [], [0.03, 0.06, 0.09]
        for r in range(4):
            c, s = math.cos(r * math.pi / 5), math.sin(r * math.pi / 5)
            turn = np.array([[c, -s], [s, c]])
            for k in range(3):
                _, size, v = np.linalg.svd(turn @ np.diag([spreads[k] ** 2, (1.6 * spreads[k]) ** 2]) @ turn.T)
                rows.append(f"({r}, {k}, " + ", ".join(f"{float(math.sqrt(size[j]) * v[j, d])!r}::DOUBLE" for j in (0, 1) for d in (0, 1)) + ")")
            spreads = [spreads[-1], *spreads[:-1]]
        table = f"axes AS (SELECT * FROM (VALUES {', '.join(rows)}) AS axes(r, k, ax, ay, bx, by_))"
        turning = f"w.i + 1 > 0 AND (w.i + 1) % {n // 4} = 0"
        first, second, third = "a.pp[w.p + 1]", "a.pp[a.pp[w.p + 1] + 5]", "a.pp[a.pp[a.pp[w.p + 1] + 5] + 5]"
        clip = lambda v: f"least(0.94::DOUBLE, greatest(0.06::DOUBLE, {v}))"
        moved = ", ".join(f"CASE WHEN {turning} THEN {clip(f'w.{c}{k} + 0.04::DOUBLE * a.g{d}[{where} + 1]')} ELSE w.{c}{k} END AS {c}{k}" for k, where in enumerate((first, second, third)) for d, c in enumerate("xy"))
        walk = f"""w AS (
            SELECT -1::BIGINT AS i, 0::BIGINT AS q, -4::BIGINT AS s, 0.18::DOUBLE AS x0, 0.18::DOUBLE AS y0, 0.82::DOUBLE AS x1, 0.24::DOUBLE AS y1, 0.50::DOUBLE AS x2, 0.78::DOUBLE AS y2
            UNION ALL SELECT i, q, a.pp[q + 2], x0, y0, x1, y1, x2, y2 FROM (SELECT w.i + 1 AS i, a.p3[CASE WHEN {turning} THEN {third} + 4 ELSE w.p END + 1] AS q, {moved} FROM (SELECT *, s + 4 AS p FROM w) w, a WHERE w.i < {n} - 1) w, a
        )"""
        body = f"SELECT i, k, CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END + a.g0[s + 1] * ax + a.g1[s + 1] * bx AS x, CASE k WHEN 0 THEN y0 WHEN 1 THEN y1 ELSE y2 END + a.g0[s + 1] * ay + a.g1[s + 1] * by_ AS y FROM (SELECT w.*, a.v[q + 1] & 3 AS k, {quarter} AS r FROM w, a WHERE i >= 0) JOIN axes USING (r, k), a"
        return _points(name, seed, n, [walk, table], body, few)
    if name == "SpeedVariant":
        clip = lambda v: f"least(0.95::DOUBLE, greatest(0.05::DOUBLE, {v}))"
        names = [f"{c}{k}" for k in range(3) for c in "xy"]
        jump = f"i IN ({n // 3}, {2 * n // 3})"
        # places first: of the walk's three pairs, of the label and of the point's normals; a jump takes 18 words in between
        walk = f"""w AS (
            SELECT -1::BIGINT AS i, 0::INT AS n0, 0::INT AS n1, 0::INT AS n2, 0::INT AS q, -4::INT AS s
            UNION ALL SELECT i, n0, n1, n2, q, a.pp[q + 2] FROM (
                SELECT i, n0, n1, a.pp[n1 + 5] AS n2, a.p3[a.pp[n1 + 5] + CASE WHEN {jump} THEN 23 ELSE 5 END] AS q FROM (
                    SELECT w.i + 1 AS i, a.pp[w.s + 5] AS n0, a.pp[a.pp[w.s + 5] + 5] AS n1 FROM w, a WHERE w.i < {n} - 1
                ) w, a
            ) w, a
        )"""
        moves = ", ".join(f"0.0003::DOUBLE * a.g{d}[n{k} + 1] AS m{c}{k}" for k in range(3) for d, c in enumerate("xy"))
        # six words of signs and twelve of sizes, row by row
        jumps = ", ".join(f"CASE WHEN {jump} THEN (2 * (a.v[n2 + 4 + {m} + 1] & 1) - 1) * (0.08::DOUBLE + (0.15::DOUBLE - 0.08::DOUBLE) * a.d[n2 + 10 + {2 * m} + 1]) ELSE 0 END AS j{c}" for m, c in enumerate(names))
        steps = f"steps AS MATERIALIZED (SELECT i, q, s, {moves}, {jumps} FROM w, a WHERE i >= 0)"
        moved = ", ".join(f"{clip(clip(f'h.{c} + m{c}') + f' + j{c}')} AS {c}" for c in names)
        held = f"""held AS (
            SELECT -1::BIGINT AS i, 0::INT AS q, 0::INT AS s, 0.25::DOUBLE AS x0, 0.25::DOUBLE AS y0, 0.75::DOUBLE AS x1, 0.25::DOUBLE AS y1, 0.5::DOUBLE AS x2, 0.75::DOUBLE AS y2
            UNION ALL SELECT t.i, t.q, t.s, {moved} FROM held h JOIN steps t ON t.i = h.i + 1
        )"""
        body = "SELECT i, k, CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END + 0.05::DOUBLE * a.g0[s + 1] AS x, CASE k WHEN 0 THEN y0 WHEN 1 THEN y1 ELSE y2 END + 0.05::DOUBLE * a.g1[s + 1] AS y FROM (SELECT h.*, a.v[q + 1] & 3 AS k FROM held h, a WHERE i >= 0), a"
        return _points(name, seed, n, [walk, steps, held], body, many)
    if name == "BirthDeath":
        exp = lambda at: ", ".join(f"-ln(1 - a.d[{at} + {2 * k + 1}]) AS e{k}" for k in range(3))
        walk = f"""w AS (
            SELECT -1::BIGINT AS i, 34::BIGINT AS p, [0, 1, 2]::BIGINT[] AS act, e0 / (e0 + e1 + e2) AS c0, (e0 + e1) / (e0 + e1 + e2) AS c1, 0::BIGINT AS calm, 0::BIGINT AS k, 0::BIGINT AS s, false AS noisy FROM (SELECT {exp('28')} FROM a)
            UNION ALL SELECT i, s + 4, act, c0, c1, calm, k, s, noisy FROM (
                SELECT *, CASE WHEN noisy THEN from_ ELSE a.pp[from_ + 1] END AS s FROM (
                    SELECT *, i < calm AND a.d[at_ + 3] < 0.18 AS noisy, CASE WHEN i < calm THEN at_ + 4 ELSE at_ + 2 END AS from_, act[1 + (a.d[at_ + 1] >= c0)::INT + (a.d[at_ + 1] >= c1)::INT] AS k FROM (
                        SELECT i, CASE WHEN turn THEN list_append(act2, a.v[t1 + 1] & 7) ELSE act END AS act, CASE WHEN turn THEN e0 / (e0 + e1 + e2) ELSE c0 END AS c0, CASE WHEN turn THEN (e0 + e1) / (e0 + e1 + e2) ELSE c1 END AS c1, CASE WHEN turn THEN i + 120 ELSE calm END AS calm, CASE WHEN turn THEN t1 + 7 ELSE p END AS at_ FROM (
                            SELECT w.*, {exp('t1 + 1')} FROM (
                                SELECT w.*, CASE WHEN turn THEN list_filter(range(t0 + 1, t0 + 120), lambda j: a.v[j + 1] & 7 < 7 AND NOT list_contains(act2, a.v[j + 1] & 7))[1] END AS t1 FROM (
                                    SELECT w.*, CASE WHEN turn THEN list_filter(act, lambda z, j: j <> (a.v[t0 + 1] & 3) + 1) ELSE act END AS act2 FROM (
                                        SELECT w.i + 1 AS i, p, act, c0, c1, calm, a.p3[p + 1] AS t0, w.i + 1 > 0 AND (w.i + 1) % {n // 4} = 0 AS turn FROM w, a WHERE w.i < {n} - 1
                                    ) w, a
                                ) w, a
                            ) w, a
                        ) w, a
                    ) w, a
                ) w, a
            ) w
        )"""
        center = lambda c: f"0.12::DOUBLE + (0.88::DOUBLE - 0.12::DOUBLE) * a.d[4 * k + {2 * c + 1}]"
        spread = "CASE WHEN i < calm THEN 0.085::DOUBLE ELSE 0.05::DOUBLE END"
        body = f"SELECT i, k, CASE WHEN noisy THEN a.d[s + 1] ELSE {center(0)} + {spread} * a.g0[s + 1] END AS x, CASE WHEN noisy THEN a.d[s + 3] ELSE {center(1)} + {spread} * a.g1[s + 1] END AS y FROM w, a WHERE i >= 0"
        return _points(name, seed, n, [walk], body, few + 2 * n)
    raise KeyError(name)
