"""SQL for DuckDB that runs the state machines of `streaming` as recursive queries: an independent form to compare with.

Each step joins a stream's state with its next row. Lists hold what the state machines keep in windows.
"""

from __future__ import annotations

import math


def _slope(values: str) -> str:
    """Least-squares slope of a list over its places."""
    return f"(CASE WHEN len({values}) < 2 THEN 0.0::DOUBLE ELSE list_sum(list_transform({values}, lambda v, i: (i - 1 - (len({values}) - 1) / 2.0::DOUBLE) * v)) * 12.0::DOUBLE / (len({values}) * (len({values}) * len({values}) - 1.0::DOUBLE)) END)"


def _last(values: str, new: str, n: int) -> str:
    """A list with a new value, of which the last n stay."""
    return f"list_append({values}, {new})[greatest(1, len({values}) + 2 - {n}):]"


def detector(rows: str, key: str, x: str, k_lambda: float = 4.5, k_slope: float = 3.5, ema_alpha: float = 0.05, delta: float = 0.01, slope_window: int = 10, accel_window: int = 8, confirm_steps: int = 3, var_window: int = 50, adapt_window: int = 150, clip_sigma: float = 2.5, min_samples: int = 50, accel_floor: float = 0.12) -> str:
    """CTEs, the last of which is `det`: the change detector's snapshot after each row of `rows` (key, seq from 1, x)."""
    arms = {}
    for arm, sign in (("up", "z"), ("low", "-z")):
        arms[arm] = sign
    none = "[]::DOUBLE[]"
    d = lambda v: f"{v}::DOUBLE"
    heights = ", ".join(f"greatest(0, (CASE WHEN fired THEN 0 ELSE {a} END) + {s} - {d(delta)}) AS {a}2" for a, s in arms.items())
    paths = ", ".join(f"{_last(f'(CASE WHEN fired THEN {none} ELSE {a}_path END)', f'{a}2', slope_window)} AS {a}_path2" for a in arms)
    slopes = ", ".join(f"{_slope(f'{a}_path2')} AS {a}_slope" for a in arms)
    lists = ", ".join(f"{_last(f'{a}_slopes', f'{a}_slope', adapt_window)} AS {a}_slopes2, {_last(f'(CASE WHEN fired THEN {none} ELSE {a}_recent END)', f'{a}_slope', accel_window)} AS {a}_recent2" for a in arms)
    pick = lambda c: f"CASE WHEN rises THEN up_{c} ELSE low_{c} END"
    return f"""
    det AS (
        SELECT DISTINCT {key}, 0::BIGINT AS seq, NULL::DOUBLE AS mean, {none} AS vals, {none} AS heights, 0.0::DOUBLE AS up, {none} AS up_path, {none} AS up_slopes, {none} AS up_recent,
            0.0::DOUBLE AS low, {none} AS low_path, {none} AS low_slopes, {none} AS low_recent, 0 AS conf, false AS fired, 'none' AS direction, 0.0::DOUBLE AS score, 0.0::DOUBLE AS acceleration, 0.0::DOUBLE AS level, 0.0::DOUBLE AS lim
        FROM {rows}
        UNION ALL
        SELECT {key}, seq, mean2, vals2, heights2, up2, up_path2, up_slopes2, up_recent2, low2, low_path2, low_slopes2, low_recent2,
            CASE WHEN met THEN before + 1 ELSE 0 END, met AND before + 1 >= {confirm_steps}, CASE WHEN rises THEN 'up' ELSE 'down' END, score2, acceleration2, level2, lim2
        FROM (
            SELECT *, seq >= {min_samples} AND CASE WHEN rises THEN up2 ELSE low2 END > level2 AND score2 > lim2 AND acceleration2 > {d(accel_floor)} AS met FROM (
                SELECT *, CASE WHEN n < 5 THEN slope ELSE (slope - avg_slope) / (dev_slope + 1e-9::DOUBLE) END AS score2, CASE WHEN n < 10 THEN 2 * {d(k_slope)} ELSE avg_slope + {d(k_slope)} * dev_slope END AS lim2, abs({_slope('recent')}) AS acceleration2 FROM (
                    SELECT *, len(slopes) AS n, list_avg(slopes) AS avg_slope, coalesce(list_stddev_samp(slopes), 0) AS dev_slope FROM (
                        SELECT *, {pick('slope')} AS slope, {pick('slopes2')} AS slopes, {pick('recent2')} AS recent, CASE WHEN len(heights2) < 20 THEN 3 * {d(k_lambda)} ELSE {d(k_lambda)} * greatest(1.5::DOUBLE, list_stddev_samp(heights2)) END AS level2 FROM (
                            SELECT *, {lists}, {_last('heights', 'greatest(up2, low2)', adapt_window)} AS heights2, up_slope >= low_slope AS rises FROM (
                                SELECT *, {slopes} FROM (
                                    SELECT *, {paths} FROM (
                                        SELECT *, {heights} FROM (
                                            SELECT *, least(greatest((x - mu) / CASE WHEN len(vals2) < 4 THEN 1 ELSE greatest(1.4826::DOUBLE * list_sort(list_transform(vals2, lambda v: abs(v - list_median(vals2))))[len(vals2) // 2 + 1], 1e-6::DOUBLE) END, -{d(clip_sigma)}), {d(clip_sigma)}) AS z FROM (
                                                SELECT det.* EXCLUDE (seq), r.seq, r.{x} AS x, coalesce(mean, r.{x}) AS mu, {d(ema_alpha)} * r.{x} + (1.0::DOUBLE - {d(ema_alpha)}) * coalesce(mean, r.{x}) AS mean2, {_last('vals', f'r.{x}', var_window)} AS vals2, CASE WHEN fired THEN 0 ELSE conf END AS before
                                                FROM det JOIN {rows} r ON r.{key} = det.{key} AND r.seq = det.seq + 1
                                            )
                                        )
                                    )
                                )
                            )
                        )
                    )
                )
            )
        )
    )"""


#: The columns of the detector's snapshot, rounded as the query rounds them.
SNAPSHOT = "fired, seq AS n_samples, round(mean, 6) AS ema_mean, round(up, 6) AS \"U_t\", round(low, 6) AS \"L_t\", round(score, 6) AS abruptness_score, round(acceleration, 6) AS acceleration, conf::INT AS confirm_count, direction, round(level, 6) AS lambda_current, round(lim, 6) AS slope_thresh_current, fired AS drift_detected"

#: A point's distances to the centres (lists cx and cy) of prototypes, and the nearest one's place, 0 without any.
_NEAREST = "list_transform(list_zip({cx}, {cy}), lambda c: sqrt((c[1] - x) * (c[1] - x) + (c[2] - y) * (c[2] - y)))"


def _near(cx: str, cy: str) -> str:
    return _NEAREST.format(cx=cx, cy=cy)


def _put(values: str, at: str, new: str) -> str:
    """A list with another value at a place."""
    return f"list_transform({values}, lambda v, i: CASE WHEN i = {at} THEN {new} ELSE v END)"


def _keep(values: str, good: str) -> str:
    """The values of a list whose places (v of 1, 2, ...) are good."""
    return f"list_transform(list_filter(range(1, len({values}) + 1), lambda v: {good}), lambda v: {values}[v])"


#: Columns of a clusterer's row that these methods do not fill.
BLANK = "0.0::DOUBLE AS surprise, false AS fired, NULL::VARCHAR AS direction, NULL::DOUBLE AS score, NULL::DOUBLE AS acceleration, 0 AS pending"
_E = "[]::DOUBLE[]"


def _labelled(state: str, cx: str, cy: str, bound: float) -> str:
    """The rows of a clusterer's query from its states: the label is the nearest centre's place, -1 beyond the bound."""
    return f"""SELECT stream, seq, CASE WHEN len(d) > 0 AND list_min(d) <= {bound!r}::DOUBLE THEN list_position(d, list_min(d)) - 1 ELSE -1 END::BIGINT AS label, len(d)::INT AS n_micro, len(d)::INT AS n_macro, {BLANK}
    FROM (SELECT stream, seq, {_near(cx, cy)} AS d FROM {state} WHERE seq > 0 AND NOT busy)"""


def dbstream(rows: str, radius: float = 0.11, fading: float = 0.998, every: int = 100, least: float = 1.5, merge: float = 0.7) -> str:
    """States of the fading-prototype clusterer that merges close centres; a step with `busy` merges one pair and takes no point."""
    absorbed = f"(SELECT *, d <= {radius!r}::DOUBLE AS hit, 1.0::DOUBLE / greatest(w1[spot], 1.0::DOUBLE) AS rate FROM (SELECT *, list_min(ds) AS d, list_position(ds, list_min(ds)) AS spot FROM (SELECT m.stream, r.seq, r.x, r.y, cx, cy, list_transform(w, lambda v: v * {fading!r}::DOUBLE) AS w1, {_near('cx', 'cy')} AS ds FROM (SELECT * EXCLUDE (x, y) FROM m) m JOIN {rows} r ON r.stream = m.stream AND r.seq = m.seq + 1 WHERE NOT busy)))"
    moved = f"(SELECT stream, seq, x, y, CASE WHEN hit THEN {_put('cx', 'spot', '(1 - rate) * cx[spot] + rate * x')} ELSE list_append(cx, x) END AS cx, CASE WHEN hit THEN {_put('cy', 'spot', '(1 - rate) * cy[spot] + rate * y')} ELSE list_append(cy, y) END AS cy, CASE WHEN hit THEN {_put('w1', 'spot', 'v + 1.0')} ELSE list_append(w1, 1.0::DOUBLE) END AS w FROM {absorbed})"
    cleaned = f"SELECT stream, seq, x, y, CASE WHEN seq % {every} = 0 THEN {_keep('cx', f'w[v] >= {least!r}')} ELSE cx END AS cx, CASE WHEN seq % {every} = 0 THEN {_keep('cy', f'w[v] >= {least!r}')} ELSE cy END AS cy, CASE WHEN seq % {every} = 0 THEN {_keep('w', f'w[v] >= {least!r}')} ELSE w END AS w, seq % {every} = 0 AS busy FROM {moved}"
    close = f"list_filter(flatten(list_transform(range(1, len(cx) + 1), lambda i: list_transform(range(i + 1, len(cx) + 1), lambda j: [i, j]))), lambda p: sqrt((cx[p[1]] - cx[p[2]]) * (cx[p[1]] - cx[p[2]]) + (cy[p[1]] - cy[p[2]]) * (cy[p[1]] - cy[p[2]])) < {radius!r}::DOUBLE * {merge!r}::DOUBLE)"
    mean = lambda c: f"(w[p[1]] * {c}[p[1]] + w[p[2]] * {c}[p[2]]) / (w[p[1]] + w[p[2]])"
    one = lambda c, new: _keep(f"({_put(c, 'p[1]', new)})", "v <> p[2]")
    merged = f"SELECT stream, seq, x, y, CASE WHEN p IS NULL THEN cx ELSE {one('cx', mean('cx'))} END, CASE WHEN p IS NULL THEN cy ELSE {one('cy', mean('cy'))} END, CASE WHEN p IS NULL THEN w ELSE {one('w', 'w[p[1]] + w[p[2]]')} END, p IS NOT NULL FROM (SELECT *, ({close})[1] AS p FROM m WHERE busy)"
    return f"""m AS (
        SELECT DISTINCT stream, 0::BIGINT AS seq, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, {_E} AS cx, {_E} AS cy, {_E} AS w, false AS busy FROM {rows}
        UNION ALL (SELECT * FROM ({cleaned}) UNION ALL SELECT * FROM ({merged}))
    ) {_labelled('m', 'cx', 'cy', radius * 1.1)}"""


def adaptive_radius(rows: str, radius: float = 0.12, decay: float = 0.995, least: float = 0.35, most: int = 25, scale: float = 1.10, window: int = 500) -> str:
    """States of the clusterer with a bounded number of fading prototypes, of which the lightest gives way."""
    absorbed = f"(SELECT *, coalesce(d <= {radius!r}::DOUBLE, false) AS hit, 1.0::DOUBLE / greatest(w1[near], 1.0::DOUBLE) AS rate FROM (SELECT *, list_min(ds) AS d, list_position(ds, list_min(ds)) AS near FROM (SELECT m.stream, r.seq, r.x, r.y, cx, cy, list_transform(age, lambda v: v + 1) AS a1, list_transform(w, lambda v: v * {decay!r}::DOUBLE) AS w1, {_near('cx', 'cy')} AS ds FROM (SELECT * EXCLUDE (x, y) FROM m) m JOIN {rows} r ON r.stream = m.stream AND r.seq = m.seq + 1)))"
    placed = f"(SELECT *, CASE WHEN hit THEN near WHEN len(cx) < {most} THEN len(cx) + 1 ELSE list_position(w1, list_min(w1)) END AS spot, NOT hit AND len(cx) < {most} AS new FROM {absorbed})"
    put = lambda c, hit, fresh: f"CASE WHEN new THEN list_append({c}, {fresh}) WHEN hit THEN {_put(c, 'spot', hit)} ELSE {_put(c, 'spot', fresh)} END"
    moved = f"(SELECT stream, seq, x, y, {put('cx', '(1 - rate) * cx[spot] + rate * x', 'x')} AS cx, {put('cy', '(1 - rate) * cy[spot] + rate * y', 'y')} AS cy, {put('w1', 'v + 1.0', '1.0::DOUBLE')} AS w, CASE WHEN new THEN list_append(a1, 0::BIGINT) ELSE {_put('a1', 'spot', '0::BIGINT')} END AS age FROM {placed})"
    good = f"w[v] >= {least!r} OR age[v] <= {window}"
    kept = ", ".join(f"{_keep(c, good)} AS {c}" for c in ("cx", "cy", "w", "age"))
    return f"""m AS (
        SELECT DISTINCT stream, 0::BIGINT AS seq, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, {_E} AS cx, {_E} AS cy, {_E} AS w, []::BIGINT[] AS age, false AS busy FROM {rows}
        UNION ALL SELECT stream, seq, x, y, {kept}, false FROM {moved}
    ) {_labelled('m', 'cx', 'cy', radius * scale)}"""


def denstream(rows: str, eps: float = 0.11, mu: float = 2.0, beta: float = 0.5, lam: float = 0.1) -> str:
    """States of the clusterer with potential (p) and outlier (o) prototypes; those heavy enough are shown."""
    fade, strong = 2.0**-lam, beta * mu
    near = lambda k: f"{_near(f'{k}x', f'{k}y')} AS {k}d"
    faded = ", ".join(f"list_transform({k}w, lambda v: v * {fade!r}::DOUBLE) AS {k}w" for k in "po")
    step = f"(SELECT *, coalesce(list_min(pd) <= {eps!r}::DOUBLE, false) AS ph, list_position(pd, list_min(pd)) AS pa, coalesce(list_min(od) <= {eps!r}::DOUBLE, false) AND NOT coalesce(list_min(pd) <= {eps!r}::DOUBLE, false) AS oh, list_position(od, list_min(od)) AS oa FROM (SELECT m.stream, r.seq, r.x, r.y, px, py, ox, oy, {faded}, {near('p')}, {near('o')} FROM (SELECT * EXCLUDE (x, y) FROM m) m JOIN {rows} r ON r.stream = m.stream AND r.seq = m.seq + 1))"
    shift = lambda k, c: _put(f"{k}{c}", f"{k}a", f"{k}{c}[{k}a] + ({c} - {k}{c}[{k}a]) / ({k}w[{k}a] + 1.0::DOUBLE)")
    part = lambda k, c: f"CASE WHEN {k}h THEN {shift(k, c) if c != 'w' else _put(f'{k}w', f'{k}a', 'v + 1.0')} ELSE {k}{c} END AS {k}{c}"
    moved = f"(SELECT stream, seq, x, y, ph, oh, oa, {', '.join(part(k, c) for k in 'po' for c in 'xyw')} FROM {step})"
    up = f"oh AND ow[oa] >= {strong!r}"
    lifted = ", ".join(f"CASE WHEN {up} THEN list_append(p{c}, o{c}[oa]) ELSE p{c} END AS p{c}, CASE WHEN {up} THEN {_keep(f'o{c}', 'v <> oa')} WHEN NOT ph AND NOT oh THEN list_append(o{c}, {fresh}) ELSE o{c} END AS o{c}" for c, fresh in (("x", "x"), ("y", "y"), ("w", "1.0::DOUBLE")))
    held = f"(SELECT stream, seq, x, y, {lifted} FROM {moved})"
    pruned = ", ".join(f"CASE WHEN seq % 50 = 0 THEN {_keep(f'{k}{c}', f'{k}w[v] >= {least!r}')} ELSE {k}{c} END AS {k}{c}" for k, least in (("p", strong), ("o", 0.1)) for c in "xyw")
    return f"""m AS (
        SELECT DISTINCT stream, 0::BIGINT AS seq, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, {', '.join(f'{_E} AS {k}{c}' for k in 'po' for c in 'xyw')} FROM {rows}
        UNION ALL SELECT stream, seq, x, y, {pruned} FROM {held}
    ), seen AS (SELECT stream, seq, x, y, {_keep('px', f'pw[v] >= {mu!r}')} AS cx, {_keep('py', f'pw[v] >= {mu!r}')} AS cy, false AS busy FROM m) {_labelled('seen', 'cx', 'cy', eps * 1.15)}"""


def greedy_cover(rows: str, radius: float, least: int) -> str:
    """stream, seq, cover: in order, each unclaimed point claims all unclaimed points within the radius, if there are enough."""
    return f"""pts AS (SELECT stream, seq, vec, row_number() OVER (PARTITION BY stream ORDER BY seq) AS i FROM {rows}),
    near AS (SELECT a.stream, a.i, list(b.i ORDER BY b.i) AS l FROM pts a JOIN pts b ON a.stream = b.stream AND list_distance(a.vec, b.vec) <= {radius!r} GROUP BY ALL),
    c AS (
        SELECT stream, 0::BIGINT AS i, []::BIGINT[] AS taken, 0::BIGINT AS n, []::BIGINT[] AS own FROM (SELECT DISTINCT stream FROM pts)
        UNION ALL
        SELECT stream, i, CASE WHEN good THEN list_concat(taken, own2) ELSE taken END, n + CASE WHEN good THEN 1 ELSE 0 END, CASE WHEN good THEN own2 ELSE []::BIGINT[] END
        FROM (SELECT *, NOT list_contains(taken, i) AND len(own2) >= {least} AS good FROM (SELECT c.stream, near.i, c.taken, c.n, list_filter(near.l, lambda v: NOT list_contains(c.taken, v)) AS own2 FROM c JOIN near ON near.stream = c.stream AND near.i = c.i + 1))
    ),
    covers AS (SELECT stream, unnest(own) AS i, n - 1 AS cover FROM c)
    SELECT stream, seq, coalesce(cover, -1)::BIGINT AS cover FROM pts LEFT JOIN covers USING (stream, i)"""


def windowed_dbscan(rows: str, window: int = 500, eps: float = 0.12, least: int = 5, every: int = 20, rounds: int = 64) -> str:
    """The rows of the clusterer that runs DBSCAN over its last points again and again.

    Core points in one cell of a grid are near one another, so components are those of cells; `rounds` bounds their diameter.
    """
    side = eps / math.sqrt(2) * 0.999
    close = lambda u, v: f"sqrt(({u}.x - {v}.x) * ({u}.x - {v}.x) + ({u}.y - {v}.y) * ({u}.y - {v}.y)) <= {eps!r}::DOUBLE"
    return f"""held AS MATERIALIZED (SELECT w.stream, w.seq AS t, r.seq, r.x, r.y FROM {rows} w JOIN {rows} r ON r.stream = w.stream AND r.seq > w.seq - {window} AND r.seq <= w.seq WHERE w.seq % {every} = 0 AND w.seq >= {least}),
    counted AS MATERIALIZED (SELECT a.stream, a.t, a.seq, a.x, a.y, count(*) >= {least} AS core, floor(a.x / {side!r})::INT AS cx, floor(a.y / {side!r})::INT AS cy FROM held a JOIN held b ON a.stream = b.stream AND a.t = b.t WHERE {close('a', 'b')} GROUP BY ALL),
    cores AS MATERIALIZED (SELECT * FROM counted WHERE core),
    edges AS MATERIALIZED (SELECT DISTINCT a.stream, a.t, a.cx, a.cy, b.cx AS dx, b.cy AS dy FROM cores a JOIN cores b ON a.stream = b.stream AND a.t = b.t WHERE abs(a.cx - b.cx) <= 2 AND abs(a.cy - b.cy) <= 2 AND {close('a', 'b')}),
    spread AS (
        SELECT 0 AS round, stream, t, cx, cy, min(seq) AS first FROM cores GROUP BY ALL
        UNION ALL SELECT s.round + 1, e.stream, e.t, e.cx, e.cy, min(s.first) FROM spread s JOIN edges e ON e.stream = s.stream AND e.t = s.t AND e.dx = s.cx AND e.dy = s.cy WHERE s.round < {rounds} GROUP BY ALL
    ),
    named AS (SELECT stream, t, cx, cy, dense_rank() OVER (PARTITION BY stream, t ORDER BY first) - 1 AS label FROM spread WHERE round = {rounds}),
    inner_ AS MATERIALIZED (SELECT c.stream, c.t, c.x, c.y, label FROM cores c JOIN named USING (stream, t, cx, cy)),
    border AS (SELECT b.stream, b.t, b.x, b.y, min(i.label) AS label FROM counted b JOIN inner_ i ON i.stream = b.stream AND i.t = b.t WHERE NOT b.core AND {close('b', 'i')} GROUP BY b.stream, b.t, b.seq, b.x, b.y),
    members AS MATERIALIZED (SELECT * FROM inner_ UNION ALL SELECT * FROM border),
    means AS (SELECT stream, t, label, avg(x) AS mx, avg(y) AS my FROM members GROUP BY ALL),
    balls AS MATERIALIZED (SELECT stream, t, label, mx AS x, my AS y, 1.1 * greatest(quantile_cont(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 0.95), 1e-6) AS radius FROM members JOIN means USING (stream, t, label) GROUP BY stream, t, label, mx, my),
    asked AS (SELECT p.stream, p.seq, b.label, b.radius, sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) AS d FROM {rows} p JOIN balls b ON b.stream = p.stream AND b.t = p.seq // {every} * {every}),
    best AS (SELECT stream, seq, count(*) AS n, min({{'d': d, 'label': label, 'radius': radius}}) AS m FROM asked GROUP BY ALL)
    SELECT p.stream, p.seq, CASE WHEN m.d <= m.radius THEN m.label ELSE -1 END::BIGINT AS label, coalesce(n, 0)::INT AS n_micro, coalesce(n, 0)::INT AS n_macro, {BLANK} FROM {rows} p LEFT JOIN best ON best.stream = p.stream AND best.seq = p.seq"""
