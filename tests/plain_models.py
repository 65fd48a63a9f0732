"""Second models of the stream clusterers, in plain Python over lists and dicts, written from their rules one by one.

Nothing here is shared with the library, keeps anything between steps but the state itself, or is meant to be fast.
"""

import math
import statistics


def dist(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))


def mean(points):
    return [sum(c) / len(points) for c in zip(*points)]


def nearest(x, centers):
    """Place of the nearest centre, the first of equal ones."""
    return min(range(len(centers)), key=lambda i: (dist(x, centers[i]), i))


def knn(points, k):
    return [[j for _, j in sorted((dist(p, q), j) for j, q in enumerate(points) if j != i)[:k]] for i, p in enumerate(points)]


def tight_groups(points, k, alpha):
    """Components of the mutual neighbour graph without outliers, in order of their first points; a lone point is an outlier."""
    n = len(points)
    if n < 2:
        return []
    near = knn(points, min(k, n - 1))
    tight = [[j for j in near[i] if i in near[j]] for i in range(n)]
    score = {i: sum(dist(points[i], points[j]) for j in t) / len(t) / len(t) ** 2 for i, t in enumerate(tight) if t}
    if not score:
        return []
    limit = statistics.fmean(score.values()) + alpha * statistics.pstdev(score.values())
    good = [i for i in range(n) if i in score and score[i] <= limit + 1e-15]
    groups, seen = [], set()
    for i in good:
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in tight[todo.pop()]:
                    if j in good and j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            groups.append(sorted(group))
    return groups


def shared_radius(points, k, r_max, tk, mk):
    n = len(points)
    if n < 2:
        return r_max
    near = knn(points, min(k, n - 1))
    steps = [(i, set(near[i]) & set(near[j])) for i in range(n) for j in near[i]]
    steps = [(i, shared) for i, shared in steps if len(shared) >= tk]
    if len(steps) < mk:
        return r_max
    return min(r_max, max(1e-4, max((dist(points[i], points[s]) for i, shared in steps for s in shared), default=0.0)))


class Plain:
    """The two-tier clusterer. A ball is a dict; `macro` is the number of its group or -1; a group is a list of balls."""

    W, N, r_max, k, n_micro, snn_k, alpha, tk, mk = 500, 5, 0.15, 4, 2, 5, 1.6, 3, 2

    def __init__(self, W=500):
        self.W, self.t, self.pool, self.balls, self.groups, self.next = W, 0, [], [], {}, 0

    def update(self, x):
        self.t += 1
        self.expire()
        self.drop(self.n_micro)
        self.place(x)
        self.rest(self.N, self.n_micro)

    def rest(self, least_pool, n_micro):
        if len(self.pool) >= least_pool:
            self.cover()
        self.attach()
        self.define(n_micro)
        self.split()
        self.drop(n_micro)

    def expire(self):
        alive = []
        for b in self.balls:
            b["points"] = [(t, p) for t, p in b["points"] if t > self.t - self.W]
            if len(b["points"]) >= self.N:
                b["center"] = mean([p for _, p in b["points"]])
                alive.append(b)
            else:
                self.pool += b["points"]
        self.balls = alive

    def drop(self, least):
        for m in list(self.groups):
            live = [b for b in self.groups[m] if b["macro"] == m and any(b is x for x in self.balls)]
            if len(live) < least:
                for b in live:
                    b["macro"] = -1
                del self.groups[m]
            else:
                self.groups[m] = live

    def place(self, x):
        if self.balls:
            b = self.balls[nearest(x, [b["center"] for b in self.balls])]
            if dist(x, b["center"]) <= b["radius"]:
                b["points"].append((self.t, x))
                b["center"] = mean([p for _, p in b["points"]])
                return
        self.pool = [(t, p) for t, p in [*self.pool, (self.t, x)] if t > self.t - self.W]

    def cover(self):
        if len(self.pool) < self.N:
            return
        pts = [p for _, p in self.pool]
        radius = shared_radius(pts, min(self.snn_k, len(pts) - 1), self.r_max, self.tk, self.mk)
        used = set()
        for i in range(len(pts)):
            if i not in used:
                own = [j for j in range(len(pts)) if j not in used and dist(pts[i], pts[j]) <= radius]
                if len(own) >= self.N:
                    used |= set(own)
                    self.balls.append({"points": [self.pool[j] for j in own], "center": mean([pts[j] for j in own]), "radius": radius, "macro": -1})
        self.pool = [p for j, p in enumerate(self.pool) if j not in used]

    def attach(self):
        held = [(b, b["macro"]) for b in self.balls if b["macro"] >= 0]
        if not self.groups or not held:
            return
        for b in [b for b in self.balls if b["macro"] < 0]:
            other, macro = held[nearest(b["center"], [h["center"] for h, _ in held])]
            if dist(b["center"], other["center"]) <= 2 * other["radius"]:
                b["macro"] = macro
                self.groups[macro].append(b)

    def new_group(self, balls):
        m, self.next = self.next, self.next + 1
        self.groups[m] = balls
        for b in balls:
            b["macro"] = m

    def define(self, least):
        free = [b for b in self.balls if b["macro"] == -1]
        if len(free) >= least:
            for g in tight_groups([b["center"] for b in free], self.k, self.alpha):
                if len(g) >= least:
                    self.new_group([free[i] for i in g])

    def split(self):
        later = []
        for m in list(self.groups):
            balls = [b for b in self.groups[m] if b["macro"] == m and any(b is x for x in self.balls)]
            parts = tight_groups([b["center"] for b in balls], self.k, self.alpha) if len(balls) >= self.n_micro else []
            size = max(map(len, parts), default=0)
            for b in self.groups[m]:
                if b["macro"] == m:
                    b["macro"] = -1
            if size < self.n_micro:
                del self.groups[m]
                continue
            best = next(p for p in parts if len(p) == size)  # the first of the largest ones
            self.groups[m] = [balls[i] for i in best]
            for b in self.groups[m]:
                b["macro"] = m
            later += [[balls[i] for i in p] for p in parts if p is not best and len(p) >= self.n_micro]
        for p in later:
            self.new_group(p)

    def label(self, x):
        if not self.balls:
            return -1
        b = self.balls[nearest(x, [b["center"] for b in self.balls])]
        return b["macro"] if dist(x, b["center"]) <= b["radius"] else -1

    def surprise(self, x):
        if not self.balls:
            return 0.0
        b = self.balls[nearest(x, [b["center"] for b in self.balls])]
        return dist(x, b["center"]) / max(b["radius"], 1e-6)


class PlainDetector:
    """The two-armed detector, with all its windows cut from whole histories."""

    def __init__(self, k_lambda, k_slope, ema_alpha, delta, confirm, min_samples):
        self.k_lambda, self.k_slope, self.alpha, self.delta, self.confirm, self.least = k_lambda, k_slope, ema_alpha, delta, confirm, min_samples
        self.xs, self.mu, self.heights, self.streak = [], None, [], 0
        self.arms = {s: {"value": 0.0, "path": [], "slopes": [], "recent": []} for s in (1, -1)}

    @staticmethod
    def slope(ys):
        n = len(ys)
        if n < 2:
            return 0.0
        mx, my = (n - 1) / 2, sum(ys) / n
        return sum((i - mx) * (y - my) for i, y in enumerate(ys)) / sum((i - mx) ** 2 for i in range(n))

    def update(self, x):
        mu = x if self.mu is None else self.mu
        self.mu = self.alpha * x + (1 - self.alpha) * mu
        self.xs.append(x)
        own = self.xs[-50:]
        sigma = 1.0
        if len(own) >= 4:
            mid = statistics.median(own)
            sigma = max(1e-6, 1.4826 * sorted(abs(v - mid) for v in own)[len(own) // 2])
        z = max(-2.5, min(2.5, (x - mu) / sigma))
        for sign, a in self.arms.items():
            a["value"] = max(0.0, a["value"] + sign * z - self.delta)
            a["path"].append(a["value"])
            a["slope"] = self.slope(a["path"][-10:])
            a["slopes"].append(a["slope"])
            a["recent"].append(a["slope"])
        self.heights.append(max(a["value"] for a in self.arms.values()))
        heights = self.heights[-150:]
        level = 3 * self.k_lambda if len(heights) < 20 else max(1.5, statistics.stdev(heights)) * self.k_lambda
        sign = 1 if self.arms[1]["slope"] >= self.arms[-1]["slope"] else -1
        a, usual = self.arms[sign], self.arms[sign]["slopes"][-150:]
        spread = statistics.stdev(usual) if len(usual) > 1 else 0.0
        self.score = a["slope"] if len(usual) < 5 else (a["slope"] - statistics.fmean(usual)) / (spread + 1e-9)
        limit = 2 * self.k_slope if len(usual) < 10 else statistics.fmean(usual) + self.k_slope * spread
        met = len(self.xs) >= self.least and a["value"] > level and self.score > limit and abs(self.slope(a["recent"][-8:])) > 0.12
        self.streak = self.streak + 1 if met else 0
        self.direction = "up" if sign > 0 else "down"
        return self.streak >= self.confirm

    def reset(self):
        self.streak = 0
        for a in self.arms.values():
            a["value"], a["path"], a["recent"] = 0.0, [], []


class PlainAware(Plain):
    """The clusterer that forgets faster after a fire of the detector on its surprise."""

    def __init__(self, W=500):
        super().__init__(W)
        self.detector = PlainDetector(3.5304030498554377, 2.509685764176742, 0.11986779639677939, 0.016777202486114567, 2, 39)
        self.relax = self.cooldown = 0
        self.boundary, self.fires = None, []

    def update(self, x):
        self.t += 1
        n_micro, least_pool = (1, 4) if self.relax > 0 else (self.n_micro, self.N)
        self.relax = max(0, self.relax - 1)
        if self.cooldown > 0:
            self.cooldown -= 1
        else:
            self.boundary = None
        self.expire()
        self.drop(self.n_micro)
        self.place(x)
        self.rest(least_pool, n_micro)
        if self.groups and self.detector.update(self.surprise(x)):
            self.fires.append((self.t, self.detector.direction))
            self.relax = 238
            if self.cooldown == 0 and self.detector.score >= 2.3:
                self.boundary, self.cooldown = self.t, 238
            self.detector.reset()

    def expire(self):
        alive = []
        for b in self.balls:
            old = sum(t < self.boundary for t, _ in b["points"]) if self.boundary is not None else 0
            window = int(self.W * 0.21498970223954925) if old > 0.5 * len(b["points"]) else self.W
            b["points"] = [(t, p) for t, p in b["points"] if t > self.t - window]
            if b["points"]:
                b["center"] = mean([p for _, p in b["points"]])
                alive.append(b)
        self.balls = alive


class PlainDbscan:
    """DBSCAN of the last points at every 20th one; a point belongs to the nearest cluster's mean within its radius."""

    def __init__(self, window=500, eps=0.12, least=5, every=20):
        self.window, self.eps, self.least, self.every, self.held, self.t, self.clusters = window, eps, least, every, [], 0, []

    def update(self, x):
        self.t += 1
        self.held = [*self.held, x][-self.window :]
        if self.t % self.every or len(self.held) < self.least:
            return
        pts = self.held
        near = [[j for j in range(len(pts)) if dist(pts[i], pts[j]) <= self.eps] for i in range(len(pts))]
        core = [len(n) >= self.least for n in near]
        of, count = {}, 0
        for i in range(len(pts)):
            if core[i] and i not in of:
                of[i], todo = count, [i]
                while todo:
                    for j in near[todo.pop()]:
                        if core[j] and j not in of:
                            of[j] = count
                            todo.append(j)
                count += 1
        for i in range(len(pts)):
            if not core[i] and (around := [of[j] for j in near[i] if core[j]]):
                of[i] = min(around)
        self.clusters = []
        for c in range(count):
            own = [pts[i] for i in range(len(pts)) if of.get(i) == c]
            center = mean(own)
            ds = sorted(dist(p, center) for p in own)
            place = 0.95 * (len(ds) - 1)
            lo = int(place)
            p95 = ds[lo] + (place - lo) * (ds[min(lo + 1, len(ds) - 1)] - ds[lo])
            self.clusters.append((center, 1.1 * max(p95, 1e-6)))

    def label(self, x):
        if not self.clusters:
            return -1
        i = nearest(x, [c for c, _ in self.clusters])
        return i if dist(x, self.clusters[i][0]) <= self.clusters[i][1] else -1
