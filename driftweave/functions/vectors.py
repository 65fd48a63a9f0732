"""Column expressions over vectors (arrays of doubles) and scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def within(point: Column, center: Column, radius: Column) -> Column:
    """Whether a point lies in a ball, its border included."""
    return l2_distance(point, center) <= radius


def centroid(vec: Column, dims: int) -> Column:
    """Component-wise mean of a group's vectors of a known length, as one aggregate without exploding them."""
    return F.array(*(F.avg(vec[i]) for i in range(dims)))


def winsorize(z: Column, n_sigma: float | Column) -> Column:
    """z held within plus or minus n_sigma."""
    n = F.lit(n_sigma) if not isinstance(n_sigma, Column) else n_sigma
    return F.greatest(-n, F.least(n, z))


def clip_radius(distance: Column, r_max: float) -> Column:
    return F.greatest(F.lit(1e-4), F.least(F.lit(float(r_max)), distance))


def surprise(distance: Column, radius: Column) -> Column:
    """Distance to the nearest centre over its radius; 0 without a centre."""
    return F.coalesce(distance / F.greatest(radius, F.lit(1e-6)), F.lit(0.0))


def decayed(weight: Column, factor: float, steps: Column) -> Column:
    """A weight after fading by `factor` at each of `steps` points."""
    return weight * F.pow(F.lit(factor), steps)


def drift_window_before(point: Column, every: int = 50) -> Column:
    """Index of the evaluation window that a drift index falls into, where a multiple of `every` belongs to the window before."""
    return F.greatest(F.lit(0), F.ceil(point / F.lit(float(every))).cast("int") - 1)


def drift_window_at(point: Column, every: int = 50) -> Column:
    """Index of the evaluation window that holds a drift index."""
    return F.floor(point / F.lit(every)).cast("int")


def assigned(pred: Column) -> Column:
    return pred >= 0


def finite(x: Column) -> Column:
    """x, or null where it is null, NaN or infinite, so that aggregates skip it."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def unexpired(points: Column, cutoff: Column) -> Column:
    """The points (structs with a time t) that are newer than the cutoff."""
    return F.filter(points, lambda p: p["t"] > cutoff)
