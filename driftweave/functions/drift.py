"""The parts of the cumulative-sum drift detector as window expressions.

They hold between resets: window frames cannot see a reset. The stateful detector in `streaming.detector` has resets; the
tests compare both on streams without any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _rows(by: str, order: str, n: int):
    return W.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)


def mad_sigma(x: Column, by: str, order: str, window: int = 50) -> Column:
    """Robust deviation of the last values: 1.4826 times the upper median of distances to the median; 1 with under four."""
    frame = _rows(by, order, window)
    values, n = F.collect_list(x).over(frame), F.count(x).over(frame)
    center = F.percentile(x, F.lit(0.5)).over(frame)
    distances = F.array_sort(F.transform(values, lambda v: F.abs(v - center)))
    mad = F.element_at(distances, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n < 4, F.lit(1.0)).otherwise(F.greatest(F.lit(1.4826) * mad, F.lit(1e-6)))


def slope(y: Column, by: str, order: str, window: int = 10) -> Column:
    """Least-squares slope of the last values over their places; 0 with under two."""
    frame = _rows(by, order, window)
    return F.when(F.count(y).over(frame) >= 2, F.regr_slope(y, F.col(order).cast("double")).over(frame)).otherwise(0.0)


def adaptive_level(arm: Column, by: str, order: str, k: float = 4.5, window: int = 150) -> Column:
    """k times the sample deviation of the last arm values, 1.5 k at least; 3 k with under twenty."""
    frame = _rows(by, order, window)
    return F.when(F.count(arm).over(frame) < 20, F.lit(3.0 * k)).otherwise(F.greatest(k * F.stddev_samp(arm).over(frame), F.lit(1.5 * k)))


def slope_limit(s: Column, by: str, order: str, k: float = 3.5, window: int = 150) -> Column:
    """Mean plus k sample deviations of the last slopes; 2 k with under ten."""
    frame = _rows(by, order, window)
    return F.when(F.count(s).over(frame) < 10, F.lit(2.0 * k)).otherwise(F.avg(s).over(frame) + k * F.stddev_samp(s).over(frame))


def slope_score(s: Column, by: str, order: str, window: int = 150) -> Column:
    """The slope in sample deviations from the mean of the last slopes, itself included; the slope itself with under five."""
    frame = _rows(by, order, window)
    return F.when(F.count(s).over(frame) < 5, s).otherwise((s - F.avg(s).over(frame)) / (F.stddev_samp(s).over(frame) + 1e-9))


def cusum_arms(df: DataFrame, z: str, by: str, order: str, delta: float = 0.01) -> DataFrame:
    """`df` with up and low: one-sided cumulative sums that never fall below zero, as running sums less their running minimum."""
    frame = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = df.withColumn("_s", F.sum(F.col(z) - delta).over(frame)).withColumn("_t", F.sum(-F.col(z) - delta).over(frame))
    up = F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(frame))
    low = F.col("_t") - F.least(F.lit(0.0), F.min("_t").over(frame))
    return sums.withColumn("up", up).withColumn("low", low).drop("_s", "_t")


def run_lengths(df: DataFrame, condition: str, by: str, order: str) -> DataFrame:
    """`df` with run: how many rows in a row the condition has held, this one included; 0 where it does not."""
    frame = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    island = df.withColumn("_island", F.sum(F.when(F.coalesce(F.col(condition), F.lit(False)), 0).otherwise(1)).over(frame))
    inner = W.partitionBy(by, "_island").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return island.withColumn("run", F.sum(F.when(F.coalesce(F.col(condition), F.lit(False)), 1).otherwise(0)).over(inner)).drop("_island")


def lagged_ema(df: DataFrame, x: str, by: str, order: str, alpha: float = 0.05) -> DataFrame:
    """`df` with mu: the exponential mean of the values before each row; the first row's own value there.

    The recursion runs over a stream's rows in order, so they are folded in one task per stream, in Arrow batches of which
    only the last mean is carried. Step by step, so that means are those of the detector to the last bit.
    """
    from collections.abc import Iterator
    from itertools import accumulate

    import numpy as np
    import pyarrow as pa

    columns = df.columns
    by_at, x_at = columns.index(by), columns.index(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mean = None, 0.0
        for batch in batches:
            keys, values = batch.column(by_at).to_pylist(), batch.column(x_at).to_pylist()
            turns = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            out = np.empty(len(keys))
            for a, b in zip(turns, [*turns[1:], len(keys)]):
                if held is None or keys[a] != held[0]:
                    held, mean = (keys[a],), values[a]
                *out[a:b], mean = accumulate(values[a:b], lambda m, v: alpha * v + (1.0 - alpha) * m, initial=mean)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*columns, "mu"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartition(parts, by).sortWithinPartitions(by, order)
    return ordered.mapInArrow(run, df.withColumn("mu", F.lit(0.0)).schema)


def detector_signals(df: DataFrame, x: str = "x", by: str = "stream", order: str = "seq", k_lambda: float = 4.5, k_slope: float = 3.5, ema_alpha: float = 0.05, delta: float = 0.01, slope_window: int = 10, accel_window: int = 8, confirm_steps: int = 3, var_window: int = 50, adapt_window: int = 150, clip_sigma: float = 2.5, min_samples: int = 50, accel_floor: float = 0.12) -> DataFrame:
    """All signals of the detector for each row, up to a stream's first fire: up, low, lambda, score, limit, acceleration, direction, run, fired."""
    from .vectors import winsorize

    own = lagged_ema(df, x, by, order, ema_alpha).withColumn("_sigma", mad_sigma(F.col(x), by, order, var_window))
    arms = cusum_arms(own.withColumn("_z", winsorize((F.col(x) - F.col("mu")) / F.col("_sigma"), clip_sigma)), "_z", by, order, delta)
    arms = arms.withColumn("_su", slope(F.col("up"), by, order, slope_window)).withColumn("_sl", slope(F.col("low"), by, order, slope_window))
    level = adaptive_level(F.greatest("up", "low"), by, order, k_lambda, adapt_window)
    rises = F.col("_su") >= F.col("_sl")
    signals = (
        arms.withColumn("lambda", level)
        .withColumn("_au", F.abs(slope(F.col("_su"), by, order, accel_window)))
        .withColumn("_al", F.abs(slope(F.col("_sl"), by, order, accel_window)))
        .withColumn("_zu", slope_score(F.col("_su"), by, order, adapt_window))
        .withColumn("_zl", slope_score(F.col("_sl"), by, order, adapt_window))
        .withColumn("_lu", slope_limit(F.col("_su"), by, order, k_slope, adapt_window))
        .withColumn("_ll", slope_limit(F.col("_sl"), by, order, k_slope, adapt_window))
        .withColumn("direction", F.when(rises, "up").otherwise("down"))
        .withColumn("score", F.when(rises, F.col("_zu")).otherwise(F.col("_zl")))
        .withColumn("limit", F.when(rises, F.col("_lu")).otherwise(F.col("_ll")))
        .withColumn("acceleration", F.when(rises, F.col("_au")).otherwise(F.col("_al")))
    )
    n = F.row_number().over(W.partitionBy(by).orderBy(order))
    met = (n >= min_samples) & (F.when(rises, F.col("up")).otherwise(F.col("low")) > F.col("lambda")) & (F.col("score") > F.col("limit")) & (F.col("acceleration") > accel_floor)
    out = run_lengths(signals.withColumn("_met", met), "_met", by, order)
    return out.withColumn("fired", F.col("run") >= confirm_steps).drop("_sigma", "_z", "_su", "_sl", "_au", "_al", "_zu", "_zl", "_lu", "_ll", "_met")
