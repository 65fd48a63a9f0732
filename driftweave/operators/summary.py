"""Summaries of benchmark runs over seeds, rankings, and tables ready to be written or drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import finite

#: Column of a run, its name in the detail table, and the decimals it is rounded to there.
DETAIL = (
    ("quality_mean", "Quality", 4), ("purity_mean", "Purity", 4), ("coverage_mean", "Coverage", 4), ("ari_mean", "ARI", 4), ("pending_ratio", "PendingRatio", 4),
    ("pre_quality", "PreQuality", 4), ("during_quality", "DuringQuality", 4), ("post_quality", "PostQuality", 4), ("quality_drop", "QualityDrop", 4),
    ("response_lag_w", "ResponseLag_w", 2), ("recovery_w", "Recovery_w", 2), ("recovery_pts", "Recovery_pts", 0),
)
SPREAD = ("Quality", "ResponseLag_w", "Recovery_w")


def detail_table(runs: DataFrame) -> DataFrame:
    """Runs under their published names, rounded half to even; missing values are null."""
    return runs.select(F.col("algorithm").alias("Algorithm"), F.col("dataset").alias("Dataset"), F.col("seed").alias("Seed"), *(F.bround(finite(F.col(c)), d).alias(n) for c, n, d in DETAIL))


def _mean(value: Column, decimals: int) -> Column:
    """The rounded mean of values of few decimals, halves up. Sums of doubles would put a half on either side, by the order of rows."""
    own = value.try_cast("decimal(30,10)")
    return F.when(F.count(own) == F.count(value), F.round(F.avg(own), decimals).cast("double")).otherwise(F.round(F.avg(value), decimals))


def seed_summary(detail: DataFrame, decimals: int = 4) -> DataFrame:
    """Means over seeds of the rounded values, sample deviations of three of them (null under two values), and runs."""
    aggs: list[Column] = [F.count("*").alias("Runs")]
    for _, n, _ in DETAIL:
        aggs.append(_mean(F.col(n), decimals).alias(f"{n} mean"))
        if n in SPREAD:
            aggs.append(F.round(F.when(F.count(n) >= 2, F.stddev_samp(n)), decimals).alias(f"{n} std"))
    return detail.groupBy("Algorithm", "Dataset").agg(*aggs)


def seed_summary_population(runs: DataFrame, columns: Sequence[str] = ("quality_mean", "quality_drop", "response_lag_w", "recovery_w"), by: Sequence[str] = ("algorithm", "dataset")) -> DataFrame:
    """Means over seeds and population deviations, 0 with at most one finite value."""
    aggs = []
    for c in columns:
        v = finite(F.col(c))
        aggs += [F.avg(v).alias(f"{c}_avg"), F.when(F.count(v) > 1, F.stddev_pop(v)).otherwise(0.0).alias(f"{c}_std")]
    return runs.groupBy(*by).agg(*aggs)


def series_summary(runs: DataFrame, series: str = "quality_series", by: Sequence[str] = ("algorithm", "dataset")) -> DataFrame:
    """by, window, mean, std: over seeds at each window; series of different lengths simply end."""
    rows = runs.select(*by, F.posexplode(series).alias("window", "q")).withColumn("q", finite(F.col("q")))
    return rows.groupBy(*by, "window").agg(F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"))


def plot_series(summary: DataFrame, drifts: DataFrame) -> DataFrame:
    """dataset, algorithm, window, mean, lo, hi, is_drift: what a chart of mean and spread needs. `drifts`: dataset, drift (a window)."""
    marks = drifts.select("dataset", F.col("drift").cast("int").alias("window")).distinct().withColumn("is_drift", F.lit(True))
    return summary.join(marks, ["dataset", "window"], "left").select("dataset", "algorithm", "window", "mean", (F.col("mean") - F.col("std")).alias("lo"), (F.col("mean") + F.col("std")).alias("hi"), F.coalesce("is_drift", F.lit(False)).alias("is_drift"))


def plot_summary(summary: DataFrame, values: Sequence[str]) -> DataFrame:
    """A row for each dataset and algorithm, also for pairs without runs (null), sorted by dataset. Both lists of names are short."""
    names = summary.select("dataset").distinct().withColumn("_1", F.lit(1)).join(summary.select("algorithm").distinct().withColumn("_1", F.lit(1)), "_1").drop("_1")
    return names.join(summary, ["dataset", "algorithm"], "left").select("dataset", "algorithm", *values).orderBy("dataset", "algorithm")


def recovery_ranking(summary: DataFrame, own: Sequence[str] = (), dataset: str = "Dataset", value: str = "Recovery_w mean", algorithm: str = "Algorithm") -> DataFrame:
    """dataset, place, algorithm, value, mark: fastest recovery first, missing ones last; `own` algorithms are marked."""
    place = F.row_number().over(W.partitionBy(dataset).orderBy(F.col(value).asc_nulls_last(), algorithm))
    return summary.select(F.col(dataset).alias("dataset"), place.alias("place"), F.col(algorithm).alias("algorithm"), F.col(value).alias("value"), F.when(F.col(algorithm).isin(*own), "*").otherwise("").alias("mark"))


def ranking_lines(summary: DataFrame, own: Sequence[str] = ()) -> DataFrame:
    """dataset, place, line: the ranking as lines of text."""
    def number(c: str, form: str) -> Column:
        return F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(form, c)), F.lit("n/a"))

    place = F.row_number().over(W.partitionBy("Dataset").orderBy(F.col("Recovery_w mean").asc_nulls_last(), "Algorithm"))
    line = F.format_string("  %-20s %8s %7s %7s %8s %10s%s", "Algorithm", number("Quality mean", "%.3f"), number("QualityDrop mean", "%.3f"), number("ResponseLag_w mean", "%.1f"), number("Recovery_w mean", "%.1f"), number("Recovery_pts mean", "%.0f"), F.when(F.col("Algorithm").isin(*own), " *").otherwise(""))
    return summary.select(F.col("Dataset").alias("dataset"), place.alias("place"), line.alias("line"))


def fire_report(fires: DataFrame) -> DataFrame:
    """One row: fires on abrupt segments, on gradual ones, and on others. `fires` has a column segment."""
    abrupt, gradual = F.col("segment").contains("ABRUPT"), F.col("segment").contains("gradual")
    return fires.agg(F.count_if(abrupt).alias("abrupt"), F.count_if(gradual).alias("gradual"), F.count_if(~abrupt & ~gradual).alias("false_alarms"))


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header."""
    df.write.option("header", True).csv(path)
