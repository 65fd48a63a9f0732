"""The stream-clustering benchmark: every algorithm on every dataset and seed, measured around the drifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import drift_window_at, drift_window_before
from ..operators import charts, metrics, recovery, summary
from ..sources import streams
from ..streaming import drivers
from .storage import written

KEYS = ["algorithm", "dataset", "seed"]


def points(spark: SparkSession, datasets: Sequence[str], seeds: Sequence[int], n: int, table: str = "points") -> DataFrame:
    streams.register(spark)
    return spark.read.format("drift_stream").options(dataset=",".join(datasets), seed=",".join(map(str, seeds)), n=n, table=table).load()


def jobs(spark: SparkSession, algorithms: Sequence[str], datasets: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """algorithm, dataset, seed: the runs of a benchmark, every algorithm on every dataset and seed."""
    one = spark.createDataFrame([(list(algorithms), list(datasets), list(seeds))], "algorithms array<string>, datasets array<string>, seeds array<int>")
    return one.select("datasets", "seeds", F.explode("algorithms").alias("algorithm")).select("algorithm", "seeds", F.explode("datasets").alias("dataset")).select("algorithm", "dataset", F.explode("seeds").alias("seed"))


def predictions(spark: SparkSession, algorithms: Sequence[str], datasets: Sequence[str], seeds: Sequence[int], n: int, every: int = 50, window: int = 500) -> DataFrame:
    """algorithm, dataset, seed, seq, window, pred, pending_ratio, y: train, then label the same points, every `every` points."""
    own = points(spark, datasets, seeds, n).select(F.col("stream").alias("dataset"), "seed", (F.col("idx") + 1).alias("seq"), F.col("x").alias("vec"), "y")
    parts = [drivers.evaluate(own, a, ["dataset", "seed"], "seq", "vec", "y", every, window).withColumn("algorithm", F.lit(a)) for a in algorithms]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def runs(spark: SparkSession, algorithms: Sequence[str], datasets: Sequence[str], seeds: Sequence[int], n: int, every: int = 50, strict: bool = False) -> DataFrame:
    """One row a run: means, phase qualities, drop, response and recovery, and the series. `strict` takes the other family of measures."""
    labelled = written(predictions(spark, algorithms, datasets, seeds, n, every), "predictions")
    by = [*KEYS, "window"]
    quality = metrics.quality_macro(labelled, by) if strict else metrics.quality_micro(labelled, by)
    if strict:
        quality = quality.withColumn("coverage", F.lit(None).cast("double"))
    pending = labelled.groupBy(*by).agg(F.first("pending_ratio").alias("pending"))
    series = written(quality.join(pending, by), "series")
    index = drift_window_at(F.col("drift_idx"), every) if strict else drift_window_before(F.col("drift_idx"), every)
    drifts = points(spark, datasets, seeds, n, "drifts").select(F.col("stream").alias("dataset"), "seed", index.alias("drift"))
    drifts = written(drifts.withColumn("algorithm", F.explode(F.array(*(F.lit(a) for a in algorithms)))), "drifts")
    means = series.groupBy(*KEYS).agg(
        *(F.avg(c).alias(f"{n}_mean") for c, n in (("quality", "quality"), ("purity", "purity"), ("coverage", "coverage"), ("ari", "ari"))),
        F.avg("pending").alias("pending_ratio"),
        F.transform(F.array_sort(F.collect_list(F.struct("window", "quality"))), lambda s: s["quality"]).alias("quality_series"),
    )
    phases = recovery.phase_quality(series.select(*by, "quality"), drifts, KEYS)
    back = recovery.recovery(series.select(*by, "quality"), drifts, None, KEYS, after=0 if strict else 1, least_drop=0.02 if strict else 0.05)
    lags = back.groupBy(*KEYS).agg(F.avg("response").alias("response_lag_w"), F.avg("recovery").alias("recovery_w"), F.sort_array(F.collect_list("drift")).alias("drift_windows"))
    return means.join(phases, KEYS, "left").join(lags, KEYS, "left").withColumn("recovery_pts", F.col("recovery_w") * every)


def main(argv: Sequence[str] | None = None) -> None:
    """Runs the benchmark and writes detail and summary as CSV."""
    import argparse
    import time

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--seeds", type=int, nargs="+", default=list(streams.SEEDS))
    parser.add_argument("--jobs", type=int, default=4, help="tasks at a time")
    parser.add_argument("--quick", action="store_true", help="two seeds and 2,000 points")
    parser.add_argument("--strict", action="store_true", help="two algorithms on all datasets, by the strict measures")
    parser.add_argument("--out", default="benchmark_outputs")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.master(f"local[{args.jobs}]").config("spark.sql.shuffle.partitions", str(4 * args.jobs)).getOrCreate()
    seeds, n = (streams.QUICK_SEEDS, 2000) if args.quick else (args.seeds, 5000)
    tag = time.strftime("%Y%m%d_%H%M%S")
    if args.strict:
        found = written(runs(spark, ["tight", "tight_drift"], streams.FULL, seeds, n, strict=True), "runs")
        short = summary.seed_summary_population(found)
        series = summary.series_summary(found)
        summary.write_csv(short, f"{args.out}/comparison_{tag}_summary.csv")
        summary.write_csv(series, f"{args.out}/comparison_{tag}_series.csv")
        drifts = found.select("dataset", F.explode("drift_windows").alias("drift")).distinct()
        charts.write_charts(charts.series_charts(summary.plot_series(series, drifts)), f"{args.out}/comparison_{tag}_series.svg")
        charts.write_charts(charts.summary_chart(short, "quality_mean_avg", "quality_mean_std"), f"{args.out}/comparison_{tag}_summary.svg")
        short.orderBy("dataset", "algorithm").show(100, truncate=False)
        return
    print(f"{jobs(spark, list(drivers.ALGORITHMS), streams.ALL, seeds).count()} runs of {n} points")
    found = written(runs(spark, list(drivers.ALGORITHMS), streams.ALL, seeds, n), "runs")
    detail = summary.detail_table(found)
    short = written(summary.seed_summary(detail), "summary")
    summary.write_csv(detail, f"{args.out}/benchmark_{tag}_detail.csv")
    summary.write_csv(short, f"{args.out}/benchmark_{tag}_summary.csv")
    for row in summary.ranking_lines(short, ["tight", "tight_drift"]).orderBy("dataset", "place").collect():
        print(f"[{row['dataset']}] {row['line']}")


if __name__ == "__main__":
    main()
