"""Quality of a labelling against true classes, per group. Predictions below 0 are unassigned; a missing value is null.

Two families exist. The `micro` family weighs clusters by size, counts unassigned points in the coverage, and skips
degenerate Rand indices; the `macro` family weighs clusters equally and looks at assigned points only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _majority(df: DataFrame, by: Sequence[str], y: str, pred: str) -> DataFrame:
    """by, pred, n, top: size of each predicted cluster and of its largest class."""
    cells = df.where(F.col(pred) >= 0).groupBy(*by, F.col(pred).alias("pred"), F.col(y).alias("y")).agg(F.count("*").alias("c"))
    return cells.groupBy(*by, "pred").agg(F.sum("c").alias("n"), F.max("c").alias("top"))


def _grouped(df: DataFrame, by: Sequence[str], out: DataFrame, name: str, value: Column) -> DataFrame:
    """One row for each group of `df`, also where `out` has none."""
    if not by:
        return out.select(value.alias(name))
    return df.select(*by).distinct().join(out, list(by), "left").select(*by, value.alias(name))


def purity_micro(df: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Share of assigned points in the largest class of their cluster; 0 without assigned points."""
    out = _majority(df, by, y, pred).groupBy(*by).agg((F.sum("top") / F.sum("n")).alias("v"))
    return _grouped(df, by, out, "purity", F.coalesce("v", F.lit(0.0)))


def purity_macro(df: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Mean over clusters of the share of the largest class; null without assigned points."""
    out = _majority(df, by, y, pred).groupBy(*by).agg(F.avg(F.col("top") / F.col("n")).alias("v"))
    return _grouped(df, by, out, "purity", F.col("v"))


def coverage(df: DataFrame, by: Sequence[str] = (), pred: str = "pred") -> DataFrame:
    """Share of points that are assigned; 0 without points."""
    return df.groupBy(*by).agg(F.coalesce(F.avg((F.col(pred) >= 0).cast("double")), F.lit(0.0)).alias("coverage"))


def coverage_masked(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", masked: bool = False) -> DataFrame:
    """Coverage of the macro family: 1 unless unassigned points are to be masked; null without points then."""
    value = F.avg((F.col(pred) >= 0).cast("double")) if masked else F.lit(1.0)
    return df.groupBy(*by).agg(value.alias("coverage"))


def rand_index(df: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred", guarded: bool = True) -> DataFrame:
    """Adjusted Rand index of assigned points from pair counts of the contingency table.

    `guarded` gives null with under two assigned points, classes or clusters; otherwise labellings without any disagreeing
    pair give 1, and groups without assigned points null.
    """
    cells = df.where(F.col(pred) >= 0).groupBy(*by, F.col(pred).alias("p"), F.col(y).alias("t")).agg(F.count("*").alias("c"))

    def pairs(n: Column) -> Column:
        n = n.cast("double")
        return n * (n - 1) / 2

    rows = cells.groupBy(*by, "p").agg(F.sum("c").alias("a"), F.sum(pairs(F.col("c"))).alias("s"))
    cols = cells.groupBy(*by, "t").agg(F.sum("c").alias("b")).groupBy(*by).agg(F.sum(pairs(F.col("b"))).alias("bb"), F.count("*").alias("classes"))
    both = rows.groupBy(*by).agg(F.sum("s").alias("s"), F.sum(pairs(F.col("a"))).alias("aa"), F.count("*").alias("clusters"), F.sum("a").alias("n"))
    both = both.join(cols, list(by)) if by else both.withColumn("_one", F.lit(1)).join(cols.withColumn("_one", F.lit(1)), "_one")
    s, a, b, t = F.col("s"), F.col("aa"), F.col("bb"), pairs(F.col("n"))
    raw = F.when((s == a) & (s == b), F.lit(1.0)).otherwise((s - a * b / t) / ((a + b) / 2 - a * b / t))
    value = F.when((F.col("n") >= 2) & (F.col("clusters") >= 2) & (F.col("classes") >= 2), raw) if guarded else F.when(F.col("n") > 0, raw)
    return _grouped(df, by, both, "ari", value)


def quality_micro(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """by, coverage, purity, ari, quality: the mean of coverage, purity and, where there is one, the Rand index."""
    out = coverage(df, by, pred).join(purity_micro(df, by, y, pred), list(by)).join(rand_index(df, by, y, pred), list(by))
    mean = (F.col("coverage") + F.col("purity") + F.coalesce("ari", F.lit(0.0))) / F.when(F.col("ari").isNull(), 2).otherwise(3)
    return out.withColumn("quality", mean)


def quality_macro(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """by, purity, ari, quality over assigned points, with a coverage of 1; null for groups without any."""
    out = purity_macro(df, by, y, pred).join(rand_index(df, by, y, pred, guarded=False), list(by))
    return out.withColumn("quality", F.when(F.col("purity").isNotNull(), (F.col("purity") + 1.0 + F.coalesce("ari", F.lit(0.0))) / F.when(F.col("ari").isNull(), 2).otherwise(3)))


def count_windows(df: DataFrame, every: int = 50, seq: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """`df` with window = (seq - 1) div every, complete windows only."""
    own = df.withColumn("window", F.floor((F.col(seq) - 1) / every).cast("long"))
    full = own.groupBy(*by, "window").agg(F.count("*").alias("_n")).where(F.col("_n") == every).select(*by, "window")
    return own.join(full, [*by, "window"], "left_semi")
