"""How the quality of a run behaves around drifts. Series are rows (keys, window, quality); drifts are rows (keys, drift)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import finite


def drift_phases(series: DataFrame, drifts: DataFrame, by: Sequence[str] = (), pre: int = 2, during: int = 1, post: int = 3) -> DataFrame:
    """by, drift, phase, window, quality: windows before, at and after each drift; a window may serve several drifts."""
    own = series.withColumn("quality", finite(F.col("quality"))).where("quality is not null")
    # each drift names the few windows around it, so the join is by window
    around = drifts.withColumn("window", F.explode(F.sequence(F.col("drift") - pre, F.col("drift") + during + post - 1)))
    offset = F.col("window") - F.col("drift")
    phase = F.when(offset < 0, "pre").when(offset < during, "during").otherwise("post")
    return own.join(around.withColumn("window", F.col("window").cast(dict(series.dtypes)["window"])), [*by, "window"]).select(*by, "drift", phase.alias("phase"), "window", "quality")


def phase_quality(series: DataFrame, drifts: DataFrame, by: Sequence[str] = (), **sizes: int) -> DataFrame:
    """by, pre_quality, during_quality, post_quality, quality_drop, pooled over all drifts of a run."""
    rows = drift_phases(series, drifts, by, **sizes)
    mean = {p: F.avg(F.when(F.col("phase") == p, F.col("quality"))).alias(f"{p}_quality") for p in ("pre", "during", "post")}
    return rows.groupBy(*by).agg(*mean.values()).withColumn("quality_drop", F.col("pre_quality") - F.col("during_quality"))


def recovery(series: DataFrame, drifts: DataFrame, total: int | None = None, by: Sequence[str] = (), after: int = 1, least_drop: float = 0.05, hold: int = 3, share: float = 0.9) -> DataFrame:
    """by, drift, response, recovery, in windows from the segment's first: null where a drift does no harm or leaves too few windows.

    A drift's segment runs from `after` windows behind it to the next drift. Its target is `share` of the median of its
    last five finite values. The response is the first window at the target, the recovery the first of `hold` in a row.
    `after` 1 with `least_drop` 0.05 is the usual definition, 0 with 0.02 the strict one.
    """
    keys = list(by)
    own = series.select(*keys, F.col("window").cast("long").alias("window"), finite(F.col("quality")).alias("q"))
    ends = own.groupBy(*keys).agg((F.max("window") + 1).alias("total")) if total is None else None
    order = W.partitionBy(*keys).orderBy("drift") if keys else W.orderBy("drift")
    marks = drifts.select(*keys, F.col("drift").cast("long").alias("drift")).withColumn("next", F.lead("drift").over(order))
    if ends is None:
        marks = marks.withColumn("stop", F.coalesce("next", F.lit(total)))
    else:
        joined = marks.join(ends, keys) if keys else marks.withColumn("_1", F.lit(1)).join(ends.withColumn("_1", F.lit(1)), "_1").drop("_1")
        marks = joined.withColumn("stop", F.coalesce("next", "total"))
    marks = marks.withColumn("start", F.col("drift") + after).select(*keys, "drift", "start", "stop")
    inside = marks.where("stop > start").withColumn("window", F.explode(F.expr("sequence(start, stop - 1)")))
    seg = inside.join(own, [*keys, "window"], "left").withColumn("s", F.col("window") - F.col("start"))
    group = [*keys, "drift"]
    per = W.partitionBy(*group)
    ahead = per.orderBy("s").rowsBetween(0, hold - 1)
    ranked = seg.withColumn("back", F.row_number().over(per.orderBy(F.col("q").isNull(), F.desc("s"))))
    target = F.percentile(F.when((F.col("back") <= 5) & F.col("q").isNotNull(), F.col("q")), F.lit(0.5)).over(per) * share
    ranked = ranked.withColumn("target", target).withColumn("ok", (F.col("q") >= F.col("target")) & F.col("q").isNotNull())
    ranked = ranked.withColumn("held", (F.min(F.col("ok").cast("int")).over(ahead) == 1) & (F.count("*").over(ahead) == hold))
    facts = ranked.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.count("q").alias("n_finite"),
        F.min(F.when(F.col("s") < 5, F.col("q"))).alias("low"),
        F.min(F.when(F.col("ok"), F.col("s") + 1)).cast("double").alias("response"),
        F.min(F.when(F.col("held"), F.col("s") + 1)).cast("double").alias("recovery"),
    )
    pre = marks.select(*group, F.explode(F.expr("sequence(drift - 2, drift - 1)")).alias("window")).join(own, [*keys, "window"]).groupBy(*group).agg(F.avg("q").alias("pre"))
    all_of = marks.select(*group).join(facts, group, "left").join(pre, group, "left")
    room = (F.col("n") >= hold + 2) & (F.col("n_finite") >= hold + 2)
    harmless = F.coalesce(F.col("pre") - F.col("low") < least_drop, F.lit(False))
    counted = F.coalesce(room, F.lit(False)) & ~harmless
    return all_of.select(*group, F.when(counted, F.col("response")).alias("response"), F.when(counted, F.col("recovery")).alias("recovery"))
