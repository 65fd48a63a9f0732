"""Detected drifts against true ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import written


def match_drifts(events: DataFrame, drifts: DataFrame, tolerance: int = 125, by: Sequence[str] = ()) -> DataFrame:
    """`events` with nearest_real_drift, lag_to_real and verdict (true_positive, early or false_positive).

    Each event takes the nearest true drift within the tolerance, the earlier one of two at equal distance. Both sides are
    bucketed by the tolerance, so that an event meets only drifts of its own and the neighbouring buckets.
    """
    width = max(1, tolerance)
    # numbered and written first, so that an event keeps its number where a stage is done again after a lost executor
    own = written(events.withColumn("_row", F.monotonically_increasing_id()), "events")
    near = own.withColumn("_bucket", F.explode(F.expr(f"sequence(floor(t / {width}) - 1, floor(t / {width}) + 1)")))
    true = drifts.select(*by, F.col("drift").alias("_drift"), F.floor(F.col("drift") / width).alias("_bucket"))
    lag = F.col("t") - F.col("_drift")
    hit = near.join(true, [*by, "_bucket"], "left").withColumn("_lag", F.when(F.abs(lag) <= tolerance, lag))
    best = hit.groupBy("_row").agg(F.min(F.when(F.col("_lag").isNotNull(), F.struct(F.abs("_lag").alias("a"), F.col("_drift").alias("d"), F.col("_lag").alias("l")))).alias("m"), *(F.first(c).alias(c) for c in events.columns))
    verdict = F.when(F.col("m").isNull(), "false_positive").when(F.col("m.l") < 0, "early").otherwise("true_positive")
    return best.select(*events.columns, F.col("m.d").cast("long").alias("nearest_real_drift"), F.col("m.l").cast("long").alias("lag_to_real"), verdict.alias("verdict"))


def missed_drifts(matched: DataFrame, drifts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The true drifts that no event is matched with."""
    found = matched.where("nearest_real_drift is not null").select(*by, F.col("nearest_real_drift").alias("drift"))
    return drifts.join(found, [*by, "drift"], "left_anti")


def timing_scores(matched: DataFrame, drifts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each key of `by`: counts by verdict, missed drifts, precision over all events and recall over all true drifts (null without any)."""
    counts = matched.groupBy(*by).agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("true_positive", "false_positive", "early")), F.count("*").alias("events"))
    true = drifts.select(*by, "drift").distinct()
    missed = missed_drifts(matched, true, by).groupBy(*by).agg(F.count("*").alias("missed"))
    all_of = drifts.groupBy(*by).agg(F.count("*").alias("true"))
    one, on = [x.withColumn("_1", F.lit(1)) for x in (counts, missed, all_of)], [*by, "_1"]
    held = one[0].join(one[1], on, "full").join(one[2], on, "full").na.fill(0, ["true_positive", "false_positive", "early", "events", "missed", "true"])
    ratio = lambda n: F.when(F.col(n) > 0, F.round(F.col("true_positive") / F.col(n), 3))
    return held.select(*by, "true_positive", "false_positive", "early", "missed", ratio("events").alias("precision"), ratio("true").alias("recall"))


#: The drift log's lines.
LOG_HEAD = f"  {'t':>6}  {'dir':<5} {'score':>6}  {'accel':>6}  {'mcs':>4}  {'macros':>6}  {'verdict':<16}  lag"
LOG_NONE = "  [drift log] no drift events detected"


def drift_log(matched: DataFrame, drifts: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """by, place, line: the log of each key as lines of text: a head and a rule, a line an event in order of time, a blank one and the totals.

    Totals need `drifts`. A key with true drifts but without events has one line that says so. Every event has a line of its
    own; events of one key and time stand in the order of their other values.
    """
    lag = F.coalesce(F.when(F.col("lag_to_real") >= 0, F.format_string("+%d", "lag_to_real")).otherwise(F.col("lag_to_real").cast("string")), F.lit("n/a"))
    line = F.format_string("  %6d  %-5s %6.2f  %6.3f  %4d  %6d  %-16s  %s", F.col("t").cast("long"), "direction", F.col("score").cast("double"), F.col("acceleration").cast("double"), F.col("n_mcs").cast("long"), F.col("n_macros").cast("long"), "verdict", lag)
    key = [F.col(c) for c in by] or [F.lit(1)]
    place = F.row_number().over(W.partitionBy(*key).orderBy("t", line)) + 1
    lines = matched.select(*by, place.cast("long").alias("place"), line.alias("line"))
    keys = matched.select(*by, F.lit(1).alias("_1")).distinct()
    head = keys.select(*by, F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("place"), F.lit(x).alias("line")) for i, x in enumerate((LOG_HEAD, "  " + "-" * (len(LOG_HEAD) - 2)))))).alias("h")).select(*by, "h.*")
    out = head.unionByName(lines)
    if drifts is None:
        return out
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    total = F.format_string("  TP=%d  FP=%d  early=%d  missed=%d  precision=%s  recall=%s", "true_positive", "false_positive", "early", "missed", number("precision"), number("recall"))
    last = matched.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_1", F.lit(1))
    scores = timing_scores(matched, drifts, by).withColumn("_1", F.lit(1)).join(last, [*by, "_1"])
    ends = scores.select(*by, F.explode(F.array(F.struct((F.col("_n") + 2).alias("place"), F.lit("").alias("line")), F.struct((F.col("_n") + 3).alias("place"), total.alias("line")))).alias("h")).select(*by, "h.*")
    silent = drifts.select(*by, F.lit(1).alias("_1")).distinct().join(keys, [*by, "_1"], "left_anti").select(*by, F.lit(0).cast("long").alias("place"), F.lit(LOG_NONE).alias("line"))
    return out.unionByName(ends).unionByName(silent)


def first_per_drift(matched: DataFrame) -> DataFrame:
    """The first event after each true drift."""
    own = matched.where("verdict = 'true_positive'")
    return own.withColumn("_n", F.row_number().over(W.partitionBy("nearest_real_drift").orderBy("t"))).where("_n = 1").drop("_n")
