"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each document's number of copies inverts a Poisson distribution at a uniform number that its id and a seed give by MD5.
The mean is the repetition rate of its source: the source's share of the target over what the source has. Copies are
spread over the whole output by a second hash, which no source or document decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

#: Means beyond this are sums of several equal Poisson numbers, each from a hash of its own, so that exp(-mean) stays exact.
PART = 16.0
#: Above a mean of at most PART the chance of a number beyond this is under 1e-16.
TERMS = 96
#: With more sources than this, the table of rates is joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson(mean: Column, *key: Column) -> Column:
    """The least k whose cumulative Poisson chance is above the key's uniform number; a sum of such for large means."""

    def invert(lam: Column, u: Column) -> Column:
        start = F.struct(F.exp(-lam).alias("p"), F.exp(-lam).alias("c"), F.lit(0).alias("k"))

        def step(acc: Column, k: Column) -> Column:
            p = acc["p"] * lam / k
            return F.when(acc["c"] <= u, F.struct(p.alias("p"), (acc["c"] + p).alias("c"), k.alias("k"))).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["k"]

    parts = F.greatest(F.lit(1), F.ceil(mean / PART)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0).cast("long"), lambda a, j: a + invert(mean / parts, uniform(*key, j.cast("string"))).cast("long"))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: Column | None = None, total: float | None = None, source: str = "source", power: float = 0.5) -> DataFrame:
    """source, rate: the mean number of copies of a document of that source.

    `weights` are target shares by source; sources without one have none. Without `weights`, a source's target is its
    size to the `power`, which lifts small sources. `size` is what a document adds (its characters by default), `total`
    the target sum of sizes (that of the input by default). A null source counts as one source of its own.
    """
    size = F.col("n_chars") if size is None else size
    own = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(F.coalesce(size, F.lit(0)).cast("double")).alias("own"))
    if weights is None:
        goal = F.pow("own", F.lit(power))
    else:
        table = docs.sparkSession.createDataFrame(list(weights.items()) or [("", 0.0)], "name string, weight double")
        table = F.broadcast(table) if len(weights) <= BROADCAST_SOURCES else table
        own = own.join(table, F.col("source").eqNullSafe(F.col("name")), "left")
        goal = F.coalesce("weight", F.lit(0.0))
    sums = own.withColumn("goal", F.when(F.col("own") > 0, goal).otherwise(0.0))
    over = sums.agg(F.sum("goal").alias("goals"), F.sum("own").alias("owns")).first()
    goals, whole = over["goals"] or 0.0, float(over["owns"] or 0.0) if total is None else float(total)
    if not goals:
        return sums.select("source", F.lit(0.0).alias("rate"))
    return sums.select("source", F.round(F.when(F.col("own") > 0, F.col("goal") / F.lit(goals) * F.lit(whole) / F.col("own")).otherwise(0.0), 9).alias("rate"))


def mix(docs: DataFrame, seed: int = 1, doc_id: str = "doc_id", source: str = "source", shuffle: bool = True, marks: bool = True, **target) -> DataFrame:
    """`docs` with each row as often as its Poisson number says, in the order of a hash of id, copy and seed.

    With `marks` the columns copy (from 0) and order_key (that hash) are added, and take the place of columns of these
    names; without, the columns are those of `docs`. Extra columns of any name pass through. Repeated rows with one id have
    one number of copies and each is repeated so. A null id has the key 'null'; a null text is a row like others. An empty
    table gives an empty table. The global order has no hot keys.
    """
    rate = rates(docs, source=source, **target)
    bounded = rate.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rate = F.broadcast(rate) if bounded else rate  # Spark splits the partitions of hot sources in that join
    own, at = numbered(docs)
    key = F.coalesce(F.col(at[doc_id]).cast("string"), F.lit("null"))
    joined = own.join(rate.toDF("rate_source", "rate"), F.col(at[source]).eqNullSafe(F.col("rate_source"))).drop("rate_source")
    copies = joined.withColumn("n", poisson(F.col("rate"), key, F.lit(str(seed)))).where("n > 0")
    out = copies.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n", "rate")
    out = out.withColumn("order_key", F.md5(F.concat_ws(":", key, F.col("copy").cast("string"), F.lit(f"order{seed}")).cast("binary")))
    if shuffle:
        # MD5 is uniform, so equal ranges of its first 24 bits need no sampling pass
        parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        place = F.floor(F.conv(F.substring("order_key", 1, 6), 16, 10).cast("long") * parts / F.lit(2**24)).cast("int")
        out = out.repartitionById(parts, place).sortWithinPartitions("order_key")
    if not marks:
        return out.select(*own.columns).toDF(*docs.columns)
    kept = [(n, c) for n, c in zip(own.columns, docs.columns) if c.lower() not in ("copy", "order_key")]
    return out.select(*(n for n, _ in kept), "copy", "order_key").toDF(*(c for _, c in kept), "copy", "order_key")
