"""Batch clustering over neighbour graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import written
from . import neighbors
from .components import components


def dense_labels(roots: DataFrame) -> DataFrame:
    """node, label: components numbered from 0 in the order of their least node. Only one row a component is ordered in one place."""
    names = roots.select("root").distinct().withColumn("label", F.dense_rank().over(W.orderBy("root")).cast("long") - 1)
    return roots.join(names, "root").select("node", "label")


def tight_clusters(points: DataFrame, k: int, alpha: float = 1.0, id: str = "id", vec: str = "vec") -> DataFrame:
    """i, label: components of the mutual-neighbour graph without its outliers, numbered by their least id; outliers have -1."""
    mutual = written(neighbors.mutual_knn(neighbors.knn(points, k, id, vec)), "mutual")
    marked = written(neighbors.outliers(neighbors.tight_scores(points, mutual, id), alpha), "marked")
    good = marked.where("not is_outlier").select("i")
    links = mutual.join(good, "i", "left_semi").join(good.select(F.col("i").alias("j")), "j", "left_semi").select(F.col("i").alias("a"), F.col("j").alias("b"))
    alone = good.select(F.col("i").alias("a"), F.col("i").alias("b"))  # a point whose neighbours are all outliers is a component
    labels = dense_labels(components(links.unionByName(alone)))
    return marked.join(labels.withColumnRenamed("node", "i"), "i", "left").select("i", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


def dbscan(points: DataFrame, eps: float, min_samples: int = 5, id: str = "id", vec: str = "vec") -> DataFrame:
    """i, label, is_core: clusters numbered by their least core point; border points take the least cluster near them; noise is -1."""
    near = written(neighbors.range_join(points, eps, None, id, vec).select("i", "j"), "near")
    core = written(near.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("i"), "core")
    links = near.join(core, "i", "left_semi").join(core.select(F.col("i").alias("j")), "j", "left_semi")
    labels = dense_labels(components(links, "i", "j"))
    reach = near.join(labels.select(F.col("node").alias("j"), "label"), "j").groupBy("i").agg(F.min("label").alias("near"))
    own = points.select(F.col(id).alias("i")).join(labels.withColumnRenamed("node", "i"), "i", "left").join(reach, "i", "left")
    return own.select("i", F.coalesce("label", "near", F.lit(-1)).cast("long").alias("label"), F.col("label").isNotNull().alias("is_core"))


def cluster_summary(points: DataFrame, label: str = "label", vec: str = "vec", dims: int | None = None, scale: float = 1.1) -> DataFrame:
    """label, n, center, radius: mean of each cluster, and its 95th percentile distance (interpolated) times `scale`."""
    dims = dims or points.select(F.size(vec)).first()[0]
    from ..functions.vectors import centroid, l2_distance

    own = points.where(F.col(label) >= 0).select(F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    means = own.groupBy("label").agg(F.count("*").alias("n"), centroid(F.col("vec"), dims).alias("center"))
    far = own.join(means, "label").withColumn("d", l2_distance(F.col("vec"), F.col("center")))
    wide = far.groupBy("label").agg((F.greatest(F.percentile("d", F.lit(0.95)), F.lit(1e-6)) * scale).alias("radius"))
    return means.join(wide, "label")


def largest_group(labels: DataFrame, label: str = "label") -> DataFrame:
    """label, n: the cluster with the most members, the lower label of equal ones; no row without clusters. -1 is none."""
    sizes = labels.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.struct(F.col("n"), (-F.col(label)).alias("back"))).alias("m")).where("m is not null")
    return best.select((-F.col("m.back")).cast("long").alias("label"), F.col("m.n").alias("n"))


def greedy_cover(points: DataFrame, radius: float | None = None, least: int = 5, group: str = "stream", order: str = "seq", vec: str = "vec", r_max: float = 0.15, snn_k: int = 5, tk: int = 3, mk: int = 2) -> DataFrame:
    """group, seq, cover: points in order claim all unclaimed points within the radius if there are enough; others have -1.

    The claim order matters, so each group's pool is folded in one task; a pool is what one stream holds back. The task holds
    the pool's points, but distances of a block of them only.
    """
    from ..streaming.clusterer import cover, shared_radius_of

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order).select([group, order, vec])
        lists = table.column(vec).combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)
        owner = np.full(len(x), -1, np.int64)
        if len(x) >= least:
            r = shared_radius_of(x, min(snn_k, len(x) - 1), r_max, tk, mk) if radius is None else radius
            for c, members in enumerate(cover(x, r, least)):
                owner[members] = c
        return table.select([group, order]).append_column("cover", pa.array(owner))

    kinds = dict(points.dtypes)
    return points.select(group, order, vec).groupBy(group).applyInArrow(run, f"{group} {kinds[group]}, {order} {kinds[order]}, cover long")
