"""Connected components of a graph given by its links, for graphs that only the cluster can hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch, written

#: Graphs of at most so many links are solved by one task; larger ones in rounds. Both give the same.
ONE_TASK = 200_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least node of each component by repeated minima over the links of one task."""
    held = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = held.column("u").to_numpy(), held.column("v").to_numpy()
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        np.minimum.at(new, root, new.copy())  # what a node has found goes to its root too
        new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node of a link, the least node of its component."""
    if dict(links.dtypes)[a] == "bigint" and dict(links.dtypes)[b] == "bigint":
        with Scratch(links.sparkSession) as scratch:
            links = written(links.select(a, b), "links")
            if links.count() <= ONE_TASK:
                return scratch.keep(written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").coalesce(1).mapInArrow(_solve, "node long, root long"), "roots"))
            return scratch.keep(in_rounds(links, a, b))
    return in_rounds(links, a, b)


def in_rounds(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """As `components`, for nodes of any type that has an order, and always spread over the cluster.

    Each round gives a node the least root among its neighbours' and then that root's own root, so that the number of
    rounds grows with the logarithm of a component's diameter. Every round is written to the shared folder.
    """
    with Scratch(links.sparkSession) as scratch:
        both = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "links")
        roots = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "roots")
        for _ in range(rounds):
            seen = both.join(roots.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
            near = roots.join(seen.select(F.col("u").alias("node"), "r"), "node").select("node", "root", F.least("root", "r").alias("best"))
            # what a node's neighbours have goes to the node's root too
            told = near.where("best < root").groupBy(F.col("root").alias("node")).agg(F.min("best").alias("hook"))
            # written, so that both sides of the next join are plain shuffles: Spark splits a hot root's partition there
            hooked = written(near.join(told, "node", "left").select("node", "root", F.least("best", F.coalesce("hook", "best")).alias("best")), "hooked")
            jump = hooked.select(F.col("node").alias("best"), F.col("best").alias("over"))
            least = F.least("best", F.coalesce("over", "best"))
            new = written(hooked.join(jump, "best", "left").select("node", least.alias("root"), (least < F.col("root")).alias("moved")), "roots")
            scratch.drop(hooked)
            scratch.drop(roots)
            roots = new
            if not new.where("moved").limit(1).count():
                out = scratch.keep(new).select("node", "root")
                out._written_at = new._written_at
                return out
    raise RuntimeError(f"components did not settle in {rounds} rounds")
