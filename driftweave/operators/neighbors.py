"""Nearest-neighbour joins: exact, mutual, shared, by radius, to the nearest centre, and with hashed hyperplanes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import clip_radius
from ..plans.storage import written
from .blocks import exact, least, meet, meet_in_buckets, nearest, squares

EDGE = "i long, j long, dist double"


def _edges(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> pa.Table:
    return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "dist": pa.array(d, pa.float64())})


def _within(ids: np.ndarray, a: np.ndarray, r_ids: np.ndarray, b: np.ndarray, radius: float, out: np.ndarray | None = None) -> pa.Table:
    """i, j, dist of all rows and columns within the radius, but for the pairs marked in `out`."""
    sq, slack = squares(a, b)
    if out is not None:
        sq[out] = np.inf
    x, y = np.nonzero(sq <= radius * radius * (1 + 1e-12) + slack)
    d = exact(a[x], b[y])
    keep = d <= radius
    return _edges(ids[x[keep]], r_ids[y[keep]], d[keep])


def knn(points: DataFrame, k: int, id: str = "id", vec: str = "vec") -> DataFrame:
    """i, j, rank, dist: the k exact nearest others of each point; equal distances go to the smaller id.

    A point is never its own neighbour, but an equal point with another id is one. With fewer than k others all are neighbours.
    """

    def kernel(ids: np.ndarray, a: np.ndarray, r_ids: np.ndarray, b: np.ndarray, _: np.ndarray) -> pa.Table:
        sq, slack = squares(a, b)
        sq[ids[:, None] == r_ids[None, :]] = np.inf
        x, y, d = nearest(a, r_ids, b, sq, slack, k)
        return _edges(ids[x], r_ids[y], d)

    near = meet(points, points, kernel, EDGE, id, vec, best=lambda t: least(t, k))
    rank = F.row_number().over(W.partitionBy("i").orderBy("dist", "j"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("i", "j", "rank", "dist")


def mutual_knn(edges: DataFrame) -> DataFrame:
    """The edges (i, j, dist) whose reverse is an edge too."""
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return edges.join(back, ["i", "j"], "left_semi").select("i", "j", "dist")


def tight_scores(points: DataFrame, mutual: DataFrame, id: str = "id") -> DataFrame:
    """i, n_tight, score: mean distance to the mutual neighbours over their number squared; null without any (infinite)."""
    own = mutual.groupBy("i").agg(F.count("*").alias("n"), F.avg("dist").alias("mean"))
    return points.select(F.col(id).alias("i")).join(own, "i", "left").select("i", F.coalesce("n", F.lit(0)).cast("long").alias("n_tight"), (F.col("mean") / (F.col("n") * F.col("n"))).alias("score"))


def outliers(scores: DataFrame, alpha: float = 1.0) -> DataFrame:
    """i, n_tight, score, is_outlier: the score is over the mean plus alpha population deviations, or there is none."""
    limit = scores.agg((F.avg("score") + F.lit(float(alpha)) * F.stddev_pop("score")).alias("theta"))
    theta = limit.first()["theta"]  # one number
    over = F.lit(True) if theta is None else F.coalesce(F.col("score") > F.lit(theta), F.lit(True))
    return scores.withColumn("is_outlier", over)


def shared_neighbors(edges: DataFrame, least: int) -> DataFrame:
    """i, j, shared (array), for directed edges whose lists share at least so many neighbours. Lists have k entries at most."""
    lists = edges.groupBy("i").agg(F.sort_array(F.collect_set("j")).alias("list"))
    other = lists.select(F.col("i").alias("j"), F.col("list").alias("other"))
    both = edges.select("i", "j").join(lists, "i").join(other, "j")
    return both.select("i", "j", F.array_intersect("list", "other").alias("shared")).where(F.size("shared") >= least)


def shared_radius(points: DataFrame, k: int = 5, r_max: float = 0.5, tk: int = 5, mk: int = 4, id: str = "id", vec: str = "vec") -> DataFrame:
    """One row: n_pairs, max_dist, radius. The greatest distance to a shared neighbour, or r_max with too few qualifying pairs."""
    edges = written(knn(points, k, id, vec), "knn")
    pairs = shared_neighbors(edges, tk)
    steps = pairs.select("i", F.explode("shared").alias("j")).join(edges.select("i", "j", "dist"), ["i", "j"])  # a shared neighbour is a neighbour
    longest = steps.agg(F.max("dist").alias("max_dist"))
    count = pairs.agg(F.count("*").alias("n_pairs"))
    radius = F.when(F.col("n_pairs") < mk, F.lit(float(r_max))).otherwise(clip_radius(F.coalesce("max_dist", F.lit(0.0)), r_max))
    return count.withColumn("one", F.lit(1)).join(longest.withColumn("one", F.lit(1)), "one").select("n_pairs", "max_dist", radius.alias("radius"))


def range_join(points: DataFrame, radius: float, others: DataFrame | None = None, id: str = "id", vec: str = "vec") -> DataFrame:
    """i, j, dist of all pairs within the radius, its border and a point with itself included."""

    def kernel(ids: np.ndarray, a: np.ndarray, r_ids: np.ndarray, b: np.ndarray, _: np.ndarray) -> pa.Table:
        return _within(ids, a, r_ids, b, radius)

    return meet(points, points if others is None else others, kernel, EDGE, id, vec)


def grid_range_join(points: DataFrame, radius: float, dims: int, id: str = "id", vec: str = "vec") -> DataFrame:
    """As range_join for few dimensions: points meet only in neighbouring cells of a grid as wide as the radius, cut into tiles."""
    slim = points.select(F.col(id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    width = radius * (1 + 1e-9)  # so that rounding puts no pair two cells apart
    cell = lambda d: F.floor(F.col("vec")[d] / width)
    bucket = lambda cells: F.concat_ws(",", *(c.cast("string") for c in cells))
    names = ("part", "id", "vec", "codes")
    plain = slim.withColumn("part", F.lit(0)).withColumn("codes", F.array().cast("array<long>"))
    held = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    plain = plain.where((F.size("vec") >= dims) & held)
    left = plain.select(bucket([cell(d) for d in range(dims)]).alias("bucket"), *names)
    right = plain
    for d in range(dims):
        right = right.withColumn(f"_{d}", F.explode(F.array(*(cell(d) + s for s in (-1, 0, 1)))))
    right = right.select(bucket([F.col(f"_{d}") for d in range(dims)]).alias("bucket"), *names)

    def kernel(ids: np.ndarray, a: np.ndarray, _: np.ndarray, r_ids: np.ndarray, b: np.ndarray, __: np.ndarray, ___: int) -> pa.Table:
        return _within(ids, a, r_ids, b, radius)

    return meet_in_buckets(left, right, kernel, EDGE, dims)


def nearest_center(points: DataFrame, centers: DataFrame, bound: str | float | None = None, id: str = "id", vec: str = "vec", center_id: str = "id", center_vec: str = "vec") -> DataFrame:
    """i, j, dist, accepted: the nearest centre of each point, ties to the smaller centre id, and whether it is within the bound.

    `bound` is a column of the centres, a number, or None for no bound. Only the nearest centre counts, even where a
    farther one would hold the point. Without centres there are no rows.
    """

    def kernel(ids: np.ndarray, a: np.ndarray, r_ids: np.ndarray, b: np.ndarray, extra: np.ndarray) -> pa.Table:
        if not len(r_ids) or not len(ids):
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "dist": pa.array([], pa.float64()), "bound": pa.array([], pa.float64())})
        sq, slack = squares(a, b)
        x, y, d = nearest(a, r_ids, b, sq, slack, 1)
        return pa.table({"i": pa.array(ids[x]), "j": pa.array(r_ids[y]), "dist": pa.array(d), "bound": pa.array(extra[y])})

    near = meet(points, centers, kernel, "i long, j long, dist double, bound double", id, vec, bound if isinstance(bound, str) else None, center_id, center_vec, lambda t: least(t, 1))
    best = near.groupBy("i").agg(F.min(F.struct("dist", "j", "bound")).alias("m")).select("i", "m.j", "m.dist", "m.bound")
    limit = F.col("bound") if isinstance(bound, str) else F.lit(float("inf") if bound is None else float(bound))
    return best.select("i", "j", "dist", (F.col("dist") <= limit).alias("accepted"))


def attach_to_macro(micro: DataFrame, id: str = "id", vec: str = "vec", radius: str = "radius", macro: str = "macro_id") -> DataFrame:
    """i, j, dist, macro_id: micro-clusters without a macro (-1) join that of the nearest assigned one within twice its radius."""
    free = micro.where(F.col(macro) == -1)
    held = micro.where(F.col(macro) >= 0).withColumn("_bound", 2 * F.col(radius))
    found = nearest_center(free, held, "_bound", id, vec, id, vec)
    names = held.select(F.col(id).alias("j"), F.col(macro).alias("name"))
    return found.join(names, "j").select("i", "j", "dist", F.when(F.col("accepted"), F.col("name")).otherwise(F.lit(-1)).cast("long").alias("macro_id"))


# Hashed hyperplanes -------------------------------------------------------------------------------------------------


def planes(dims: int, tables: int = 3, hashes: int = 10, seed: int = 42) -> np.ndarray:
    """tables x hashes x dims normal numbers of the legacy generator."""
    return np.random.RandomState(seed).randn(tables, hashes, dims)


def lsh_keys(points: DataFrame, normal: np.ndarray, id: str = "id", vec: str = "vec") -> DataFrame:
    """idx, tbl, key: for each table the string of bits that tell on which side of each plane a point lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("vec").to_pylist(), np.float64)
            if not len(x):
                continue
            bits = np.einsum("nd,thd->nth", x, normal) > 0
            keys = ["".join("1" if b else "0" for b in row) for row in bits.reshape(-1, normal.shape[1])]
            n, t = len(x), normal.shape[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(zero_copy_only=False), t)), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(keys)], names=["idx", "tbl", "key"])

    return points.select(F.col(id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec is not null").mapInArrow(run, "idx long, tbl int, key string")


def lsh_insert(index: DataFrame, points: DataFrame, normal: np.ndarray, id: str = "id", vec: str = "vec") -> DataFrame:
    """An index with more points."""
    return index.unionByName(lsh_keys(points, normal, id, vec))


def lsh_candidates(index: DataFrame, queries: DataFrame, normal: np.ndarray, id: str = "id", vec: str = "vec") -> DataFrame:
    """q, j: indexed points that share a bucket with a query in some table."""
    asked = lsh_keys(queries, normal, id, vec).withColumnRenamed("idx", "q")
    return asked.join(index, ["tbl", "key"]).select("q", F.col("idx").alias("j")).distinct()


def _hashed(points: DataFrame, normal: np.ndarray, id: str, vec: str) -> DataFrame:
    """id, vec, codes: the keys of a point in all tables, each as numbers of up to 62 bits."""
    tables, hashes, dims = normal.shape
    words = -(-hashes // 62)
    powers = np.zeros((hashes, words), np.int64)
    powers[np.arange(hashes), np.arange(hashes) // 62] = np.int64(1) << (np.arange(hashes) % 62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                codes = ((np.einsum("nd,thd->nth", x, normal) > 0).astype(np.int64) @ powers).reshape(-1)
                ends = np.arange(n + 1, dtype=np.int32) * (tables * words)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(codes))], names=["id", "vec", "codes"])

    own = points.select(F.col(id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    return written(own.mapInArrow(run, "id long, vec array<double>, codes array<long>"), "hashed")


def _in_tables(hashed: DataFrame, normal: np.ndarray) -> DataFrame:
    """A row for each table, for `meet_in_buckets`."""
    words = -(-normal.shape[1] // 62)
    own = hashed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(normal.shape[0] - 1))))
    return own.withColumn("bucket", F.concat_ws(":", F.col("part").cast("string"), F.slice("codes", F.col("part") * words + 1, F.lit(words)).cast("array<string>")))


def _met_before(codes: np.ndarray, r_codes: np.ndarray, part: int, words: int) -> np.ndarray:
    """The pairs that share a bucket in a table before this one."""
    out = np.zeros((len(codes), len(r_codes)), bool)
    for t in range(part):
        same = np.ones_like(out)
        for w in range(t * words, (t + 1) * words):
            same &= codes[:, w][:, None] == r_codes[:, w][None, :]
        out |= same
    return out


def lsh_range(points: DataFrame, queries: DataFrame, radius: float, normal: np.ndarray, id: str = "id", vec: str = "vec") -> DataFrame:
    """q, j, dist of candidates within the radius; queries without a candidate are compared with all points.

    Candidates are compared in tiles of their buckets, each pair in the first table that it shares. Ids are unique.
    """
    words = -(-normal.shape[1] // 62)
    held = _in_tables(_hashed(points, normal, id, vec), normal)
    asked = held if queries is points else _in_tables(_hashed(queries, normal, id, vec), normal)

    def kernel(ids: np.ndarray, a: np.ndarray, codes: np.ndarray, r_ids: np.ndarray, b: np.ndarray, r_codes: np.ndarray, part: int) -> pa.Table:
        return _within(ids, a, r_ids, b, radius, _met_before(codes, r_codes, part, words))

    near = meet_in_buckets(asked, held, kernel, EDGE, normal.shape[2])
    if queries is points:
        return near.toDF("q", "j", "dist")  # each is a candidate of its own
    found = asked.join(held.select("bucket").distinct(), "bucket", "left_semi").select(F.col("id").alias(id)).distinct()
    lost = queries.join(found, id, "left_anti")
    return near.unionByName(range_join(lost, radius, points, id, vec)).toDF("q", "j", "dist")


def lsh_knn(points: DataFrame, queries: DataFrame, k: int, normal: np.ndarray, id: str = "id", vec: str = "vec") -> DataFrame:
    """q, j, rank, dist: the k nearest candidates that are not equal to the query.

    Queries with fewer than k candidates (themselves included) are compared with all points. k is one less than the
    number of points at most; with fewer neighbours than k there are fewer rows. Candidates are compared in tiles of their
    buckets, each pair in the first table that it shares; only the k best of a tile leave it. Ids are unique.
    """
    k = min(k, max(0, points.count() - 1))
    words = -(-normal.shape[1] // 62)
    held = _in_tables(_hashed(points, normal, id, vec), normal)
    asked = held if queries is points else _in_tables(_hashed(queries, normal, id, vec), normal)

    def apart(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        sq, slack = squares(a, b)
        if out is not None:
            sq[out] = np.inf
        x, y = np.nonzero(sq <= 4 * slack)
        same = exact(a[x], b[y]) == 0
        sq[x[same], y[same]] = np.inf
        return sq, slack

    def kernel(ids: np.ndarray, a: np.ndarray, codes: np.ndarray, r_ids: np.ndarray, b: np.ndarray, r_codes: np.ndarray, part: int) -> pa.Table:
        out = _met_before(codes, r_codes, part, words)
        sq, slack = apart(a, b, out)
        x, y, d = nearest(a, r_ids, b, sq, slack, k)
        ends = np.searchsorted(x, np.arange(len(ids) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (r_ids[y], d)]
        return pa.table({"q": pa.array(ids), "n": pa.array(len(r_ids) - out.sum(axis=1, dtype=np.int64)), "js": lists[0], "ds": lists[1]})

    found = written(meet_in_buckets(asked, held, kernel, "q long, n long, js array<long>, ds array<double>", normal.shape[2]), "candidates")
    enough = written(found.groupBy("q").agg(F.sum("n").alias("n")).where(F.col("n") >= k).select("q"), "enough")
    near = found.where(F.size("js") > 0).join(enough, "q", "left_semi").select("q", F.explode(F.arrays_zip("js", "ds")).alias("r")).select("q", F.col("r.js").alias("j"), F.col("r.ds").alias("dist"))
    few = queries.join(enough.select(F.col("q").alias(id)), id, "left_anti")

    def full(ids: np.ndarray, a: np.ndarray, r_ids: np.ndarray, b: np.ndarray, _: np.ndarray) -> pa.Table:
        x, y, d = nearest(a, r_ids, b, *apart(a, b), k)
        return _edges(ids[x], r_ids[y], d)

    all_of = meet(few, points, full, EDGE, id, vec, best=lambda t: least(t, k)).toDF("q", "j", "dist")
    rank = F.row_number().over(W.partitionBy("q").orderBy("dist", "j"))
    return near.unionByName(all_of).withColumn("rank", rank).where(F.col("rank") <= k).select("q", "j", "rank", "dist")
