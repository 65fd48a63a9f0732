"""Work on all pairs of two sets of vectors, in blocks and tiles of fixed size.

Vectors are dealt into blocks by a hash and packed into one row each. Blocks of both sides are dealt into groups, and every
group of the left meets every group of the right in one task, a tile: with g groups a vector travels g times, not once for
every block of the other side. Within a tile a kernel in numpy returns the few rows that matter of each pair of blocks, of
which only the best for each vector need leave the task. No pair of vectors is ever a row of its own, and the work of a task
does not depend on how the vectors are distributed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, and blocks of a group at most: a task holds a group of each side.
BLOCK, GROUP = 512, 32


def _pack(table: pa.Table) -> pa.Table:
    lists = table.column("vec").to_pylist()
    vec = np.array(lists, np.float64) if lists else np.zeros((0, 0))
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    extra = np.array(table.column("extra").to_pylist(), np.float64)
    return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "vecs": pa.array([vec[order].astype("<f8").tobytes()], pa.binary()), "extras": pa.array([extra[order].astype("<f8").tobytes()], pa.binary())})


def packed(points: DataFrame, id: str, vec: str, extra: str | None, blocks: int) -> DataFrame:
    slim = points.select(F.col(id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"), (F.lit(0.0) if extra is None else F.col(extra).cast("double")).alias("extra")).where("id is not null and vec is not null")
    keyed = slim.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return keyed.groupBy("block").applyInArrow(_pack, "block int, ids binary, vecs binary, extras binary")


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to rows, added up dimension by dimension, so that equal vectors have distance zero."""
    out = np.zeros(len(a))
    for d in range(a.shape[1] if a.ndim == 2 else 0):
        diff = a[:, d] - b[:, d]
        out += diff * diff
    return np.sqrt(out)


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """All squared distances from one matrix product, and a bound of their rounding error; infinite where there is none."""
    if not len(a) or not len(b) or a.ndim < 2 or not a.shape[1]:
        return np.zeros((len(a), len(b))), 0.0
    with np.errstate(invalid="ignore", over="ignore"):
        middle = np.where(np.isfinite(b), b, 0.0).mean(axis=0)  # near the points' middle, squares cancel least
        a, b = a - middle, b - middle
        u, v = np.einsum("id,id->i", a, a), np.einsum("id,id->i", b, b)
        out = u[:, None] + v[None, :] - 2.0 * (a @ b.T)
    finite = np.isfinite(out)
    slack = 1e-14 * a.shape[1] * (np.max(u[np.isfinite(u)], initial=0.0) + np.max(v[np.isfinite(v)], initial=0.0))
    return np.where(finite, np.maximum(out, 0.0), np.inf), float(slack)


def nearest(a: np.ndarray, ids: np.ndarray, b: np.ndarray, sq: np.ndarray, slack: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their k nearest columns of finite `sq` and the exact distances; equal distances go to the smaller id of `ids`."""
    k = min(k, sq.shape[1])
    if k < 1 or not len(sq):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    limit = np.partition(sq, k - 1, axis=1)[:, k - 1]
    x, y = np.nonzero((sq <= limit[:, None] + 2 * slack) & np.isfinite(sq))
    d = exact(a[x], b[y])
    order = np.lexsort((ids[y], d, x))
    x, y, d = x[order], y[order], d[order]
    rank = np.arange(len(x)) - np.searchsorted(x, x)
    keep = (rank < k) & np.isfinite(d)
    return x[keep], y[keep], d[keep]


def least(table: pa.Table, k: int) -> pa.Table:
    """Of rows i, j, dist, ... the k least of each i, by distance and then j."""
    if not table.num_rows:
        return table
    i, j, d = (table.column(c).to_numpy() for c in ("i", "j", "dist"))
    order = np.lexsort((j, d, i))
    i = i[order]
    return table.take(pa.array(order[np.arange(len(i)) - np.searchsorted(i, i) < k]))


Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table]


def meet(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str, id: str = "id", vec: str = "vec", extra: str | None = None, right_id: str | None = None, right_vec: str | None = None, best: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """Rows that kernel(left ids, left vectors, right ids, right vectors, right extras) gives for each pair of blocks.

    With `best`, only what it keeps of all rows of a left block in a tile leaves the task.
    """
    n, m = left.count(), right.count()
    x, y = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))
    side = math.isqrt(4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, cols = (max(-(-v // GROUP), min(v, side), 1) for v in (x, y))
    a = packed(left, id, vec, None, x).withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.pmod("block", F.lit(rows)) * cols + c)))
    b = packed(right, right_id or id, right_vec or vec, extra, y).withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * cols + F.pmod("block", F.lit(cols)))))
    dealt = a.withColumn("asks", F.lit(True)).unionByName(b.withColumn("asks", F.lit(False)))
    tiles = dealt.select("tile", "asks", "ids", "vecs", "extras").repartitionById(rows * cols, F.col("tile").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                held[row["asks"]].append((ids, np.frombuffer(row["vecs"], "<f8").reshape(len(ids), -1), np.frombuffer(row["extras"], "<f8")))
        for ids, vecs, _ in held[True]:
            found = (kernel(ids, vecs, *other) for other in held[False])
            if best is not None:
                own = list(found)
                found = iter([best(pa.concat_tables(own))] if own else [])
            for part in found:
                yield from part.to_batches()

    return tiles.drop("tile").mapInArrow(run, schema)


# Buckets ------------------------------------------------------------------------------------------------------------

#: Rows of a bucket's side that stay in one tile, parts that a larger one is cut into if they hold it, and MB of a part at most.
TILE, PARTS, TILE_MB = 4096, 4, 32

#: left ids, vectors and codes, right ids, vectors and codes, number of the table: the rows of a pair of blocks.
BucketKernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], pa.Table]


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def meet_in_buckets(left: DataFrame, right: DataFrame, kernel: BucketKernel, schema: str, dims: int) -> DataFrame:
    """Rows that the kernel gives for the pairs of blocks within each bucket.

    Both sides have bucket (string), part (int), id (long), vec (doubles) and codes (longs, of equal number). Large buckets
    are cut into tiles of bounded size, so that a task's memory and work do not depend on how rows are spread over buckets;
    no pair of rows is a row of its own unless the kernel returns it. Broadcast is one row a bucket of over `TILE` rows.
    """
    most = max(BLOCK, (TILE_MB << 20) // (8 * dims + 64))
    both = left.select("bucket", "part", "id", "vec", "codes", F.lit(True).alias("asks")).unionByName(right.select("bucket", "part", "id", "vec", "codes", F.lit(False).alias("asks")))
    parts = lambda n: F.greatest(F.ceil(F.col(n) / most), F.least(F.ceil(F.col(n) / TILE), F.lit(PARTS))).cast("int")
    large = both.groupBy("bucket").agg(F.count_if("asks").alias("n"), F.count_if(~F.col("asks")).alias("m")).where(F.greatest("n", "m") > TILE)
    large = large.select("bucket", F.greatest(parts("n"), F.lit(1)).alias("rows"), F.greatest(parts("m"), F.lit(1)).alias("cols"))
    rows, cols = F.coalesce("rows", F.lit(1)), F.coalesce("cols", F.lit(1))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("asks"), rows).otherwise(cols)).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("asks"), cols).otherwise(rows) - 1)
    dealt = both.join(F.broadcast(large), "bucket", "left").withColumn("own", own).withColumn("other", F.explode(other))
    tile = F.concat_ws("/", "bucket", F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")), F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")))
    tiles = dealt.select(tile.alias("tile"), "part", "asks", "id", "vec", "codes").repartition(4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile").sortWithinPartitions("tile", "asks")

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held)
        asks = table.column("asks").to_numpy()
        first, n = int(np.searchsorted(asks, True)), len(asks)
        if not 0 < first < n:
            return
        ids, vec, codes = table.column("id").to_numpy(), _matrix(table.column("vec"), n), _matrix(table.column("codes"), n)
        part = table.column("part")[0].as_py()
        for x in range(first, n, BLOCK):
            a = slice(x, min(n, x + BLOCK))
            for y in range(0, first, TILE):
                b = slice(y, min(first, y + TILE))
                yield kernel(ids[a], vec[a], codes[a], ids[b], vec[b], codes[b], part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.Table] = []
        held: list[pa.RecordBatch] = []
        size, name = 0, None

        def sent(table: pa.Table | None) -> Iterator[pa.RecordBatch]:
            nonlocal size
            if table is not None and table.num_rows:
                out.append(table)
                size += table.num_rows
            if out and (table is None or size >= 1 << 16):
                yield from pa.concat_tables(out).combine_chunks().to_batches(max_chunksize=1 << 16)
                out.clear()
                size = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column("tile").dictionary_encode()
            at = tile.indices.to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
            for s, e in zip(starts[:-1], starts[1:]):
                new = tile[int(s)].as_py()
                if held and new != name:
                    for table in solve(held):
                        yield from sent(table)
                    held = []
                name = new
                held.append(batch.slice(int(s), int(e - s)))
        if held:
            for table in solve(held):
                yield from sent(table)
        yield from sent(None)

    return tiles.mapInArrow(run, schema)
