"""Exact top-k inner products over integer vectors by MaxScore.

A vector's component is a term; a shard's postings of a term hold its values, stored term by term. Per shard and query,
the bounds of a term's contribution come from the least and the largest value. Terms in order of their bounds split into
essential ones and a tail whose bounds together cannot lift a vector to the threshold. Essential postings are traversed for
all vectors of the shard; the others are probed, a few terms at a time, only for vectors that can still get into the top k.
Each shard gives k rows for a query; a task merges those of its shards, and what the tasks give is merged again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import narrow

#: Vectors of a shard and queries of a block; shards and blocks of queries of a tile at most.
SHARD_ROWS, QUERY_ROWS, SHARD_GROUP, QUERY_GROUP = 4096, 256, 64, 256
#: Vectors that a shard scores in full first, for a threshold; terms that are probed at a time.
LEAD, PROBE = 256, 8


def quantized(vectors: DataFrame, factor: int = 64, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """vec_id, v: floor(factor * x) of the components as longs, which end where longs do.

    Rows with a null id, a null vector or a null or non-finite component are left out; extra columns of any name too.
    """
    own = narrow(vectors, vec_id=vec_id, v=vec).select("vec_id", F.col("v").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return own.where(finite).select("vec_id", F.transform("v", lambda x: F.floor(x * factor).cast("long")).alias("v"))


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """One row for all vectors of a block: ids, and the values term by term; missing components are zero."""
    lists = table.column("v").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    sizes = np.diff(np.asarray(lists.offsets))
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "width": pa.array([width], pa.int32()), "terms": pa.array([_narrowed(out[order].T)], pa.binary())})


def _narrowed(values: np.ndarray) -> bytes:
    """The values as the smallest integers that hold them all."""
    most = max(int(values.max()), -int(values.min())) if values.size else 0
    return np.ascontiguousarray(values, "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _opened(raw: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // max(1, width * n) or 2}").reshape(width, n).astype(np.int64)


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).groupBy("block").applyInArrow(_pack, "block int, ids binary, width int, terms binary")


def bounds(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest and the least value of each term of a shard."""
    return (terms.max(axis=1), terms.min(axis=1)) if terms.shape[1] else (np.zeros(len(terms), np.int64),) * 2


def _kind(hi: np.ndarray, lo: np.ndarray, queries: np.ndarray) -> type | None:
    """The fastest type of numbers in which all sums of products are exact; None where even a long may not hold them."""
    size = lambda v, w: max(1.0, float(v.max(initial=0)), -float(w.min(initial=0)))
    most = len(hi) * size(hi, lo) * size(queries, queries)
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else None


def search(terms: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, held: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of a shard for one query, ties to the smaller id; `own` is left out. `ids` ascend.

    `held` are the shard's bounds, and its terms have the type of `_kind` then.
    """
    width, n = terms.shape
    if held is None:
        held = bounds(terms)
        kind = _kind(*held, query)
        if kind is None:
            return _search_wide(terms, ids, query, own, k)
        terms = terms.astype(kind)
    exact = np.int64 if terms.dtype == np.int64 else np.float64  # of sums over terms
    q = np.zeros(width, terms.dtype)
    q[: min(width, len(query))] = query[:width]
    hi, lo, wide = held[0].astype(exact), held[1].astype(exact), q.astype(exact)
    upper, lower = np.maximum(wide * hi, wide * lo), np.minimum(wide * hi, wide * lo)
    order = np.argsort(lower - upper, kind="stable")
    order = order[q[order] != 0]
    after = np.concatenate((np.cumsum(upper[order][::-1])[::-1], [0]))  # the most that terms from here on can add
    used = ids != own
    lead = np.flatnonzero(used)[:LEAD]
    scores = q[order] @ terms[np.ix_(order, lead)] if len(order) else np.zeros(len(lead), terms.dtype)
    floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None
    if floor is None:
        at = lead
    else:
        # essential: the shortest head of terms behind which no score from the tail alone, over the head's least, reaches the floor
        spread = upper[order] - lower[order]
        tail = np.concatenate((np.cumsum(spread[::-1])[::-1], [0]))
        essential = int(np.argmax(tail + lower[order].sum() < floor)) if (tail + lower[order].sum() < floor).any() else len(order)
        head = order[:essential]
        at = np.flatnonzero(used)
        part = q[head] @ terms[head] if essential else np.zeros(n, terms.dtype)
        part = part[at]
        step = essential
        while step < len(order):
            alive = part + after[step] >= floor
            at, part = at[alive], part[alive]
            probe = order[step : step + PROBE]
            part = part + q[probe] @ terms[np.ix_(probe, at)]
            step += PROBE
            if len(at) > 4 * k and step < len(order):
                # what is sure of the k-th best so far lifts the floor
                rest = lower[order[step:]].sum()
                floor = max(floor, np.partition(part, len(part) - k)[len(part) - k] + rest)
        keep = part >= floor
        at, scores = at[keep], part[keep]
    best = np.lexsort((ids[at], -scores))[:k]
    return ids[at[best]], scores[best].astype(np.int64)


def _search_wide(terms: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As `search`, for values whose products may leave the range of a long: exact sums, which end where longs do."""
    width = min(len(terms), len(query))
    sums = query[:width].astype(object) @ terms[:width].astype(object)
    scores = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in sums], np.int64)
    at = np.flatnonzero(ids != own)
    best = np.array(sorted(at.tolist(), key=lambda i: (-int(scores[i]), int(ids[i])))[:k], np.int64)
    return ids[best], scores[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all vectors but those of its own id.

    Both inputs have vec_id and v (see `quantized`). Ties go to the smaller vec_id; with fewer than k vectors all come. An
    empty input gives no rows. Of rows that share an id each is a candidate of the others, and each is a query of its own,
    with k rows of its own. Scores beyond a long end where longs do. Shards and blocks of queries are dealt into groups, and
    each pair of groups meets in one task, a tile, which only a query's k best of the tile leave. Nothing is broadcast.
    """
    n, m = vectors.count(), queries.count()
    shards, asked = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // QUERY_ROWS))
    side = math.isqrt(4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cols = min(shards, max(side, -(-shards // SHARD_GROUP)))
    # with few queries, the shards are dealt into more groups, so that there are tasks enough
    rows = min(asked, max(side, -(-asked // QUERY_GROUP)))
    cols = min(shards, max(cols, -(-side * side // rows)))
    rows = min(asked, max(rows, -(-side * side // cols)))
    left = _blocks(vectors, shards).withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * cols + F.pmod("block", F.lit(cols)))))
    right = _blocks(queries, asked).withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.pmod("block", F.lit(rows)) * cols + c)))
    dealt = left.withColumn("asks", F.lit(False)).unionByName(right.withColumn("asks", F.lit(True)))
    tiles = dealt.repartitionById(rows * cols, F.col("tile").cast("int")).select("block", "asks", "ids", "width", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {True: [], False: []}
        for batch in batches:
            for x in batch.to_pylist():
                held[x["asks"]].append((x["block"], np.frombuffer(x["ids"], "<i8"), x["width"], x["terms"]))
        best: dict[int, list[tuple]] = {}  # of a block of queries: the k best so far of each
        for _, ids, width, raw in held[False]:
            terms = _opened(raw, width, len(ids))
            edges = bounds(terms)
            typed = {}
            for block, q_ids, q_width, q_raw in held[True]:
                asked_terms = _opened(q_raw, q_width, len(q_ids))
                kind = _kind(*edges, asked_terms)
                if kind not in typed:
                    typed[kind] = terms if kind is None else terms.astype(kind)
                found = [search(typed[kind], ids, asked_terms[:, i], int(q), k, None if kind is None else edges) for i, q in enumerate(q_ids)]
                best[block] = [_merged(a, b, k) for a, b in zip(best[block], found)] if block in best else found
        for block, q_ids, _, _ in held[True]:
            found = best.get(block, [])
            sizes = [len(f[0]) for f in found]
            if sum(sizes):
                place = (block << 32) + np.arange(len(q_ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(place, sizes)), pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))], names=["query", "query_id", "vec_id", "score"])

    found = tiles.mapInArrow(run, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two results of `search`."""
    ids, scores = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    at = np.lexsort((ids, ~scores))[:k]
    return ids[at], scores[at]
