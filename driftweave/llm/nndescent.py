"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from random-projection blocks and is refined by joins of neighbours with neighbours' neighbours.
Links are the graph's edges of at least the threshold. Where a vector's list holds links only, the list is too short: it is
doubled before the last refinement. Vectors whose lists are still full then belong to groups that no list of fixed size can
hold: all vectors of their components are compared in blocks, which counts their links and may join components.
An audit compares the links of a sample with brute force; while its recall is too low, more projections and refinements
follow, and after the last of them all pairs of each label, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import in_rounds as components
from .common import Scratch, narrow, written

#: Neighbours kept for a vector, and taken of those that name it; tables of projections; vectors of a block.
LIST, BACK, TABLES, BLOCK = 8, 4, 10, 512
ROUNDS, AUDIT_ROWS, AUDIT_RECALL, AUDITS = 2, 256, 0.999, 4
#: Below the threshold by so much, a nearest neighbour makes its node one that the audit asks for.
AUDIT_MARGIN = 0.05


def nodes(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """node, label, vec (unit vector in double precision, as bytes), ids: one row for all equal vectors of a label.

    Vectors that are null, zero or hold a null or non-finite component, and those without a label, have no node.
    """
    own = narrow(vectors, vec_id=vec_id, vec=vec, label=label).select("vec_id", "label", F.col("vec").cast("array<double>").alias("vec"))
    sound = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vec", lambda x: x != 0)
    same = own.where(sound).groupBy("label", "vec").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("vec"):
                v = np.array(x.as_py(), np.float64)
                v = v / np.abs(v).max()
                out.append((v / np.sqrt((v * v).sum())).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("copies"), pa.array(out, pa.binary())], names=["node", "label", "copies", "vec"])

    slim = same.select("node", "label", "copies", "vec")
    return slim.mapInArrow(pack, slim.select("node", "label", "copies", F.lit(None).cast("binary").alias("vec")).schema)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors as rows; shorter ones end in zeros, so that vectors of different lengths stay comparable."""
    raw = column.to_pylist()
    if len({len(x) for x in raw}) == 1:
        return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    width = max(map(len, raw), default=0)
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), "<f8").reshape(len(raw), -1)


def _best(ids: np.ndarray, vec: np.ndarray, k: int) -> pa.Table:
    """The k nearest others of each vector of a block."""
    n = len(ids)
    if n < 2:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})
    dots = vec @ vec.T
    np.fill_diagonal(dots, -2.0)
    k = min(k, n - 1)
    at = np.argpartition(-dots, k - 1, axis=1)[:, :k]
    return pa.table({"u": pa.array(np.repeat(ids, k)), "v": pa.array(ids[at].ravel()), "cos": pa.array(np.take_along_axis(dots, at, 1).ravel())})


def _start(own: DataFrame, seed: int, tables: int) -> DataFrame:
    """Edges within blocks of vectors on the same side of random planes; large buckets are dealt out into blocks."""
    sizes = own.groupBy("label").agg(F.count("*").alias("n"))
    sized = own.join(sizes, "label")  # a row for each label; Spark splits a hot label's partition

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = _matrix(batch.column("vec"))
            d = vec.shape[1]
            if d not in planes:
                planes[d] = np.random.RandomState(seed).randn(d, tables * 40)
            side = (vec @ planes[d] > 0).reshape(len(vec), tables, 40)
            bits = np.clip(np.ceil(np.log2(np.maximum(batch.column("n").to_numpy(), 1) / 128)), 0, 40).astype(int)
            inside = np.arange(40)[None, :] < bits[:, None]
            key = ((side & inside[:, None, :]) * (1 << np.arange(40, dtype=np.int64))).sum(axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1, dtype=np.int32) * tables), pa.array(key.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), lists], names=["node", "label", "keys"])

    slim = sized.select("node", "label", "vec", "n")
    keyed = slim.mapInArrow(cut, slim.select("node", "label", F.lit(None).cast("array<long>").alias("keys")).schema)
    placed = keyed.select("node", "label", F.posexplode("keys").alias("t", "key"))
    counts = placed.groupBy("label", "t", "key").agg(F.count("*").alias("m"))
    block = F.pmod(F.xxhash64("node", F.col("t"), F.lit(seed)), F.ceil(F.col("m") / BLOCK)).cast("int")
    dealt = placed.join(counts, ["label", "t", "key"]).withColumn("block", block).join(own.select("node", "vec"), "node")

    def near(table: pa.Table) -> pa.Table:
        return _best(table.column("node").to_numpy(), _matrix(table.column("vec")), LIST)

    return dealt.select("label", "t", "key", "block", "node", "vec").groupBy("label", "t", "key", "block").applyInArrow(near, "u long, v long, cos double")


def _lists(edges: DataFrame, k: int = LIST, wide: DataFrame | None = None) -> DataFrame:
    """The k best distinct neighbours of each node; `wide` has other numbers (u, k) for some nodes."""
    one = edges.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    ranked = one.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("cos"), "v")))
    if wide is None:
        return ranked.where(F.col("r") <= k).drop("r")
    return ranked.join(wide, "u", "left").where(F.col("r") <= F.coalesce("k", F.lit(k))).drop("r", "k")


def _full(graph: DataFrame, threshold: float, wide: DataFrame | None) -> DataFrame:
    """u, k: nodes whose list of k neighbours holds links only."""
    n = graph.where(F.col("cos") >= threshold).groupBy("u").agg(F.count("*").alias("n"))
    sized = n.withColumn("k", F.lit(LIST)) if wide is None else n.join(wide, "u", "left").withColumn("k", F.coalesce("k", F.lit(LIST)))
    return sized.where(F.col("n") >= F.col("k")).select("u", "k")


def _widened(graph: DataFrame, own: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """The graph after a refinement for which full lists were doubled, and the sizes (u, k) of these."""
    wide = written(_full(graph, threshold, None).select("u", (2 * F.col("k")).alias("k")), "wide")
    if wide.isEmpty():
        wide = None
    return _refine(graph, own, wide), wide


def _refine(graph: DataFrame, own: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """One round: each node shows its neighbours, and the nearest of those that name it, to one another. `wide` has lists of other sizes (u, k)."""
    back = _lists(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos"), BACK)
    around = graph.select("u", "v").unionByName(back.select("u", "v")).distinct()
    size = F.lit(LIST)
    held = graph
    if wide is not None:
        held, size = graph.join(wide, "u", "left"), F.coalesce(F.max("k"), F.lit(LIST))
    last = held.groupBy("u").agg(F.when(F.count("*") < size, F.lit(-2.0)).otherwise(F.min("cos")).alias("last"))
    vecs = own.select(F.col("node").alias("v"), "vec").join(last.withColumnRenamed("u", "v"), "v", "left").withColumn("last", F.coalesce("last", F.lit(-2.0)))
    shown = around.join(vecs, "v").select("u", "v", "last", "vec")

    def meet(table: pa.Table) -> pa.Table:
        ids, last = table.column("v").to_numpy(), table.column("last").to_numpy()
        vec = _matrix(table.column("vec"))
        dots = vec @ vec.T
        np.fill_diagonal(dots, -3.0)
        a, b = np.nonzero(dots > last[:, None])
        return pa.table({"u": pa.array(ids[a]), "v": pa.array(ids[b]), "cos": pa.array(dots[a, b])})

    found = shown.groupBy("u").applyInArrow(lambda t: meet(t), "u long, v long, cos double")
    return written(_lists(graph.unionByName(found), LIST, wide), "graph")


def _enlarged(graph: DataFrame, wide: DataFrame | None, roots: DataFrame, own: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Counts and links, as of `_compared`, of all nodes of components in which some list holds links only.

    A node whose list has room names all its links itself, so that links between components that the lists miss have a full
    list at both ends: these components are compared with one another, not with the rest.
    """
    full = _full(graph, threshold, wide).select(F.col("u").alias("node"))
    short = roots.join(full, "node").select("root").distinct()
    held = written(roots.join(short, "root").join(own, "node").select("label", "root", "node", "copies", "vec"), "held")
    sizes = held.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cell = F.concat_ws(":", "root", F.pmod(F.xxhash64("node"), F.col("blocks")))
    return _compared(held.join(sizes, "root").withColumn("cell", cell).drop("blocks"), threshold)


def _pairs_of(rows: DataFrame, part: str, parts: str, *rest: str) -> DataFrame:
    """Each row once for every part of its label that it meets: the pair's parts as lo and hi."""
    others = F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda j: F.struct(F.least(j, F.col(part)).alias("lo"), F.greatest(j, F.col(part)).alias("hi")))
    return rows.withColumn("pair", F.explode(others)).select("label", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), part, *rest)


def _compared(held: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of vectors in cells (label, root, cell, node, copies, vec): node, n (links, with copies); a, b (linked roots).

    All pairs within a label, in blocks, but for pairs of cells that are too far apart to hold a link: a cell lies within
    an angle of its mean, and angles obey the triangle inequality.
    """

    def ball(key: tuple, table: pa.Table) -> pa.Table:
        vec = _matrix(table.column("vec"))
        mean = vec.sum(axis=0)
        size = np.sqrt(mean @ mean)
        mean = mean / size if size > 1e-9 else vec[0]
        angle = float(np.arccos(np.clip(vec @ mean, -1, 1)).max())
        return pa.table({"label": table.column("label")[:1], "cell": table.column("cell")[:1], "mean": pa.array([mean.astype("<f8").tobytes()], pa.binary()), "angle": pa.array([angle])})

    slim = held.select("label", "cell", "vec")
    balls = written(slim.groupBy("label", "cell").applyInArrow(ball, slim.select("label", "cell", F.col("vec").alias("mean"), F.lit(0.0).alias("angle")).schema), "balls")
    sizes = balls.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    parted = balls.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("cell"), F.col("parts")).cast("int"))

    def close(key: tuple, table: pa.Table) -> pa.Table:
        _, lo, hi = (k.as_py() for k in key)
        part, angle, mean = table.column("part").to_numpy(), table.column("angle").to_numpy(), _matrix(table.column("mean"))
        a, b = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        near = np.arccos(np.clip(mean[a] @ mean[b].T, -1, 1)) <= angle[a][:, None] + angle[b][None, :] + np.arccos(threshold) + 1e-6
        if lo == hi:
            np.fill_diagonal(near, True)
            near = np.triu(near)
        i, j = np.nonzero(near)
        cells = table.column("cell")
        return pa.table({"label": table.column("label").take(a[i]), "a": cells.take(a[i]), "b": cells.take(b[j])})

    placed = _pairs_of(parted, "part", "parts", "cell", "mean", "angle")
    meet = written(placed.groupBy("label", "lo", "hi").applyInArrow(close, placed.select("label", F.col("cell").alias("a"), F.col("cell").alias("b")).schema), "meet")
    # a cell's vectors go once to every cell that it meets: m vectors make m * cells rows, not m * m
    sides = meet.withColumn("cell", F.explode(F.array_distinct(F.array("a", "b"))))
    dealt = sides.join(held, ["label", "cell"]).select("label", "a", "b", "cell", "root", "node", "copies", "vec")

    def count(key: tuple, table: pa.Table) -> pa.Table:
        _, lo, hi = (k.as_py() for k in key)
        cell = np.array(table.column("cell").to_pylist(), object)
        copies, ids, roots, vec = table.column("copies").to_numpy(), table.column("node").to_numpy(), table.column("root").to_numpy(), _matrix(table.column("vec"))
        a, b = cell == lo, cell == hi
        hit = vec[a] @ vec[b].T >= threshold
        if lo == hi:
            np.fill_diagonal(hit, False)
            node, n = ids[a], hit @ copies[b]
        else:
            node, n = np.concatenate([ids[a], ids[b]]), np.concatenate([hit @ copies[b], hit.T @ copies[a]])
        u, v = _forest(roots[a], roots[b], hit)
        nothing = [None] * len(node)
        return pa.table({"node": pa.array([*node, *[None] * len(u)], pa.int64()), "n": pa.array([*n, *[0] * len(u)], pa.int64()), "a": pa.array([*nothing, *u], pa.int64()), "b": pa.array([*nothing, *v], pa.int64())})

    out = written(dealt.groupBy("label", "a", "b").applyInArrow(count, "node long, n long, a long, b long"), "compared")
    return out.where("node is not null").groupBy("node").agg(F.sum("n").alias("n")), out.where("node is null").select("a", "b").distinct()


def _forest(left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs of different roots that join what the hits join: fewer than there are roots."""
    if (left == left[0]).all() and (right == left[0]).all():
        return [], []
    i, j = np.nonzero(hit)
    pairs = np.unique(np.stack([np.minimum(left[i], right[j]), np.maximum(left[i], right[j])], axis=1), axis=0)
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while x in top:
            x = top[x]
        return x

    u, v = [], []
    for a, b in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
        x, y = find(a), find(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            u.append(a)
            v.append(b)
    return u, v


def audit(own: DataFrame, found: DataFrame, graph: DataFrame, threshold: float, seed: int, rows: int = AUDIT_ROWS) -> float:
    """Mean share of a node's links that were found, over sampled nodes with links, against brute force over all nodes of their labels.

    The sample has `rows` nodes of all, and `rows` of those whose nearest neighbour is linked or almost: where copies are
    rare, few of the former have links. A node counts once, however many links it has.
    """
    at = F.xxhash64("node", F.lit(seed))
    nearest = graph.groupBy(F.col("u").alias("node")).agg(F.max("cos").alias("cos")).where(F.col("cos") >= threshold - AUDIT_MARGIN).select("node")
    picked = own.select("node").orderBy(at).limit(rows).unionByName(nearest.orderBy(at).limit(rows)).distinct()
    asked = own.join(F.broadcast(picked), "node").select("node", "label", "vec", "copies").toArrow()  # at most 2 * AUDIT_ROWS vectors
    if not asked.num_rows:
        return 1.0
    ids, labels, vec = asked.column("node").to_numpy(), np.array(asked.column("label").to_pylist(), object), _matrix(asked.column("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            other = _matrix(batch.column("vec"))
            d = min(vec.shape[1], other.shape[1])
            hit = (vec[:, :d] @ other[:, :d].T >= threshold) & (labels[:, None] == np.array(batch.column("label").to_pylist(), object)[None, :]) & (ids[:, None] != batch.column("node").to_numpy()[None, :])
            total += hit @ batch.column("copies").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "n"])

    true = own.select("node", "label", "vec", "copies").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("true"))
    got = true.where(F.col("true") > 0).join(found.select("node", "n"), "node", "left").agg(F.avg(F.least("true", F.coalesce("n", F.lit(0))) / F.col("true")).alias("recall")).first()
    return 1.0 if got["recall"] is None else got["recall"]


def _exact(edges: DataFrame, roots: DataFrame, own: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Counts and roots from all pairs of each label, in blocks."""
    sizes = own.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cell = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("string")
    held = own.join(roots, "node", "left").join(sizes, "label").select("label", F.coalesce("root", "node").alias("root"), cell.alias("cell"), "node", "copies", "vec")
    counts, links = _compared(written(held, "held"), threshold)
    counts = written(counts, "counts")
    return counts, components(edges.unionByName(links))


def classes(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, by links between vectors of one label.

    n_links counts other vectors linked directly, equal ones too; component_id is the least vec_id that links reach, the
    row's own included. Vectors without a node (see `nodes`) have no links. Repeated rows of one id give one row each.
    """
    with Scratch(vectors.sparkSession) as scratch:
        own = scratch.keep(written(nodes(vectors, vec_id, vec, label), "nodes"))
        graph = None
        for again in range(AUDITS):
            start = _start(own, seed + again, TABLES)
            graph = written(_lists(start if graph is None else graph.unionByName(start)), "graph")
            for _ in range(ROUNDS - 1):
                graph = _refine(graph, own)
            graph, wide = _widened(graph, own, threshold)
            near = graph.where(F.col("cos") >= threshold)
            edges = written(near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "edges")
            roots = components(edges)
            more, links = _enlarged(graph, wide, roots, own, threshold)
            if not links.isEmpty():
                roots = components(edges.unionByName(links))
            copies = own.select("node", "copies")
            sides = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
            few = sides.join(copies.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("few"))
            found = written(few.join(more, "node", "left").select("node", F.coalesce("n", "few").alias("n")), "counts")
            if audit(own, found, graph, threshold, seed + again) >= AUDIT_RECALL:
                break
        else:
            found, roots = _exact(edges, roots, own, threshold)
        scratch.keep(found)
        scratch.keep(roots)
    by_node = own.select("node", "label", "copies").join(found, "node", "left").join(roots, "node", "left").select("node", "label", F.col("copies") - 1 + F.coalesce("n", F.lit(0)), F.coalesce("root", "node")).toDF("node", "label", "n_links", "component_id")
    # rows find their node by their vector
    rows = narrow(vectors, vec_id=vec_id, vec=vec, label=label).withColumn("vec", F.col("vec").cast("array<double>"))
    named = rows.where("vec_id is not null and vec is not null and label is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("node"))
    held = rows.join(named, ["label", "vec"], "left").join(by_node.drop("label"), "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return held.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
