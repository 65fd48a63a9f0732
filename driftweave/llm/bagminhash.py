"""Near-duplicate documents by BagMinHash signatures of their multisets of five-word shingles.

A shingle with weight w (how often it occurs) owns the unit cells 1 to w. Cells are grouped into dyadic blocks, each with
a Poisson process of points whose rate is the block's size; a point falls into one cell of its block (halving the block by
one random bit after another) and counts if the weight covers that cell. Each point goes to one register; a register keeps
its earliest point. Two documents agree in a register with exactly the weighted Jaccard similarity as chance. Points come
in order, so a process stops once it is later than all registers of its document.

Registers are cut into bands; documents with an equal band are candidates. Equal word sequences are one node from the
start. In each bucket every node is checked against one leader, by multiset overlap of the whole texts; nodes that stand
outside their bucket's largest component then ask all of its nodes, in blocks. No bucket is expanded into rows of all its
pairs, and none is cut off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import in_rounds as components
from .common import Scratch, claim, narrow, numbered, slices, small_batches, text_batches, written

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares no band with chance (1 - 0.8^4)^24, three in a million.
ROWS, BANDS = 4, 24
REGISTERS = ROWS * BANDS
#: Pairs that agree in fewer registers are not checked: at similarity 0.8 this is seven standard deviations below the mean.
LEAST_AGREEING = 49
#: Nodes of a bucket that are compared at once.
BLOCK = 256
CACHE_WORDS = 300_000

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_cache: dict[str, int] = {}


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def forget() -> None:
    _cache.clear()


def words(text: str) -> list[str]:
    """A text's words: what white space parts, in small letters."""
    return text.lower().split()


def word_hashes(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, flat, and the number of words of each document."""
    import xxhash

    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    new = set().union(*docs).difference(_cache) if docs else ()
    _cache.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    own = _cache
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    return np.fromiter((own[w] for d in docs for w in d), np.uint64, int(sizes.sum())), sizes


def shingles(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of the multisets. Fewer than five words make one shingle; none make no shingle."""
    h, sizes = word_hashes(docs)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(docs)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(h))
    s = np.zeros(len(h), np.uint64)
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    for j in range(SHINGLE):
        inside = left > j
        s = mix(s * _G + np.where(inside, padded[j : j + len(h)], np.uint64(j + 1)))
    first = np.arange(len(h)) == np.repeat(ends - sizes, sizes)
    keep = (left >= SHINGLE) | first
    doc, s = doc[keep], s[keep]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    if not len(s):
        return doc, s, np.zeros(0, np.int64)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])))
    at = np.flatnonzero(new)
    return doc[at], s[at], np.diff(np.concatenate((at, [len(s)])))


def signatures(doc: np.ndarray, s: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers: each keeps 32 random bits of its earliest point; documents without shingles have zeros."""
    # one process for each block that the weight reaches: block 0 is cell 0, block j has the cells from 2^(j-1) below 2^j
    blocks = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    owner = np.repeat(np.arange(len(s)), blocks)
    block = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.where(block == 0, 1, 1 << np.maximum(block - 1, 0))
    covered = weight[owner] - np.where(block == 0, 0, size)
    seed = mix(s[owner] + _G * (block.astype(np.uint64) + np.uint64(1)))
    d, rate, whole = doc[owner], size.astype(np.float64), covered >= size
    x = np.zeros(len(owner))
    count = np.zeros(len(owner), np.uint64)
    first, bits = np.full(n * m, np.inf), np.zeros(n * m, np.uint32)
    latest = np.full(n, np.inf)
    while len(d):
        # few processes left: several points of each at once
        t = 1 if len(d) > 4096 else 16
        z = mix(seed[:, None] + _G * (count[:, None] + np.arange(1, t + 1, dtype=np.uint64)))
        step = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        xs = x[:, None] + np.cumsum(step, axis=1)
        y = mix(z + _M1)
        register = ((y >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        cell = ((y & np.uint64(0xFFFFFFFF)) * size.astype(np.uint64)[:, None] >> np.uint64(32)).astype(np.int64)
        counts = (whole[:, None] | (cell < covered[:, None])) & (xs <= latest[d][:, None])
        place = (d[:, None] * m + register)[counts]
        at = xs[counts]
        np.minimum.at(first, place, at)
        won = at == first[place]
        bits[place[won]] = (mix(y + _M2) >> np.uint64(32)).astype(np.uint32)[counts][won]
        live = np.unique(d)
        latest[live] = first.reshape(n, m)[live].max(axis=1)
        x, count = xs[:, -1], count + np.uint64(t)
        keep = x < latest[d]
        d, rate, whole, covered, size, seed, x, count = (v[keep] for v in (d, rate, whole, covered, size, seed, x, count))
    return bits.reshape(n, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, of its number and registers."""
    z = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _G
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        z = mix(z * _G + parts[:, :, j])
    return z.view(np.int64)


def similarity(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two whole texts; 0 if one has no words."""
    doc, s, w = shingles([words(a), words(b)])
    return _overlap(s[doc == 0], w[doc == 0], s[doc == 1], w[doc == 1])


def _overlap(sa: np.ndarray, wa: np.ndarray, sb: np.ndarray, wb: np.ndarray) -> float:
    if not len(sa) or not len(sb):
        return 0.0
    at = np.minimum(np.searchsorted(sa, sb), len(sa) - 1)
    hit = sa[at] == sb
    both = int(np.minimum(wa[at[hit]], wb[hit]).sum())
    return both / (int(wa.sum()) + int(wb.sum()) - both)


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, node (MD5 of the word sequence; null without words), sig (registers) and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bagminhash", forget)
        for batch, texts in text_batches(batches, "text"):
            parts = [words(x) for x in texts]
            sig = signatures(*shingles(parts), len(parts))
            keys = band_keys(sig)
            nodes = [hashlib.md5(" ".join(p).encode()).digest() if p else None for p in parts]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary()), bands], names=["doc_id", "text_hash", "node", "sig", "bands"])

    slim = narrow(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = slim.select("doc_id", "text_hash", F.lit(None).cast("binary").alias("node"), F.lit(None).cast("binary").alias("sig"), F.lit(None).cast("array<long>").alias("bands")).schema
    return slim.mapInArrow(run, schema)


def _texts(nodes: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, text: the text of one row of each of the nodes."""
    # one row a node before the join, so that the rows of many equal texts meet in no task
    first = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    keys = first.join(nodes, "node", "left_semi").select("node", "k.doc_id", "k.text_hash")
    full = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = keys.withColumnsRenamed({"doc_id": "_id", "text_hash": "_own"}).join(full, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_own"))).select("node", "text")
    return written(found.dropDuplicates(["node"]), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs a, b of nodes, those whose whole texts' similarity reaches the threshold."""
    joined = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bagminhash", forget)
        held: tuple[str | None, tuple] = (None, ())
        for batch in slices(batches, "ta", "tb"):
            keep = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                if held[0] != ta:
                    held = (ta, shingles([words(ta)])[1:])
                keep.append(_overlap(*held[1], *shingles([words(tb)])[1:]) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(joined.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary"), "links")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs a, b, those whose registers agree often enough to be worth a check."""
    sigs = nodes.select("node", "sig")
    joined = pairs.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((sa == sb).sum(axis=1) >= LEAST_AGREEING))

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def links(docs: DataFrame, rows: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Verified links a, b between nodes whose transitive closure is that of all similar pairs that share a band."""
    nodes = written(rows.where("node is not null").select("node", "sig", "bands").dropDuplicates(["node"]), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    # what is joined by a bucket's key is written first: where both sides of a join are plain shuffles, Spark splits a hot bucket
    counts = written(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    members = written(members.join(counts, "key"), "members")
    texts = _texts(members.select("node").distinct(), docs, rows)
    # a bucket's leader is the member with the most company over all its buckets: it stands in the middle of its group
    company = members.groupBy("node").agg(F.sum("n").alias("c"))
    leaders = written(members.join(company, "node").groupBy("key").agg(F.max(F.struct("c", "node")).alias("m")).select("key", F.col("m.node").alias("a")), "leaders")
    pairs = members.join(leaders, "key").where("node != a").select("a", F.col("node").alias("b")).distinct()
    found = _verified(written(_likely(pairs, nodes), "pairs"), texts, threshold)
    roots = components(found)
    # nodes of one bucket that are still apart: all of them were checked against the leader, not against each other
    shared = members.where("n > 2").select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    shared = written(shared, "shared")
    parts = shared.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("n"), F.count("*").alias("parts"))
    mixed = parts.where("parts > 1").select("key", F.col("top.root").alias("major"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).cast("int").alias("asks"), F.ceil(F.col("n") / BLOCK).cast("int").alias("answers"))
    mixed = written(mixed, "mixed")
    # nodes outside a bucket's largest component ask all of its nodes, block by block: a * n / 256 rows for a that ask n
    dealt = written(shared.join(mixed, "key").withColumn("minor", F.col("root") != F.col("major")), "dealt")
    place = F.xxhash64("node")
    asks = dealt.where("minor").withColumn("ask", F.pmod(place, "asks").cast("int")).withColumn("answer", F.explode(F.expr("sequence(0, answers - 1)")))
    answers = dealt.withColumn("answer", F.pmod(place, "answers").cast("int")).withColumn("ask", F.explode(F.expr("sequence(0, asks - 1)")))
    sides = asks.select("key", "ask", "answer", "node", "root", "minor", F.lit(True).alias("asking")).unionByName(answers.select("key", "ask", "answer", "node", "root", "minor", F.lit(False).alias("asking")))
    full = sides.join(nodes.select("node", "sig").join(texts, "node"), "node")

    def cross(key: tuple, table: pa.Table) -> pa.Table:
        return _cross(key[0].as_py(), table, threshold)

    more = full.select("key", "ask", "answer", "node", "root", "minor", "asking", "sig", "text").groupBy("key", "ask", "answer").applyInArrow(cross, "a binary, b binary")
    return found.unionByName(written(more, "links"))


def _cross(band: int, table: pa.Table, threshold: float) -> pa.Table:
    """Links that connect components of the asking and the answering nodes; each pair is looked at in its first shared band.

    The likeliest pairs come first, and pairs whose components are connected by then are left out, so there are fewer links
    than nodes.
    """
    node, text = table.column("node").to_pylist(), table.column("text").to_pylist()
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, REGISTERS)
    names: dict[bytes, int] = {}
    part = np.array([names.setdefault(r, len(names)) for r in table.column("root").to_pylist()])
    asking, minor = table.column("asking").to_numpy(), table.column("minor").to_numpy()
    left, right = np.flatnonzero(asking), np.flatnonzero(~asking)
    keys = band_keys(sig)
    found: list[tuple[int, int, int]] = []
    for i in left.tolist():
        others = right[part[right] != part[i]]
        agree = (sig[others] == sig[i]).sum(axis=1)
        others, agree = others[agree >= LEAST_AGREEING], agree[agree >= LEAST_AGREEING]
        if len(others):
            own = keys[i][(keys[others] == keys[i]).argmax(axis=1)] == band
            found += [(-int(g), i, int(j)) for g, j in zip(agree[own], others[own]) if not minor[j] or node[i] < node[j]]
    found.sort()
    parent = list(range(len(names)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held: dict[int, tuple] = {}
    a, b = [], []
    for _, i, j in found:
        x, y = top(part[i]), top(part[j])
        if x == y:
            continue
        for k in (i, j):
            if k not in held:
                held[k] = shingles([words(text[k])])[1:]
        if _overlap(*held[i], *held[j]) >= threshold:
            parent[x] = y
            a.append(node[i])
            b.append(node[j])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, class_id, class_root, class_rows of every row: class_id is the least doc_id of the row's class.

    Rows with equal word sequences share a class, and so do rows linked by a similarity of `threshold` or more, directly
    or through others. A null or empty text, or one without words, is a class of its own. Repeated rows share a class.
    """
    own = narrow(docs, doc_id=doc_id, text=text)
    with Scratch(docs.sparkSession) as scratch, small_batches(docs.sparkSession):
        rows = written(sketch(own), "sketch")
        roots = components(links(own, rows, threshold))
        # both written, so that Spark splits a hot class in their join
        held = rows.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("class_root"))
        held = scratch.keep(written(held, "rows"))
        sizes = held.where("class_root is not null").groupBy("class_root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows")).where("class_rows > 1")
        sizes = scratch.keep(written(sizes, "sizes"))
    return held.join(sizes, "class_root", "left").select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), "class_root", F.coalesce("class_rows", F.lit(1)).alias("class_rows"))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stand for their class: the least doc_id stays, texts without words all stay.

    Of equal rows with the least id one stays. An empty table stays empty; extra columns of any name pass through.
    """
    plain, at = numbered(docs)
    i, t = at[doc_id], at[text]
    own = plain.select(F.col(i).alias("doc_id"), F.col(t).alias("text"))
    found = written(classes(own, threshold=threshold), "classes")
    # a row goes if its id is not the least of its class; equal rows with the least id are told apart below
    gone = found.where("class_id is not null and not (doc_id <=> class_id)").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    hashed = plain.withColumn("hash", F.xxhash64(t))
    left = hashed.join(gone, F.col(i).eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    twice = found.where("class_rows > 1 and doc_id <=> class_id").groupBy("class_root").agg(F.count("*").alias("n"), F.min("text_hash").alias("stays")).where("n > 1").select("class_root", "stays")
    if twice.limit(1).count():
        names = found.join(twice, "class_root").where("doc_id <=> class_id").select(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash"), "stays").distinct()
        marked = left.join(names, F.col(i).eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_hash")), "left").drop("own_id", "own_hash")
        single = marked.where("stays is null")
        first = marked.where("stays is not null and hash = stays").dropDuplicates([i, "hash"])
        left = single.unionByName(first)
    return left.select(*plain.columns).toDF(*docs.columns)
