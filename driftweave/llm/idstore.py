"""A content-addressed store of token ids.

Rolling hashes over the ids cut each document's id stream into chunks; a chunk is named by the SHA-256 of its bytes and
stored once; each document has a recipe, the list of its chunks, with the Merkle root over them; a manifest has the root
over all recipes of a file. Files are Parquet, written and read by Spark, so any file system of the cluster will do:

    kind=chunk/   key, data (ids as little-endian unsigned integers of 16 bits, or of 32 where the vocabulary needs them)
    recipe/       doc_id, place (MD5 of the text), chunks, root, n_tokens, file, start; in ascending doc_id order
    manifest/     of each file (range) of recipes: first and last id, rows, root over its recipes
    head/         bytes of an id, and the manifest's files, rows and root; written last

Chunk bytes cross the network once, to meet their copies. Reading back joins only names with lengths and checksums, as
the CRC-32 of a document follows from those of its chunks; `read_ids` gives the ids themselves. Nothing is lost silently:
readers compare recipes, manifest and head first and raise `StoreError` where they differ, and a document with a missing
or changed chunk comes back with verified = false.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import claim, narrow, removed, small_batches, text_batches

#: Rolling window in ids; a chunk ends where the low bits of its hash are zero, within these bounds.
WINDOW, LEAST, MOST, BITS = 16, 128, 4096, 9
#: Words whose ids a worker keeps; beyond this, those that came in one batch only go.
CACHE_WORDS = 1_000_000
#: Names of chunks that a writing task remembers, so that it sends a chunk with many copies once; it starts anew beyond this.
SENT_KEYS = 100_000
#: Rows of a range of recipes, and ranges at most; beyond that, ranges grow.
RANGE_ROWS, RANGES = 20_000, 5_000
#: One of so many recipes is looked at for chunks that very many share, of which there are at most HOT. Only how their rows
#: are joined depends on it.
HOT_SAMPLE, HOT = 64, 1_000
#: Bytes of text that are encoded at once: the more, the fewer words are met again as new.
ENCODE_BYTES = 4 << 20
#: White space that byte-level patterns may join across a single space: texts with it are encoded whole.
_JOINED = ("  ", *(f"{a} {b}" for a in "\n\t\r" for b in "\n\t\r"))
_ODD = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_EDGE = re.compile(r"[\n\t\r] [\n\t\r]|^[\n\t\r]|[\n\t\r]$")

_encoders: dict[str, "ByteEncoder"] = {}


class StoreError(ValueError):
    """Parts of a store are missing or were changed."""


def gear(n: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each of n ids (the SplitMix64 sequence)."""
    z = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _Places(dict):
    """The place of each word; -2 for words that have none."""

    def __missing__(self, word: str) -> int:
        return -2


class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizers file; words are encoded once and kept."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.no_truncation()
        self.tk.no_padding()
        spec = json.load(open(path))
        pre = spec.get("pre_tokenizer") or {}
        self.words = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        vocab = self.tk.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        for x, i in vocab.items():
            self.starts[i] = x[:1] == "Ġ"
        #: ids are stored in two bytes where all of the vocabulary fits
        self.kind = np.dtype("<u2" if len(self.starts) <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        """Drops the words met so far: the place of each in the pool of ids, -1 for words with rare white space."""
        self.places = _Places()
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0
        self.spans, self.known = np.zeros((3, 1 << 14), np.int64), 1  # start and length in the pool, and batches with it; place 0 holds no ids

    def _trim(self) -> None:
        """Keeps the words that came in most batches: half of CACHE_WORDS at most, and none of one batch only."""
        words = [w for w, k in self.places.items() if k > 0]
        places = np.fromiter((k for k in self.places.values() if k > 0), np.int64, len(words))
        start, length, uses = self.spans[:, places]
        least = max(2, int(np.partition(uses, -(CACHE_WORDS // 2))[-(CACHE_WORDS // 2)]) + 1 if len(uses) > CACHE_WORDS // 2 else 0)
        keep = np.flatnonzero(uses >= least)
        words, start, length = [words[i] for i in keep.tolist()], start[keep], length[keep]
        ends = np.cumsum(length)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)]
        self.forget()
        self._put(words, ids, length)
        self.spans[2, 1 : self.known] = 1

    @classmethod
    def at(cls, path: str) -> "ByteEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tk.encode_batch_fast(texts, add_special_tokens=False)]

    def _put(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Gives the words places; `ids` are those of all of them, in order."""
        n, k = self.used + len(ids), self.known + len(words)
        if n > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(n, len(self.pool)), self.kind)])
        if k > self.spans.shape[1]:
            self.spans = np.concatenate([self.spans[:, : self.known], np.zeros((3, max(k, self.known)), np.int64)], axis=1)
        self.pool[self.used : n] = ids
        self.spans[:2, self.known : k] = self.used + np.cumsum(lengths) - lengths, lengths
        self.places.update(zip(words, range(self.known, k)))
        self.used, self.known = n, k

    def _put_lists(self, words: list[str], ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._put(words, np.fromiter((i for x in ids for i in x), self.kind, int(lengths.sum())), lengths)

    def _learn(self, words: list[str]) -> None:
        """Ids of each word behind a space. Many words go into one call: only a word's first id begins with a space.

        Words with rare white space have none: their texts are encoded whole.
        """
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        joined = [" " + " ".join(g) for g in groups]
        single: list[str] = []
        for i, x in enumerate(joined):
            if _ODD.search(x) or _EDGE.search(x) or "  " in x:
                for w in groups[i]:
                    if _ODD.search(w):
                        self.places[w] = -1
                    else:
                        single.append(w)
                groups[i], joined[i] = [], ""
        for group, ids in zip(groups, self._ids(joined)):
            flat = np.array(ids, np.int64)
            at = np.flatnonzero(self.starts[flat])
            if len(at) == len(group):
                self._put(group, flat, np.diff(np.concatenate((at, [len(flat)]))))
            else:  # a vocabulary in which a word may have no or several ids that begin with a space
                single += group
        self._put_lists(single, self._ids([" " + w for w in single]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, of the type `kind`, and how many each has, as the library's encode(text, add_special_tokens=False) has them."""
        n = len(texts)
        whole = np.fromiter((not self.words or x[-1:] == " " or any(s in x for s in self.special) or any(s in x for s in _JOINED) for x in texts), bool, n)
        column = pa.array(["" if w else x for x, w in zip(texts, whole.tolist())], pa.string())
        parts = pc.split_pattern(column, " ")
        count = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(count) - count  # a text's first word has no space before it, so it is not looked up
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if len(self.places) > CACHE_WORDS:
            self._trim()
        # words that only begin texts need no place
        behind = np.ones(len(codes), bool)
        behind[first] = False
        asked = np.zeros(len(coded.dictionary), bool)
        asked[codes[behind]] = True
        words = coded.dictionary.filter(pa.array(asked)).to_pylist()
        found = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        if len(lost := np.flatnonzero(found == -2)):
            new = [words[i] for i in lost.tolist()]
            self._learn(new)
            found[lost] = np.fromiter(map(self.places.__getitem__, new), np.int64, len(new))
        self.spans[2, found[found > 0]] += 1
        place = np.zeros(len(asked), np.int64)
        place[asked] = found
        own = place[codes]
        own[first] = 0
        heads = coded.dictionary.take(pa.array(codes[first])).to_pylist()
        odd = np.logical_or.reduceat(own < 0, first) if n else np.zeros(0, bool)
        whole |= odd | np.fromiter((_ODD.search(h) is not None for h in heads), bool, n)
        own[np.repeat(whole, count)] = 0
        # each text's first word, or the whole text, stands behind the pool
        more = self._ids([x if w else h for x, w, h in zip(texts, whole.tolist(), heads)])
        sizes = np.fromiter(map(len, more), np.int64, n)
        pool = np.concatenate([self.pool[: self.used], np.fromiter((i for x in more for i in x), self.kind, int(sizes.sum()))])
        start, length = self.spans[:2, own]
        start[first], length[first] = self.used + np.cumsum(sizes) - sizes, sizes
        ends = np.cumsum(length)
        flat = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)]
        return flat, np.add.reduceat(length, first) if n else sizes


def cuts(ids: np.ndarray, ends: np.ndarray, table: np.ndarray) -> list[list[int]]:
    """Where each document's chunks end, in its own ids. `ends`: where the documents end in the flat array `ids`."""
    h = table[ids]
    step = 1
    while step < WINDOW:  # doubles the window: h[i] becomes the sum of 2^j * table[ids[i - j]] for j below 2 * step
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint64(step)
        h = h + shifted
        step *= 2
    at = np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << BITS) - 1) == 0) + 1
    out = []
    start = 0
    bounds = np.searchsorted(at, ends)
    k = 0
    for end, hi in zip(ends.tolist(), bounds.tolist()):
        own, last = [], 0
        # the window of the first ids reaches into the document before; cuts this early are never taken
        for c in (at[k:hi] - start).tolist():
            if c - last >= LEAST and c >= WINDOW:
                while c - last > MOST:
                    last += MOST
                    own.append(last)
                if c - last >= LEAST:
                    own.append(c)
                    last = c
        n = end - start
        while n - last > MOST:
            last += MOST
            own.append(last)
        if n > last or not own:
            own.append(n)
        out.append(own)
        start, k = end, hi
    return out


def merkle(names: list[bytes]) -> bytes:
    """Root of the binary hash tree over the names; a node without a partner moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in names] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _crc_tables(most: int = 44) -> np.ndarray:
    """For each k, what appending 2^k zero bytes makes of each value of each byte of a CRC-32."""
    def times(m: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= m[i]
        return out

    m = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        m = [times(m, x) for x in m]
    out = np.zeros((most, 4, 256), np.uint64)
    for k in range(most):
        for byte in range(4):
            for v in range(256):
                out[k, byte, v] = times(m[8 * byte : 8 * byte + 8] + [0] * 24, v)
        m = [times(m, x) for x in m]
    return out


_TABLES: list[np.ndarray] = []


def crc_whole(crc: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """CRC-32 of each of n byte strings, from those of its parts in order and the parts' lengths; `owner` ascends.

    A CRC is linear: a part adds its own, moved on by the bytes behind it.
    """
    if not _TABLES:
        _TABLES.append(_crc_tables())
    tables = _TABLES[0]
    total = np.bincount(owner, sizes, n).astype(np.int64)
    ends = np.cumsum(sizes)
    behind = np.repeat(np.cumsum(total), np.bincount(owner, minlength=n)) - ends
    v = crc.astype(np.uint64)
    k = 0
    while (behind >> k).any():
        at = np.flatnonzero(behind >> k & 1)
        x = v[at]
        v[at] = tables[k, 0][x & np.uint64(255)] ^ tables[k, 1][x >> np.uint64(8) & np.uint64(255)] ^ tables[k, 2][x >> np.uint64(16) & np.uint64(255)] ^ tables[k, 3][x >> np.uint64(24)]
        k += 1
    out = np.zeros(n, np.uint64)
    np.bitwise_xor.at(out, owner, v)
    return out.astype(np.int64)


STORE = "kind string, key binary, data binary, doc_id long, place string, chunks array<binary>, sizes array<int>, root binary"
RECIPE = "doc_id long, place string, chunks array<binary>, root binary, n_tokens long, file int, start long"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text (null: empty), appends `end_id`, and writes the store to `path`, recipes in ascending doc_id order.

    Rows with a null doc_id are kept and sort first. Rows that share a doc_id are all kept, in the order of the MD5 of
    their texts.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, table, task, row = ByteEncoder.at(tokenizer), gear(1 << 17), TaskContext.get().partitionId(), 0
        claim("idstore", encoder.forget)
        width = encoder.kind.itemsize
        sent: set[bytes] = set()
        for batch, texts in text_batches(batches, "text", ENCODE_BYTES):
            flat, count = encoder.encode(texts)
            flat = np.insert(flat, np.cumsum(count), end_id)
            ends = np.cumsum(count + 1)
            chunks: dict[bytes, bytes] = {}
            names, sizes, roots = [], [], []
            data = flat.tobytes()
            for end, own in zip((width * ends).tolist(), cuts(flat, ends, table)):
                raw = data[end - width * own[-1] : end]
                parts = [raw[width * a : width * b] for a, b in zip([0, *own], own)]
                keys = [hashlib.sha256(p).digest() for p in parts]
                chunks.update((k, x) for k, x in zip(keys, parts) if k not in sent)
                names.append(keys)
                sizes.append([b - a for a, b in zip([0, *own], own)])
                roots.append(merkle(keys))
            if len(sent) > SENT_KEYS:
                sent.clear()
            sent.update(chunks)
            n, m = len(texts), len(chunks)
            none = [None] * m
            keys = [b"%d:%d" % (task, row + i) for i in range(n)]  # a recipe has no copies: its key is its place in the input
            row += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(["staged"] * n + ["chunk"] * m), pa.array(keys + list(chunks), pa.binary()), pa.array([None] * n + list(chunks.values()), pa.binary()), pa.array(batch.column("doc_id").to_pylist() + none, pa.int64()), pa.array([hashlib.md5(t.encode()).hexdigest() for t in texts] + none, pa.string()), pa.array(names + none, pa.list_(pa.binary())), pa.array(sizes + none, pa.list_(pa.int32())), pa.array(roots + none, pa.binary())],
                names=["kind", "key", "data", "doc_id", "place", "chunks", "sizes", "root"],
            )

    rows = narrow(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, STORE)
    # as many partitions as the input has, at least: the names of a partition's chunks are held in memory
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    unique = rows.repartition(parts, "key").mapInArrow(_once, STORE)
    # ids hardly compress, and chunks do not repeat: neither codec nor dictionary would help
    with small_batches(spark):
        unique.write.partitionBy("kind").option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)
    none = spark.createDataFrame([], STORE)  # so that a store of no documents has files too
    none.select("key", "data", "doc_id", "place", "chunks", "sizes", "root").write.mode("append").parquet(f"{path}/kind=chunk")
    none.select("key", "data", "doc_id", "place", "chunks", "sizes", "root").write.mode("append").parquet(f"{path}/kind=staged")
    staged = spark.read.schema("doc_id long, place string, chunks array<binary>, sizes array<int>, root binary").parquet(f"{path}/kind=staged")
    sized = staged.withColumn("n_tokens", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).drop("sizes")
    with_starts(sized, "doc_id", "place", path=f"{path}/ranged").write.parquet(f"{path}/recipe")
    removed(spark, f"{path}/ranged")
    removed(spark, f"{path}/kind=staged")
    _roots(read_recipes(spark, path)).write.parquet(f"{path}/manifest")
    head = _head(spark.read.schema(MANIFEST).parquet(f"{path}/manifest"))
    spark.createDataFrame([(ByteEncoder.at(tokenizer).kind.itemsize, *head)], HEAD).coalesce(1).write.parquet(f"{path}/head")


MANIFEST = "file int, first_id long, last_id long, n_rows long, root binary"
HEAD = "width int, files long, n_rows long, root binary"


class _Tree:
    """A Merkle root in passing: one node for each height at most."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (0, hashlib.sha256(b"\0" + leaf).digest())
        while self.stack and self.stack[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.sha256(b"\1" + self.stack.pop()[1] + node[1]).digest())
        self.stack.append(node)

    def root(self) -> bytes:
        out = b""
        for _, x in reversed(self.stack):
            out = hashlib.sha256(b"\1" + x + out).digest() if out else x
        return out


def _roots(recipes: DataFrame) -> DataFrame:
    """The manifest's rows of recipes: a leaf is a recipe's id, start, length and root. Every document has a start of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        done: list[list] = []
        for batch in batches:
            for file, i, start, n, root in zip(*(batch.column(c).to_pylist() for c in ("file", "doc_id", "start", "n_tokens", "root"))):
                if not held or held[0] != file:
                    if held:
                        done.append([*held[:4], held[4].root()])
                    held = [file, i, i, 0, _Tree()]
                held[2], held[3] = i, held[3] + 1
                held[4].add(b"%s:%d:%d:%s" % (b"null" if i is None else b"%d" % i, -1 if start is None else start, -1 if n is None else n, root or b""))
        if held:
            done.append([*held[:4], held[4].root()])
        schema = pa.schema([("file", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_rows", pa.int64()), ("root", pa.binary())])
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], t) for c, t in enumerate(schema.types)], schema=schema)

    ordered = recipes.select("file", "doc_id", "start", "n_tokens", "root").repartition("file").sortWithinPartitions("file", "start")
    return ordered.mapInArrow(run, MANIFEST)


def _head(manifest: DataFrame) -> tuple[int, int, bytes]:
    """Files, rows and root of a manifest, which has RANGES rows at most."""
    tree, files, rows = _Tree(), 0, 0
    for r in manifest.orderBy("file").collect():
        tree.add(b"%d:%d:%s" % (r["file"], r["n_rows"], bytes(r["root"])))
        files, rows = files + 1, rows + r["n_rows"]
    return files, rows, tree.root()


def check(spark: SparkSession, path: str) -> int:
    """Bytes of an id of a store whose recipes, manifest and head agree; raises `StoreError` that names the ranges which do not."""
    from pyspark.errors import AnalysisException

    try:
        heads = spark.read.schema(HEAD).parquet(f"{path}/head").collect()
        manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        recipes = read_recipes(spark, path)
        read_chunks(spark, path)
    except AnalysisException as e:
        raise StoreError(f"{path}: a part of the store is missing: {e}") from e
    if len(heads) != 1 or (heads[0]["files"], heads[0]["n_rows"], bytes(heads[0]["root"])) != _head(manifest):
        raise StoreError(f"{path}: the manifest is not the one that was written")
    got = _roots(recipes).select(F.col("file").alias("own"), F.col("n_rows").alias("n"), F.col("root").alias("r"))
    same = (F.col("n") == F.col("n_rows")) & (F.col("r") == F.col("root"))
    wrong = manifest.join(got, F.col("file") == F.col("own"), "full").where(~F.coalesce(same, F.lit(False))).orderBy("first_id").limit(20).collect()
    if wrong:
        told = "; ".join(f"doc_id {r['first_id']} to {r['last_id']}: {r['n'] or 0} of {r['n_rows'] or 0} recipes" + (", changed" if r["n"] == r["n_rows"] else "") for r in wrong)
        raise StoreError(f"{path}: recipes differ from the manifest: {told}")
    return heads[0]["width"]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key; equal keys stand in one partition, whose keys are a small part of its bytes."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for k in batch.column("key").to_pylist():
            keep.append(k not in seen)
            seen.add(k)
        yield batch.filter(pa.array(keep, pa.bool_()))


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPE).parquet(f"{path}/recipe")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, data binary").parquet(f"{path}/kind=chunk")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, place and the ids of each document, put together from its recipe's chunks; a missing or changed chunk is an error."""
    width = check(spark, path)
    joined = read_recipes(spark, path).select("start", "doc_id", "place", F.posexplode("chunks").alias("k", "key")).join(read_chunks(spark, path), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for i, row in zip(batch.column("doc_id").to_pylist(), batch.column("parts").to_pylist()):
                if any(p["data"] is None or hashlib.sha256(p["data"]).digest() != p["key"] for p in row):
                    raise StoreError(f"{path}: a chunk of doc_id {i} is missing or was changed")
                ids.append(np.frombuffer(b"".join(p["data"] for p in row), f"<u{width}").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "place", "ids"])

    rows = joined.groupBy("start", "doc_id", "place").agg(F.sort_array(F.collect_list(F.struct("k", "key", "data"))).alias("parts"))
    return rows.mapInArrow(run, "doc_id long, place string, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, place, start, n_tokens, ids_crc32 and verified, from the files.

    Every chunk's bytes are read, checked against its name and summed as 32-bit integers; recipes then take lengths and
    sums of their chunks, and are checked against their roots and lengths. No bytes of ids are shuffled. A document with a
    missing or changed chunk has verified = false, and counts without the missing ids; missing recipes raise (see `check`).
    """
    width = check(spark, path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, keys = batch.column("data").to_pylist(), batch.column("key").to_pylist()
            good = [hashlib.sha256(x).digest() == k for x, k in zip(data, keys)]
            crc = [zlib.crc32(np.frombuffer(x, f"<u{width}", len(x) // width).astype("<u4")) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(x) // width for x in data], pa.int64()), pa.array(crc, pa.int64()), pa.array(good)], names=["key", "n", "crc", "good"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")
            n = len(lists)
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(n), counts)
            flat = lists.flatten()
            sizes, crc = (flat.field(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("n", "crc"))
            good = flat.field("good").fill_null(False).to_numpy(zero_copy_only=False)
            keys = flat.field("key").to_pylist()
            ends = np.cumsum(counts).tolist()
            bad = np.bincount(owner, ~good.astype(bool), n)
            same = [merkle(keys[a:b]) == r for a, b, r in zip([0, *ends], ends, batch.column("root").to_pylist())]
            total = np.bincount(owner, sizes, n).astype(np.int64)
            full = total == batch.column("n_tokens").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("place"), batch.column("start"), pa.array(total), pa.array(crc_whole(crc, 4 * sizes.astype(np.int64), owner, n)), pa.array((bad == 0) & full & np.array(same, bool))],
                names=["doc_id", "place", "start", "n_tokens", "ids_crc32", "verified"],
            )

    chunks, summed = read_chunks(spark, path), "key binary, n long, crc long, good boolean"
    own = ["start", "doc_id", "place", "root", "n_tokens"]
    refs = read_recipes(spark, path).select(*own, F.posexplode("chunks").alias("k", "key"))
    # chunks that very many recipes share meet those in a broadcast of HOT rows at most, the others in a shuffle
    some = refs.where(F.pmod(F.xxhash64("start"), F.lit(HOT_SAMPLE)) == 0)
    counted = some.groupBy("key").agg(F.count("*").alias("c"))
    least = max(8, (some.count() // HOT) + 1)
    hot = [bytes(r["key"]) for r in counted.where(F.col("c") >= least).select("key").collect()]  # fewer than HOT names
    joined = refs.join(chunks.mapInArrow(sums, summed), "key", "left")
    if hot:
        names = F.broadcast(spark.createDataFrame([(k,) for k in hot], "key binary"))
        few = F.broadcast(chunks.join(names, "key", "left_semi").mapInArrow(sums, summed))
        rest = refs.join(names, "key", "left_anti").join(chunks.join(names, "key", "left_anti").mapInArrow(sums, summed), "key", "left")
        joined = rest.unionByName(refs.join(names, "key", "left_semi").join(few, "key", "left"))
    rows = joined.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("k", "key", "n", "crc", "good"))).alias("parts"))
    return rows.mapInArrow(whole, "doc_id long, place string, start long, n_tokens long, ids_crc32 long, verified boolean")


def with_starts(df: DataFrame, order: str, tie: str, path: str, size: str = "n_tokens") -> DataFrame:
    """`df` in the order of the integer `order` and the hexadecimal digits `tie`, with the running total `start` of `size`
    before each row and its range's number `file`.

    Ranges are cut at quantiles of `order`; a value that fills several ranges is dealt out over them by `tie`, in order.
    Each range adds up its own rows in passing; only one total for each range is then summed in one place. The ranges
    are written to `path` in between, so that both passes see the same ones. The driver gets one number for each range.
    """
    from pyspark.sql.functions import pandas_udf

    spark = df.sparkSession
    n = df.count()
    ranges = max(1, min(RANGES, -(-n // RANGE_ROWS)))
    bounds = np.zeros(0, np.int64)
    value = F.coalesce(F.col(order), F.lit(-(2**63)))  # nulls come first
    if ranges > 1:
        shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
        got = df.agg(F.percentile_approx(value, shares, F.lit(20 * ranges)).alias("q")).first()["q"]
        bounds = np.array(got or [], np.int64)

    @pandas_udf("int")
    def range_of(value: pd.Series, tie: pd.Series) -> pd.Series:
        v = value.to_numpy(np.int64)
        lo, hi = np.searchsorted(bounds, v, "left"), np.searchsorted(bounds, v, "right")
        part = np.fromiter((int(x[:8], 16) for x in tie), np.float64, len(tie)) / 2.0**32
        return pd.Series((lo + np.floor(part * (hi - lo + 1))).astype(np.int32))

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = batch.column(size).to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n)], names=[*batch.schema.names, "_inner"])
            total = int(ends[-1]) if len(n) else total

    placed = df.withColumn("file", range_of(value, F.col(tie)))
    schema = placed.select("*", F.lit(0).cast("long").alias("_inner")).schema
    placed.repartitionById(ranges, F.col("file")).sortWithinPartitions(F.col(order).asc_nulls_first(), tie).mapInArrow(inner, schema).write.parquet(path)
    ranged = spark.read.schema(schema).parquet(path)
    totals = ranged.groupBy("file").agg(F.max(F.col("_inner") + F.col(size)).alias("_sum"))  # a row for each range
    before = totals.select("file", F.coalesce(F.sum("_sum").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "file").select(*df.columns, "file", (F.col("_before") + F.col("_inner")).alias("start"))
