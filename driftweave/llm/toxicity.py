"""A convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its character n-grams. Filters of several widths
slide over the words of a whole text, each keeps its largest value (max pooling), and a logistic layer gives the score.
Only words count: no label, language, source or id is an input. Pooling needs each text's largest values only, so texts of
any length are scored whole, in flat arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, claim, numbered, small_batches, text_batches, written

BUCKETS, DIM, WIDTHS, FILTERS, GRAMS = 1 << 18, 8, (1, 2, 3), 8, (4, 5)
BATCH, RATE, LEAST_DF, LEAST_STEPS = 64, 0.02, 4, 150
#: Training reads every labelled row. Its chains of steps, at most; rounds after which they are averaged, at most, and the steps of a
#: round that are aimed at; characters beyond which a step takes no further row; pieces in which chains' tables are averaged.
CHAINS, ROUNDS, ROUND_STEPS, BATCH_CHARS, PIECES = 64, 8, 40, 1 << 20, 16
#: Labels up to which they are broadcast, bits of the bitmap of more of them, and bins in which limits are looked for.
BROADCAST_ROWS, BITS, BINS = 10_000, 1 << 26, 256
#: Words whose vectors a worker keeps; the table starts anew beyond this.
CACHE_WORDS = 200_000
_STRIP = ".,;:!?\"'()[]{}*#$%&<>-_/\\|«»…“”‘’+=~^@"


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams and of the words themselves, flat, and where each word's begin."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(words))
    cps = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(cps))  # characters from here to the word's end
    word = np.repeat(np.arange(len(words)), lengths)
    mixed = (cps + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    found, owners = [np.array([zlib.crc32(m.encode()) for m in marked], np.uint64) % np.uint64(BUCKETS)], [np.arange(len(words))]
    for n in GRAMS:
        if len(cps) < n:
            continue
        h = np.zeros(len(cps) - n + 1, np.uint64)
        for j in range(n):
            h = (h ^ mixed[j : len(cps) - n + 1 + j]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        inside = left[: len(h)] >= n
        found.append(((h[inside] >> np.uint64(20)) + np.uint64(n)) % np.uint64(BUCKETS))
        owners.append(word[: len(h)][inside])
    owner, bucket = np.concatenate(owners), np.concatenate(found).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(words)))


def split(text: str) -> list[str]:
    """The words of a text, in small letters, without marks around them; a text without words has one empty word."""
    return [w.strip(_STRIP) for w in text.lower().split()] or [""]


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    #: score = logistic(slope * (logit - middle)): the limit that fits the held-in rows best stands at 0.5
    slope: float = 1.0
    middle: float = 0.0
    #: limits of the score by language, for those with enough held-in rows of both classes
    limits: dict[str, float] = field(default_factory=dict)
    words: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray | None = None

    def word_ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of `vectors` for all words, each text followed by gaps (row 0) so that no window crosses texts; the texts' ends."""
        if len(self.words) > CACHE_WORDS or self.vectors is None:
            self.words, self.vectors = {"": 0}, np.zeros((1, DIM), np.float32)  # no word: nothing known
        new = list(set().union(*texts).difference(self.words))
        if new:
            buckets, starts = hashes(new)
            made = np.add.reduceat(self.table[buckets], starts, axis=0)
            at = len(self.vectors)
            self.vectors = np.concatenate([self.vectors, made.astype(np.float32)])
            self.words.update(zip(new, range(at, at + len(new))))
        own, pad = self.words, [0] * (max(WIDTHS) - 1)
        ids = np.fromiter((i for t in texts for i in ([own[w] for w in t] + pad)), np.int64)
        return ids, np.cumsum(np.fromiter((len(t) + len(pad) for t in texts), np.int64, len(texts)))

    def pool(self, x: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """For each width, every window's values; windows that begin in a gap are out."""
        pad = max(WIDTHS) - 1
        gap = np.zeros(len(x), bool)
        for j in range(1, pad + 1):
            gap[ends - j] = True
        out = []
        padded = np.concatenate([x, np.zeros((pad, DIM), np.float32)])
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            z = sum(padded[j : j + len(x)] @ f[j] for j in range(w)) + b
            z[gap] = -1e30
            out.append(z)
        return out

    def logits(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        ids, ends = self.word_ids([split(t) for t in texts])
        starts = np.concatenate(([0], ends[:-1]))
        top = np.concatenate([np.maximum.reduceat(z, starts, axis=0) for z in self.pool(self.vectors[ids], ends)], axis=1)
        return np.maximum(top, 0) @ self.out + self.out_bias

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of texts, in slices of about a million characters."""
        out, at, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= 1 << 20 or i + 1 == len(texts):
                out.append(self.logits(texts[at : i + 1]))
                at, held = i + 1, 0
        return self.logistic(np.concatenate(out)) if out else np.zeros(0)

    def logistic(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.middle), -60, 60)))

    def forget(self) -> None:
        """Drops the vectors of the words met so far."""
        self.words, self.vectors = {}, None

    def bare(self) -> "Model":
        return Model(self.table, self.filters, self.bias, self.out, self.out_bias, self.slope, self.middle, self.limits)

    def copy(self) -> "Model":
        """A model with weights of its own."""
        return Model(self.table.copy(), [f.copy() for f in self.filters], [b.copy() for b in self.bias], self.out.copy(), self.out_bias, self.slope, self.middle, dict(self.limits))

    def small(self) -> np.ndarray:
        """All weights but the table's, in one array."""
        return np.concatenate([*(f.ravel() for f in self.filters), *self.bias, self.out, [self.out_bias]]).astype(np.float64)

    def set_small(self, values: np.ndarray) -> None:
        for part in (*self.filters, *self.bias, self.out):
            part[...] = values[: part.size].reshape(part.shape)
            values = values[part.size :]
        self.out_bias = float(values[0])


class Words:
    """Buckets of the words met so far; they start anew beyond CACHE_WORDS."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.buckets, self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: Iterable[str]) -> None:
        if len(self.index) > CACHE_WORDS:
            self.__init__()
        new = [w for w in dict.fromkeys(words) if w and w not in self.index]
        if new:
            buckets, starts = hashes(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.sizes = np.concatenate([self.sizes, np.diff(np.append(starts, len(buckets)))])
            self.starts = np.concatenate([self.starts, starts + len(self.buckets)])
            self.buckets = np.concatenate([self.buckets, buckets])

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of words by their numbers, flat, and how many each word has."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.buckets[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def document_counts(slices: Iterable[list[str]]) -> np.ndarray:
    """In how many texts each bucket occurs."""
    counts, place, words = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), Words()
    for texts in slices:
        docs = [set(split(t)) - {""} for t in texts]
        words.add(set().union(*docs))
        met, sizes = words.of(np.fromiter((words.index[w] for d in docs for w in d), np.int64))
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum([len(d) for d in docs]))]
        for start, end in zip(ends, ends[1:]):
            own, at = met[start:end], np.arange(end - start)
            place[own] = at
            counts[own[place[own] == at]] += 1  # each bucket once
    return counts


def first(alive: np.ndarray, seed: int) -> Model:
    """A model that has learnt nothing; n-grams that are not alive stay at zero."""
    rng, scale = np.random.RandomState(seed), 0.3
    return Model(
        (rng.randn(BUCKETS, DIM) * 0.05 * alive[:, None]).astype(np.float32),
        [(rng.randn(w, DIM, FILTERS) * scale).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        (rng.randn(len(WIDTHS) * FILTERS) * scale).astype(np.float32),
        0.0,
    )


class Trainer:
    """Adam on the weighted logistic loss, batch by batch; only the window that wins a filter's pooling learns.

    `weights` are those of a clean and of a toxic row. The model's arrays are changed in place. What is held does not grow
    with the number of batches.
    """

    def __init__(self, model: Model, alive: np.ndarray, weights: tuple[float, float], step: int = 0):
        self.model, self.alive, self.weights, self.step = model, alive, weights, step
        self.params = [model.table, *model.filters, *model.bias, model.out]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        self.bias_m = self.bias_v = 0.0
        self.own = 0  # steps of this trainer, whose moments begin at zero
        self.words = Words()

    def learn(self, docs: list[list[str]], labels: list[int]) -> None:
        """One step."""
        model, pad = self.model, max(WIDTHS) - 1
        # texts of unknown words only have nothing toxic about them: some blank ones say so
        blank = max(1, labels.count(0) // 10)
        docs, y = docs + [[""]] * blank, np.array([*labels, *[0] * blank], np.float32)
        self.words.add(w for d in docs for w in d)
        index = self.words.index
        ids = np.fromiter((i for d in docs for i in ([index[w] if w else -1 for w in d] + [-1] * pad)), np.int64)
        ends = np.cumsum([len(d) + pad for d in docs])
        begin = np.concatenate(([0], ends[:-1]))
        used, inverse = np.unique(ids, return_inverse=True)
        vec = np.zeros((len(used), DIM), np.float32)
        real = used[used >= 0]
        if len(real):
            own, sizes = self.words.of(real)
            vec[used >= 0] = np.add.reduceat(model.table[own], np.cumsum(sizes) - sizes, axis=0)
        x = vec[inverse]
        doc = np.repeat(np.arange(len(docs)), np.diff(np.concatenate(([0], ends))))
        zs = model.pool(x, ends)
        tops = [np.maximum.reduceat(z, begin, axis=0) for z in zs]
        top = np.concatenate(tops, axis=1)
        feats = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(feats @ model.out + model.out_bias, -60, 60)))
        g = ((p - y) * np.where(y > 0, self.weights[1], self.weights[0]) / len(y)).astype(np.float32)
        grads = [np.zeros_like(q) for q in self.params[1:]]
        grads[-1] = feats.T @ g
        d_top = np.outer(g, model.out) * (top > 0)
        inside = np.concatenate([inverse, np.full(pad, len(used))])  # windows at the very end reach beyond it
        vec = np.concatenate([vec, np.zeros((1, DIM), np.float32)])
        dv = np.zeros_like(vec)
        for k, (w, z, t) in enumerate(zip(WIDTHS, zs, tops)):
            r, c = np.nonzero(z == t[doc])
            win = np.zeros(t.shape, np.int64)
            win[doc[r][::-1], c[::-1]] = r[::-1]  # the first of equal windows
            d = d_top[:, k * FILTERS : (k + 1) * FILTERS]
            grads[len(WIDTHS) + k] = d.sum(0)
            for j in range(w):
                word = inside[win + j]
                grads[k][j] = np.einsum("bf,bfd->df", d, vec[word])
                np.add.at(dv, word.ravel(), (d[:, :, None] * model.filters[k][j].T[None]).reshape(-1, DIM))
        self.step += 1
        self.own += 1
        hit = np.flatnonzero(np.abs(dv[:-1]).sum(1) > 0)
        hit = hit[used[hit] >= 0]
        lr = RATE * min(1.0, self.step / 20)
        if len(hit):
            own, sizes = self.words.of(used[hit])
            gb = np.repeat(dv[hit], sizes, axis=0)
            ub, ib = np.unique(own, return_inverse=True)
            ge = np.zeros((len(ub), DIM), np.float32)
            np.add.at(ge, ib, gb)
            ge *= self.alive[ub][:, None]
            m, v = self.moments[0]
            m[ub] = 0.9 * m[ub] + 0.1 * ge
            v[ub] = 0.99 * v[ub] + 0.01 * ge * ge
            model.table[ub] -= (lr * m[ub] / (np.sqrt(v[ub]) + 1e-6)) * self.alive[ub][:, None]
        for q, gq, (m, v) in zip(self.params[1:], grads, self.moments[1:]):
            m *= 0.9
            m += 0.1 * gq
            v *= 0.99
            v += 0.01 * gq * gq
            q -= (lr * (m / (1 - 0.9 ** min(self.own, 500))) / (np.sqrt(v / (1 - 0.99 ** min(self.own, 2000))) + 1e-6)).astype(np.float32)
        gb0 = float(g.sum())
        self.bias_m, self.bias_v = 0.9 * self.bias_m + 0.1 * gb0, 0.99 * self.bias_v + 0.01 * gb0 * gb0
        model.out_bias -= lr * self.bias_m / (self.bias_v**0.5 + 1e-6)


def class_weights(toxic: int, clean: int) -> tuple[float, float]:
    """Weights of a clean and of a toxic row: both classes, with the blank texts of the clean one, weigh the same."""
    clean += 1 + clean // 10
    n = toxic + clean
    return n / (2 * max(1, clean)), n / (2 * max(1, toxic))


def epochs(rows: int) -> int:
    """How often each row is learnt from: once, or as often as it takes for a chain of the least length."""
    return max(1, -(-LEAST_STEPS * BATCH // max(1, rows)))


def train(texts: list[str], labels: list[int], seed: int = 1) -> Model:
    """A model of rows in memory, learnt in one chain of steps."""
    rng, docs = np.random.RandomState(seed), [split(t) for t in texts]
    # n-grams of few documents only stay at zero: they could be learnt by heart
    alive = document_counts([texts]) >= LEAST_DF
    trainer = Trainer(first(alive, seed), alive, class_weights(sum(labels), labels.count(0)))
    for _ in range(epochs(len(docs))):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            rows = order[at : at + BATCH]
            trainer.learn([docs[r] for r in rows], [labels[r] for r in rows])
    return trainer.model


def best_limit(z: np.ndarray, y: np.ndarray) -> float:
    """The limit with the best F1 on rows of both classes, in the middle of its gap."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    tp = np.cumsum(y)
    f1 = 2 * tp / (np.arange(1, len(z) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # ties stand on one side
    k = int(np.argmax(f1))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1.0)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def labelled(docs: DataFrame, own: DataFrame, count: int) -> DataFrame:
    """The rows of `docs` that `own`, a table of `count` ids, has. Of many ids only a bitmap of their hashes is broadcast; it spares most other rows the shuffle of the exact join."""
    if count <= BROADCAST_ROWS:
        return docs.join(F.broadcast(own), "doc_id")
    if docs.schema["doc_id"].dataType == own.schema["doc_id"].dataType:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)) + 1
        bits = own.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
        at = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        docs = docs.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_bucket", "_bits")
    return docs.join(own.hint("merge"), "doc_id")


def _alive(rows: DataFrame) -> np.ndarray:
    """Which buckets occur in enough texts of all `rows`."""
    size = BUCKETS // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity's training", lambda: None)
        counts = document_counts(texts for _, texts in text_batches(batches, "text"))
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([counts[p * size : (p + 1) * size].tobytes() for p in range(PIECES)])], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total = None, np.zeros(size, np.int64)
        for batch in batches:
            for p, counts in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist()):
                piece = p
                total += np.frombuffer(counts, np.int64)
        if piece is not None:
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.packbits(total >= LEAST_DF).tobytes()])], names=["piece", "alive"])

    counted = rows.select("text").mapInArrow(count, "piece int, counts binary").repartitionById(PIECES, F.col("piece"))
    alive = np.zeros(BUCKETS, bool)
    for r in counted.mapInArrow(add, "piece int, alive binary").collect():
        alive[r["piece"] * size : (r["piece"] + 1) * size] = np.unpackbits(np.frombuffer(r["alive"], np.uint8)).astype(bool)
    return alive


def _learnt(rows: DataFrame, chains: int, model: Model, alive: np.ndarray, weights: tuple[float, float], step: int) -> int:
    """Learns from `rows` (chain, place, toxic, text) in chains of steps that begin at `model`, which becomes their mean; the steps of a chain.

    A bucket's weights become the mean over the chains that changed them. Sums are taken in the order of chains.
    """
    size = BUCKETS // PIECES
    shared = rows.sparkSession.sparkContext.broadcast((model.bare(), alive))
    schema, weights_small = "piece int, chain int, at binary, delta binary", len(model.small())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity's training", lambda: None)
        start, alive = shared.value
        trainer, chain, docs, labels, held = Trainer(start.copy(), alive, weights, step), None, [], [], 0
        for batch, texts in text_batches(batches, "text"):
            for chain, y, text in zip(batch.column("chain").to_pylist(), batch.column("toxic").to_pylist(), texts):
                docs.append(split(text))
                labels.append(y)
                held += len(text)
                if len(docs) == BATCH or held >= BATCH_CHARS:
                    trainer.learn(docs, labels)
                    docs, labels, held = [], [], 0
        if docs:
            trainer.learn(docs, labels)
        if chain is None:
            return
        delta = trainer.model.table - start.table
        changed = delta.any(axis=1)
        for p in range(PIECES):
            part = slice(p * size, (p + 1) * size)
            at = np.flatnonzero(changed[part]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([chain], pa.int32()), pa.array([at.tobytes()]), pa.array([delta[part][at].tobytes()])], names=["piece", "chain", "at", "delta"])
        rest = np.append(trainer.model.small() - start.small(), float(trainer.own))
        yield pa.RecordBatch.from_arrays([pa.array([PIECES], pa.int32()), pa.array([chain], pa.int32()), pa.array([b""]), pa.array([rest.tobytes()])], names=["piece", "chain", "at", "delta"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, total, times = None, np.zeros((size, DIM)), np.zeros((size, 1), np.int64)
        rest, ended = np.zeros(weights_small + 1), 0
        for batch in batches:
            for piece, at, delta in zip(*(batch.column(c).to_pylist() for c in ("piece", "at", "delta"))):
                if piece == PIECES:
                    rest, ended = rest + np.frombuffer(delta, np.float64), ended + 1
                else:
                    rows = np.frombuffer(at, np.int32)
                    total[rows] += np.frombuffer(delta, np.float32).reshape(-1, DIM)
                    times[rows] += 1
        if piece is not None:
            out = rest / ended if piece == PIECES else (total / np.maximum(1, times)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([out.tobytes()])], names=["piece", "delta"])

    dealt = rows.select("chain", "place", "toxic", "text").repartitionById(chains, F.col("chain")).sortWithinPartitions("place", "text")
    found = dealt.mapInArrow(learn, schema).repartitionById(PIECES + 1, F.col("piece")).sortWithinPartitions("chain")
    for r in found.mapInArrow(mean, "piece int, delta binary").collect():
        if r["piece"] < PIECES:
            model.table[r["piece"] * size : (r["piece"] + 1) * size] += np.frombuffer(r["delta"], np.float32).reshape(-1, DIM)
        else:
            rest = np.frombuffer(r["delta"], np.float64)
            model.set_small(model.small() + rest[:-1])
            step += max(1, int(rest[-1]))
    shared.destroy()
    return step


def _trained(rows: DataFrame, toxic: int, clean: int, seed: int) -> Model:
    """A model that has learnt from each of `rows` (doc_id, toxic, text).

    As many chains learn beside each other as have steps enough, and their weights are averaged after each round. Which
    rows a chain has and their order follow from hashes of their ids, not from how the table is cut.
    """
    n = toxic + clean
    alive = _alive(rows)
    model, weights = first(alive, seed), class_weights(toxic, clean)
    chains = max(1, min(CHAINS, n // (LEAST_STEPS * BATCH)))
    times = epochs(n)
    rounds = 1 if chains == 1 else min(ROUNDS, -(-n // (chains * BATCH * ROUND_STEPS)))
    own = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 1 else rows.withColumn("epoch", F.lit(0))
    place = F.struct("epoch", F.xxhash64("doc_id", "epoch", F.lit(seed)))
    own = own.select(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(chains)).cast("int").alias("chain"), F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), F.lit(rounds)).alias("round"), place.alias("place"), "toxic", "text")
    step = 0
    for r in range(rounds):
        step = _learnt(own.where(F.col("round") == r), chains, model, alive, weights, step)
    return model


def _logits(rows: DataFrame, model: Model) -> DataFrame:
    """lang, toxic and logit z of each row's whole text."""
    shared = rows.sparkSession.sparkContext.broadcast(model.bare())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        claim("toxicity", model.forget)
        for batch, texts in text_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(model.logits(texts).astype(np.float64))], names=["lang", "toxic", "z"])

    slim = rows.select("lang", "toxic", "text")
    out = written(slim.mapInArrow(run, slim.select("lang", "toxic", F.lit(0.0).alias("z")).schema), "logits")
    shared.destroy()
    return out


def best_gaps(rows: DataFrame, by: Column) -> dict[str, tuple[float, float | None, int, int]]:
    """For each value of `by`, the two z between which `best_limit` lies (the lower one is None at the end), and its toxic and clean rows.

    Exact over all rows (toxic, z), in bins of z, so that no task has to sort them all; nulls of `by` and groups of one
    class have none.
    """
    same = rows.select(by.alias("g"), "toxic", "z").where("g is not null").groupBy("g", "z").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    ends = same.groupBy("g").agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.sum("pos").alias("total"), F.sum("n").alias("all")).where("total > 0 and total < all")
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.floor((F.col("z") - F.col("lo")) / width * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    binned = same.join(F.broadcast(ends), "g").withColumn("bin", place.cast("int"))
    higher = Window.partitionBy("g").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy("g", "bin").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    above = sums.select("g", "bin", F.coalesce(F.sum("pos").over(higher), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("n_above"))
    down = Window.partitionBy("g", "bin").orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, 0)
    f1 = 2 * (F.col("pos_above") + F.sum("pos").over(down)) / (F.col("n_above") + F.sum("n").over(down) + F.col("total"))
    best = binned.join(F.broadcast(above), ["g", "bin"]).select("g", "z", "total", "all", f1.alias("f1")).groupBy("g").agg(F.max(F.struct("f1", "z")).alias("best"), F.max("total").alias("total"), F.max("all").alias("all"))
    best = best.select("g", F.col("best.z").alias("top"), "total", "all")
    found = same.join(F.broadcast(best), "g").groupBy("g").agg(F.first("top").alias("top"), F.max(F.when(F.col("z") < F.col("top"), F.col("z"))).alias("low"), F.first("total").alias("total"), F.first("all").alias("all"))
    return {r["g"]: (r["top"], r["low"], r["total"], r["all"] - r["total"]) for r in found.collect()}


def _calibrate(model: Model, rows: DataFrame, prior_rows: int) -> None:
    """Sets the model's common limit, its slope and the languages' limits by all of `rows`."""
    scored = _logits(rows, model)
    common = best_gaps(scored, F.lit(""))
    if not common:
        return
    top, low, toxic, clean = common[""]
    # a text without known words stays below the limit
    model.middle = max(top - 1.0 if low is None else (top + low) / 2, float(model.logits([""])[0]) + 1e-3)
    # whole millionths, so that the sum does not depend on the order of rows
    spread = scored.agg(F.sum(F.round(F.abs(F.col("z") - model.middle) * 1_000_000).cast("long")).alias("sum")).first()["sum"] / 1_000_000 / (toxic + clean)
    model.slope = float(3.0 / spread) if spread > 1e-6 else 1.0
    # no language's limit lets a text without known words go
    least = max(0.3, float(model.scores([""])[0]) + 1e-6)
    for lang, (top, low, toxic, clean) in best_gaps(scored, F.when(F.col("lang") != "", F.col("lang"))).items():
        few, at = min(toxic, clean), model.logistic(np.array([top, top if low is None else low]))
        own_limit = (few * (at[0] - 1.0 if low is None else at.mean()) + prior_rows * 0.5) / (few + prior_rows)
        model.limits[lang] = float(np.clip(own_limit, least, max(0.7, least)))


def fit(docs: DataFrame, labels: DataFrame, seed: int = 1, prior_rows: int = 20) -> Model:
    """Learns from the whole text of every labelled row whose fold is 1 to 3, and sets limits by every one of fold 4; fold 0 is never read.

    Of conflicting labels of one id the toxic one counts, of several texts the least. A language's limit is drawn to the
    common one, 0.5, as if `prior_rows` rows of its rarer class had that limit; languages without rows of both classes have
    0.5. Without rows of both classes every score is the same: the share of toxic rows, or 0 without rows. Null ids, labels
    and texts teach nothing. What the driver holds is one model.
    """
    spark = docs.sparkSession
    with Scratch(spark), small_batches(spark):
        own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        own = written(own, "labels")
        rows = labelled(docs.select("doc_id", "lang", "text").where("text is not null"), own, own.count())
        # one row an id
        rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r"), F.max("toxic").alias("toxic")).select("doc_id", "r.lang", "r.text", "toxic", fold(F.col("doc_id")).alias("fold"))
        rows = written(rows, "labelled")
        n = {(r["learn"], r["toxic"]): r["count"] for r in rows.groupBy((F.col("fold") != 4).alias("learn"), "toxic").count().collect()}
        toxic, clean = n.get((True, 1), 0), n.get((True, 0), 0)
        if not (toxic and clean):
            total = sum(n.values())
            share = (toxic + n.get((False, 1), 0)) / total if total else 0.0
            model = first(np.zeros(BUCKETS, bool), seed)
            model.set_small(np.zeros(len(model.small())))
            model.out_bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
            return model
        model = _trained(rows.where("fold <> 4"), toxic, clean, seed)
        _calibrate(model, rows.where("fold = 4"), prior_rows)
        return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """`docs` without its text (or with it) and with the score of each whole text; null texts are empty.

    Repeated rows stay repeated, an empty table stays empty, and other columns pass through, but for one named `out`.
    """
    own, at = numbered(docs)
    names = [c for c in docs.columns if c != out and (keep_text or c != text)]
    scored = _scored(own, model, at[text], [at[c] for c in names])
    return scored.toDF(*names, out)


def _scored(own: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """The columns of `keep` and score, of a table without such a column."""
    shared = own.sparkSession.sparkContext.broadcast(model.bare())  # about 8 MB, whatever the corpus; it goes with the result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        claim("toxicity", model.forget)
        for batch, texts in text_batches(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(model.scores(texts).astype(np.float64))], names=[*keep, "score"])

    slim = own.select(*dict.fromkeys([*keep, text]))
    return slim.mapInArrow(run, slim.select(*keep, F.lit(0.0).alias("score")).schema)


def limit(model: Model, lang: Column) -> Column:
    """The limit of a language; 0.5 where it has none of its own."""
    out = F.lit(0.5)
    for k, v in sorted(model.limits.items()):
        out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out


def keep_clean(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of `docs` whose score is under their language's limit, as they are.

    Rows with a null or empty text stay, repeated rows stay repeated, an empty table stays empty, and extra columns of any
    name pass through.
    """
    own, at = numbered(docs)
    scored = _scored(own, model, at[text], own.columns)
    return scored.where(F.col("score") < limit(model, F.col(at[lang]))).select(*own.columns).toDF(*docs.columns)
