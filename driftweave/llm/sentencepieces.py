"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words are turned into one flat array of symbols. Each round finds, for every word, the smallest rank among the pairs of
neighbouring symbols, merges that pair wherever it stands (leftmost first, without overlap), and compacts the arrays,
until no word has a pair left. Characters outside the vocabulary become byte pieces.

Long words, as texts without spaces have them, are encoded in parts. No merge crosses a place between two parts if the
token before it and the token behind it, encoded together, stay these two: up to the first merge that crosses, both tokens'
own merges come in the same order whatever stands around them. So parts are joined where that holds, and else encoded as one.

Cutting a text before each run of spaces is exact as long as no piece holds a space mark behind another character;
`Pieces` checks this and else keeps texts whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, text_batches

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Distinct words whose ids a worker keeps; the cache starts anew beyond this.
CACHE_WORDS = 300_000
#: Words of more characters are encoded in parts of about so many, so many parts at a time.
PART, PARTS = 64, 4096

_loaded: dict[str, "Pieces"] = {}


class Pieces:
    """The tables of a SentencePiece BPE model with byte fallback and no character map."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if "".join(sp.encode("  a  b ", out_type=str)) != "▁▁▁a▁▁b▁" or any(sp.decode(sp.encode(x)) != x for x in ("\ufb01 \u2460", "A\u030a\u3000b", "\tx\n")):
            raise ValueError(f"{path} maps characters, drops spaces or puts none in front: this encoder does not know such models")
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        own = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        ids = {names[i]: i for i in own}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.cuts = not any(MARK in p.lstrip(MARK) for p in ids)
        # symbols: the pieces, and behind them single characters that only occur inside pieces
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(names) + len(symbols))
        pairs: dict[int, int] = {}
        risky = np.zeros(max(symbols.values()) + 2, bool)
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
                    for x in (a, b):  # a better rank than that of a part: after a merge, this pair would come first
                        if x < n and rank[i] <= rank[x]:
                            risky[x] = True
        self.risky = risky
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = rank[self.merged]
        chars = sorted(c for c in symbols if len(c) == 1)
        self.chars = np.array([ord(c) for c in chars], np.uint32)
        self.char_symbols = np.array([symbols[c] for c in chars], np.int32)
        self.size = n
        self.code = np.zeros(max(symbols.values()) + 1, np.int64)  # code points of symbols of one character
        self.code[self.char_symbols] = self.chars
        self.width = np.ones(max(symbols.values()) + 1, np.int64)  # characters of each symbol
        for p, i in ids.items():
            self.width[i] = len(p)
        # decoding: the bytes of each piece
        shown: list[bytes] = []
        byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        for i, p in enumerate(names):
            shown.append(bytes([byte_of[i]]) if i in byte_of else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else p.replace(MARK, " ").encode())
        self.shown_len = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.concatenate(([0], np.cumsum(self.shown_len)))[:-1]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.starts_blank = np.array([x[:1] == b" " and i not in byte_of and not sp.is_unknown(i) for i, x in enumerate(shown)], bool)
        self.cache: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> "Pieces":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging symbols a and b; NONE where there is no such piece."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), self.merged[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the number of ids of each word. Words hold marks for spaces."""
        return self._bytes(*self._symbols(words), len(words))

    def encode_long(self, word: str) -> np.ndarray:
        """Ids of a long word, in time and memory that grow with its length."""
        ends = np.cumsum(self._widths(self._parts([word[i : i + PART] for i in range(0, len(word), PART)])))
        # first parts end at any character; the second ones end at tokens' ends in the middle of the first ones
        middle = np.minimum(np.arange(0, len(word), PART) + PART // 2, len(word))
        bounds = np.unique(np.concatenate(([0], ends[np.searchsorted(ends, middle)], [len(word)]))).tolist()
        found: dict[tuple[int, int], np.ndarray] = {}
        sound: set[int] = set()
        grown: dict[int, int] = {}
        while True:
            spans = list(zip(bounds, bounds[1:]))
            new = [s for s in spans if s not in found]
            for i in range(0, len(new), PARTS):
                some = new[i : i + PARTS]
                sym, wid = self._symbols([word[a:b] for a, b in some])
                found.update(zip(some, np.split(sym, np.cumsum(np.bincount(wid, minlength=len(some)))[:-1])))
            asked = [(at, found[left][-1], found[right][0]) for left, right in zip(spans, spans[1:]) if (at := left[1]) not in sound or left in new or right in new]
            left, right = (self._widths(np.array([x[c] for x in asked], np.int32)) for c in (1, 2))
            bad = set()
            for i in range(0, len(asked), PARTS):
                some = asked[i : i + PARTS]
                sym, wid = self._symbols([word[at - a : at + b] for (at, _, _), a, b in zip(some, left[i:].tolist(), right[i:].tolist())])
                two = np.bincount(wid, minlength=len(some)) == 2
                first = np.searchsorted(wid, np.arange(len(some)))
                for (at, l, r), k, ok in zip(some, first.tolist(), two.tolist()):
                    (sound if ok and sym[k] == l and sym[k + 1] == r else bad).add(at)
            if not bad:
                break
            # a part whose end is bad takes in the part behind it, and twice as many each time that this does not do
            sound -= bad
            left, kept, skip = 0, [0], 0
            for b in bounds[1:-1]:
                if b in bad and not skip:
                    skip = grown[left] = 2 * grown.get(left, 0) or 1
                if skip:
                    skip -= 1
                    sound.discard(b)
                else:
                    kept.append(b)
                    left = b
            bounds = [*kept, bounds[-1]]
        whole = np.concatenate([found[s] for s in spans])
        return self._bytes(whole, np.zeros(len(whole), np.int32), 1)[0]

    def _parts(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self._symbols(words[i : i + PARTS])[0] for i in range(0, len(words), PARTS)])

    def _widths(self, sym: np.ndarray) -> np.ndarray:
        return np.where(sym < 0, 1, self.width[np.maximum(sym, 0)])

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, flat, and each one's word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        cps = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.chars, cps), len(self.chars) - 1)
        known = self.chars[at] == cps
        # unknown characters get symbols of their own, below zero, that no pair has
        sym = np.where(known, self.char_symbols[at], -1 - cps.astype(np.int64)).astype(np.int32)
        wid = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        done_w, done_s = [], []
        rank, into = self._pairs(sym, wid)
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], wid[1:] != wid[:-1])))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.concatenate((starts, [len(sym)])))
            least_at = np.repeat(least, sizes)
            if (least == NONE).any():
                over = least_at == NONE
                done_w.append(wid[over])
                done_s.append(sym[over])
                keep = ~over
                sym, wid, rank, into, least_at = sym[keep], wid[keep], rank[keep], into[keep], least_at[keep]
                if not len(sym):
                    break
            best = np.flatnonzero(rank == least_at)
            # overlapping pairs stand next to each other: take every other one of a run, from its left end
            gap = np.concatenate(([True], np.diff(best) > 1))
            first = best[np.maximum.accumulate(np.where(gap, np.arange(len(best)), 0))]
            best = best[(best - first) % 2 == 0]
            if (careful := self.risky[into[best]]).any():
                w = wid[best]
                lead = np.concatenate(([True], w[1:] != w[:-1]))
                best = best[lead | ~careful]
            sym[best] = into[best]
            keep = np.ones(len(sym), bool)
            keep[best + 1] = False
            stale = np.zeros(len(sym), bool)
            stale[best] = True
            stale[np.maximum(best - 1, 0)] = True
            sym, wid, rank, into, stale = sym[keep], wid[keep], rank[keep], into[keep], stale[keep]
            # the symbol before a merge may itself have been merged away: its keeper stands one further left
            again = np.flatnonzero(stale | np.concatenate((stale[1:], [False])))
            rank[again], into[again] = self._pairs(sym, wid, again)
        if not done_s:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        wid, sym = np.concatenate(done_w), np.concatenate(done_s)
        order = np.argsort(wid, kind="stable")
        return sym[order], wid[order]

    def _pairs(self, sym: np.ndarray, wid: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(sym)) if at is None else at
        rank, into = np.full(len(at), NONE), np.zeros(len(at), np.int32)
        inner = np.flatnonzero(at + 1 < len(sym))
        inner = inner[wid[at[inner]] == wid[at[inner] + 1]]
        rank[inner], into[inner] = self.pair(sym[at[inner]], sym[at[inner] + 1])
        return rank, into

    def _bytes(self, sym: np.ndarray, wid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of symbols outside the vocabulary."""
        odd = np.flatnonzero((sym < 0) | (sym >= self.size))
        if len(odd):
            own = sym[odd]
            code = np.where(own < 0, -1 - own, self.code[np.maximum(own, 0)])
            size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            count = np.ones(len(sym), np.int64)
            count[odd] = size
            sym, wid = np.repeat(sym, count), np.repeat(wid, count)
            at = np.repeat(np.cumsum(count)[odd] - size, size) + (place := np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            size, code = np.repeat(size, size), np.repeat(code, size)
            rest = code >> 6 * (size - 1 - place)  # UTF-8: the first byte tells the length, the others hold six bits each
            sym[at] = self.byte_ids[np.where(size == 1, code, np.where(place == 0, (0xF00 >> size & 0xFF) | rest, 0x80 | rest & 0x3F))]
        return sym, np.bincount(wid, minlength=n)

    def words(self, text: str) -> list[str]:
        """The parts of a text that are encoded one by one, without the space that each begins with."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if not self.cuts:
            return [text]
        if "  " in text or text[0] == " ":
            return [x[1:] for x in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ")

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of whole texts."""
        parts = [self.words(x) for x in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = list(set().union(*parts).difference(cache)) if parts else []
        long = {w: self.encode_long((MARK + w).replace(" ", MARK)).astype("<i4").tobytes() for w in new if len(w) >= 2 * PART}  # not kept: they are large and seldom come again
        new = [w for w in new if w not in long]
        if new:
            ids, counts = self.encode_words([(MARK + w).replace(" ", MARK) for w in new])
            raw, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
            cache.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends))))
        known = cache if not long else {**{w: cache[w] for p in parts for w in p if w in cache}, **long}
        docs = [b"".join([known[w] for w in p]) for p in parts]
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) // 4))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(docs), np.int32)))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of the lists of ids that `offsets` cuts out of `ids`."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        lens, at = self.shown_len[ids], self.shown_at[ids]
        filled = offsets[:-1] < offsets[1:]
        head = offsets[:-1][filled]
        if (lens[head] == 0).any():  # the blank after leading control pieces goes too; the library has that rule
            return pa.array([self.sp.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
        blank = self.starts_blank[ids[head]]
        lens[head[blank]] -= 1
        at[head[blank]] += 1
        ends = np.concatenate(([0], np.cumsum(lens)))
        data = self.shown[np.arange(ends[-1]) + np.repeat(at - ends[:-1], lens)]
        bounds = ends[offsets].astype(np.int64)
        raw = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
        try:
            raw.validate(full=True)
        except pa.ArrowInvalid:  # byte pieces that are not UTF-8: the library has its own rule for them
            return pa.array([self.sp.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
        return raw.cast(pa.string())


def _append(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` without its text and with the ids of each whole text; a null or empty text has no ids.

    Repeated rows stay repeated, an empty table gives an empty table, and other columns pass through, but for one named
    `ids`. Each batch of about 2 MB of text is encoded on its own, so memory does not depend on the number of rows.
    """
    rest = [c for c in df.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.at(model)
        claim("sentencepieces", pieces.cache.clear)
        for batch, texts in text_batches(batches, text):
            yield _append(batch.select(rest), ids, pieces.encode(texts))

    slim = df.select(*(F.col(f"`{c}`") for c in [*rest, text]))
    schema = slim.select(*(F.col(f"`{c}`") for c in rest), F.array().cast("array<int>").alias(ids)).schema
    return slim.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """`df` with the text of each list of ids, as the library's decode(ids) has it; null or empty lists give ''.

    Other columns pass through, but for one named `text`; repeated rows stay repeated.
    """
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.at(model)
        for batch in batches:
            lists = batch.column(ids)
            step = max(1, len(lists) * 500_000 // max(1, len(lists.values)))
            for i in range(0, len(lists), step):
                part = batch.slice(i, step)
                lists = part.column(ids).fill_null([])
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                offsets = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
                yield _append(part.select(rest), text, pieces.decode(flat.astype(np.int64), offsets))

    slim = df.select(*(F.col(f"`{c}`") for c in rest))
    return slim.mapInArrow(run, slim.select("*", F.lit("").alias(text)).schema)


def ids_sha256(ids: str = "ids") -> Column:
    """Lowercase hex of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
