"""Secrets in whole texts: fixed patterns, and strings that look like random keys.

Candidates for random keys are long runs of key characters. Their encoding is inferred as the smallest alphabet that
holds all characters. A battery then tests each candidate against a random string of that encoding: chi-squared
uniformity of the alphabet, runs above and below the median, and serial correlation. What passes is weighed against
ordinary writing: 2^-(log-likelihood ratio of the uniform alphabet to writing) bounds the chance that writing looks like
this (Markov's inequality), so short strings never get a small one. The Benjamini-Hochberg rule over all candidates of
the corpus, by bins of length, sets the limit for that chance; it needs only a table of counts of fixed size.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, narrow, numbered, small_batches, text_batches, written

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: Key characters with padding behind them; a '=' before more of them parts a name from its value.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")

_LOWER, _UPPER, _DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: Letters of ordinary writing, per cent, a to z; other characters share what is left.
_LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)
#: Chances of the class of a character after a character of that or another class, in ordinary runs of key characters.
_STAY, _MOVE = 0.92, 0.04
#: Level of the battery, and of the false-discovery rule.
BATTERY, FDR = 0.001, 0.01
BINS = (20, 24, 32, 48, 64, 128)


def _classes(x: str) -> np.ndarray:
    a = np.frombuffer(x.encode("ascii"), np.uint8)
    return np.where((a >= 97) & (a <= 122), 0, np.where((a >= 65) & (a <= 90), 1, np.where((a >= 48) & (a <= 57), 2, 3)))


_FREQ = np.full(128, 1 / 4)
for _i, _v in enumerate(_LETTERS):
    _FREQ[97 + _i] = _FREQ[65 + _i] = _v / sum(_LETTERS)
_FREQ[48:58] = 1 / 10


def infer(x: str) -> str | None:
    """The smallest encoding whose alphabet holds the whole string (without padding), or None."""
    chars = set(x.rstrip("="))
    fitting = [k for k, a in ENCODINGS.items() if chars <= set(a)]
    return min(fitting, key=lambda k: len(ENCODINGS[k])) if fitting else None


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(x: str, encoding: str) -> tuple[float, float, float]:
    """P-values of uniformity (upper tail), runs and serial correlation (both tails) of a random string's symbols."""
    alphabet = ENCODINGS[encoding]
    place = np.zeros(128, np.int64)
    for i, c in enumerate(alphabet):
        place[ord(c)] = i
    v = place[np.frombuffer(x.rstrip("=").encode("ascii"), np.uint8)]
    n, k = len(v), len(alphabet)
    counts = np.bincount(v, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() / (n / k))
    # Wilson-Hilferty, with the exact variance of the statistic for short strings
    d = k - 1
    spread = 2 * d * (n - 1) / n
    z = (chi - d) / math.sqrt(spread)
    skewed = ((max(chi, 1e-9) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    uniform = 0.5 * math.erfc(max(z, skewed) / math.sqrt(2))
    above = v >= k / 2
    hi = int(above.sum())
    lo = n - hi
    if hi and lo:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * hi * lo / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = _tail((runs - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    w = v - v.mean()
    s = float((w * w).sum())
    r = float((w[1:] * w[:-1]).sum() / s) if s else 1.0
    p_serial = _tail((r + 1 / n) * math.sqrt(n))
    return uniform, p_runs, p_serial


def writing_bits(x: str, encoding: str) -> float:
    """Bits by which the uniform alphabet is likelier than ordinary writing; the length makes it grow."""
    x = x.rstrip("=")
    cls = _classes(x)
    stay = cls[1:] == cls[:-1]
    log_writing = float(np.log2(_FREQ[np.frombuffer(x.encode("ascii"), np.uint8)]).sum()) + float(np.where(stay, math.log2(_STAY), math.log2(_MOVE)).sum()) + math.log2(0.25)
    return -len(x) * math.log2(len(ENCODINGS[encoding])) - log_writing


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]], tested: list[int] | None = None) -> list[tuple[int, int, float]]:
    """(start, end, bits) of strings that pass the battery and touch no base span.

    Every string with an encoding is a hypothesis of the false-discovery rule, whether it passes or not: `tested` counts
    them by bins of length.
    """
    out = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if any(s < b and a < e for s, _, e in base):
            continue
        x = m[0]
        encoding = infer(x)
        if encoding is None or len(x.rstrip("=")) < 20:
            continue
        if tested is not None:
            tested[bisect_right(BINS, b - a) - 1] += 1
        bits = writing_bits(x, encoding)
        if bits > 0 and min(battery(x, encoding)) >= BATTERY:
            out.append((a, b, bits))
    return out


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and spans, an array of (start, kind, end) in order of start, then kind.

    Offsets count code points; ends are exclusive. A null or empty text has no spans; repeated rows stay, an empty table
    gives an empty table, and extra columns are left out. The texts are read once, whole: candidates go to the shared folder,
    the limit comes from their counts, and spans under it are dropped.
    """
    return _tested(narrow(docs, doc_id=doc_id, text=text), "text", ["doc_id"])


def _tested(own: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns of `keep` and spans, of a table without columns named found, tested and spans."""
    schema = "array<struct<start:int,kind:int,end:int,bits:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("secretscan", lambda: None)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
        for batch, texts in text_batches(batches, text):
            rows, counts = [], []
            for x in texts:
                base, tested = base_spans(x), [0] * len(BINS)
                found = [(s, k, e, None) for s, k, e in base] + [(a, 3, b, bits) for a, b, bits in candidates(x, base, tested)]
                rows.append([{"start": s, "kind": k, "end": e, "bits": z} for s, k, e, z in sorted(found, key=lambda v: v[:2])])
                counts.append(tested if any(tested) else None)
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(rows, kind), pa.array(counts, pa.list_(pa.int32()))], names=[*keep, "found", "tested"])

    slim = own.select(*dict.fromkeys([*keep, text]))
    found = slim.mapInArrow(run, slim.select(*keep, F.lit(None).cast(schema).alias("found"), F.lit(None).cast("array<int>").alias("tested")).schema)
    with small_batches(own.sparkSession):
        found = written(found, "secrets")
    limits = _limits(found)
    passed = F.filter("found", lambda s: s["bits"].isNull() | (s["bits"] >= _limit_of(s, limits)))
    return found.select(*keep, F.transform(passed, lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("spans"))


def _bin(length):
    at = F.lit(0)
    for i, b in enumerate(BINS[1:], 1):
        at = F.when(length >= b, i).otherwise(at)
    return at


def _limit_of(s, limits: dict[int, float]):
    b = _bin(s["end"] - s["start"])
    out = F.lit(float("inf"))
    for i, v in limits.items():
        out = F.when(b == i, F.lit(v)).otherwise(out)
    return out


def _limits(found: DataFrame) -> dict[int, float]:
    """For each bin of length, the least bits that the Benjamini-Hochberg rule lets through.

    The hypotheses are all strings that were tested; those that passed the battery are counted by bin and by tenths of a
    bit up to 400 bits: at most 6 x 4001 rows, however large the corpus.
    """
    s = F.explode(F.filter("found", lambda s: s["bits"].isNotNull())).alias("s")
    rows = found.select(s).groupBy(_bin(F.col("s.end") - F.col("s.start")).alias("bin"), F.least(F.lit(4000), F.floor(F.col("s.bits") * 10)).cast("int").alias("tenth")).count().collect()
    sums = found.where("tested is not null").agg(*(F.sum(F.col("tested")[b].cast("long")).alias(f"n{b}") for b in range(len(BINS)))).first()
    return {b: least_bits(sums[b] or 0, [(r["tenth"], r["count"]) for r in rows if r["bin"] == b]) for b in range(len(BINS))}


def least_bits(tested: int, passed: list[tuple[int, int]]) -> float:
    """The limit of a bin with `tested` hypotheses, of which `passed` has (tenths of a bit, how many)."""
    rank, limit = 0, float("inf")
    for tenth, n in sorted(passed, reverse=True):
        rank += n
        if tenth / 10 >= math.log2(tested * len(BINS) / (FDR * rank)):
            limit = tenth / 10
    return limit


def spans_text(spans, kinds: tuple[int, ...] = (0, 1, 2, 3)):
    """kind:start:end of the spans of these kinds, joined by commas."""
    name = F.array(*(F.lit(k) for k in KINDS))
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans, kind: int):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, mark: str = "[secret]", doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """`docs` with each span that `scan` finds replaced by `mark`; overlapping spans become one.

    Null texts stay null, repeated rows stay repeated, an empty table stays empty. Extra columns of any name pass through;
    `n_chars`, where there is such a column, counts the new text's characters (and stays as it is where the text is null).
    """
    own, at = numbered(docs)
    body, names = at[text], own.columns
    # the spans of a row travel with its text, so that rows with equal ids stay apart
    found = _tested(own, body, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, body):
            out = []
            for x, null, spans in zip(texts, batch.column(body).is_null().to_pylist(), batch.column("spans").to_pylist()):
                parts, end = [], 0
                for s in spans:
                    if s["end"] <= end:
                        continue
                    if s["start"] >= end:
                        parts += [x[end : s["start"]], mark]
                    end = s["end"]
                out.append(None if null else "".join([*parts, x[end:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == body else batch.column(c) for c in names], names=names)

    changed = found.mapInArrow(run, own.schema)
    if n_chars in at:
        kind = dict(own.dtypes)[at[n_chars]]
        changed = changed.withColumn(at[n_chars], F.when(F.col(body).isNull(), F.col(at[n_chars])).otherwise(F.length(body).cast(kind)))
    return changed.toDF(*docs.columns)
