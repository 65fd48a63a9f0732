"""Token counts of whole texts by batch encoding in Arrow functions that return lengths only.

Long texts are cut where cutting cannot change the tokens, and the pieces of a batch are encoded in calls of about equal
bytes, so that neither one long text nor many long texts in a row decide a worker's memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Texts of more characters than this are cut, at the first safe place behind each so many characters.
CUT_CHARS = 16_384
CALL_BYTES = 1 << 20

_counters: dict[str, "Counter"] = {}


def utf8_size(x: str) -> int:
    return len(x) if x.isascii() else len(x.encode())


class Counter:
    """Counts the tokens that a tokenizer file's library gives: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        self.piece = path.endswith(".model")
        if self.piece:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
            # a text may be cut before a run of spaces if no piece reaches across and spaces are kept as they are
            self.safe = not any("▁" in x.lstrip("▁") for x in names) and sp.encode("  a  b ", out_type=str) == sp.encode(" " * 2 + "a", out_type=str) + sp.encode(" b ", out_type=str)
            self.count = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            import json
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            from tokenizers import Tokenizer

            tk = Tokenizer.from_file(path)
            tk.no_truncation()
            tk.no_padding()
            spec = json.load(open(path))
            pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
            self.safe = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None
            self.special = [x["content"] for x in spec.get("added_tokens") or []]
            self.count = lambda texts: [len(x) for x in tk.encode_batch(texts, add_special_tokens=False)]

    @classmethod
    def at(cls, path: str) -> "Counter":
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def parts(self, text: str, size: int = CUT_CHARS) -> list[str]:
        """A text cut so that the parts' tokens are the text's; the whole text where there is no safe place."""
        if len(text) <= size or not self.safe or (not self.piece and any(x in text for x in self.special)):
            return [text]
        # sentencepiece puts a space before each part, which stands for the one that is cut away;
        # byte-level patterns start a token at a space between two ASCII letters, digits or marks
        # a space that ends the text stays in its part, as a part of no characters would lose its token
        gap = re.compile("(?s)(?<=[^ ▁]) (?=.)" if self.piece else "(?<=[!-~]) (?=[!-~])")
        out, start = [], 0
        while (m := gap.search(text, start + size)) is not None:
            out.append(text[start : m.start()])
            start = m.end() if self.piece else m.start()
        return [*out, text[start:]]

    def counts(self, texts: list[str]) -> np.ndarray:
        parts = [self.parts(x) for x in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        flat = [x for p in parts for x in p]
        got: list[int] = []
        at = held = 0
        for i, x in enumerate(flat):
            held += utf8_size(x)
            if held >= CALL_BYTES or i + 1 == len(flat):
                got += self.count(flat[at : i + 1])
                at, held = i + 1, 0
        return np.bincount(owner, got, len(texts)).astype(np.int64)


def count_tokens(df: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens", n_bytes: str = "n_bytes") -> DataFrame:
    """`df` without its text and with the tokens and UTF-8 bytes of each whole text, without begin, end or padding ids.

    A null or empty text has 0 of both; repeated rows stay repeated, and an empty table gives an empty table. Other columns
    pass through, but for ones named as the two new ones. Strings of special tokens inside a text count as the library's
    default has it. Texts of any length count whole.
    """
    rest = [c for c in df.columns if c not in (text, n_tokens, n_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.at(path)
        for batch, texts in text_batches(batches, text):
            sizes = np.fromiter(map(utf8_size, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.select(rest).columns, pa.array(counter.counts(texts)), pa.array(sizes)], names=[*rest, n_tokens, n_bytes])

    slim = df.select(*(F.col(f"`{c}`") for c in [*rest, text]))
    schema = slim.select(*(F.col(f"`{c}`") for c in rest), F.lit(0).cast("long").alias(n_tokens), F.lit(0).cast("long").alias(n_bytes)).schema
    return slim.mapInArrow(run, schema)
