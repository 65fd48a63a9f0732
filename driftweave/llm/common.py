"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Scratch, removed, shared_dir, written  # noqa: F401

#: Bytes of text that a Python worker handles at once.
BATCH_BYTES = 2 << 20


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch cut into slices of about `limit` bytes of text, with the slice's texts; null texts are empty.

    Slices share the batch's memory, and only one slice's texts are Python strings at a time. Spark itself bounds a batch
    by rows and by bytes (spark.sql.execution.arrow.maxBytesPerBatch).
    """
    for batch in batches:
        column = batch.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            held = int(ends[start - 1]) if start else 0
            end = min(len(ends), int(np.searchsorted(ends, held + limit)) + 1)
            part = batch.slice(start, end - start)
            yield part, ["" if x is None else x for x in part.column(text).to_pylist()]
            start = end


def slices(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch cut into slices of about `limit` bytes in the named columns of strings or bytes."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            held = int(ends[start - 1]) if start else 0
            end = min(len(ends), int(np.searchsorted(ends, held + limit)) + 1)
            yield batch.slice(start, end - start)
            start = end


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """For actions inside the block, no more than so many rows go to a Python worker at once, so that little waits on both sides; the setting is restored."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """`df` written with small batches and read again, so that its Python workers' memory does not depend on the session's batches."""
    with small_batches(df.sparkSession):
        return written(df, name)


#: What each operator keeps in its worker between tasks; workers are shared by the stages of a pipeline.
_kept: dict[str, Callable[[], None]] = {}
_owner: list[str] = []


def claim(name: str, forget: Callable[[], None]) -> None:
    """Tells that an operator's task begins in this worker: what other operators keep here is dropped."""
    _kept[name] = forget
    if _owner != [name]:
        for other, drop in _kept.items():
            if other != name:
                drop()
        _owner[:] = [name]
        pa.default_memory_pool().release_unused()


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names of the keywords, so that extra columns cannot clash."""
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in columns.items()))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns named by their places, and which place each name has, so that no name can clash with one of ours.

    `toDF(*df.columns)` gives the names back.
    """
    names = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(reversed(df.columns), reversed(names)))
