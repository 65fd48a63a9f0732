"""Runs the per-stream state machines over DataFrames: in batch, in Structured Streaming, and from SQL.

All ways share the same step functions. In batch, rows are dealt out by stream, sorted, and folded in passing: a task holds
one stream's state and one Arrow batch, however long the stream is. Arrival order (`order`) is time.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import baselines
from .clusterer import StreamClusterer
from .detector import SNAPSHOT, ChangeDetector
from .drift_clusterer import DriftAwareClusterer

#: Name of an algorithm and what makes its state. Any class with update, labels, pending_ratio and events can be added.
ALGORITHMS: dict[str, Callable[..., Any]] = {
    "tight": StreamClusterer,
    "tight_drift": DriftAwareClusterer,
    "windowed_dbscan": baselines.WindowedDbscan,
    "dbstream": baselines.DbStream,
    "denstream": baselines.DenStream,
    "adaptive_radius": baselines.AdaptiveRadius,
}

DETECTED = f"fired boolean, {SNAPSHOT}"
CLUSTERED = "label long, surprise double, n_micro int, n_macro int, pending int, fired boolean, direction string, score double, acceleration double"
EVALUATED = "window long, pred long, pending_ratio double"


def detector_step(model: ChangeDetector, x: float, reset: bool = True) -> dict:
    """Feeds one number; with `reset`, a fire lowers the arms after it is reported."""
    fired = model.update(x)
    out = {"fired": fired, **model.snapshot()}
    if fired and reset:
        model.reset()
    return out


def cluster_step(model: Any, x: np.ndarray) -> dict:
    """Feeds one point and reads its label and the state's size."""
    model.update(x)
    event = next(iter(model.events()), {})
    balls, macros = getattr(model, "balls", None), getattr(model, "macros", None)
    centers = len(model._view()[0]) if balls is None else len(balls)
    surprise = model.last_surprise if hasattr(model, "last_surprise") else model.surprise(x)
    return {
        "label": int(model.labels([x])[0]), "surprise": float(surprise), "n_micro": centers, "n_macro": centers if macros is None else len(macros), "pending": len(getattr(model, "pool", ())),
        "fired": bool(event), "direction": event.get("direction"), "score": event.get("score"), "acceleration": event.get("acceleration"),
    }


def fold(df: DataFrame, by: list[str], order: str, columns: list[str], make: Callable[[tuple], Any], step: Callable[[Any, list], list[dict]], out: str, end: Callable[[Any], list[dict]] | None = None) -> DataFrame:
    """by, order and the columns of `out` for each dict that `step(state, row values of columns)` returns, stream by stream in order."""
    schema = StructType([*(df.schema[c] for c in (*by, order)), *StructType.fromDDL(out).fields])
    names = schema.names
    target = pa.schema([(f.name, t) for f, t in zip(schema, _arrow_types(schema))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows: list[dict] = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
            seqs, values = batch.column(order).to_pylist(), list(zip(*(batch.column(c).to_pylist() for c in columns)))
            for k, seq, value in zip(keys, seqs, values):
                if state is None or k != key:
                    key, state = k, make(k)
                for found in step(state, list(value)):
                    rows.append({**dict(zip(by, k)), order: seq, **found})
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*by, order, *(c for c in columns if c not in by and c != order)).repartition(parts, *by).sortWithinPartitions(*by, order)
    return dealt.mapInArrow(run, schema).select(*names)


def _arrow_types(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def detect(df: DataFrame, by: str | list[str] = "stream", order: str = "seq", x: str = "x", reset: bool = True, **settings: float) -> DataFrame:
    """Fires and snapshots of the change detector after each row of each stream."""
    return fold(df, _list(by), order, [x], lambda _: ChangeDetector(**settings), lambda m, v: [detector_step(m, v[0], reset)], DETECTED)


def cluster(df: DataFrame, algorithm: str = "tight", by: str | list[str] = "stream", order: str = "seq", vec: str = "vec", **settings: Any) -> DataFrame:
    """Label, surprise, sizes and drift events after each row of each stream."""
    make = ALGORITHMS[algorithm]
    return fold(df, _list(by), order, [vec], lambda _: make(**settings), lambda m, v: [cluster_step(m, np.array(v[0], float))], CLUSTERED)


def evaluate(df: DataFrame, algorithm: str, by: str | list[str] = "stream", order: str = "seq", vec: str = "vec", y: str = "y", every: int = 50, window: int = 500, **settings: Any) -> DataFrame:
    """by, order, window, pred, pending_ratio, y: after each full window, the labels of the points just learnt from."""
    make, by = ALGORITHMS[algorithm], _list(by)

    def step(state: list, value: list) -> list[dict]:
        model, held, _ = state
        model.update(np.array(value[0], float))
        held.append(value)
        if len(held) % every:
            return []
        state[2] += 1
        pred = model.labels([v[0] for v in held])
        ratio = model.pending_ratio(min(state[2] * every, window))
        rows = [{order: v[2], "window": state[2] - 1, "pred": int(p), "pending_ratio": ratio, "y": v[1]} for v, p in zip(held, pred)]
        held.clear()
        return rows

    own = df.withColumn("_seq", F.col(order))
    return fold(own, by, order, [vec, y, "_seq"], lambda _: [make(**settings), [], 0], step, f"{EVALUATED}, y {dict(df.dtypes)[y]}")


def micro_clusters(df: DataFrame, algorithm: str = "tight", by: str | list[str] = "stream", order: str = "seq", vec: str = "vec", **settings: Any) -> DataFrame:
    """by, id, center, radius, macro_id, n: the balls of each stream after its last row."""
    by = _list(by)
    kinds = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in by)
    make = ALGORITHMS[algorithm]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shown(key: tuple, model: Any) -> Iterator[pa.RecordBatch]:
            rows = [{**dict(zip(by, key)), "id": b.id, "center": b.center.tolist(), "radius": b.radius, "macro_id": b.macro, "n": len(b)} for b in model.balls]
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows), preserve_index=False)

        key, model = None, None
        for batch in batches:
            for *k, x in zip(*(batch.column(c).to_pylist() for c in [*by, vec])):
                if model is None or tuple(k) != key:
                    if model is not None:
                        yield from shown(key, model)
                    key, model = tuple(k), make(**settings)
                model.update(np.array(x, float))
        if model is not None:
            yield from shown(key, model)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*by, order, vec).repartition(parts, *by).sortWithinPartitions(*by, order)
    return dealt.mapInArrow(run, f"{kinds}, id long, center array<double>, radius double, macro_id long, n long")


def _list(by: str | list[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


# Structured Streaming ----------------------------------------------------------------------------------------------


def stream_state(df: DataFrame, make: Callable[[], Any], step: Callable[[Any, list], dict], columns: list[str], out: str, by: str = "stream", order: str = "seq") -> DataFrame:
    """The same fold over a streaming DataFrame: one pickled state per stream in the state store (RocksDB provider).

    Rows of a stream must come in order across batches; within a batch they are sorted. Rows whose order is not beyond the
    last one seen are late: they are flagged and change nothing.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    kinds = dict(df.dtypes)
    schema = StructType.fromDDL(f"{by} {kinds[by]}, {order} {kinds[order]}, late boolean, {out}")
    blank = {f.name: None for f in StructType.fromDDL(out)}

    class Folded(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.held = handle.getValueState("model", "raw binary, last long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            got = self.held.get() if self.held.exists() else None
            model, last = (pickle.loads(bytes(got[0])), got[1]) if got else (make(), None)
            pdf = pd.concat(list(rows)).sort_values(order, kind="stable")
            result = []
            for values in pdf[[order, *columns]].itertuples(index=False):
                late = last is not None and values[0] <= last
                result.append({by: key[0], order: values[0], "late": late, **(blank if late else step(model, list(values[1:])))})
                last = values[0] if last is None else max(last, values[0])
            self.held.update((pickle.dumps(model), int(last)))
            yield pd.DataFrame(result, columns=schema.names)

        def close(self) -> None:
            pass

    return df.groupBy(by).transformWithStateInPandas(statefulProcessor=Folded(), outputStructType=schema, outputMode="Append", timeMode="None")


def detect_stream(df: DataFrame, by: str = "stream", order: str = "seq", x: str = "x", reset: bool = True, **settings: float) -> DataFrame:
    return stream_state(df, lambda: ChangeDetector(**settings), lambda m, v: detector_step(m, float(v[0]), reset), [x], DETECTED, by, order)


def cluster_stream(df: DataFrame, algorithm: str = "tight", by: str = "stream", order: str = "seq", vec: str = "vec", **settings: Any) -> DataFrame:
    make = ALGORITHMS[algorithm]
    return stream_state(df, lambda: make(**settings), lambda m, v: cluster_step(m, np.array(v[0], float)), [vec], CLUSTERED, by, order)


# SQL ---------------------------------------------------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    """Table functions for SQL: detect_change(TABLE(t) PARTITION BY stream ORDER BY seq) and cluster_points(...), whose tables have (stream, seq, x) and (stream, seq, vec)."""
    from pyspark.sql.functions import udtf

    class DetectChange:
        def __init__(self):
            self.model = ChangeDetector()

        def eval(self, row: Row):
            yield (row["stream"], row["seq"], *detector_step(self.model, float(row["x"])).values())

    class ClusterPoints:
        def __init__(self):
            self.model = StreamClusterer()

        def eval(self, row: Row):
            yield (row["stream"], row["seq"], *cluster_step(self.model, np.array(row["vec"], float)).values())

    spark.udtf.register("detect_change", udtf(DetectChange, returnType=f"stream string, seq long, {DETECTED}"))
    spark.udtf.register("cluster_points", udtf(ClusterPoints, returnType=f"stream string, seq long, {CLUSTERED}"))
