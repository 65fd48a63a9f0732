"""Charts of the benchmark's tables as SVG text, one row a chart, made where the rows are."""

from __future__ import annotations

from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, EDGE = 900, 360, 48
COLORS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e", "#17becf", "#8c564b", "#7f7f7f")


def _frame(title: str, parts: list[str], names: list[str], low: float, high: float) -> str:
    """The chart's outline with a scale from low to high, its title and a legend."""
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif" font-size="11">', f'<text x="{WIDTH / 2:.0f}" y="18" text-anchor="middle" font-size="14">{escape(title)}</text>']
    for k in range(6):
        v = low + (high - low) * k / 5
        y = _y(v, low, high)
        out.append(f'<line x1="{EDGE}" y1="{y:.1f}" x2="{WIDTH - EDGE}" y2="{y:.1f}" stroke="#ddd"/><text x="{EDGE - 6}" y="{y + 4:.1f}" text-anchor="end">{v:.2f}</text>')
    out += parts
    for k, name in enumerate(names):
        x = EDGE + k * (WIDTH - 2 * EDGE) / max(1, len(names))
        out.append(f'<rect x="{x:.1f}" y="{HEIGHT - 16}" width="10" height="10" fill="{COLORS[k % len(COLORS)]}"/><text x="{x + 14:.1f}" y="{HEIGHT - 7}">{escape(name)}</text>')
    return "".join([*out, "</svg>"])


def _y(v: float, low: float, high: float) -> float:
    return HEIGHT - EDGE - (v - low) / max(high - low, 1e-9) * (HEIGHT - 2 * EDGE)


def series_charts(series: DataFrame) -> DataFrame:
    """dataset, svg: the mean of each algorithm over windows with its band, and lines at drifts. `series` is that of `summary.plot_series`.

    A chart has a row for each algorithm and window; missing means leave a gap.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["algorithm", "window"])
        last = max(1, int(pdf["window"].max()))
        low, high = min(0.0, float(np.nanmin([*pdf["lo"], 0.0]))), max(1.0, float(np.nanmax([*pdf["hi"], 1.0])))
        x = lambda w: EDGE + w / last * (WIDTH - 2 * EDGE)
        parts = [f'<line class="drift" x1="{x(w):.1f}" y1="{EDGE}" x2="{x(w):.1f}" y2="{HEIGHT - EDGE}" stroke="#444" stroke-dasharray="4 3"/>' for w in sorted(set(pdf.loc[pdf["is_drift"], "window"]))]
        names = list(dict.fromkeys(pdf["algorithm"]))
        for k, name in enumerate(names):
            own, color = pdf[(pdf["algorithm"] == name) & pdf["mean"].notna()], COLORS[k % len(COLORS)]
            point = lambda c: [f"{x(w):.1f},{_y(v, low, high):.1f}" for w, v in zip(own["window"], own[c].fillna(own["mean"]))]  # noqa: B023, E731
            parts.append(f'<polygon points="{" ".join(point("hi") + point("lo")[::-1])}" fill="{color}" opacity="0.15"/><polyline points="{" ".join(point("mean"))}" fill="none" stroke="{color}" stroke-width="1.5"/>')
        return pd.DataFrame({"dataset": pdf["dataset"].iloc[:1], "svg": [_frame(str(pdf["dataset"].iloc[0]), parts, names, low, high)]})

    return series.select("dataset", "algorithm", F.col("window").cast("long").alias("window"), *(F.col(c).cast("double").alias(c) for c in ("mean", "lo", "hi")), "is_drift").groupBy("dataset").applyInPandas(draw, "dataset string, svg string")


def summary_chart(table: DataFrame, value: str, spread: str | None = None) -> DataFrame:
    """One row, svg: a bar for each algorithm and dataset, in groups by dataset, with a whisker of `spread`. Missing values have no bar.

    The table has a row for each pair of names, so that one task holds it.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        datasets, names = sorted(set(pdf["dataset"])), sorted(set(pdf["algorithm"]))
        high = max(1.0, float(np.nanmax([*(pdf["v"] + pdf["s"].fillna(0)), 1.0])))
        wide = (WIDTH - 2 * EDGE) / max(1, len(datasets))
        bar, parts = 0.8 * wide / max(1, len(names)), []
        for r in pdf[pdf["v"].notna()].itertuples():
            i, k = datasets.index(r.dataset), names.index(r.algorithm)
            x, y = EDGE + i * wide + 0.1 * wide + k * bar, _y(r.v, 0.0, high)
            parts.append(f'<rect class="bar" x="{x:.1f}" y="{y:.1f}" width="{bar:.1f}" height="{HEIGHT - EDGE - y:.1f}" fill="{COLORS[k % len(COLORS)]}"/>')
            if r.s == r.s and r.s:
                parts.append(f'<line x1="{x + bar / 2:.1f}" y1="{_y(r.v - r.s, 0.0, high):.1f}" x2="{x + bar / 2:.1f}" y2="{_y(r.v + r.s, 0.0, high):.1f}" stroke="#222"/>')
        parts += [f'<text x="{EDGE + (i + 0.5) * wide:.1f}" y="{HEIGHT - EDGE + 14}" text-anchor="middle">{escape(d)}</text>' for i, d in enumerate(datasets)]
        return pd.DataFrame({"svg": [_frame(value, parts, names, 0.0, high)]})

    own = table.select("dataset", "algorithm", F.col(f"`{value}`").cast("double").alias("v"), (F.lit(None) if spread is None else F.col(f"`{spread}`")).cast("double").alias("s"))
    return own.groupBy(F.lit(1).alias("one")).applyInPandas(draw, "svg string")


def write_charts(charts: DataFrame, path: str) -> None:
    """Each chart as a text file under `path`, in a folder of its dataset where it has one."""
    charts.write.mode("overwrite").partitionBy(*(c for c in charts.columns if c == "dataset")).text(path)
