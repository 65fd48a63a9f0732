"""Queries of the library against their SQL in DuckDB, on the driver's smallest tables; those of subpackages have their own tests."""

import os

import duckdb
import numpy as np
import pytest

from driftweave.plans import catalog, stream_sql
from driftweave.sources import streams

SF = "/root/testdata/sf0.001"
TABLES = ("events", "embeddings", "part")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(v) if isinstance(v, (str, bool)) else float(v or 0)) for v in row)


#: Drawing 5,000 points in SQL takes seconds each; `test_streams_match_sql` compares the first of all streams.
SLOW = {k for k in catalog.ORACLES if k.startswith("source_") and k not in ("source_drifts", "source_rotatingmoons")}


@pytest.mark.parametrize("name", streams.DATASETS)
def test_streams_match_sql(name):
    x, y, _ = streams.generate(name, 314, 400)
    rows = duckdb.sql(stream_sql.stream(name, 314, 400) + " ORDER BY idx").fetchall()
    assert [r[2] for r in rows] == list(range(400)) and [r[5] for r in rows] == y.tolist()
    assert np.abs(np.array([r[3:5] for r in rows]) - x).max() < 1e-8


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_query_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=_key)
    rel = db.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=_key)
    assert got == want


def test_every_query_without_sql_runs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    slow = {"bench_matrix", "bench_matrix_strict"}
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - slow):
        assert catalog.QUERIES[name](spark, SF).count() > 0, name
