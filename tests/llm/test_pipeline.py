"""The corpus pipeline over a small folder of tables, stage by stage and whole."""

import zlib

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_text_operators import SCHEMA, brute_classes, near_texts, toxic_rows  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(r[0], r[1] + (" token=abcdefgh" if r[0] % 7 == 0 else ""), *r[2:]) for r in toxic_rows(300)]
    more = [(1000 + i, t, "en", "t", None if t is None else len(t)) for i, t in enumerate(near_texts())]
    spark.createDataFrame([r[:5] for r in rows] + more, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder):
    sf, rows = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/out-{name}")
        docs = spark.read.parquet(f"{sf}/out-{name}")
        out[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    toxic = {r[0] for r in rows if r[5]}
    left = {r["doc_id"] for r in out["toxicity"].collect()}
    held = {i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(left & toxic) <= 0.05 * len(toxic) + len(held) * 0.1 and len({r[0] for r in rows if not r[5]} - left) <= 0.02 * len(rows)
    roots = brute_classes(near_texts())
    kept = {r["doc_id"] for r in out["near_dedup"].collect()}
    assert {i - 1000 for i in kept if i >= 1000} == {i for i, r in enumerate(roots) if i == r}
    assert not any("token=abcdefgh" in (r["text"] or "") for r in out["secrets"].collect())
    assert out["secrets"].count() == out["near_dedup"].count()
    assert {r["doc_id"] for r in out["mixing"].collect()} <= kept
    assert out["tokens"].count() == out["mixing"].count()


def test_run(spark, folder):
    sf, _ = folder
    a = {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()}
    b = {tuple(r) for r in spark.read.parquet(f"{sf}/out-tokens").select("doc_id", "ids_sha256").collect()}
    assert a == b
