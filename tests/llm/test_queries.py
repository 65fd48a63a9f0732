"""The registered queries on the driver's smallest tables: against the tokenizers' libraries, brute force, or their SQL in DuckDB."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import pyarrow.parquet as pq  # noqa: E402
import sentencepiece  # noqa: E402
import tokenizers  # noqa: E402

from driftweave.llm import htmltext, queries, secretscan  # noqa: E402
from test_text_operators import base_by_hand, brute_classes  # noqa: E402
from test_vector_operators import classes_by_hand, top_by_hand  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r for r in table("documents")}


def test_op1(spark):
    pages = {r["page_id"]: r for r in table("pages")}
    weights = htmltext.fit_weights(htmltext.labelled_pages())
    got = rows(spark, "op1_html_text")
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        assert r["url"] == pages[r["page_id"]]["url"] and r["text"] == htmltext.main_text(pages[r["page_id"]]["html"] or "", weights) and r["n_chars"] == len(r["text"])


def test_op2(spark, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, "op2_sentencepiece")
    assert sorted(r["doc_id"] for r in got) == sorted(documents)
    for r in got:
        ids = sp.encode(documents[r["doc_id"]]["text"] or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_op3(spark, documents):
    got = rows(spark, "op3_secrets")
    assert sorted(r["doc_id"] for r in got) == sorted(documents)
    texts = [documents[i]["text"] or "" for i in documents]
    tested, passed = [0] * len(secretscan.BINS), {}
    for x in texts:
        for s, e, bits in secretscan.candidates(x, secretscan.base_spans(x), tested):
            b = max(k for k, least in enumerate(secretscan.BINS) if e - s >= least)
            passed.setdefault(b, []).append(min(4000, int(bits * 10 // 1)))
    limits = {b: secretscan.least_bits(tested[b], [(t, 1) for t in own]) for b, own in passed.items()}
    for r in got:
        x = documents[r["doc_id"]]["text"] or ""
        base = base_by_hand(x)
        told = lambda spans: ",".join(f"{secretscan.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == v for _, k, _ in base) for v in (0, 1, 2)]
        assert r["base_sha256"] == hashlib.sha256(told(base).encode()).hexdigest()
        more = [(s, 3, e) for s, e, bits in secretscan.candidates(x, secretscan.base_spans(x)) if bits >= limits[max(k for k, least in enumerate(secretscan.BINS) if e - s >= least)]]
        assert r["spans"] == told(sorted([*base, *more], key=lambda v: v[:2]))


def vectors():
    own = sorted(table("embeddings"), key=lambda r: r["vec_id"])
    assert [r["vec_id"] for r in own] == list(range(len(own)))
    return [r["embedding"] for r in own], [r["label"] for r in own]


def test_op4(spark):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(spark, "op4_top_k"))
    assert got == top_by_hand(vectors()[0], 20)


def test_op5(spark):
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(spark, "op5_vector_classes"))
    assert got == classes_by_hand(*vectors())


def test_op7(spark, documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, "op7_token_counts")
    assert sorted(r["doc_id"] for r in got) == sorted(documents)
    for r in got:
        x = documents[r["doc_id"]]["text"] or ""
        n = len(sp.encode(x))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(x.encode()), n, n > 4096)


def test_op8(spark, documents):
    toxic = {r["doc_id"]: r["toxic"] for r in table("labels")}
    got = rows(spark, "op8_toxicity")
    assert sorted(r["doc_id"] for r in got) == sorted(documents)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    assert np.mean([p == y for p, y in held]) > 0.85  # a tenth of the labels follows no text


def test_op9(spark, documents):
    order = sorted(documents)
    roots = brute_classes([documents[i]["text"] for i in order])
    got = {r["doc_id"]: r for r in rows(spark, "op9_near_duplicates")}
    assert sorted(got) == order
    for i, root in zip(order, roots):
        assert got[i]["class_id"] == order[root] and got[i]["kept"] == (order[root] == i) and got[i]["class_rows"] == roots.count(root)


def test_op10(spark, documents):
    tk = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in rows(spark, "op10_content_store")}
    start = 0
    assert sorted(got) == sorted(documents)
    for i in sorted(documents):
        ids = np.array([*tk.encode(documents[i]["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], got[i]["verified"]) == (start, len(ids), zlib.crc32(ids.tobytes()), True)
        start += len(ids)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = db.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=key)
