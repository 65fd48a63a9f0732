"""Vector operators against brute force."""

import numpy as np
import pytest

from driftweave.llm import maxscore, nndescent

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(x, labels):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], l) for i, (v, l) in enumerate(zip(x, labels))]


def cloud(seed=1, n=300, d=16):
    rs = np.random.RandomState(seed)
    x = rs.normal(size=(n, d))
    for i in range(40, 60):  # a group of near copies
        x[i] = x[40] + rs.normal(size=d) * 0.02
    x[70] = x[71] = x[72]  # equal vectors
    x[80] = x[81] * 3
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    out = [v.tolist() for v in x]
    out += [None, [0.0] * d, [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [None] * d]
    return out, [i % 3 if i not in range(40, 90) else 0 for i in range(len(out) - 1)] + [None]


def top_by_hand(x, ask, k=20):
    ok = [i for i, v in enumerate(x) if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    q = {i: np.floor(64 * np.array(x[i], np.float32).astype(float)).astype(np.int64) for i in ok}
    out = []
    for i in ok:
        if i % ask == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard,lead", [(4096, 256), (37, 25)])
def test_top_k(spark, monkeypatch, shard, lead):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", shard)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 7)
    monkeypatch.setattr(maxscore, "LEAD", lead)
    x, labels = cloud()
    df = spark.createDataFrame(rows_of(x, labels), SCHEMA)
    vectors = maxscore.quantized(df)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in maxscore.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect())
    assert got == top_by_hand(x, 20)


def test_search_prunes_and_stays_exact():
    rs = np.random.RandomState(2)
    terms = (rs.normal(size=(32, 3000)) * 8 * np.linspace(3, 0.1, 32)[:, None]).astype(np.int64)
    ids = np.arange(3000)
    for q in (terms[:, 5], terms[:, 77], np.zeros(32, np.int64)):
        got = maxscore.search(terms, ids, q, 5, 20)
        s = q @ terms
        order = [i for i in np.lexsort((ids, -s)) if i != 5][:20]
        assert got[0].tolist() == order and got[1].tolist() == s[order].tolist()


def test_top_k_broadcasts_no_queries_and_a_tile_gives_k_rows(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 8)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 3)
    x = np.random.RandomState(4).randn(200, 6)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    vectors = maxscore.quantized(df)
    found = maxscore.top_k(vectors, vectors.where("vec_id % 20 = 0"), 5)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    v = np.floor(64 * np.float32(x).astype(float)).astype(int)
    want = [(q, r + 1, j, int(v[q] @ v[j])) for q in range(0, 200, 20) for r, j in enumerate([j for j in np.lexsort((np.arange(200), -(v @ v[q]))) if j != q][:5])]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [0.5, 0.1], 1), (1, [0.2, 0.2], 1), (2, [0.2, 0.2], None)], SCHEMA)
    vectors = maxscore.quantized(df)
    got = [tuple(r) for r in maxscore.top_k(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 32 * 12 + 6 * 12), (0, 2, 2, 32 * 12 + 6 * 12)]
    none = maxscore.quantized(df.where("vec_id < 0"))
    assert maxscore.top_k(none, none).count() == 0


def classes_by_hand(x, labels, limit=0.98):
    n = len(x)
    ok = [v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) and l is not None for v, l in zip(x, labels)]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(x, ok)]
    near = {i: [j for j in range(n) if j != i and ok[i] and ok[j] and labels[i] == labels[j] and unit[i] @ unit[j] >= limit] for i in range(n)}
    root = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min(seen)
    return [(i, len(near[i]), root[i], i == root[i]) for i in range(n)]


@pytest.mark.parametrize("block", [512, 16])
def test_vector_classes(spark, monkeypatch, block):
    monkeypatch.setattr(nndescent, "BLOCK", block)
    x, labels = cloud()
    df = spark.createDataFrame(rows_of(x, labels), SCHEMA)
    got = sorted(tuple(r) for r in nndescent.classes(df).select("vec_id", "n_links", "component_id", "kept").collect())
    want = classes_by_hand(x, labels)
    assert max(w[1] for w in want) >= 19  # longer than a list
    assert got == want


@pytest.mark.parametrize("block", [512, 16])
def test_groups_that_fill_each_others_lists_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(nndescent, "BLOCK", block)
    rs = np.random.RandomState(5)
    base = np.eye(16)[0]
    x = [base + 0.12 * np.eye(16)[1 + i // 20] + rs.normal(size=16) * 0.0005 for i in range(120)]  # 6 groups, all pairs linked
    x += [10 * np.eye(16)[9] + 0.001 * rs.normal(size=16) for _ in range(20)] + list(rs.normal(size=(40, 16)))
    x = [v.tolist() for v in x]
    labels = [0] * len(x)
    want = classes_by_hand(np.array(x, np.float32).tolist(), labels)
    assert all(w[1:3] == (119, 0) for w in want[:120])
    df = spark.createDataFrame(rows_of(x, labels), SCHEMA)
    assert sorted(tuple(r) for r in nndescent.classes(df).select("vec_id", "n_links", "component_id", "kept").collect()) == want


def test_all_pairs_are_compared_where_the_audits_fail(spark, monkeypatch):
    blind = nndescent._start
    monkeypatch.setattr(nndescent, "_start", lambda own, seed, tables: blind(own, seed, tables).where("false"))
    monkeypatch.setattr(nndescent, "AUDITS", 1)
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    x, labels = cloud()
    df = spark.createDataFrame(rows_of(x, labels), SCHEMA)
    assert sorted(tuple(r) for r in nndescent.classes(df).select("vec_id", "n_links", "component_id", "kept").collect()) == classes_by_hand(x, labels)


def test_audit_asks_for_nodes_with_links_where_copies_are_rare(spark):
    rs = np.random.RandomState(3)
    x = rs.normal(size=(2000, 16))
    x[1:40:2] = x[0:40:2] * 2 + rs.normal(size=(20, 16)) * 0.01  # 20 pairs
    own = nndescent.nodes(spark.createDataFrame(rows_of(x, [0] * 2000), SCHEMA)).cache()
    graph = spark.createDataFrame([(i, i ^ 1, 0.99) for i in range(40)], "u long, v long, cos double")
    found = spark.createDataFrame([(i, 1 if i < 20 else 0) for i in range(40)], "node long, n long")
    assert nndescent.audit(own, found, graph, 0.98, 7, rows=40) == pytest.approx(0.5)


def test_vector_classes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1)], SCHEMA)
    assert [tuple(r) for r in nndescent.classes(df).collect()] == [(1, 0, 1, True)]
    assert nndescent.classes(df.where("vec_id < 0")).count() == 0
