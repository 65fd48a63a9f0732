"""Operators on hand-made inputs, against brute force and by their properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftweave.operators import charts, clustering, components, metrics, neighbors, recovery, summary, timing
from driftweave.streaming import clusterer


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")


@pytest.fixture(scope="module")
def cloud():
    rs = np.random.RandomState(3)
    return np.concatenate([rs.normal(c, 0.05, (25, 2)) for c in ((0.2, 0.2), (0.8, 0.3), (0.5, 0.8))] + [rs.rand(5, 2)])


def test_mutual_neighbours_are_symmetric(spark, cloud):
    edges = neighbors.mutual_knn(neighbors.knn(frame(spark, cloud), 4)).collect()
    pairs = {(r["i"], r["j"]) for r in edges}
    assert pairs and all((j, i) in pairs for i, j in pairs)


def test_equal_points_are_neighbours_but_never_their_own(spark):
    edges = neighbors.knn(frame(spark, [[0, 0], [0, 0], [1, 1]]), 5).collect()
    assert len(edges) == 6 and all(r["i"] != r["j"] for r in edges)
    assert next(r["dist"] for r in edges if (r["i"], r["j"]) == (0, 1)) == 0.0


def test_tight_clusters_match_the_state_machine(spark, cloud):
    got = {r["i"]: r["label"] for r in clustering.tight_clusters(frame(spark, cloud), 4, 1.6).collect()}
    assert [got[i] for i in range(len(cloud))] == clusterer.tight_groups(cloud, 4, 1.6).tolist()
    labels = sorted(set(got.values()) - {-1})
    assert labels == list(range(len(labels)))


def test_tight_clusters_of_few_points(spark):
    assert clustering.tight_clusters(frame(spark, [[0, 0]]), 4).collect()[0]["label"] == -1
    assert {r["label"] for r in clustering.tight_clusters(frame(spark, [[0, 0], [1, 1]]), 4).collect()} == {0}
    assert clustering.tight_clusters(frame(spark, []), 4).count() == 0


def test_shared_radius_matches_the_state_machine(spark, cloud):
    got = neighbors.shared_radius(frame(spark, cloud), 5, 0.5, 3, 2).first()["radius"]
    assert got == pytest.approx(clusterer.shared_radius_of(cloud, 5, 0.5, 3, 2))


def test_grid_and_block_range_joins_agree(spark, cloud):
    a = {(r["i"], r["j"]) for r in neighbors.range_join(frame(spark, cloud), 0.1).collect()}
    b = {(r["i"], r["j"]) for r in neighbors.grid_range_join(frame(spark, cloud), 0.1, 2).collect()}
    assert a == b


def whole_plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grid_join_makes_no_row_of_a_pair_and_cuts_large_cells(spark, monkeypatch):
    from driftweave.operators import blocks

    monkeypatch.setattr(blocks, "TILE", 16)
    x = np.concatenate([np.tile([[0.5, 0.5], [0.505, 0.5]], (40, 1)), np.random.RandomState(1).rand(40, 2)])
    found = neighbors.grid_range_join(frame(spark, x), 0.1, 2)
    assert "Join Inner" not in whole_plan(found)
    got = sorted((r["i"], r["j"]) for r in found.collect())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert got == sorted(zip(*(v.tolist() for v in np.nonzero(d <= 0.1))))


def hashed_cloud():
    x = np.random.RandomState(5).randn(90, 3)
    x[40:60] = x[:20]
    normal = neighbors.planes(3, 3, 2)
    bits = np.einsum("nd,thd->tnh", x, normal) > 0
    shared = (bits[:, :, None, :] == bits[:, None, :, :]).all(axis=3).any(axis=0)
    return x, normal, shared, np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def test_lsh_range_makes_no_row_of_a_candidate_and_cuts_large_buckets(spark, monkeypatch):
    from driftweave.operators import blocks

    monkeypatch.setattr(blocks, "TILE", 16)
    x, normal, shared, d = hashed_cloud()
    points = frame(spark, x)
    found = neighbors.lsh_range(points, points, 1.0, normal)
    assert "Join Inner" not in whole_plan(found)
    assert sorted((r["q"], r["j"]) for r in found.collect()) == sorted(zip(*(v.tolist() for v in np.nonzero(shared & (d <= 1.0)))))


@pytest.mark.parametrize("hashes", [2, 70])
def test_lsh_knn_makes_no_row_of_a_candidate_and_cuts_large_buckets(spark, monkeypatch, hashes):
    from driftweave.operators import blocks

    made = []
    keep = neighbors.written
    monkeypatch.setattr(blocks, "TILE", 16)
    monkeypatch.setattr(neighbors, "written", lambda df, name: made.append((name, df.count())) or keep(df, name))
    x, normal, shared, d = hashed_cloud()
    if hashes > 2:  # no buckets are shared but by equal points: all is searched
        normal = neighbors.planes(3, 1, hashes)
    points = frame(spark, x)
    got = {}
    for r in neighbors.lsh_knn(points, points, 3, normal).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["j"]))
    bits = np.einsum("nd,thd->tnh", x, normal) > 0
    shared = (bits[:, :, None, :] == bits[:, None, :, :]).all(axis=3).any(axis=0)
    for q in range(len(x)):
        near = shared[q] if shared[q].sum() >= 3 else np.ones(len(x), bool)
        order = sorted((d[q, j], j) for j in np.flatnonzero(near & (d[q] > 0)))[:3]
        assert sorted(got.get(q, [])) == [(k + 1, j) for k, (_, j) in enumerate(order)]
    assert not [n for name, n in made if name == "candidates" and n > len(x) * normal.shape[0] * 24], "a row a tile and query at most, none a candidate"
    assert all(n < shared.sum() for _, n in made) or hashes > 2


def test_lsh_range_falls_back_to_a_full_search(spark):
    normal = neighbors.planes(2, 1, 8)
    points, far = frame(spark, [[1.0, 0.0], [0.9, 0.1]]), frame(spark, [[-1.0, -0.01]])
    got = neighbors.lsh_range(points, far, 10.0, normal).collect()
    assert len(got) == 2


def test_components_in_rounds_and_in_one_task_agree(spark, monkeypatch):
    rs = np.random.RandomState(5)
    links = [(int(a), int(b)) for a, b in rs.randint(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    one = {tuple(r) for r in components.components(df).select("node", "root").collect()}
    monkeypatch.setattr(components, "ONE_TASK", -1)
    assert one == {tuple(r) for r in components.components(df).select("node", "root").collect()}
    assert {r for n, r in one if n >= 200} == {200}


def test_dbscan(spark, cloud):
    from driftweave.streaming import baselines

    got = {r["i"]: r["label"] for r in clustering.dbscan(frame(spark, cloud), 0.08, 5).collect()}
    assert [got[i] for i in range(len(cloud))] == baselines.dbscan(cloud, 0.08, 5).tolist()


def labelled(spark, rows):
    return spark.createDataFrame([("g", y, p) for y, p in rows], "g string, y int, pred long")


def test_quality_without_assigned_points(spark):
    row = metrics.quality_micro(labelled(spark, [(0, -1), (1, -1)]), ["g"]).first()
    assert (row["purity"], row["coverage"], row["ari"], row["quality"]) == (0.0, 0.0, None, 0.0)
    assert metrics.quality_macro(labelled(spark, [(0, -1)]), ["g"]).first()["quality"] is None


def test_one_cluster_has_no_rand_index(spark):
    row = metrics.quality_micro(labelled(spark, [(0, 0), (1, 0), (0, 0)]), ["g"]).first()
    assert row["ari"] is None and row["quality"] == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.rand_index(labelled(spark, [(0, 0), (0, 0)]), ["g"], guarded=False).first()["ari"] == 1.0


def test_early_fire_and_ties(spark):
    events = spark.createDataFrame([(90,), (101,), (300,), (150,)], "t long")
    drifts = spark.createDataFrame([(100,), (200,)], "drift long")
    got = {r["t"]: (r["nearest_real_drift"], r["lag_to_real"], r["verdict"]) for r in timing.match_drifts(events, drifts, 50).collect()}
    assert got == {90: (100, -10, "early"), 101: (100, 1, "true_positive"), 300: (None, None, "false_positive"), 150: (100, 50, "true_positive")}


def test_short_segments_have_no_recovery(spark):
    series = spark.createDataFrame([(i, 0.9 if i < 10 or i > 12 else 0.3) for i in range(20)], "window long, quality double")
    drifts = spark.createDataFrame([(10,), (17,)], "drift long")
    got = {r["drift"]: (r["response"], r["recovery"]) for r in recovery.recovery(series, drifts, after=0, least_drop=0.02).collect()}
    assert got == {10: (4.0, 4.0), 17: (None, None)}


def test_missing_values_are_skipped(spark):
    runs = spark.createDataFrame([("a", "d", 1, 0.5, float("nan")), ("a", "d", 2, 0.7, None)], "algorithm string, dataset string, seed int, quality_mean double, recovery_w double")
    row = summary.seed_summary_population(runs, ["quality_mean", "recovery_w"]).first()
    assert row["quality_mean_avg"] == pytest.approx(0.6) and row["quality_mean_std"] == pytest.approx(0.1)
    assert row["recovery_w_avg"] is None and row["recovery_w_std"] == 0.0


def test_seed_means_at_a_half_do_not_depend_on_the_order_of_rows(spark):
    import itertools

    columns = [n for _, n, _ in summary.DETAIL]
    values = (0.6341, 0.587, 0.472, 0.5755)  # their mean is 0.56715
    rows = [(f"{k}", "d", s, *[v] * len(columns)) for k, order in enumerate(itertools.permutations(values)) for s, v in enumerate(order)]
    detail = spark.createDataFrame(rows, ["Algorithm", "Dataset", "Seed", *columns]).coalesce(1)
    assert {r["Quality mean"] for r in summary.seed_summary(detail).collect()} == {0.5672}


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "name string, value double")
    summary.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["value"] == "1.5"


def test_fire_report(spark):
    fires = spark.createDataFrame([("ABRUPT up",), ("gradual",), ("stable",), ("ABRUPT down",)], "segment string")
    assert tuple(summary.fire_report(fires).first()) == (2, 1, 1)


def test_nearest_center_takes_the_nearest_only(spark):
    points = frame(spark, [[0.0, 0.0]])
    centers = spark.createDataFrame([(1, [0.3, 0.0], 0.1), (2, [0.5, 0.0], 2.0)], "id long, vec array<double>, radius double")
    row = neighbors.nearest_center(points, centers, "radius").first()
    assert row["j"] == 1 and not row["accepted"]
    assert neighbors.nearest_center(points, centers.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("name", ["bench_matrix", "bench_matrix_strict"])
def test_benchmark_queries_run_the_whole_benchmark(spark, monkeypatch, name):
    from driftweave.plans import benchmark, catalog
    from driftweave.sources import streams

    asked = []

    def runs(spark, algorithms, datasets, seeds, n, strict=False):
        asked.append((list(seeds), n))
        raise InterruptedError

    monkeypatch.setattr(benchmark, "runs", runs)
    with pytest.raises(InterruptedError):
        catalog.QUERIES[name](spark, "")
    assert asked == [(list(streams.SEEDS), 5000)]


def test_charts_draw_what_the_tables_hold(spark, tmp_path):
    import xml.etree.ElementTree as xml

    series = spark.createDataFrame([("d<1>", a, w, (w + k) / 20, (w + k) / 20 - 0.1, (w + k) / 20 + 0.1, w in (2, 5)) for k, a in enumerate(("one & two", "b")) for w in range(8)] + [("d2", "b", 0, None, None, None, False)], "dataset string, algorithm string, window int, mean double, lo double, hi double, is_drift boolean")
    out = {r["dataset"]: xml.fromstring(r["svg"]) for r in charts.series_charts(series).collect()}
    own = "{http://www.w3.org/2000/svg}"
    assert set(out) == {"d<1>", "d2"}
    lines = [len(p.get("points").split()) for p in out["d<1>"].iter(f"{own}polyline")]
    assert lines == [8, 8] and len([x for x in out["d<1>"].iter(f"{own}line") if x.get("class") == "drift"]) == 2
    table = spark.createDataFrame([("d1", "a", 0.5, 0.1), ("d1", "b", None, None), ("d2", "a", 0.9, 0.0)], "dataset string, algorithm string, v double, s double")
    bars = [float(x.get("height")) for x in xml.fromstring(charts.summary_chart(table, "v", "s").first()["svg"]).iter(f"{own}rect") if x.get("class") == "bar"]
    assert len(bars) == 2 and bars[1] / bars[0] == pytest.approx(0.9 / 0.5, rel=0.01)
    charts.write_charts(charts.series_charts(series.where("dataset = 'd2'")), f"file://{tmp_path}/charts")
    assert spark.read.text(f"file://{tmp_path}/charts").count() == 1


def test_tiles_hold_each_pair_of_blocks_once(spark, monkeypatch):
    from driftweave.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 10)
    monkeypatch.setattr(blocks, "GROUP", 3)
    rs = np.random.RandomState(4)
    x, y = np.round(rs.rand(157, 3), 2), np.round(rs.rand(83, 3), 2)
    x[3], x[100], y[7] = x[9], x[9], x[9]
    a, b = frame(spark, x), frame(spark, y)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    got = {(r["i"], r["j"]): r["dist"] for r in neighbors.range_join(a, 0.4, b).collect()}
    assert set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 0.4)))) and all(v == pytest.approx(d[k]) for k, v in got.items())
    own = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(own, np.inf)
    near = sorted((r["i"], r["rank"], r["j"]) for r in neighbors.knn(a, 4).collect())
    assert [(i, r, round(own[i, j], 9)) for i, r, j in near] == [(i, r + 1, round(v, 9)) for i in range(157) for r, v in enumerate(np.sort(own[i])[:4])]
    one = {r["i"]: r["dist"] for r in neighbors.nearest_center(a, b).collect()}
    assert len(one) == 157 and all(one[i] == pytest.approx(d[i].min()) for i in one)
    assert neighbors.nearest_center(a, b.where("id < 0")).count() == 0 and neighbors.knn(a.where("id < 0"), 3).count() == 0


def test_tiles_send_a_vector_once_for_every_group(spark, monkeypatch):
    """The bytes that cross the network, as the rows of blocks in the plan tell: groups, not blocks, times the blocks of a side."""
    from driftweave.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 4)
    seen = []
    monkeypatch.setattr(type(frame(spark, np.zeros((1, 1)))), "repartitionById", lambda self, n, c: seen.append((self.count(), n)) or self)
    x = np.random.RandomState(1).rand(400, 2)  # 100 blocks
    blocks.meet(frame(spark, x), frame(spark, x), lambda *_: None, "i long")
    side = 4  # the root of 4 tasks for each of 4 shuffle partitions; a few blocks are empty
    assert len(seen) == 1 and seen[0][1] == side * side and 700 < seen[0][0] <= 2 * 100 * side


def test_near_points_are_found_in_spite_of_rounding():
    from driftweave.operators import blocks

    rs = np.random.RandomState(2)
    a = 1e6 + rs.rand(300, 8) * 1e-3  # far from the origin, where squares cancel
    sq, slack = blocks.squares(a, a)
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(2))
    assert (np.abs(sq - d * d) <= slack).all()
    np.fill_diagonal(sq, np.inf)
    np.fill_diagonal(d, np.inf)
    x, y, got = blocks.nearest(a, np.arange(300), a, sq, slack, 3)
    assert np.allclose(got.reshape(300, 3), np.sort(d, axis=1)[:, :3], rtol=1e-9)


def test_covers_and_radii_of_large_pools_hold_no_matrix_of_all_distances(spark):
    import tracemalloc

    x = np.random.RandomState(2).rand(4000, 8)
    tracemalloc.start()
    owners = clusterer.cover(x, 0.3, 5)
    radius = clusterer.shared_radius_of(x[:1500], 5, 0.5, 2, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6
    d = np.stack([np.sqrt(((p - x) ** 2).sum(axis=1)) for p in x])
    free, want = np.ones(len(x), bool), []
    for i in range(len(x)):
        own = np.flatnonzero((d[i] <= 0.3) & free)
        if free[i] and len(own) >= 5:
            want.append(own.tolist())
            free[own] = False
    assert [o.tolist() for o in owners] == want
    d = d[:1500, :1500] + np.diag([np.inf] * 1500)
    lists = [set(r) for r in np.argsort(d, axis=1, kind="stable")[:, :5].tolist()]
    found = [max(d[i, j] for j in lists[i] & lists[o]) for i in range(1500) for o in lists[i] if len(lists[i] & lists[o]) >= 2]
    assert len(found) >= 2 and radius == pytest.approx(min(0.5, max(found)))
