"""The state machines: golden stream, edge cases, and agreement of their ways to run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_models
from driftweave.functions import drift
from driftweave.sources import streams
from driftweave.streaming import baselines, clusterer, drivers
from driftweave.streaming.clusterer import Ball, StreamClusterer
from driftweave.streaming.detector import ChangeDetector, mad_sigma, slope
from driftweave.streaming.drift_clusterer import DriftAwareClusterer


def fires(xs, **settings):
    d, out = ChangeDetector(**settings), []
    for i, x in enumerate(xs, 1):
        if d.update(x):
            out.append(i)
            d.reset()
    return out


GOLDEN = [305, 313, 506, 700, 1105]


def test_golden_scalar_stream():
    rows = streams.scalar_stream(42)
    got = fires([x for _, _, x in rows])
    assert got == GOLDEN
    segment = {i: s for i, s, _ in rows}
    assert all("ABRUPT" in segment[i] for i in got)
    # the published steps are the first ones of each abrupt segment
    assert [next(i for i in got if segment[i] == s) for s in ("ABRUPT up", "ABRUPT down", "ABRUPT final")] == [305, 506, 1105]


def test_detector_small_samples():
    assert mad_sigma([1.0, 2.0, 3.0]) == 1.0
    # even length: the true median 2.5, the upper median 1.5 of the distances
    assert mad_sigma([1.0, 2.0, 3.0, 4.0]) == pytest.approx(1.4826 * 1.5)
    assert slope([5.0]) == 0.0 and slope([1.0, 3.0, 5.0]) == pytest.approx(2.0)
    d = ChangeDetector()
    d.update(1.0)
    assert d.level == 13.5 and d.limit == 7.0 and d.direction == "up"
    before = d.snapshot()
    d.reset()
    assert d.n == before["n_samples"] and d.direction == "none" and len(d.up.slopes) == 1
    d.full_reset()
    assert d.n == 0 and not d.up.slopes


def test_tight_groups_edges():
    assert clusterer.tight_groups(np.zeros((0, 2)), 4).tolist() == []
    assert clusterer.tight_groups(np.zeros((1, 2)), 4).tolist() == [-1]
    assert clusterer.tight_groups(np.array([[0.0, 0], [1, 1]]), 4).tolist() == [0, 0]


def test_shared_radius_falls_back():
    assert clusterer.shared_radius_of(np.zeros((1, 2))) == 0.5
    x = np.random.RandomState(1).rand(6, 2)
    assert clusterer.shared_radius_of(x, 2, 0.5, tk=5, mk=4) == 0.5


def test_ball():
    b = Ball(0, 1.0)
    b.add(1, np.zeros(2))
    b.add(2, np.ones(2))
    assert b.center.tolist() == [0.5, 0.5] and b.contains(np.array([0.5, 1.5])) and not b.contains(np.array([0.5, 1.6]))
    assert b.expire(1) and b.center.tolist() == [1.0, 1.0] and not b.expire(2)


def test_no_balls_no_surprise():
    m = StreamClusterer()
    assert m.surprise([0.1, 0.2]) == 0.0 and m.labels([[0.1, 0.2]]).tolist() == [-1]
    d = DriftAwareClusterer()
    d.update([0.0, 0.0])
    assert d.last_surprise == 0.0 and d.detector.n == 0  # unfed until there is a macro


def test_dissolving_rule_differs():
    x, _, _ = streams.generate("AbruptSplit", 42, 700)
    plain, aware = StreamClusterer(W=100), DriftAwareClusterer(W=100, detect=False)
    small = False
    for p in x:
        plain.update(p)
        aware.update(p)
        assert all(len(b) >= plain.N for b in plain.balls if max(b.times) < plain.t)
        small |= any(len(b) < aware.N for b in aware.balls)
    assert small  # balls live on below N points


def test_relaxation_leaves_no_trace():
    x, _, _ = streams.generate("AbruptShift", 42, 900)

    def parts(**settings):
        m = DriftAwareClusterer(**settings).fit(x)
        return sorted(sorted(b.id for b in m.balls if b.macro == k) for k in {b.macro for b in m.balls}), len(m._events)

    base = parts()
    assert base == parts(n_micro_relax=2) == parts(N_fast=2)


def test_lsh_backend_runs():
    x, _, _ = streams.generate("AbruptSplit", 42, 200)
    m = StreamClusterer(backend="lsh", n_hashes=2, n_tables=4).fit(x)
    assert m.balls


def test_dbscan_border_takes_least_cluster():
    x = np.array([[0.0], [0.05], [0.1], [0.2], [0.45], [0.7], [0.8], [0.85], [0.9]])
    assert baselines.dbscan(x, 0.26, 4).tolist() == [0, 0, 0, 0, 0, 1, 1, 1, 1]


def test_generators_keep_their_draws():
    x, y, d = streams.generate("AbruptShift", 42, 100)
    rs = np.random.RandomState(42)
    k = rs.randint(3)
    assert y[0] == k and np.allclose(x[0], rs.normal(np.array([[0.2, 0.2], [0.8, 0.2], [0.5, 0.8]])[k], 0.055))
    assert d == [25, 50, 75]
    for name in streams.DATASETS:
        a, b = streams.generate(name, 7, 120), streams.generate(name, 7, 120)
        assert a[0].shape == (120, 2) and np.array_equal(a[0], b[0])


def scalar_frame(spark, n=1400):
    return spark.createDataFrame([("s", i, x) for i, _, x in streams.scalar_stream()[:n]], "stream string, seq long, x double")


def test_batch_detector_fires(spark):
    got = drivers.detect(scalar_frame(spark)).where("fired").orderBy("seq")
    assert [r["seq"] for r in got.collect()] == GOLDEN


def test_window_form_agrees_until_a_fire(spark):
    own = scalar_frame(spark, 304)
    a = {r["seq"]: r for r in drivers.detect(own, reset=False).collect()}
    rows = drift.detector_signals(own).collect()
    assert len(rows) == 304
    for r in rows:
        s = a[r["seq"]]
        for x, y in (("up", "U_t"), ("low", "L_t"), ("lambda", "lambda_current"), ("score", "abruptness_score"), ("limit", "slope_thresh_current"), ("acceleration", "acceleration")):
            assert r[x] == pytest.approx(s[y], abs=1e-6), (r["seq"], x)
        assert r["direction"] == s["direction"] and r["run"] == s["confirm_count"]


def points_frame(spark, n=260):
    rows = []
    for name in ("AbruptSplit", "AbruptMerge"):
        x, _, _ = streams.generate(name, 42, n)
        rows += [(name, i + 1, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "stream string, seq long, vec array<double>")


@pytest.mark.parametrize("size", [40, 97])
def test_streaming_equals_batch_across_a_restart(spark, tmp_path, size):
    own = points_frame(spark, 120)
    want = {(r["stream"], r["seq"]): (r["label"], r["n_micro"]) for r in drivers.cluster(own, "tight", W=60).collect()}
    source = str(tmp_path / "in")
    held = []

    def run():
        df = spark.readStream.schema("stream string, seq long, vec array<double>").parquet(source)
        q = (
            drivers.cluster_stream(df, "tight", W=60)
            .writeStream.foreachBatch(lambda b, _: held.extend(b.select("stream", "seq", "label", "n_micro", "late").collect()))
            .option("checkpointLocation", str(tmp_path / "ckpt"))
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination(120)
        assert q.exception() is None

    for start in range(0, 120, size):  # each part is a run of its own, from the checkpoint of the one before
        own.where((F.col("seq") > start) & (F.col("seq") <= start + size)).orderBy(F.desc("seq")).coalesce(1).write.mode("append").parquet(source)
        run()
    got = {(r["stream"], r["seq"]): (r["label"], r["n_micro"]) for r in held if not r["late"]}
    assert got == want


def test_source_reads_batch_and_stream(spark):
    streams.register(spark)
    df = spark.read.format("drift_stream").options(dataset="AbruptSplit", seed="42", n="50").load()
    assert df.count() == 50
    x, y, _ = streams.generate("AbruptSplit", 42, 50)
    first = df.orderBy("idx").first()
    assert first["x"] == pytest.approx(x[0].tolist()) and first["y"] == y[0]
    assert spark.read.format("drift_stream").options(dataset="full", table="drifts", n="400").load().count() > 9
    q = spark.readStream.format("drift_stream").options(dataset="AbruptSplit", n="60", rows_per_batch="25").load().writeStream.format("memory").queryName("pts").start()
    try:
        import time

        for _ in range(60):
            if spark.sql("SELECT count(*) FROM pts").first()[0] >= 60:
                break
            time.sleep(0.5)
        assert spark.sql("SELECT count(DISTINCT idx), count(*) FROM pts").first() == (60, 60)
    finally:
        q.stop()


def test_table_functions(spark):
    drivers.register(spark)
    scalar_frame(spark, 320).createOrReplaceTempView("numbers")
    got = spark.sql("SELECT seq FROM detect_change(TABLE(SELECT stream, seq, x FROM numbers) PARTITION BY stream ORDER BY seq) WHERE fired")
    assert sorted(r["seq"] for r in got.collect()) == GOLDEN[:2]


def test_every_algorithm_evaluates(spark):
    own = points_frame(spark, 110).withColumn("y", F.lit(1))
    for name in drivers.ALGORITHMS:
        out = drivers.evaluate(own, name)
        assert out.count() == 200 and out.select("window").distinct().count() == 2, name


# against second models


@pytest.mark.parametrize("name", streams.DATASETS)
def test_clusterers_are_those_of_second_models(name):
    x, _, _ = streams.generate(name, 42, 700)
    fired = []
    for plain, own, n in ((plain_models.Plain(150), StreamClusterer(W=150), 700), (plain_models.PlainAware(150), DriftAwareClusterer(W=150), 700), (plain_models.PlainDbscan(), baselines.WindowedDbscan(), 300)):
        for i, p in enumerate(x[:n]):
            plain.update(p.tolist())
            own.update(p)
            assert plain.label(p.tolist()) == own.labels([p])[0], i
            if hasattr(plain, "balls"):
                assert (len(plain.balls), len(plain.groups), len(plain.pool)) == (len(own.balls), len(own.macros), len(own.pool)), i
                assert plain.surprise(p.tolist()) == pytest.approx(own.surprise(p))
                assert len(plain.pool) / 150 == own.pending_ratio(150)
            fired += [(e["t"], e["direction"]) for e in own.events()]
    assert fired == plain_models_fires(x)


def plain_models_fires(x):
    aware = plain_models.PlainAware(150)
    for p in x:
        aware.update(p.tolist())
    return aware.fires


def test_batch_rows_are_those_of_a_second_model(spark):
    own = points_frame(spark, 200)
    for algorithm, make in (("tight", plain_models.Plain), ("tight_drift", plain_models.PlainAware)):
        got = {(r["stream"], r["seq"]): r for r in drivers.cluster(own, algorithm, W=80).collect()}
        models = {}
        for r in sorted(own.collect(), key=lambda r: (r["stream"], r["seq"])):
            m = models.setdefault(r["stream"], make(80))
            x = list(r["vec"])
            m.update(x)
            out = got[r["stream"], r["seq"]]
            assert (out["label"], out["n_micro"], out["n_macro"], out["pending"]) == (m.label(x), len(m.balls), len(m.groups), len(m.pool))
            assert out["surprise"] == pytest.approx(m.surprise(x))
        balls = drivers.micro_clusters(own, algorithm, W=80).collect()
        for stream, m in models.items():
            mine = sorted((b["n"], b["macro_id"], round(b["radius"], 9), *(round(c, 9) for c in b["center"])) for b in balls if b["stream"] == stream)
            assert mine == sorted((len(b["points"]), b["macro"], round(b["radius"], 9), *(round(c, 9) for c in b["center"])) for b in m.balls)


def test_detector_is_that_of_a_second_model():
    rs = np.random.RandomState(5)
    xs = np.concatenate([rs.normal(0, 1, 200), rs.normal(5, 1, 150), rs.normal(-2, 2, 150), rs.standard_t(2, 200)])
    settings = {"k_lambda": 3.0, "k_slope": 2.0, "ema_alpha": 0.1, "delta": 0.02, "confirm_steps": 2, "min_samples": 30}
    plain, got = plain_models.PlainDetector(*settings.values()), []
    for i, x in enumerate(xs.tolist(), 1):
        if plain.update(x):
            got.append(i)
            plain.reset()
    assert got == fires(xs.tolist(), **settings) and len(got) > 2


def test_backdating_ages_balls_without_new_points():
    m = DriftAwareClusterer(W=40, detect=False)
    rs = np.random.RandomState(1)
    for _ in range(30):
        m.update(rs.normal((0.2, 0.2), 0.02))
    for _ in range(15):
        m.update(rs.normal((0.8, 0.8), 0.02))
    before = [list(b.times) for b in m.balls]
    m.backdate()
    for b, times in zip(m.balls, before):
        assert b.times == ([t - 20 for t in times] if times[-1] < m.t - 10 else times)
    assert any(b.times != t for b, t in zip(m.balls, before)) and any(b.times == t for b, t in zip(m.balls, before))
    aged = [b for b, t in zip(m.balls, before) if b.times != t]
    for _ in range(10):
        m.update(rs.normal((0.8, 0.8), 0.02))
    assert not any(b in m.balls for b in aged if max(b.times, default=-99) <= m.t - 40)


def test_backends_have_names():
    with pytest.raises(ValueError, match="unknown backend 'balltree'"):
        StreamClusterer(backend="balltree")
    x, _, _ = streams.generate("AbruptSplit", 42, 200)
    kinds = [StreamClusterer(backend=b).fit(x).labels(x).tolist() for b in ("exact", "auto", "kd", "ball")]
    assert all(k == kinds[0] for k in kinds)
