"""The queries over the library's own operators, with SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import drift, vectors
from ..operators import clustering, metrics, neighbors, recovery, summary, timing
from ..sources import streams
from ..streaming import drivers
from . import benchmark, state_sql, stream_sql
from .storage import shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K, ALPHA, EPS, RADIUS = 5, 1.0, 1.05, 1.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Inputs --------------------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, seq (from 1 within its type), event_id, value."""
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", "value", "ts", "user_id")
    return own.withColumn("seq", F.row_number().over(W.partitionBy("event_type").orderBy("event_id")).cast("long"))


def _planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of the plane, a stream for each type."""
    return _events(spark, sf_dir).select(F.col("event_type").alias("stream"), "seq", F.array(F.col("value") / 600, F.hour("ts") / 24.0).alias("vec"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """window, y, pred: events in windows of 50 ids, with their type as class and a prediction from their value."""
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    pred = F.when(F.col("value") < 5, -1).otherwise(F.floor(F.col("value") / 20) % 4).cast("int")
    return own.select(F.floor(F.col("event_id") / 50).cast("long").alias("window"), (F.col("event_id") + 1).alias("seq"), F.length("event_type").alias("y"), pred.alias("pred"))


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Window qualities between 0 and 1, and a drift every 16 windows from the sixth on."""
    own = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.floor(F.col("event_id") / 50).cast("long").alias("window")).agg((F.count_if(F.col("value") < 40) / F.count("*")).alias("quality"))
    last = own.agg(F.max("window").alias("last"))
    return own, last.select(F.explode(F.expr("sequence(6L, greatest(6L, last), 16L)")).alias("drift"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark-like runs made of events: an algorithm for each type, 3 datasets, 5 seeds; some values are missing."""
    own = spark.read.parquet(f"{sf_dir}/events.parquet")
    some = lambda c, n: F.when(F.col("n") % n != 0, F.col(c))
    base = own.groupBy(F.col("event_type").alias("algorithm"), F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dataset"), (F.col("user_id") % 5).cast("int").alias("seed")).agg((F.count_if(F.col("value") < 40) / F.count("*")).alias("q"), F.count("*").alias("n"))
    return base.select("algorithm", "dataset", "seed", F.col("q").alias("quality_mean"), (F.col("q") * F.col("q")).alias("purity_mean"), F.sqrt("q").alias("coverage_mean"), some("q", 3).alias("ari_mean"), (F.col("n") / 100000.0).alias("pending_ratio"), F.col("q").alias("pre_quality"), (F.col("q") / 2).alias("during_quality"), (F.col("q") / 4).alias("post_quality"), some("q", 4).alias("quality_drop"), some("q", 5).alias("response_lag_w"), (some("q", 7) * 8).alias("recovery_w"), (some("q", 7) * 400).alias("recovery_pts"))


E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
KNN = f"{E}, pairs AS (SELECT a.id AS i, b.id AS j, list_distance(a.vec, b.vec) AS dist FROM e a JOIN e b ON a.id <> b.id), knn AS (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j)::INT AS rank FROM pairs QUALIFY rank <= {K})"
MUTUAL = f"{KNN}, mutual AS (SELECT x.i, x.j, x.dist FROM knn x JOIN knn y ON x.i = y.j AND x.j = y.i)"
SCORES = f"{MUTUAL}, own AS (SELECT i, count(*) AS n, avg(dist) AS m FROM mutual GROUP BY i), scores AS (SELECT e.id AS i, coalesce(n, 0)::BIGINT AS n_tight, m / (n * n) AS score FROM e LEFT JOIN own ON own.i = e.id)"
MARKED = f"{SCORES}, marked AS (SELECT i, n_tight, score, coalesce(score > (SELECT avg(score) + {ALPHA} * stddev_pop(score) FROM scores), true) AS is_outlier FROM scores)"
SEQ = "s AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS seq FROM events)"
LABELLED = "l AS (SELECT event_id // 50 AS win, event_id + 1 AS seq, length(event_type)::INT AS y, CASE WHEN value < 5 THEN -1 ELSE floor(value / 20)::BIGINT % 4 END AS pred FROM events)"
CELLS = f"{LABELLED}, wins AS (SELECT DISTINCT win FROM l), cells AS (SELECT win, pred, y, count(*) AS c FROM l WHERE pred >= 0 GROUP BY ALL), clusters AS (SELECT win, pred, sum(c)::DOUBLE AS n, max(c) AS top, sum(c * (c - 1) / 2.0) AS s FROM cells GROUP BY ALL), classes AS (SELECT win, y, sum(c)::DOUBLE AS n FROM cells GROUP BY ALL)"
RAND = f"{CELLS}, r AS (SELECT win, sum(s) AS s, sum(n * (n - 1) / 2) AS a, count(*) AS nc, sum(n) AS n FROM clusters GROUP BY win), k AS (SELECT win, sum(n * (n - 1) / 2) AS b, count(*) AS nk FROM classes GROUP BY win), rand AS (SELECT win, n, nc, nk, CASE WHEN s = a AND s = b THEN 1.0 ELSE (s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)) END AS ari FROM r JOIN k USING (win))"
SERIES = "ser AS (SELECT event_id // 50 AS win, count(*) FILTER (value < 40) / count(*) AS q FROM events GROUP BY 1), dr AS (SELECT unnest(generate_series(6, greatest(6, max(win)), 16)) AS drift FROM ser)"
RUNS = "b AS (SELECT event_type AS algorithm, 'd' || (user_id % 3) AS dataset, (user_id % 5)::INT AS seed, count(*) FILTER (value < 40) / count(*) AS q, count(*) AS n FROM events GROUP BY ALL)"


def _rounded(df: DataFrame, *columns: str, decimals: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, decimals) for c in columns})


# Neighbours ----------------------------------------------------------------------------------------------------------


@query(f"WITH {KNN} SELECT i, j, rank, round(dist, 6) AS dist FROM knn")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(neighbors.knn(_points(spark, sf_dir), K), "dist")


@query(f"WITH {MUTUAL} SELECT i, j, round(dist, 6) AS dist FROM mutual")
def mutual_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(neighbors.mutual_knn(neighbors.knn(_points(spark, sf_dir), K)), "dist")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return neighbors.tight_scores(points, neighbors.mutual_knn(neighbors.knn(points, K)))


@query(f"WITH {SCORES} SELECT i, n_tight, round(score, 6) AS score FROM scores")
def tight_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scores(spark, sf_dir), "score")


@query(f"WITH {MARKED} SELECT i, n_tight, round(score, 6) AS score, is_outlier FROM marked")
def tight_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(neighbors.outliers(_scores(spark, sf_dir), ALPHA), "score")


@query(
    f"""WITH RECURSIVE {MARKED}, good AS (SELECT i FROM marked WHERE NOT is_outlier),
    links AS (SELECT i, j FROM mutual WHERE i IN (FROM good) AND j IN (FROM good) UNION SELECT i, i FROM good),
    reach AS (SELECT i, j FROM links UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
    roots AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
    named AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots)
    SELECT e.id AS i, coalesce(named.label, -1)::BIGINT AS label FROM e LEFT JOIN named ON named.i = e.id"""
)
def tight_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.tight_clusters(_points(spark, sf_dir), K, ALPHA)


SHARED = f"{KNN}, lists AS (SELECT i, list(j) AS l FROM knn GROUP BY i), shared AS (SELECT k.i, k.j, list_intersect(a.l, b.l) AS s FROM knn k JOIN lists a ON a.i = k.i JOIN lists b ON b.i = k.j)"


@query(f"WITH {SHARED} SELECT i, j, len(s)::INT AS n_shared FROM shared WHERE len(s) >= 2")
def snn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.shared_neighbors(neighbors.knn(_points(spark, sf_dir), K), 2).select("i", "j", F.size("shared").alias("n_shared"))


@query(f"WITH {SHARED}, q AS (SELECT i, j, s FROM shared WHERE len(s) >= 2), far AS (SELECT max(k.dist) AS m FROM (SELECT i, unnest(s) AS j FROM q) u JOIN knn k USING (i, j)) SELECT (SELECT count(*) FROM q) AS n_pairs, round(m, 6) AS max_dist, round(CASE WHEN (SELECT count(*) FROM q) < 4 THEN 1.2 ELSE greatest(1e-4, least(1.2, coalesce(m, 0))) END, 6) AS radius FROM far")
def snn_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(neighbors.shared_radius(_points(spark, sf_dir), K, 1.2, 2, 4), "max_dist", "radius")


@query(f"WITH {E} SELECT a.id AS i, b.id AS j, round(list_distance(a.vec, b.vec), 6) AS dist FROM e a, e b WHERE list_distance(a.vec, b.vec) <= {RADIUS}")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(neighbors.range_join(_points(spark, sf_dir), RADIUS), "dist")


@query("WITH p AS (SELECT p_partkey AS id, p_retailprice / 1000 AS x, p_size / 50.0 AS y FROM part), d AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM p a JOIN p b ON abs(a.x - b.x) <= 0.011 AND abs(a.y - b.y) <= 0.011) SELECT i, j, round(dist, 6) AS dist FROM d WHERE dist <= 0.01")
def grid_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.array(F.col("p_retailprice") / 1000, F.col("p_size") / 50.0).alias("vec"))
    return _rounded(neighbors.grid_range_join(parts, 0.01, 2), "dist")


PLANES = neighbors.planes(64, 3, 4)
_SQL_PLANES = ", ".join(f"({t}, {h}, {PLANES[t, h].tolist()})" for t in range(3) for h in range(4))
LSH = f"{E}, p(tbl, h, n) AS (VALUES {_SQL_PLANES}), keys AS (SELECT id, tbl, string_agg(CASE WHEN list_dot_product(vec, n::DOUBLE[]) > 0 THEN '1' ELSE '0' END, '' ORDER BY h) AS key FROM e, p GROUP BY id, tbl), cand AS (SELECT DISTINCT a.id AS q, b.id AS j FROM keys a JOIN keys b USING (tbl, key)), near AS (SELECT q, j, list_distance(a.vec, b.vec) AS dist FROM cand JOIN e a ON a.id = q JOIN e b ON b.id = j)"


@query(f"WITH {LSH} SELECT id AS idx, tbl::INT AS tbl, key FROM keys")
def lsh_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.lsh_keys(_points(spark, sf_dir), PLANES)


@query(f"WITH {LSH} SELECT q, j, round(dist, 6) AS dist FROM near WHERE dist <= {RADIUS}")
def lsh_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return _rounded(neighbors.lsh_range(points, points, RADIUS, PLANES), "dist")


@query(f"WITH {LSH} SELECT id AS idx, tbl::INT AS tbl, key FROM keys")
def lsh_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of half of the points, into which the other half is put."""
    points = _points(spark, sf_dir)
    index = neighbors.lsh_keys(points.where("id % 2 = 0"), PLANES)
    return neighbors.lsh_insert(index, points.where("id % 2 <> 0"), PLANES)


@query(f"WITH {LSH}, many AS (SELECT q FROM cand GROUP BY q HAVING count(*) >= 3), full_d AS (SELECT q, j, dist FROM near WHERE q IN (FROM many) AND dist > 0 UNION ALL SELECT a.id, b.id, list_distance(a.vec, b.vec) FROM e a JOIN e b ON a.vec <> b.vec WHERE a.id NOT IN (FROM many)), r AS (SELECT q, j, row_number() OVER (PARTITION BY q ORDER BY dist, j)::INT AS rank, dist FROM full_d) SELECT q, j, rank, round(dist, 6) AS dist FROM r WHERE rank <= 3")
def lsh_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return _rounded(neighbors.lsh_knn(points, points, 3, PLANES), "dist")


CENTERS = f"{E}, c AS (SELECT label, list(m ORDER BY d) AS center FROM (SELECT label, d, avg(vec[d]) AS m FROM e, generate_series(1, 64) AS g(d) GROUP BY ALL) GROUP BY label)"


@query(f"WITH {CENTERS}, d AS (SELECT e.id AS i, c.label AS j, list_distance(e.vec, c.center) AS dist FROM e, c), r AS (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS r FROM d) SELECT i, j::BIGINT AS j, round(dist, 6) AS dist, dist <= 0.95 AS accepted FROM r WHERE r = 1")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    centers = points.groupBy(F.col("label").cast("long").alias("id")).agg(vectors.centroid(F.col("vec"), 64).alias("vec"))
    return _rounded(neighbors.nearest_center(points, centers, 0.95), "dist")


@query(f"WITH {E}, m AS (SELECT id, vec, CASE WHEN label < 5 THEN label ELSE -1 END AS macro FROM e), d AS (SELECT a.id AS i, b.id AS j, b.macro, list_distance(a.vec, b.vec) AS dist FROM m a JOIN m b ON a.macro = -1 AND b.macro >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS r FROM d) SELECT i, j, round(dist, 6) AS dist, CASE WHEN dist <= 1.04 THEN macro ELSE -1 END::BIGINT AS macro_id FROM r WHERE r = 1")
def macro_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    micro = _points(spark, sf_dir).select("id", "vec", F.lit(0.52).alias("radius"), F.when(F.col("label") < 5, F.col("label")).otherwise(-1).cast("long").alias("macro_id"))
    return _rounded(neighbors.attach_to_macro(micro), "dist")


@query(
    f"""WITH RECURSIVE {E}, near AS (SELECT a.id AS i, b.id AS j FROM e a, e b WHERE list_distance(a.vec, b.vec) <= {EPS}),
    core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 5), links AS (SELECT i, j FROM near WHERE i IN (FROM core) AND j IN (FROM core)),
    reach AS (SELECT i, j FROM links UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i), roots AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
    named AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots),
    edge AS (SELECT near.i, min(label) AS label FROM near JOIN named ON named.i = near.j GROUP BY near.i)
    SELECT e.id AS i, coalesce(named.label, edge.label, -1)::BIGINT AS label, named.label IS NOT NULL AS is_core FROM e LEFT JOIN named ON named.i = e.id LEFT JOIN edge ON edge.i = e.id"""
)
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.dbscan(_points(spark, sf_dir), EPS, 5)


@query(f"WITH {CENTERS} SELECT label, count(*) AS n, round(c.center[1], 6) AS c0, round(c.center[64], 6) AS c63, round(1.1 * greatest(quantile_cont(list_distance(e.vec, c.center), 0.95), 1e-6), 6) AS radius FROM e JOIN c USING (label) GROUP BY label, c.center")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clustering.cluster_summary(_points(spark, sf_dir), dims=64)
    return out.select("label", "n", F.round(F.col("center")[0], 6).alias("c0"), F.round(F.col("center")[63], 6).alias("c63"), F.round("radius", 6).alias("radius"))


@query(
    f"""WITH RECURSIVE {MARKED}, good AS (SELECT i FROM marked WHERE NOT is_outlier),
    links AS (SELECT i, j FROM mutual WHERE i IN (FROM good) AND j IN (FROM good) UNION SELECT i, i FROM good),
    reach AS (SELECT i, j FROM links UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
    roots AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
    named AS (SELECT i, dense_rank() OVER (ORDER BY root) - 1 AS label FROM roots)
    SELECT label::BIGINT AS label, count(*) AS n FROM named GROUP BY label ORDER BY n DESC, label LIMIT 1"""
)
def largest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.largest_group(clustering.tight_clusters(_points(spark, sf_dir), K, ALPHA))


@query(f"WITH {CENTERS}, d AS (SELECT e.id AS i, list_distance(e.vec, c.center) AS dist FROM e, c) SELECT i, round(min(dist) / 0.95, 6) AS surprise FROM d GROUP BY i")
def surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    centers = points.groupBy(F.col("label").cast("long").alias("id")).agg(vectors.centroid(F.col("vec"), 64).alias("vec"))
    near = neighbors.nearest_center(points, centers, 0.95)
    return near.select("i", F.round(vectors.surprise(F.col("dist"), F.lit(0.95)), 6).alias("surprise"))


@query(f"WITH {CENTERS} SELECT e.id AS i, list_distance(e.vec, c.center) <= 0.95 AS held FROM e JOIN c USING (label)")
def ball_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    centers = points.groupBy("label").agg(vectors.centroid(F.col("vec"), 64).alias("center"))
    return points.join(centers, "label").select(F.col("id").alias("i"), vectors.within(F.col("vec"), F.col("center"), F.lit(0.95)).alias("held"))


@query(f"WITH {E}, pts AS (SELECT label AS stream, id AS seq, vec FROM e) SELECT * FROM (WITH RECURSIVE {state_sql.greedy_cover('pts', 1.05, 5)})")
def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).select(F.col("label").alias("stream"), F.col("id").alias("seq"), "vec")
    return clustering.greedy_cover(points, 1.05, 5)


# Quality -------------------------------------------------------------------------------------------------------------


@query(f'WITH {CELLS} SELECT win AS "window", round(coalesce(sum(top) / sum(n), 0), 6) AS purity FROM wins LEFT JOIN clusters USING (win) GROUP BY win')
def purity_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.purity_micro(_labelled(spark, sf_dir), ["window"]), "purity")


@query(f'WITH {CELLS} SELECT win AS "window", round(avg(top / n), 6) AS purity FROM wins LEFT JOIN clusters USING (win) GROUP BY win')
def purity_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.purity_macro(_labelled(spark, sf_dir), ["window"]), "purity")


@query(f'WITH {LABELLED} SELECT win AS "window", round(avg((pred >= 0)::INT), 6) AS coverage FROM l GROUP BY win')
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.coverage(_labelled(spark, sf_dir), ["window"]), "coverage")


@query(f'WITH {LABELLED} SELECT win AS "window", 1.0::DOUBLE AS coverage FROM l GROUP BY win')
def coverage_unmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coverage_masked(_labelled(spark, sf_dir), ["window"])


@query(f'WITH {RAND} SELECT win AS "window", round(CASE WHEN n >= 2 AND nc >= 2 AND nk >= 2 THEN ari END, 6) AS ari FROM wins LEFT JOIN rand USING (win)')
def rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.rand_index(_labelled(spark, sf_dir), ["window"]), "ari")


@query(f'WITH {RAND} SELECT win AS "window", round(ari, 6) AS ari FROM wins LEFT JOIN rand USING (win)')
def rand_index_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.rand_index(_labelled(spark, sf_dir), ["window"], guarded=False), "ari")


QUALITY = f"{RAND}, cov AS (SELECT win, avg((pred >= 0)::INT) AS coverage FROM l GROUP BY win), pur AS (SELECT win, coalesce(sum(top) / sum(n), 0) AS purity, avg(top / n) AS macro FROM wins LEFT JOIN clusters USING (win) GROUP BY win), q AS (SELECT win, coverage, purity, macro, ari AS raw, CASE WHEN n >= 2 AND nc >= 2 AND nk >= 2 THEN ari END AS ari FROM cov JOIN pur USING (win) LEFT JOIN rand USING (win))"


@query(f'WITH {QUALITY} SELECT win AS "window", round(coverage, 6) AS coverage, round(purity, 6) AS purity, round(ari, 6) AS ari, round((coverage + purity + coalesce(ari, 0)) / CASE WHEN ari IS NULL THEN 2 ELSE 3 END, 6) AS quality FROM q')
def quality_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.quality_micro(_labelled(spark, sf_dir), ["window"]), "coverage", "purity", "ari", "quality")


@query(f'WITH {QUALITY} SELECT win AS "window", round(macro, 6) AS purity, round(raw, 6) AS ari, round((macro + 1 + raw) / 3, 6) AS quality FROM q')
def quality_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.quality_macro(_labelled(spark, sf_dir), ["window"]), "purity", "ari", "quality")


@query('SELECT (event_id // 64) AS "window", count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING count(*) = 64')
def count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") + 1).alias("seq"), "value")
    return metrics.count_windows(own, 64).groupBy("window").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# Drift and recovery --------------------------------------------------------------------------------------------------


@query(f'WITH {SERIES} SELECT drift, CASE WHEN win < drift THEN \'pre\' WHEN win = drift THEN \'during\' ELSE \'post\' END AS phase, win AS "window", round(q, 6) AS quality FROM ser JOIN dr ON win BETWEEN drift - 2 AND drift + 3')
def drift_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recovery.drift_phases(*_series(spark, sf_dir)), "quality")


@query(f"WITH {SERIES}, p AS (SELECT avg(q) FILTER (win < drift) AS a, avg(q) FILTER (win = drift) AS b, avg(q) FILTER (win > drift) AS c FROM ser JOIN dr ON win BETWEEN drift - 2 AND drift + 3) SELECT round(a, 6) AS pre_quality, round(b, 6) AS during_quality, round(c, 6) AS post_quality, round(a - b, 6) AS quality_drop FROM p")
def phase_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recovery.phase_quality(*_series(spark, sf_dir)), "pre_quality", "during_quality", "post_quality", "quality_drop")


def _recovery_sql(after: int, drop: float) -> str:
    return f"""WITH {SERIES}, m AS (SELECT drift, drift + {after} AS start, coalesce(lead(drift) OVER (ORDER BY drift), (SELECT max(win) + 1 FROM ser)) AS stop FROM dr),
    seg AS (SELECT drift, win - start AS s, q, row_number() OVER (PARTITION BY drift ORDER BY win DESC) AS back FROM m JOIN ser ON win >= start AND win < stop),
    t AS (SELECT drift, count(*) AS n, min(q) FILTER (s < 5) AS low, quantile_cont(q, 0.5) FILTER (back <= 5) * 0.9 AS target FROM seg GROUP BY drift),
    o AS (SELECT seg.drift, s, q >= target AS ok, min((q >= target)::INT) OVER w AS held, count(*) OVER w AS c FROM seg JOIN t USING (drift) WINDOW w AS (PARTITION BY seg.drift ORDER BY s ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    f AS (SELECT drift, min(s + 1) FILTER (ok) AS response, min(s + 1) FILTER (held = 1 AND c = 3) AS recovery FROM o GROUP BY drift),
    pre AS (SELECT drift, avg(q) AS pre FROM dr JOIN ser ON win IN (drift - 2, drift - 1) GROUP BY drift)
    SELECT dr.drift, CASE WHEN n >= 5 AND NOT coalesce(pre - low < {drop}, false) THEN response END::DOUBLE AS response, CASE WHEN n >= 5 AND NOT coalesce(pre - low < {drop}, false) THEN recovery END::DOUBLE AS recovery
    FROM dr LEFT JOIN t USING (drift) LEFT JOIN f USING (drift) LEFT JOIN pre USING (drift)"""


@query(_recovery_sql(1, 0.05))
def recovery_usual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.recovery(*_series(spark, sf_dir))


@query(_recovery_sql(0, 0.02))
def recovery_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.recovery(*_series(spark, sf_dir), after=0, least_drop=0.02)


DETECTED = "d AS (SELECT event_id AS t FROM events WHERE value > 250), tr AS (SELECT unnest(generate_series(500, greatest(500, max(event_id)), 1000)) AS drift FROM events), hit AS (SELECT t, drift, t - drift AS lag, row_number() OVER (PARTITION BY t ORDER BY abs(t - drift), drift) AS r FROM d JOIN tr ON abs(t - drift) <= 125), m AS (SELECT d.t, drift AS nearest_real_drift, lag AS lag_to_real, CASE WHEN drift IS NULL THEN 'false_positive' WHEN lag < 0 THEN 'early' ELSE 'true_positive' END AS verdict FROM d LEFT JOIN hit ON hit.t = d.t AND r = 1)"


def _detected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = spark.read.parquet(f"{sf_dir}/events.parquet")
    drifts = own.agg(F.max("event_id").alias("last")).select(F.explode(F.expr("sequence(500L, greatest(500L, last), 1000L)")).alias("drift"))
    return own.where("value > 250").select(F.col("event_id").alias("t")), drifts


@query(f"WITH {DETECTED} SELECT t, nearest_real_drift, lag_to_real, verdict FROM m")
def drift_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.match_drifts(*_detected(spark, sf_dir), 125)


@query(f"WITH {DETECTED} SELECT drift FROM tr WHERE drift NOT IN (SELECT nearest_real_drift FROM m WHERE nearest_real_drift IS NOT NULL)")
def missed_drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, drifts = _detected(spark, sf_dir)
    return timing.missed_drifts(timing.match_drifts(events, drifts, 125), drifts)


@query(f"WITH {DETECTED}, c AS (SELECT count(*) FILTER (verdict = 'true_positive') AS tp, count(*) FILTER (verdict = 'false_positive') AS fp, count(*) FILTER (verdict = 'early') AS ea, count(*) AS n, count(DISTINCT nearest_real_drift) AS found FROM m), n AS (SELECT count(*) AS n_true FROM tr) SELECT tp AS true_positive, fp AS false_positive, ea AS early, n_true - found AS missed, round(CASE WHEN n > 0 THEN tp / n END, 3) AS precision, round(CASE WHEN n_true > 0 THEN tp / n_true END, 3) AS recall FROM c, n")
def timing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, drifts = _detected(spark, sf_dir)
    return timing.timing_scores(timing.match_drifts(events, drifts, 125), drifts)


_LOG = {"k_lambda": 1.0, "k_slope": 1.0, "confirm_steps": 1, "accel_floor": 0.01}


@query(
    f"""WITH RECURSIVE {SEQ}, {state_sql.detector("s", "event_type", "value", **_LOG)},
    f AS (SELECT event_type, seq AS t, direction, score, acceleration FROM det WHERE fired),
    tr AS (SELECT event_type, unnest(generate_series(400, greatest(400, max(seq)), 400)) AS drift FROM s GROUP BY event_type),
    hit AS (SELECT f.event_type, t, drift, t - drift AS lag, row_number() OVER (PARTITION BY f.event_type, t ORDER BY abs(t - drift), drift) AS r FROM f JOIN tr ON tr.event_type = f.event_type AND abs(t - drift) <= 100),
    m AS (SELECT f.*, drift, lag, CASE WHEN drift IS NULL THEN 'false_positive' WHEN lag < 0 THEN 'early' ELSE 'true_positive' END AS verdict FROM f LEFT JOIN hit ON hit.event_type = f.event_type AND hit.t = f.t AND r = 1),
    counts AS (SELECT event_type, count(*) AS n, count(*) FILTER (verdict = 'true_positive') AS tp, count(*) FILTER (verdict = 'false_positive') AS fp, count(*) FILTER (verdict = 'early') AS ea, count(DISTINCT drift) AS found FROM m GROUP BY event_type),
    scores AS (SELECT c.*, t.n_true, round(tp / n, 3) AS p, round(tp / n_true, 3) AS r FROM counts c JOIN (SELECT event_type, count(*) AS n_true FROM tr GROUP BY event_type) t USING (event_type))
    SELECT event_type, 0::BIGINT AS place, '{timing.LOG_HEAD}' AS line FROM counts
    UNION ALL SELECT event_type, 1, '  {"-" * (len(timing.LOG_HEAD) - 2)}' FROM counts
    UNION ALL SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY t) + 1, printf('  %6d  %-5s %6.2f  %6.3f  %4d  %6d  %-16s  %s', t, direction, score, acceleration, 0, 0, verdict, coalesce(CASE WHEN lag >= 0 THEN '+' || lag ELSE lag::VARCHAR END, 'n/a')) FROM m
    UNION ALL SELECT event_type, n + 2, '' FROM counts
    UNION ALL SELECT event_type, n + 3, printf('  TP=%d  FP=%d  early=%d  missed=%d  precision=%s  recall=%s', tp, fp, ea, n_true - found, p::VARCHAR, r::VARCHAR) FROM scores
    UNION ALL SELECT DISTINCT event_type, 0, '{timing.LOG_NONE}' FROM tr WHERE event_type NOT IN (SELECT event_type FROM counts)"""
)
def drift_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = drivers.detect(_events(spark, sf_dir), "event_type", "seq", "value", **_LOG).where("fired")
    events = own.select("event_type", F.col("seq").alias("t"), "direction", F.col("abruptness_score").alias("score"), "acceleration", F.lit(0).alias("n_mcs"), F.lit(0).alias("n_macros"))
    drifts = _events(spark, sf_dir).groupBy("event_type").agg(F.max("seq").alias("last")).select("event_type", F.explode(F.expr("sequence(400L, greatest(400L, last), 400L)")).alias("drift"))
    matched = written(timing.match_drifts(events, drifts, 100, ["event_type"]), "matched")
    return timing.drift_log(matched, drifts, ["event_type"])


@query("SELECT event_id, greatest(0, ceil(event_id / 50.0)::INT - 1) AS window_before, (event_id // 50)::INT AS window_at, round(value * pow(0.998, event_id % 500), 6) AS faded FROM events")
def point_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation window of each event by both rules, and its value after fading for some points."""
    own = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    faded = vectors.decayed(F.col("value"), 0.998, F.col("event_id") % 500)
    return own.select("event_id", vectors.drift_window_before(F.col("event_id")).alias("window_before"), vectors.drift_window_at(F.col("event_id")).alias("window_at"), F.round(faded, 6).alias("faded"))


@query("WITH g AS (SELECT event_id // 100 AS grp, list({'t': event_id, 'v': value} ORDER BY event_id) AS l, max(event_id) - 30 AS cutoff FROM events GROUP BY 1), k AS (SELECT grp, unnest(list_filter(l, lambda p: p.t > cutoff)) AS p FROM g) SELECT grp, count(*) AS n, min(p.t) AS oldest, round(sum(p.v), 6) AS total FROM k GROUP BY grp")
def window_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.floor(F.col("event_id") / 100).cast("long").alias("grp"))
    held = own.agg(F.collect_list(F.struct(F.col("event_id").alias("t"), F.col("value").alias("v"))).alias("l"), (F.max("event_id") - 30).alias("cutoff"))
    left = held.select("grp", F.explode(vectors.unexpired(F.col("l"), F.col("cutoff"))).alias("p"))
    return left.groupBy("grp").agg(F.count("*").alias("n"), F.min("p.t").alias("oldest"), F.round(F.sum("p.v"), 6).alias("total"))


# Rolling statistics --------------------------------------------------------------------------------------------------


def _frame(n: int) -> str:
    return f"(PARTITION BY event_type ORDER BY seq ROWS {n - 1} PRECEDING)"


@query(f"WITH {SEQ}, w AS (SELECT event_type, seq, list(value) OVER {_frame(50)} AS l, median(value) OVER {_frame(50)} AS c FROM s) SELECT event_type, seq, round(CASE WHEN len(l) < 4 THEN 1 ELSE greatest(1.4826 * list_sort(list_transform(l, lambda v: abs(v - c)))[len(l) // 2 + 1], 1e-6) END, 6) AS sigma FROM w")
def rolling_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_type", "seq", F.round(drift.mad_sigma(F.col("value"), "event_type", "seq"), 6).alias("sigma"))


SLOPE = f"{SEQ}, sl AS (SELECT event_type, seq, value, CASE WHEN count(*) OVER {_frame(10)} >= 2 THEN regr_slope(value, seq) OVER {_frame(10)} ELSE 0 END AS slope FROM s)"


def _slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("slope", drift.slope(F.col("value"), "event_type", "seq"))


@query(f"WITH {SLOPE} SELECT event_type, seq, round(slope, 6) AS slope FROM sl")
def reg_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_slopes(spark, sf_dir).select("event_type", "seq", "slope"), "slope")


@query(f"WITH {SLOPE} SELECT event_type, seq, round(CASE WHEN count(*) OVER {_frame(8)} >= 2 THEN abs(regr_slope(slope, seq) OVER {_frame(8)}) ELSE 0 END, 6) AS acceleration FROM sl")
def acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(spark, sf_dir).select("event_type", "seq", F.round(F.abs(drift.slope(F.col("slope"), "event_type", "seq", 8)), 6).alias("acceleration"))


@query(f"WITH {SEQ} SELECT event_type, seq, round(CASE WHEN count(*) OVER {_frame(150)} < 20 THEN 13.5 ELSE greatest(4.5 * stddev_samp(value) OVER {_frame(150)}, 6.75) END, 6) AS level FROM s")
def adaptive_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_type", "seq", F.round(drift.adaptive_level(F.col("value"), "event_type", "seq"), 6).alias("level"))


@query(f"WITH {SLOPE} SELECT event_type, seq, round(CASE WHEN count(*) OVER {_frame(150)} < 10 THEN 7.0 ELSE avg(slope) OVER {_frame(150)} + 3.5 * stddev_samp(slope) OVER {_frame(150)} END, 6) AS slope_limit FROM sl")
def slope_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(spark, sf_dir).select("event_type", "seq", F.round(drift.slope_limit(F.col("slope"), "event_type", "seq"), 6).alias("slope_limit"))


@query(f"WITH {SLOPE} SELECT event_type, seq, round(CASE WHEN count(*) OVER {_frame(150)} < 5 THEN slope ELSE (slope - avg(slope) OVER {_frame(150)}) / (stddev_samp(slope) OVER {_frame(150)} + 1e-9) END, 6) AS z FROM sl")
def slope_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(spark, sf_dir).select("event_type", "seq", F.round(drift.slope_score(F.col("slope"), "event_type", "seq"), 6).alias("z"))


ARMS = f"{SEQ}, z AS (SELECT event_type, seq, greatest(-2.5, least(2.5, (value - 50) / 40)) AS z FROM s), c AS (SELECT event_type, seq, sum(z - 0.01) OVER w AS u, sum(-z - 0.01) OVER w AS l FROM z WINDOW w AS (PARTITION BY event_type ORDER BY seq ROWS UNBOUNDED PRECEDING)), arms AS (SELECT event_type, seq, u - least(0, min(u) OVER w) AS up, l - least(0, min(l) OVER w) AS low FROM c WINDOW w AS (PARTITION BY event_type ORDER BY seq ROWS UNBOUNDED PRECEDING))"


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = vectors.winsorize((F.col("value") - 50) / 40, 2.5)
    return drift.cusum_arms(_events(spark, sf_dir).withColumn("z", z), "z", "event_type", "seq")


@query(f"WITH {ARMS} SELECT event_type, seq, round(up, 6) AS up, round(low, 6) AS low FROM arms")
def cusum_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_arms(spark, sf_dir).select("event_type", "seq", "up", "low"), "up", "low")


@query(f"WITH {SEQ}, m AS (SELECT event_type, seq, value > 30 AS met, sum((value <= 30)::INT) OVER (PARTITION BY event_type ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT event_type, seq, (sum(met::INT) OVER (PARTITION BY event_type, island ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM m")
def confirm_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir).withColumn("met", F.col("value") > 30)
    return drift.run_lengths(own, "met", "event_type", "seq").select("event_type", "seq", "run")


@query(f"WITH RECURSIVE {SEQ}, r AS (SELECT event_type, seq, value AS mu, 0.05 * value + 0.95 * value AS ema FROM s WHERE seq = 1 UNION ALL SELECT s.event_type, s.seq, r.ema, 0.05 * s.value + (1.0::DOUBLE - 0.05::DOUBLE) * r.ema FROM r JOIN s ON s.event_type = r.event_type AND s.seq = r.seq + 1) SELECT event_type, seq, round(mu, 6) AS mu FROM r")
def ema_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir).select("event_type", "seq", "value")
    return _rounded(drift.lagged_ema(own, "value", "event_type", "seq").select("event_type", "seq", "mu"), "mu")


def _slope_sql(x: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER {_frame(n)} >= 2 THEN regr_slope({x}, seq) OVER {_frame(n)} ELSE 0 END"


_WIDE = _frame(150)
SIGNALS = f"""{SEQ}, r AS (SELECT event_type, seq, value AS mu, 0.05 * value + 0.95 * value AS ema FROM s WHERE seq = 1 UNION ALL SELECT s.event_type, s.seq, r.ema, 0.05 * s.value + (1.0::DOUBLE - 0.05::DOUBLE) * r.ema FROM r JOIN s ON s.event_type = r.event_type AND s.seq = r.seq + 1),
    w AS (SELECT event_type, seq, value, list(value) OVER {_frame(50)} AS l, median(value) OVER {_frame(50)} AS c FROM s),
    z AS (SELECT event_type, seq, value, mu, greatest(-2.5, least(2.5, (value - mu) / CASE WHEN len(l) < 4 THEN 1 ELSE greatest(1.4826 * list_sort(list_transform(l, lambda v: abs(v - c)))[len(l) // 2 + 1], 1e-6) END)) AS z FROM w JOIN r USING (event_type, seq)),
    c AS (SELECT *, sum(z - 0.01) OVER a AS u, sum(-z - 0.01) OVER a AS l FROM z WINDOW a AS (PARTITION BY event_type ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    arms AS (SELECT event_type, seq, value, mu, u - least(0, min(u) OVER a) AS up, l - least(0, min(l) OVER a) AS low FROM c WINDOW a AS (PARTITION BY event_type ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    sl AS (SELECT *, {_slope_sql("up", 10)} AS su, {_slope_sql("low", 10)} AS sl FROM arms),
    sig AS (SELECT *, su >= sl AS rises, count(*) OVER {_WIDE} AS n, CASE WHEN count(*) OVER {_WIDE} < 20 THEN 13.5 ELSE greatest(4.5 * stddev_samp(greatest(up, low)) OVER {_WIDE}, 6.75) END AS level,
        abs({_slope_sql("su", 8)}) AS au, abs({_slope_sql("sl", 8)}) AS al, avg(su) OVER {_WIDE} AS mu_u, avg(sl) OVER {_WIDE} AS mu_l, stddev_samp(su) OVER {_WIDE} AS sd_u, stddev_samp(sl) OVER {_WIDE} AS sd_l FROM sl),
    pick AS (SELECT *, CASE WHEN rises THEN up ELSE low END AS arm, CASE WHEN rises THEN au ELSE al END AS acc, CASE WHEN rises THEN su ELSE sl END AS slope, CASE WHEN rises THEN mu_u ELSE mu_l END AS m, CASE WHEN rises THEN sd_u ELSE sd_l END AS sd FROM sig),
    val AS (SELECT *, CASE WHEN n < 5 THEN slope ELSE (slope - m) / (sd + 1e-9) END AS score, CASE WHEN n < 10 THEN 7.0 ELSE m + 3.5 * sd END AS lim FROM pick),
    met AS (SELECT *, (seq >= 50 AND arm > level AND score > lim AND acc > 0.12)::INT AS met, sum((NOT (seq >= 50 AND arm > level AND score > lim AND acc > 0.12))::INT) OVER (PARTITION BY event_type ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM val),
    runs AS (SELECT *, (sum(met) OVER (PARTITION BY event_type, island ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM met)"""


@query(f'WITH RECURSIVE {SIGNALS} SELECT event_type, seq, value, round(mu, 6) AS mu, round(up, 6) AS up, round(low, 6) AS low, round(level, 6) AS "lambda", CASE WHEN rises THEN \'up\' ELSE \'down\' END AS direction, round(score, 6) AS score, round(lim, 6) AS "limit", round(acc, 6) AS acceleration, run, run >= 3 AS fired FROM runs')
def detector_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drift.detector_signals(_events(spark, sf_dir).select("event_type", "seq", "value"), "value", "event_type", "seq")
    return _rounded(out, "up", "low", "lambda", "score", "limit", "acceleration", "mu")


# Summaries -----------------------------------------------------------------------------------------------------------

_DETAIL_SQL = f"{RUNS}, detail AS (SELECT algorithm, dataset, seed, round_even(q, 4) AS quality, CASE WHEN n % 4 <> 0 THEN round_even(q, 4) END AS qdrop, CASE WHEN n % 5 <> 0 THEN round_even(q, 2) END AS resp, CASE WHEN n % 7 <> 0 THEN round_even(q * 8, 2) END AS rec FROM b)"


@query(f'WITH {_DETAIL_SQL} SELECT algorithm AS "Algorithm", dataset AS "Dataset", count(*) AS runs, round(avg(quality), 4) AS quality, round(CASE WHEN count(quality) >= 2 THEN stddev_samp(quality) END, 4) AS quality_std, round(avg(qdrop), 4) AS quality_drop, round(avg(resp), 4) AS response, round(CASE WHEN count(resp) >= 2 THEN stddev_samp(resp) END, 4) AS response_std, round(avg(rec), 4) AS recovery, round(CASE WHEN count(rec) >= 2 THEN stddev_samp(rec) END, 4) AS recovery_std FROM detail GROUP BY ALL')
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summary.seed_summary(summary.detail_table(_runs(spark, sf_dir)))
    names = {"Runs": "runs", "Quality mean": "quality", "Quality std": "quality_std", "QualityDrop mean": "quality_drop", "ResponseLag_w mean": "response", "ResponseLag_w std": "response_std", "Recovery_w mean": "recovery", "Recovery_w std": "recovery_std"}
    return out.select("Algorithm", "Dataset", *(F.col(f"`{k}`").alias(v) for k, v in names.items()))


def _through_csv(df: DataFrame, name: str) -> DataFrame:
    """A table written as CSV and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    summary.write_csv(df, path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


@query(f'WITH {_DETAIL_SQL} SELECT algorithm AS "Algorithm", dataset AS "Dataset", seed AS "Seed", quality AS "Quality", qdrop AS "QualityDrop", resp AS "ResponseLag_w", rec AS "Recovery_w" FROM detail')
def detail_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_csv(summary.detail_table(_runs(spark, sf_dir)), "detail").select("Algorithm", "Dataset", "Seed", "Quality", "QualityDrop", "ResponseLag_w", "Recovery_w")


@query(f'WITH {_DETAIL_SQL} SELECT algorithm AS "Algorithm", dataset AS "Dataset", count(*) AS "Runs", round(avg(quality), 4) AS "Quality mean", round(avg(rec), 4) AS "Recovery_w mean" FROM detail GROUP BY ALL')
def summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_csv(summary.seed_summary(summary.detail_table(_runs(spark, sf_dir))), "summary").select("Algorithm", "Dataset", "Runs", "Quality mean", "Recovery_w mean")


@query(f"WITH {RUNS}, v AS (SELECT algorithm, dataset, q, CASE WHEN n % 4 <> 0 THEN q END AS d, CASE WHEN n % 7 <> 0 THEN q * 8 END AS r FROM b) SELECT algorithm, dataset, round(avg(q), 6) AS quality_mean_avg, round(CASE WHEN count(q) > 1 THEN stddev_pop(q) ELSE 0 END, 6) AS quality_mean_std, round(avg(d), 6) AS quality_drop_avg, round(CASE WHEN count(d) > 1 THEN stddev_pop(d) ELSE 0 END, 6) AS quality_drop_std, round(avg(r), 6) AS recovery_w_avg, round(CASE WHEN count(r) > 1 THEN stddev_pop(r) ELSE 0 END, 6) AS recovery_w_std FROM v GROUP BY ALL")
def seed_summary_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("quality_mean", "quality_drop", "recovery_w")
    return _rounded(summary.seed_summary_population(_runs(spark, sf_dir), columns), *(f"{c}_{x}" for c in columns for x in ("avg", "std")))


@query(f"WITH {RUNS}, v AS (SELECT algorithm, dataset, round(avg(CASE WHEN n % 7 <> 0 THEN round_even(q * 8, 2) END), 4) AS value FROM b GROUP BY ALL) SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY value ASC NULLS LAST, algorithm)::INT AS place, algorithm, value, CASE WHEN algorithm = 'click' THEN '*' ELSE '' END AS mark FROM v")
def recovery_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.recovery_ranking(summary.seed_summary(summary.detail_table(_runs(spark, sf_dir))), ["click"])


@query(f"WITH {RUNS}, v AS (SELECT algorithm, dataset, avg(q) AS q FROM b WHERE NOT (algorithm = 'click' AND dataset = 'd1') GROUP BY ALL) SELECT d.dataset, a.algorithm, round(v.q, 6) AS quality_mean FROM (SELECT DISTINCT dataset FROM v) d CROSS JOIN (SELECT DISTINCT algorithm FROM v) a LEFT JOIN v ON v.dataset = d.dataset AND v.algorithm = a.algorithm")
def plot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _runs(spark, sf_dir).groupBy("algorithm", "dataset").agg(F.round(F.avg("quality_mean"), 6).alias("quality_mean")).where("not (algorithm = 'click' and dataset = 'd1')")
    return summary.plot_summary(own, ["quality_mean"])


WINDOWS = "h AS (SELECT event_type AS algorithm, 'd' || (user_id % 3) AS dataset, (user_id % 5)::INT AS seed, event_id // 500 AS win, count(*) FILTER (value < 40) / count(*) AS q FROM events GROUP BY ALL), arr AS (SELECT algorithm, dataset, seed, list(q ORDER BY win) AS l FROM h GROUP BY ALL), x AS (SELECT algorithm, dataset, unnest(range(len(l)))::INT AS win, unnest(l) AS q FROM arr), ss AS (SELECT algorithm, dataset, win, avg(q) AS mean, stddev_pop(q) AS std FROM x GROUP BY ALL)"


def _window_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/events.parquet")
    keys = [F.col("event_type").alias("algorithm"), F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dataset"), (F.col("user_id") % 5).cast("int").alias("seed")]
    wins = own.groupBy(*keys, F.floor(F.col("event_id") / 500).alias("w")).agg((F.count_if(F.col("value") < 40) / F.count("*")).alias("q"))
    return wins.groupBy("algorithm", "dataset", "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "q"))), lambda s: s["q"]).alias("quality_series"))


@query(f'WITH {WINDOWS} SELECT algorithm, dataset, win AS "window", round(mean, 6) AS mean, round(std, 6) AS std FROM ss')
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(summary.series_summary(_window_runs(spark, sf_dir)), "mean", "std")


@query(f"WITH {WINDOWS} SELECT dataset, algorithm, win AS \"window\", round(mean, 6) AS mean, round(mean - std, 6) AS lo, round(mean + std, 6) AS hi, (dataset = 'd0' AND win IN (3, 7)) AS is_drift FROM ss")
def plot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    drifts = spark.createDataFrame([("d0", 3), ("d0", 7)], "dataset string, drift int")
    return _rounded(summary.plot_series(summary.series_summary(_window_runs(spark, sf_dir)), drifts), "mean", "lo", "hi")


# State machines ------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {SEQ}, {state_sql.detector('s', 'event_type', 'value')} SELECT event_type, seq, {state_sql.SNAPSHOT} FROM det WHERE seq > 0")
def change_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drivers.detect(_events(spark, sf_dir), "event_type", "seq", "value")
    return _rounded(out, "ema_mean", "U_t", "L_t", "abruptness_score", "acceleration", "lambda_current", "slope_thresh_current")


@query(f"WITH RECURSIVE {SEQ}, {state_sql.detector('s', 'event_type', 'value')} SELECT event_type AS stream, seq, fired, direction, round(up, 6) AS \"U_t\", round(low, 6) AS \"L_t\" FROM det WHERE seq > 0")
def detect_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change detector as a table function of SQL."""
    drivers.register(spark)
    view = f"numbers_{uuid.uuid4().hex}"
    _events(spark, sf_dir).select(F.col("event_type").alias("stream"), "seq", F.col("value").alias("x")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT stream, seq, fired, direction, round(U_t, 6) AS U_t, round(L_t, 6) AS L_t FROM detect_change(TABLE(SELECT * FROM {view}) PARTITION BY stream ORDER BY seq)")


def _clusterer(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(drivers.cluster(_planar(spark, sf_dir), name), "surprise", "score", "acceleration")

    key = {"tight": "stream_cluster", "tight_drift": "stream_cluster_drift"}.get(name, name)
    QUERIES[key] = run
    if sql := {"dbstream": state_sql.dbstream, "denstream": state_sql.denstream, "adaptive_radius": state_sql.adaptive_radius, "windowed_dbscan": state_sql.windowed_dbscan}.get(name):
        ORACLES[key] = f"WITH RECURSIVE {PLANAR}, {sql('p')}"


PLANAR = "p AS (SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS seq, value / 600 AS x, hour(ts) / 24.0::DOUBLE AS y FROM events)"
for _name in drivers.ALGORITHMS:
    _clusterer(_name)


@query()
def micro_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drivers.micro_clusters(_planar(spark, sf_dir), "tight")


def _source(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = benchmark.points(spark, [name], [42], 5000)
        return own.select("stream", "seed", "idx", *(F.round(F.col("x")[d], 9).alias(f"x{d}") for d in (0, 1)), "y")

    QUERIES[f"source_{name.lower()}"] = run
    ORACLES[f"source_{name.lower()}"] = stream_sql.stream(name, 42, 5000)


for _name in streams.DATASETS:
    _source(_name)


def _drifts_sql(n: int) -> str:
    quarters, thirds = [n // 4 * i for i in (1, 2, 3)], [n // 3, 2 * n // 3]
    own = {"AbruptSplit": [n // 2], "AbruptMerge": [n // 2], "SpeedVariant": thirds, "DimensionShift": [n // 4, n // 2, 3 * n // 4]}
    rows = ", ".join(f"('{k}', {i}, {d})" for k in streams.DATASETS for i, d in enumerate(own.get(k, quarters)))
    return f"SELECT stream, 42::INT AS seed, drift_ord::INT AS drift_ord, drift_idx::BIGINT AS drift_idx FROM (VALUES {rows}) AS v(stream, drift_ord, drift_idx)"


@query(_drifts_sql(5000))
def source_drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.points(spark, list(streams.DATASETS), [42], 5000, "drifts")


_SCALARS = ", ".join(f"('smoke', {i}, '{s}', {x!r}::DOUBLE)" for i, s, x in streams.scalar_stream())


@query(f"WITH RECURSIVE smoke AS (SELECT stream, seq::BIGINT AS seq, segment, x FROM (VALUES {_SCALARS}) AS v(stream, seq, segment, x)), {state_sql.detector('smoke', 'stream', 'x')}, f AS (SELECT segment FROM det JOIN smoke USING (stream, seq) WHERE fired) SELECT count(*) FILTER (segment LIKE '%ABRUPT%') AS abrupt, count(*) FILTER (segment LIKE '%gradual%') AS gradual, count(*) FILTER (segment NOT LIKE '%ABRUPT%' AND segment NOT LIKE '%gradual%') AS false_alarms FROM f")
def scalar_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("smoke", i, s, x) for i, s, x in streams.scalar_stream()], "stream string, seq long, segment string, x double")
    fires = drivers.detect(rows).where("fired").join(rows.select("stream", "seq", "segment"), ["stream", "seq"])
    return summary.fire_report(fires)


def _names(values: list) -> str:
    return ", ".join(f"({v!r})" for v in values)


@query(f"SELECT algorithm, dataset, seed::INT AS seed FROM (VALUES {_names(list(drivers.ALGORITHMS))}) AS a(algorithm), (VALUES {_names(streams.ALL)}) AS d(dataset), (VALUES {_names(list(streams.SEEDS))}) AS s(seed)")
def bench_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.jobs(spark, list(drivers.ALGORITHMS), streams.ALL, streams.SEEDS)


@query()
def bench_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.detail_table(benchmark.runs(spark, list(drivers.ALGORITHMS), streams.ALL, streams.SEEDS, 5000))


@query()
def bench_matrix_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.runs(spark, ["tight", "tight_drift"], streams.FULL, streams.SEEDS, 5000, strict=True).drop("quality_series", "drift_windows", "coverage_mean")
