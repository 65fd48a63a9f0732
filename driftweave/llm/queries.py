"""The queries of this subpackage, with SQL for DuckDB where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, htmltext, idstore, maxscore, mixing, nndescent, secretscan, sentencepieces, tokencounts, toxicity
from .common import settled, shared_dir, table, vocabulary


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepieces.encode(docs, model).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), sentencepieces.ids_sha256().alias("ids_sha256"))
    decoded = sentencepieces.decode(encoded, model)
    return settled(decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")), "op2")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))
    counts = [secretscan.count_kind(F.col("spans"), k).alias(f"n_{x}") for k, x in enumerate(secretscan.KINDS)]
    base = secretscan.spans_text(F.col("spans"), (0, 1, 2))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secretscan.spans_text(F.col("spans")).alias("spans"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantized(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op5_vector_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.classes(table(spark, sf_dir, "embeddings"), 0.98)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), seed=1, power=0.5).select("doc_id", "copy", "order_key", "source", "n_chars", "text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencounts.count_tokens(docs, vocabulary("piece_bpe_32k.model"))
    return settled(counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit")), "op7")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = settled(toxicity.score(docs.select("doc_id", "lang", "text"), model), "op8")
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= toxicity.limit(model, F.col("lang"))).alias("over_language_limit"),
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bagminhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_rows", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op10_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/idstore-{uuid.uuid4().hex}"
    idstore.write_ids(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return idstore.read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "verified")


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secrets": op3_secrets,
    "op4_top_k": op4_top_k,
    "op5_vector_classes": op5_vector_classes,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_content_store": op10_content_store,
}

ORACLES: dict[str, str] = {
    "op4_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        pairs AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM pairs)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op5_vector_classes": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
        least AS (SELECT u, min(v) AS lo FROM reach GROUP BY u),
        degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(lo, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(lo, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN least ON least.u = e.vec_id LEFT JOIN degree ON degree.u = e.vec_id
    """,
    "op6_mixing": """
        WITH RECURSIVE own AS (SELECT source, coalesce(sum(n_chars), 0)::DOUBLE AS own FROM documents GROUP BY source),
        goal AS (SELECT source, own, CASE WHEN own > 0 THEN pow(own, 0.5) ELSE 0 END AS goal FROM own),
        rate AS (SELECT source, round(CASE WHEN own > 0 THEN goal / sum(goal) OVER () * sum(own) OVER () / own ELSE 0 END, 9) AS rate FROM goal),
        part AS (SELECT source, greatest(1, ceil(rate / 16.0))::INT AS parts, rate / greatest(1, ceil(rate / 16.0)) AS lam FROM rate),
        cdf AS (
            SELECT source, parts, lam, 0 AS k, exp(-lam) AS p, exp(-lam) AS c FROM part
            UNION ALL
            SELECT source, parts, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) FROM cdf WHERE k < 95
        ),
        drawn AS (
            SELECT d.doc_id, d.source, ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':1:' || j::VARCHAR), 1, 13))::BIGINT / pow(2.0, 52) AS u, j
            FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN part ON d.source IS NOT DISTINCT FROM part.source, generate_series(1, part.parts) AS s(j)
        ),
        counts AS (
            SELECT n.doc_id, n.source, sum(n.k) AS n
            FROM (SELECT doc_id, drawn.source, j, count(cdf.k) AS k FROM drawn LEFT JOIN cdf ON drawn.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u GROUP BY ALL) n
            GROUP BY ALL
        )
        SELECT d.doc_id, copy, md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR || ':order1') AS order_key, d.source, d.n_chars, d.text
        FROM documents d JOIN counts c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.source IS NOT DISTINCT FROM c.source, generate_series(0, c.n::BIGINT - 1) AS g(copy)
    """,
}
