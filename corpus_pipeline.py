"""A corpus pipeline: toxic documents go, one of each group of near copies stays, secrets are masked, sources are mixed, and the rest is tokenized.

Each stage takes whole texts of any length and an empty table (which stays empty), and but for the last returns the columns
that it got, extra ones of any name too. Results that Python makes are written before they are returned, in small batches, as
stages share their workers' memory. What a stage does with null texts, repeated rows and ties stands in its docstring.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftweave.llm import bagminhash, mixing, secretscan, sentencepieces, toxicity
from driftweave.llm.common import removed, settled, shared_dir, table, vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's limit go. Null and empty texts stay; each of repeated rows has the same fate."""
    return settled(toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), "clean")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id stays, one row of repeated rows. Texts without words all stay."""
    return bagminhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes. Null texts stay null, and n_chars counts the new texts."""
    return settled(secretscan.redact(docs), "redacted")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's rate draws it, in a global shuffle. A null source is one of its own; rows with
    one id are drawn alike; null ids share one draw."""
    return mixing.mix(docs, seed=1, power=0.5, marks=False)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the text decoded from them, for each row; null texts are empty."""
    model = vocabulary("piece_bpe_32k.model")
    encoded = sentencepieces.encode(docs.select("doc_id", "text"), model)
    encoded = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), sentencepieces.ids_sha256().alias("ids_sha256"))
    decoded = sentencepieces.decode(encoded, model)
    return settled(decoded.select("doc_id", "n_tokens", "ids", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")), "tokens")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: SQL has no classifier, signatures or tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    import uuid

    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        path = os.path.join(base, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)  # what the stage after the next one reads is written
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
