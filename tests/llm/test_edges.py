"""Every operator and stage on clashing columns, empty tables, repeated rows, nulls and long texts, and without a trace in the session."""

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from driftweave.llm import bagminhash, htmltext, idstore, maxscore, mixing, nndescent, secretscan, sentencepieces, tokencounts, toxicity  # noqa: E402
from driftweave.plans import storage  # noqa: E402
from test_text_operators import SCHEMA, toxic_rows  # noqa: E402

PIECES, BYTES = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
#: Names that operators use inside, or once did, and ones that are common.
CLASHES = (
    "_id _own _keep _hash _n _rate _text_is_null _toxicity _0 _1 id ids key node root sig bands band hash text_hash class_id class_root class_rows gone_id gone_hash own_id own_hash stays found tested spans "
    "rate rate_source n copy order_key score bits start end kind row file place data chunks sizes n_tokens n_bytes vec cos u v k r t a b label_ block blocks html url embedding_ query_id rank vec_id_ name size weight"
).split()
TEXTS = ["a b c d e f g", "a b c d e f g", None, "", "password = hunter22xyz and more words", "word " * 60_000, "x" * 300_000, "漢字" * 50_000, "one two three four five six", "  "]


def frame(spark, clashes=True, texts=TEXTS):
    rows = [(i // 2 * 2 if i < 2 else i, t, "en" if i % 3 else None, f"s{i % 2}" if i != 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += rows[-2:]  # repeated rows
    df = spark.createDataFrame(rows if texts else [], SCHEMA)
    return df.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASHES)) if clashes else df


@pytest.fixture(scope="module")
def model():
    rows = toxic_rows(120)
    return toxicity.train([r[1] for r in rows], [r[5] for r in rows])


def vectors(df):
    return df.select(F.col("doc_id").alias("vec_id"), F.array((F.col("doc_id") % 3 + 1).cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.lit(1).alias("label"), *(F.col(c) for c in df.columns if c not in ("doc_id", "vec_id", "embedding", "label")))


OPERATORS = {
    "extract": lambda df, m, p: htmltext.extract(df.drop("html").withColumnRenamed("text", "html").withColumn("text", F.lit("clash")), page_id="doc_id", url="source"),
    "encode": lambda df, m, p: sentencepieces.encode(df, PIECES),
    "decode": lambda df, m, p: sentencepieces.decode(sentencepieces.encode(df, PIECES), PIECES),
    "scan": lambda df, m, p: secretscan.scan(df),
    "redact": lambda df, m, p: secretscan.redact(df),
    "top_k": lambda df, m, p: maxscore.top_k(maxscore.quantized(vectors(df)), maxscore.quantized(vectors(df)), 1000),
    "classes": lambda df, m, p: nndescent.classes(vectors(df)),
    "mix": lambda df, m, p: mixing.mix(df, weights={"s0": 1.0, "s1": 1.0}, total=0.0001),
    "mix whole": lambda df, m, p: mixing.mix(df, marks=False),
    "count_tokens": lambda df, m, p: tokencounts.count_tokens(df, PIECES),
    "score": lambda df, m, p: toxicity.score(df, m),
    "keep_clean": lambda df, m, p: toxicity.keep_clean(df, m),
    "near classes": lambda df, m, p: bagminhash.classes(df),
    "keep_one": lambda df, m, p: bagminhash.keep_one(df),
    "store": lambda df, m, p: (idstore.write_ids(df, p, BYTES), idstore.read_digests(df.sparkSession, p))[1],
}
#: What returns the input's columns as they are.
SAME_COLUMNS = ("redact", "mix whole", "keep_clean", "keep_one")
#: What takes many Spark jobs is not run a second time without clashing columns.
SLOW = ("classes", "near classes", "keep_one")
#: Rows out for all rows in, where every row gives one.
ONE_EACH = ("extract", "encode", "decode", "scan", "redact", "classes", "count_tokens", "score", "keep_clean", "near classes", "store")


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_nulls_and_repeated_rows(spark, tmp_path, model, name):
    df = frame(spark)
    before = dict(spark.sparkContext.getConf().getAll()), {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    out = OPERATORS[name](df, model, f"file://{tmp_path}/a")
    got = out.collect()
    if name in ONE_EACH:
        assert len(got) == df.count()
    if name == "top_k":
        others = {i: sum(j != i for j in ids) for ids in [[r["doc_id"] for r in df.select("doc_id").collect()]] for i in ids}
        assert len(got) == sum(others[r["doc_id"]] for r in df.select("doc_id").collect())
    if name in SAME_COLUMNS:
        assert out.columns == df.columns and all(r["_id"] == f"_id:{r['doc_id']}" == r["spans"].replace("spans", "_id") for r in got)
    if name == "keep_one":
        assert sorted(r["doc_id"] for r in got) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    if name not in SLOW:
        plain = OPERATORS[name](frame(spark, clashes=False), model, f"file://{tmp_path}/b").collect()
        common = [c for c in out.columns if c in (plain[0].asDict() if plain else ()) and c not in CLASHES and c != "text"]
        key = lambda r: tuple(str(r[c]) for c in common)
        assert sorted(map(key, got)) == sorted(map(key, plain))
    after = dict(spark.sparkContext.getConf().getAll()), {k: spark.conf.get(k) for k in before[1]}
    assert after == before


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, tmp_path, model, name):
    out = OPERATORS[name](frame(spark, texts=[]), model, f"file://{tmp_path}/none")
    assert out.count() == 0 and len(out.columns) > 0


def test_stages_with_clashing_columns_and_of_nothing(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = toxic_rows(200)
    labels = spark.createDataFrame([(5000 + r[0], 1, r[5]) for r in rows], "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(5000 + r[0], *r[1:5]) for r in rows], SCHEMA)
    for name, docs in (("all", frame(spark).unionByName(more, allowMissingColumns=True)), ("none", frame(spark, texts=[]))):
        sf = f"{tmp_path}/{name}"
        docs.write.parquet(f"{sf}/documents.parquet")
        labels.where(F.lit(name == "all")).write.parquet(f"{sf}/labels.parquet")
        held = spark.read.parquet(f"{sf}/documents.parquet")
        columns = held.columns
        for stage, run in pipeline.STAGES:
            run(spark, held, sf).write.parquet(f"{sf}/out-{stage}")
            held = spark.read.parquet(f"{sf}/out-{stage}")
            assert name == "all" or held.count() == 0
            if stage != pipeline.STAGES[-1][0]:
                assert held.columns == columns
                assert held.where("doc_id < 5000 and not (_id <=> concat('_id:', doc_id) and copy <=> concat('copy:', doc_id))").count() == 0
        assert held.count() > 0 or name == "none"


def test_scores_beyond_a_long_and_ids_that_repeat(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [-3e38, 0.0], 1), (3, [1.0, 1.0], 1), (20, [1.0, 0.0], 1), (20, [0.0, 1.0], 1)]
    own = maxscore.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = [tuple(r) for r in maxscore.top_k(own, own.where("vec_id % 20 = 0"), 3).collect()]
    big = 2**63 - 1
    assert sorted(r for r in got if r[0] == 0) == [(0, 1, 1, big), (0, 2, 20, big), (0, 3, 3, big)] or sorted(r for r in got if r[0] == 0)[0] == (0, 1, 1, big)
    twice = sorted(r for r in got if r[0] == 20)
    assert [r[1] for r in twice] == [1, 1, 2, 2, 3, 3] and all(r[2] != 20 for r in twice)
    assert (20, 1, 0, big) in twice and (20, 1, 1, 64 * 128) in twice


def test_scratch_keeps_results_only(spark):
    import os

    with storage.Scratch(spark) as scratch:
        a = scratch.keep(storage.written(spark.range(3), "kept"))
        b = storage.written(spark.range(3), "gone")
    where = [x._written_at.removeprefix("file://") for x in (a, b)]
    assert [os.path.exists(w) for w in where] == [True, False] and a.count() == 3
    storage.clear(spark)
    assert not os.path.exists(where[0])
