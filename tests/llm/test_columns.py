"""Columns of any name pass unchanged through every operator and stage that carries them."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluvion.llm import bpe, langid, quality, scratch, secrets, substring, topk, toxicity

NAMES = ["a.b", "tick`s", "__chunk", "__words", "__removed", "__spans", "__quality", "words_before", "words_removed", "secret_spans", "quality_score", "task", "node", "c0", "chunk", "spans"]
WORDS = [f"w{k}" for k in range(80)]
TEXTS = ["  a clean line\n\twith spaces  \n", " ".join(WORDS), "new\n" + " ".join(WORDS) + "\nend  ", "password = abcdefghijkl1234 stays", None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, len(t or ""), *(f"{n}-{k}" for n in NAMES)) for k, t in enumerate(TEXTS)]
    kinds = ["doc_id long", "text string", "n_chars long", *(f"{scratch.quoted(n)} string" for n in NAMES)]
    return spark.createDataFrame(rows, ", ".join(kinds)).repartition(2)


def foreign(rows, names=NAMES):
    return {r["doc_id"]: [r[n] for n in names] for r in rows}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(k, k % 2, 0) for k in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns(spark, docs, sf_dir, stage):
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, docs, sf_dir)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = got.collect()
    assert len(rows) > 1
    assert foreign(rows).items() <= foreign(docs.collect()).items()
    here = {r["doc_id"]: (r["text"], r["n_chars"]) for r in rows}
    if name != "quality":
        assert here[0] == (TEXTS[0], len(TEXTS[0]))  # a clean text as it was
    if name == "repeats":
        assert here[2][0] == "new\nend"
    if name == "secrets":
        assert here[3][0] == f"{corpus_pipeline.REDACTED} stays"


def test_operators_keep_columns(docs):
    path, want = P.path("byte_bpe_50k.tiktoken"), foreign(docs.collect())
    others = [n for n in NAMES if n != "spans"]
    assert foreign(secrets.scan(docs, path, P.PATTERN).collect(), others) == {k: [x for x, n in zip(v, NAMES) if n != "spans"] for k, v in want.items()}
    assert foreign(substring.dedup(docs).collect()) == want
    empty = quality.fit(docs.select("text").toArrow().column(0), [0] * 6)
    assert foreign(quality.score(docs, empty).collect()) == want
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    assert foreign(toxicity.score(docs, toxicity.train(docs.select("doc_id", "text"), labels)).collect()) == want
    learned = docs.select("doc_id", "text", F.lit("xx").alias("lang"))
    assert foreign(langid.predict(docs, langid.train(learned)).collect()) == want
    coded = bpe.encode(docs, path, P.PATTERN).join(docs.drop("text", "n_chars"), "doc_id")
    assert foreign(bpe.decode(coded, path, P.PATTERN).collect()) == want


def test_search_with_scores_beyond_longs(spark):
    rows = [(0, [1e12, 0.0]), (1, [1e12, 1.0]), (2, [2e12, 0.0]), (3, [0.5, 0.25]), (4, [-1e12, 0.0]), (5, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.where("vec_id in (0, 3)"), k=5).orderBy("query_id", "rank").collect()
    big = (1 << 63) - 1
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 0] == [(5, big), (2, big), (1, big), (3, 512 * 1024 * 10**12), (4, -big - 1)]
    mine = [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 3]
    assert mine[0] == (5, big) and mine[1:] == [(2, 2 * 512 * 1024 * 10**12), (1, 512 * 1024 * 10**12 + 256 * 1024), (0, 512 * 1024 * 10**12), (4, -512 * 1024 * 10**12)]


def test_scratch_of_another_application_stays(spark):
    other = f"{scratch.root(spark)}/fluvion/other-application/table"
    spark.range(3).write.parquet(other)
    scratch.keep(spark.range(2), "mine")
    scratch.drop_all(spark)
    assert spark.read.parquet(other).count() == 3
