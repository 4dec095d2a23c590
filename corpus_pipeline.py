"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvion.llm import minhash, packing, quality, scratch, secrets, substring

#: Documents that score below this are rejected.
QUALITY_LEAST = 0.3
#: What stands in the text in place of a secret.
REDACTED = "[SECRET]"


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts score as the model's bias, whatever it decides; rows with a null id
    are scored like others but never learned from; repeated rows and ties are decided alike.
    Texts of any length are scored whole. Extra columns of any name pass unchanged.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = scratch.free_name(docs, "quality_score")
    scored = quality.score(docs, model, keep_text=True, out_col=score)
    return _columns(scored.where(F.col(score) >= QUALITY_LEAST), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies. Of rows
    that repeat its id and text one stays, whichever comes first if they differ in other columns.

    Null and empty texts are nobody's copies; rows with a null id stay as they are. An id on
    rows with several texts is one document, which stays or goes with all of them. Texts of
    any length are compared whole. Extra columns of any name pass unchanged.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    keep = found.where("kept").select("doc_id").distinct()
    named = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _columns(named.unionByName(docs.where(F.col("doc_id").isNull())), docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller document has are cut out; documents of which
    nothing is left go. The others keep their lines and spaces, but for those at the two ends
    of a text that lost words.

    Null texts stay null and empty ones empty. Rows with a null id stay whole, and nothing is
    cut because of them. Rows of one id don't cut each other. Texts of any length are read whole.
    n_chars follows the text; extra columns of any name pass unchanged.
    """
    words, removed = scratch.free_name(docs, "words_before"), scratch.free_name(docs, "words_removed")
    cut = substring.dedup(docs, layout=True, counts=(words, removed))
    gone = (F.col(words) > 0) & (F.col(removed) == F.col(words))
    return _counted(cut.where(~gone), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark.

    Null texts stay null. Null ids, repeated rows and ties pass through. Texts of any length
    are read whole. n_chars follows the text; extra columns of any name pass unchanged.
    """
    clean = secrets.scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, redact=REDACTED, spans_col=scratch.free_name(docs, "secret_spans"))
    return _counted(clean, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and their place in sequences of 1024 tokens.

    A null or empty text is one piece of one token. Null ids and repeated rows are documents
    of their own; equal lengths may change places. Texts of any length are cut. Extra columns
    are not read.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def _counted(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars by the text that there is now."""
    kinds = dict(docs.dtypes)
    if "n_chars" in kinds:
        found = found.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return _columns(found, docs)


def _columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """What ``docs`` has, in its order, whatever the names."""
    return found.select(*(F.col(scratch.quoted(c)) for c in docs.columns))


STAGES = [
    ("quality", filter_quality),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
