"""A training-data pipeline over ``documents``: quality, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return the columns of documents, in their order
and whatever they are called: rows travel as one struct beside what a stage adds. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import minhash, packing, quality, secrets, toxicity
from gaugework.llm.common import ensure_checkpoint_dir, table
from gaugework.llm.queries import vocabulary


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null or empty text has the statistics 0 and is judged by these; repeated rows share their fate; labels with a null
    key or value teach nothing, and without labels of both classes all documents have one score.
    """
    return quality.good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject.

    A null or empty text has no window that could save anything, and stays; repeated rows share their fate; a text is
    read whole, however long.
    """
    return toxicity.without(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Rows are decided one by one: different texts under one doc_id all stay if they resemble nothing else, of rows equal
    in doc_id and text one stays, and rows with a null doc_id or a null or empty text stay.
    """
    return minhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts and n_chars counted anew; a null text stays null, its n_chars is null."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; a null or empty text is its end id, repeated rows are documents of their own."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", drop_low_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Classifiers, similarity groups and a tokenizer aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is written in the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
