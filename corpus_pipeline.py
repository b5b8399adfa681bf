"""The corpus pipeline: documents go through five stages, each written as Parquet and read again by the next.

run(spark, sf_dir) applies the stages to the documents table.  Intermediate results are written to the folder that
spark.checkpoint.dir names, so a lost executor re-reads files.  ORACLE_SQL is None: the stages' models are no SQL; the tests
compare run() with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsmith.llm import exact, mixing, ordinal, pieces, simhash
from flowsmith.llm.common import materialize, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal model, fitted on the rated documents of this input, rejects."""
    model = ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.select_documents(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) at random so that sources reach square-root weights, in random order."""
    return mixing.mixed_rows(docs, mixing.tempered_weights(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and the digest of the text decoded from the ids, for each row."""
    back = pieces.encode_documents(docs, decoded=True)
    return back.select("doc_id", "token_ids", F.size("token_ids").cast("bigint").alias("n_tokens"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
