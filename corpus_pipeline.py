"""Documents to packed training sequences, in five written stages.

Each stage reads all that the one before kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.llm import exact_dedup, langid, mixing, packing, queries, simhash
from bytemill.plans.scratch import forget, put_on_path, short_batches, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what a classifier fitted on two thirds of the labelled documents does not reject.

    Null texts, texts without a letter and texts far from all centroids go; with no labelled row all go.
    Rows that repeat go or stay together; columns pass through under any name, score and lang_pred among them.
    """
    put_on_path(spark)
    short_batches(spark)
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"), 3, 1)))
    packed = docs.select("text", F.struct("*").alias("_row"))
    return langid.predict(packed, model).filter("not rejected").select("_row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one row stays, see ``exact_dedup`` for which; null counts as empty."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose fingerprints are linked one row stays, the one of the smallest id; null ids come last."""
    put_on_path(spark)
    short_batches(spark)
    return simhash.near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's rate takes it, none at all included; texts without words are taken alike."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row: its length and its place in a sequence. A null text is the end id alone."""
    put_on_path(spark)
    short_batches(spark)
    return packing.pack_documents(docs, queries.tokenizer())


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("sequences", sequences)]
#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = queries.documents(spark, sf_dir)
    for k, (name, step) in enumerate(STAGES):
        made = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            forget(docs)
        docs = made
    return docs
