"""Rows told apart by what they hold, and taken out of a table by such keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytemill.llm.text import fraction, whole

#: Keys of rows that are broadcast at most (about 100 bytes each); more of them are joined by shuffling.
FEW = 200_000
KEY = "_row_key"


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of id and text: only rows that repeat both share one. A null text counts as empty."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), whole(text))))


def small(table: DataFrame, most: int | None = None) -> DataFrame:
    """The stored table, marked for broadcast if it has few rows."""
    most = FEW if most is None else most
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def one_of_equals(packed: DataFrame, key: str, row: str) -> DataFrame:
    """One row struct for each key: rows of a key are reduced inside each task before they move."""
    return packed.groupBy(key).agg(F.min_by(row, F.xxhash64(row)).alias(row))


def drawn(docs: DataFrame, seed: str, share: Column) -> DataFrame:
    """About ``share`` of the rows (doc_id, text, ...), each id and text once, with their place ``_u`` in [0, 1).

    Rows that repeat an id and a text have one place, so however many there are, one of them is drawn at most.
    """
    place = fraction(seed, F.hex(row_key(F.col("doc_id"), F.col("text")))) / share
    return docs.withColumn("_u", place).filter("_u < 1").dropDuplicates(["_u"])
