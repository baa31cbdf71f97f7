"""Exact dedup with heavy hitters split off.

A digest of the text without white space decides equality. A Misra-Gries sketch (the frequent
items aggregate of Spark SQL) over all digests names at most ``CANDIDATES`` suspects; their exact
counts and winners come from a partially aggregated group-by, and those few rows are broadcast, so
no copy of a frequent text takes part in a shuffle. The winners of all other digests come from a
group-by that is aggregated inside each task first, and are joined back; of those joins, Spark splits
partitions that are skewed. Only digests take part, never texts: ``exact_dedup`` takes rows out by a
broadcast table of the digests that occur more than once while there are at most ``rows.FEW`` of
them, and by shuffling beyond that.

Defined cases: a null text counts as empty; all empty texts are one group; a null ``doc_id`` ranks
after every number; of rows that repeat the winner's ``doc_id`` and text one is kept; very long texts are
hashed as a whole; an empty table gives an empty result. Columns of the input whose names clash with the
result's are replaced by ``exact_groups`` and pass through ``exact_dedup``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytemill.llm.rows import one_of_equals, small
from bytemill.llm.text import BLANKS, whole, without
from bytemill.plans.scratch import forget, stage

#: Most digests that are ever broadcast as frequent (about 100 bytes each).
CANDIDATES = 512
#: Counters of the sketch, over two times the candidates as it asks.
COUNTERS = 4096


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all else with the digest and the length that rank a row."""
    digest = F.sha2(without(whole(F.col("text")), BLANKS).cast("binary"), 256)
    return docs.withColumns({"text_sha256": digest, "_chars": F.char_length(whole(F.col("text"))).cast("long")})


def _order(*last: str):
    return F.struct((-F.col("_chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), *last)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, _chars, text_sha256, _at), stored; _at tells rows apart that are equal in all else."""
    slim = _keyed(docs.select("doc_id", "text")).select("doc_id", "_chars", "text_sha256")
    return stage(slim.withColumn("_at", F.monotonically_increasing_id()), "digests")


def winners(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text_sha256, _n, _best) of the frequent digests, at most CANDIDATES, and of all others that occur twice or more.

    _best.t counts the rows that tie with the winner in digest, length and id.
    """
    found = slim.agg(F.expr(f"approx_top_k(text_sha256, {CANDIDATES}, {COUNTERS})").alias("top"))
    suspects = F.broadcast(found.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256")))

    def best(rows: DataFrame) -> DataFrame:
        same = rows.groupBy("text_sha256", "_chars", "doc_id").agg(F.count(F.lit(1)).alias("t"), F.min("_at").alias("at"))
        return same.groupBy("text_sha256").agg(F.sum("t").alias("_n"), F.min(_order("at", "t")).alias("_best")).filter("_n > 1")

    heavy = stage(best(slim.join(suspects, "text_sha256")), "heavy", few=True)
    return heavy, stage(best(slim.join(F.broadcast(heavy), "text_sha256", "left_anti")), "light")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id`` of every row with keep_id, group_size, kept and text_sha256; texts are left behind."""
    slim = digests(docs)
    heavy, light = winners(slim)
    heavy = F.broadcast(heavy)
    rest = slim.join(heavy, "text_sha256", "left_anti").join(light, "text_sha256", "left")
    every = slim.join(heavy, "text_sha256").unionByName(rest)
    alone = F.col("_n").isNull()
    return every.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_best.id")).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_at") == F.col("_best.at"))).alias("kept"), "text_sha256",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, as they came: copies go where they are read, by what is known of their digests."""
    slim = digests(docs)
    heavy, light = winners(slim)
    packed = _keyed(docs.select("doc_id", "text", F.struct("*").alias("_row"))).drop("text").withColumn("_tied", F.lit(False))
    wins = F.col("_best").isNull() | ((F.col("_chars") == -F.col("_best.c")) & F.col("doc_id").eqNullSafe(F.col("_best.id")))
    for known, table in ((heavy, F.broadcast(heavy)), (light, small(light))):
        if not known.isEmpty():
            packed = packed.join(table.drop("_n"), "text_sha256", "left").filter(wins)
            packed = packed.withColumn("_tied", F.col("_tied") | F.coalesce(F.col("_best.t") > 1, F.lit(False))).drop("_best")
    forget(slim)
    if heavy.unionByName(light).filter("_best.t > 1").isEmpty():
        return packed.select("_row.*")
    one = one_of_equals(packed.filter("_tied"), "text_sha256", "_row")
    return packed.filter("not _tied").select("_row.*").unionByName(one.select("_row.*"))


ORACLE = r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM k
"""
