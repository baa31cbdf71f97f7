"""Mixing sources to target weights.

Sizes add up per source, a water level shares the total by weight under a cap of ``MOST`` times each
source's own size, and a document is emitted floor(rate) times, plus once more if its hash, a number in
[0, 1), falls below the fraction of its source's rate. Each document is drawn by itself, so what a source
takes differs from its target by the error of sampling: a standard deviation of sqrt(f * (1 - f)) times
the root of the summed squares of its sizes, where f is the fraction; nothing corrects the draw.

Sources are ranked within ranges of their names, with the counts of the ranges before, and the level is
found by rounds of sums over the table of sources, so neither needs all sources in one task or on the
driver. The rates are broadcast while there are at most ``BROADCAST_SOURCES`` sources and joined with
salted keys beyond that.

Defined cases: a null text has no words; a null source is a source of its own, listed last; a source
without words gets target 0 and rate 0; a null ``doc_id`` is replaced by the text's digest in the hash;
rows that repeat id and text share their draw; very long texts are counted as a whole; an empty table gives
an empty result. Columns that clash with the result's are replaced by ``with_copies`` and pass through
``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytemill.llm.rows import small
from bytemill.llm.text import fraction, n_words, whole
from bytemill.plans.scratch import stage

WEIGHTS = (5, 2, 1)
MOST = 3
BROADCAST_SOURCES = 50_000
SALTS = 64
SEED = "mix-0"
ADDED = ("size", "source_size", "target", "copies", "taken")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """The hash in [0, 1) that decides on a row's extra copy."""
    return fraction(seed, F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(whole(text)))))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows with their size in words and their draw."""
    return docs.drop(*ADDED).withColumns({"size": n_words(F.col("text")), "_draw": draw(F.col("doc_id"), F.col("text"), seed)})


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One stored row per source: source_size and target. Weights go round by code point of the name, null last."""
    spark = docs.sparkSession
    order = F.asc_nulls_last("source")
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = stage(per.repartitionByRange(order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id()), "sources")
    ahead, seen = [], 0
    for r in per.groupBy("_range").count().orderBy("_range").collect():  # a row for each range
        ahead.append((r["_range"], seen))
        seen += r["count"]
    before = spark.createDataFrame(ahead, "_range int, _ahead long")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + F.col("_ahead")
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.join(F.broadcast(before), "_range").select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    per = stage(per, "weights")
    total, all_w = per.agg(F.coalesce(F.sum(F.col("source_size").cast("double")), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(1.0))).first()
    level, full = total / all_w, None
    while True:  # sources that are full give the rest of their share back, until none is above its cap
        above = F.col("cap") < F.lit(level) * F.col("w")
        now = per.filter(above).agg(F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
        if now == full or not now[1]:
            break
        full, level = now, (total - now[0]) / (all_w - now[1])
    return stage(per.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target")), "targets")


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows of ``sized`` with source_size, target, copies and taken; every other column stays."""
    table = targets(docs, weights, most).withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    few = small(table, BROADCAST_SOURCES)
    if few is not table:
        out = docs.join(few, same, "left")
    else:
        salted = docs.withColumn("_salt", F.pmod(F.xxhash64("_draw"), F.lit(SALTS)))
        spread = table.withColumn("_of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = salted.join(spread, same & (F.col("_salt") == F.col("_of")), "left").drop("_salt", "_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("copies", F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("long"))
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop("_source", "_draw")


def mix(docs: DataFrame, **kw) -> DataFrame:
    """Every document as often as the mix takes it, as it came."""
    packed = docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))
    out = with_copies(sized(packed).drop("text"), **kw).filter("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-0:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][k % 3 + 1] AS w, (source_size * 3)::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0.0::DOUBLE))
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0::DOUBLE)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM v) * w) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target, (d.size * (floor(rate)::BIGINT + (d.u < rate - floor(rate))::BIGINT))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
