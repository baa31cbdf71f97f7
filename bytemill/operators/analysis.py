"""Analyses of byte content: histograms, entropy, classes, n-grams, contexts. A blob is a row (blob_id, content).

A null content gives null results; an empty one has entropy 0 and no distinct bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytemill.functions import codecs
from bytemill.functions import columns as C
from bytemill.functions import grams as G
from bytemill.plans.scratch import short_batches

#: Bytes of a blob that its analysis looks at.
SAMPLED = 65536
_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[[9, 10, 13]] = True
_PRINTABLE[32:127] = True


def blobs(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """Rows (blob_id, content) from any text or binary column."""
    return df.select(F.col(id_col).alias("blob_id"), F.col(content).cast("binary").alias("content"))


def _histogram(batch: pa.RecordBatch, column: int = 1) -> np.ndarray:
    out = np.zeros((batch.num_rows, 256), np.int64)
    for k, b in enumerate(batch.column(column)):
        raw = b.as_buffer() if b.is_valid else None
        if raw is not None and raw.size:
            out[k] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return out


def byte_histogram(df: DataFrame, sample: int | None = SAMPLED) -> DataFrame:
    """(blob_id, byte, cnt) of the bytes that occur, in all of a blob if ``sample`` is None. A blob is one row, so no shuffle is needed."""

    def run(batches):
        for batch in batches:
            counts = _histogram(batch)
            row, byte = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(byte.astype(np.int32)), pa.array(counts[row, byte])], ["blob_id", "byte", "cnt"])

    kind = dict(df.dtypes)["blob_id"]
    content = F.col("content") if sample is None else F.substring("content", 1, sample)
    return df.select("blob_id", content).mapInArrow(run, f"blob_id {kind}, byte int, cnt long")


def measures(content: pa.Array) -> pa.Array:
    """Struct (entropy, distinct, printable) of each content, null where it is."""
    n = _histogram(pa.RecordBatch.from_arrays([content], ["c"]), 0)
    total = n.sum(1)
    p = n / np.maximum(total, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1) + 0.0
    cols = [pa.array(entropy), pa.array((n > 0).sum(1).astype(np.int32)), pa.array(n[:, _PRINTABLE].sum(1) / np.maximum(total, 1))]
    return pa.StructArray.from_arrays(cols, names=["entropy", "distinct", "printable"], mask=content.is_null())


def analyze(df: DataFrame, sample: int | None = SAMPLED) -> DataFrame:
    """One row a blob, by its first ``sample`` bytes (None: all): length, entropy, distinct, printable, class, stages, predicted_ratio."""

    @F.arrow_udf("struct<entropy: double, distinct: int, printable: double>")
    def measure(content: pa.Array) -> pa.Array:
        return measures(content)

    looked = F.col("content") if sample is None else F.substring("content", 1, sample)
    out = df.select("blob_id", F.octet_length("content").cast("long").alias("length"), measure(looked).alias("m"))
    out = out.select("blob_id", "length", "m.*")
    out = out.withColumn("class", F.when(F.col("entropy").isNotNull(), C.content_class(F.col("printable"), F.col("entropy"), F.col("distinct"))))
    return out.withColumns({"stages": C.stage_mask(F.col("class"), F.col("distinct"), F.col("length")), "predicted_ratio": C.predicted_ratio(F.col("entropy"))})


def top_bytes(histogram: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent bytes of each blob, with rank; ties by byte."""
    rank = F.row_number().over(Window.partitionBy("blob_id").orderBy(F.desc("cnt"), "byte"))
    return histogram.withColumn("rank", rank).filter(F.col("rank") <= k)


def escape_byte(histogram: DataFrame) -> DataFrame:
    """(blob_id, escape): the least frequent byte, absent ones counting 0, the first of equals."""
    seen = F.collect_list(F.struct("cnt", "byte"))
    absent = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(255)), F.transform(seen, lambda s: s["byte"])))
    return histogram.groupBy("blob_id").agg(F.coalesce(absent, F.array_min(seen)["byte"]).alias("escape"))


def symbol_stats(histogram: DataFrame) -> DataFrame:
    """(blob_id, byte, cnt, below): counts with the sum of those of smaller bytes."""
    w = Window.partitionBy("blob_id").orderBy("byte").rowsBetween(Window.unboundedPreceding, -1)
    return histogram.withColumn("below", F.coalesce(F.sum("cnt").over(w), F.lit(0)))


def rounded_frequencies(histogram: DataFrame, scale: int = 4096) -> DataFrame:
    """(blob_id, byte, freq): counts scaled to sum near ``scale``, before the fix-up."""
    total = F.sum("cnt").over(Window.partitionBy("blob_id"))
    freq = F.greatest(F.lit(1), F.floor((F.col("cnt") * scale + F.floor(total / 2)) / total))
    return histogram.select("blob_id", "byte", freq.cast("long").alias("freq"))


def context_counts(df: DataFrame) -> DataFrame:
    """(blob_id, prev, cur, cnt): how often a byte follows another; 0 comes before the first."""

    def run(batches):
        for batch in batches:
            for one, b in zip(batch.column(0), batch.column(1), strict=True):
                if not b.is_valid or not (raw := b.as_buffer()).size:
                    continue
                cur = np.frombuffer(raw, np.uint8).astype(np.int32)
                prev = np.concatenate([[0], cur[:-1]])
                pair, n = np.unique(prev * 256 + cur, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one.as_py()] * len(pair), batch.column(0).type), pa.array((pair >> 8).astype(np.int32)), pa.array((pair & 255).astype(np.int32)), pa.array(n)], ["blob_id", "prev", "cur", "cnt"])

    kind = dict(df.dtypes)["blob_id"]
    return df.select("blob_id", "content").mapInArrow(run, f"blob_id {kind}, prev int, cur int, cnt long")


def ngrams(df: DataFrame, least: int = 2, most: int = 8, k: int | None = None) -> DataFrame:
    """(pattern, n, freq) of all strings of ``least`` to ``most`` bytes (2 to 8) over all blobs; with ``k`` of those that ``best_patterns`` may choose.

    A task counts windows of ``most`` bytes in numbers and hands them on in compressed blocks by bucket; a bucket has all
    windows with the same first bytes, so the strings are counted where it is merged. It holds its distinct windows.
    """
    if not 2 <= least <= most <= 8:
        raise ValueError("strings of 2 to 8 bytes")
    short_batches(df.sparkSession)
    blocks = df.select("content").mapInArrow(lambda batches: G.deal(batches, least, most), "bucket int, raw int, block binary")
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: G.count(batches, least, most, k), "pattern binary, n int, freq long")


def best_patterns(grams: DataFrame, k: int = codecs.MOST_PATTERNS) -> DataFrame:
    """(code, pattern, freq, savings): the patterns that save most; ties: longer first, then by bytes."""
    scored = grams.filter("freq >= 4 and n > 2").withColumn("savings", F.col("freq") * (F.col("n") - 2))
    top = scored.orderBy(F.desc("savings"), F.desc("n"), "pattern").limit(k)  # k rows at most from here on
    code = F.row_number().over(Window.orderBy(F.desc("savings"), F.desc("n"), "pattern")) - 1
    return top.select(code.cast("int").alias("code"), "pattern", "freq", "savings")


def element_sizes(df: DataFrame) -> DataFrame:
    """(blob_id, by_histogram, by_planes): the element size that never fires, and the one that does."""

    @F.arrow_udf("int")
    def planes(content: pa.Array) -> pa.Array:
        return pa.array([codecs.element_size_by_planes(b.as_py()) if b.is_valid else None for b in content], pa.int32())

    by_histogram = F.when(F.col("content").isNotNull(), 1)
    return df.select("blob_id", by_histogram.alias("by_histogram"), planes("content").alias("by_planes"))
